"""Keyed state over event logs, in batch and as streams."""
