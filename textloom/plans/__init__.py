"""Helpers that shape plans: materialised steps, bounded broadcasts."""
