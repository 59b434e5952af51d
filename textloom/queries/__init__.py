"""Registered queries, one module for each theme."""

from textloom.queries import corpus, graphs, models, relational, reports, sequences, stores, trees  # noqa: F401
