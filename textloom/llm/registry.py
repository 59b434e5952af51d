"""Queries of this subpackage by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["license_scan", "near_dup", "decontaminate", "quality_rules", "sharding", "quality_model", "language_id", "pieces", "suffix_dedup", "line_dedup", "filter_audit", "merkle", "language_model"]
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    import corpus_pipeline

    out: dict[str, Query] = {"pipeline": corpus_pipeline.run}
    for name in MODULES:
        out |= import_module(f"textloom.llm.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"textloom.llm.{name}").ORACLES
    return out
