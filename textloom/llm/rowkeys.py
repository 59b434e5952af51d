"""A key of its own for every row, so that null and repeated doc_ids are rows like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_keyed(docs: DataFrame, step: str) -> tuple[DataFrame, str, bool]:
    """``docs`` with a long column that no two rows share, the column's name, and whether it is the doc_id.

    The ids are counted first (no other column is read for it). Where none is null and none repeats, the id is the key
    and nothing is written; else the rows are written once with keys, so that later reads find the same ones.
    """
    key = unused("__row", docs.columns)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key, True
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), step), key, False
