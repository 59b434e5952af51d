"""Folds by checksum and bounded samples of labelled rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``n``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == rest, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``(doc_id, label)`` for each label, chosen by a hash of the id, alike on every run.

    The share to keep follows from the count of each label, so that few more rows than wanted are ever sorted.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(counts), label).where(chance * F.col("n") < most).withColumn("chance", chance)
    return some.select("doc_id", label, F.row_number().over(_by(label)).alias("rank")).where(F.col("rank") <= most).select("doc_id", label)


def _by(label: str):
    from pyspark.sql import Window

    return Window.partitionBy(label).orderBy("chance", "doc_id")
