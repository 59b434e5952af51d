"""How filters act together: for every order of application what each step keeps, removes, finds removed already.

The documents of a part are counted by the set of filters that they fail, once for all, once for the good and once for
the toxic ones. The counts of a part are reshaped to a tensor with an axis of two (pass, fail) for each filter. Every
figure of every step is one contraction of it: along each axis einsum takes pass, fail or all.

Scale: documents become a row of flags and a digest before anything is shuffled. Which of identical texts has the
smallest id is asked of rows that stand for all copies with the same flags and labels, so a group of copies costs as many
rows as it has parts, however large it is. What reaches a contraction is 2 ** filters numbers a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

FILTERS = "ABCDE"
FEW_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
_SYMBOL, _UPPER, _POINT = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_UPPER[0x41:0x5B] = True
_POINT[0x80:0xC0] = False  # bytes that go on with a character
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def _inside(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def text_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
    n, word = np.diff(first), tb.identity(data, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    kinds = np.bincount(row[new], minlength=len(n))
    failed = (n < FEW_WORDS, 100 * kinds < LEAST_DISTINCT * n, 100 * _inside(_UPPER[data], offsets) > MOST_UPPER * _inside(_POINT[data], offsets), _inside(_SYMBOL[data], offsets) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask, digests = [np.zeros(0, np.int32)], []
        for _, data, offsets in tb.chunks(batch.column("text")):
            mask.append(text_failures(data, offsets))
            raw = memoryview(data)
            digests += [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.concatenate(mask), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part that fail just the filters of ``mask`` (bit k: the k-th).

    ``docs(doc_id, text, lang, ...)``; the part is the language, null as the empty string. A null text is an empty one.
    E compares whole texts over all parts: it fails every row with an id above the smallest id of its text. A row
    without an id fails no E and makes none fail; rows that share an id and a text pass or fail together. A document is
    good (toxic) if any label of its id says so; labels without an id are left out. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    flags = rows.mapInArrow(_flags, "doc_id long, part string, mask int, digest binary")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.bool_or(F.coalesce(F.col(c) == 1, F.lit(False))).alias(d) for c, d in (("quality", "good"), ("toxic", "toxic"))))
    marked = flags.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["digest", "part", "mask", "good", "toxic"]
    ids = marked.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    copies = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_free"))
    first = F.min("least").over(Window.partitionBy("digest"))
    spared = F.col("n_free") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    both = copies.withColumn("spared", spared).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("spared").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))).alias("x")).select("part", "good", "toxic", "x.*")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def contract(tensors: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """``tensors`` (k, 2, ..., 2) and what to take along each axis (m, axes, 2) to sums (k, m)."""
    axes = "abcdefghij"[: takes.shape[1]]
    return np.einsum(f"k{axes},{','.join(f'm{x}' for x in axes)}->km", tensors, *takes.transpose(1, 0, 2), optimize="greedy")


def steps(filters: str, counts: np.ndarray) -> Iterator[tuple]:
    """For ``counts`` (3, 2 ** filters) of all, good and toxic documents by mask, each step of each order: ``(order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    n = len(filters)
    tensors = counts.reshape(3, *[2] * n)  # the first axis is the highest bit
    axis = {f: n - 1 - k for k, f in enumerate(filters)}
    told, takes = [], {k: [] for k in ("kept", "removed", "failed", "alone")}
    for order in permutations(filters):
        for step, f in enumerate(order):
            told.append(("".join(order), step + 1, f))
            for name, mine, before, after in (("kept", _PASS, _PASS, _ALL), ("removed", _FAIL, _PASS, _ALL), ("failed", _FAIL, _ALL, _ALL), ("alone", _FAIL, _PASS, _PASS)):
                take = np.empty((n, 2), np.int64)
                for k, g in enumerate(order):
                    take[axis[g]] = mine if k == step else before if k < step else after
                takes[name].append(take)
    kept, removed, failed, alone = (contract(tensors, np.array(t)) for t in takes.values())
    shapley = {f: int(sum(r for r, (_, _, g) in zip(removed[0].tolist(), told, strict=True) if g == f)) for f in filters}
    for k, (order, step, f) in enumerate(told):
        yield order, step, *(int(x) for x in (kept[0, k], removed[0, k], failed[0, k] - removed[0, k], alone[0, k], removed[1, k], removed[2, k])), shapley[f]


_REPORT = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audited(filters: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((3, 1 << len(filters)), np.int64)
        for k, c in enumerate(("n", "good", "toxic")):
            counts[k, table.column("mask").to_numpy()] = table.column(c).to_numpy()
        columns = [pa.array(c, pa.int32() if name == "step" else pa.string() if name == "filter_order" else pa.int64()) for name, c in zip(_REPORT, zip(*steps(filters, counts), strict=True), strict=True)]
        return pa.table([pa.array([table.column("part")[0].as_py()] * len(columns[0]), pa.string()), *columns], ["part", *_REPORT])

    return run


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """``counts(part, mask, n, good, toxic)`` of any filters (up to ten letters, bit k of a mask is the k-th) to one row
    for each part, order and step, zeros included. No parts give no rows."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _REPORT[2:])
    return counts.select("part", "mask", "n", "good", "toxic").groupBy("part").applyInArrow(_audited("".join(filters)), schema)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {
    "op11_filter_audit": r"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
              CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
              + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
              + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
              + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
              + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
              FROM texts d LEFT JOIN marks m ON d.doc_id = m.doc_id),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
    letters AS (SELECT chr(65 + CAST(k AS INTEGER)) AS l, CAST(pow(2, k) AS BIGINT) AS bit FROM range(5) x(k)),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
               WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, l, bit,
              (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE instr(substr(filter_order, 1, CAST(step - 1 AS INTEGER)), p.l) > 0) AS early
              FROM orders, range(1, 6) s(step), letters WHERE substr(filter_order, CAST(step AS INTEGER), 1) = l),
    sums AS (SELECT part, filter_order, step, l,
             coalesce(sum(n) FILTER (mask & (CAST(early AS BIGINT) | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(early AS BIGINT) = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(early AS BIGINT) <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & CAST(early AS BIGINT) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & CAST(early AS BIGINT) = 0), 0) AS toxic_lost
             FROM cells, steps GROUP BY part, filter_order, step, l)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM sums
    """
}
