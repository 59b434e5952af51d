"""MinHash near-duplicate documents.

Many universal-hash minima of each document's five-word shingles, cut into bands; documents that share a band are
candidates; signatures and then the full shingle sets confirm them; connected components group them.

Scale: documents with equal sets are one class from the start, so groups of copies cost one row each. In a bucket,
members are first compared with one pivot, which the bucket's key picks among its members, so that a large group of
near copies meets many pivots over its bands: one row a member. What these links leave in different components meets
inside its bucket (see ``apart``), where no row is made for a pair: rows stay linear in the members even where a
group's documents lie around the limit and aren't linked. Such a bucket of m members that no link joins takes m * m / 2
comparisons of signatures, in units that are bounded in members and in elements of their sets.

A pair at the limit of similarity shares no band with a probability of (1 - 0.75**6)**80, about 2e-7. Six rows a band
keep documents that merely share a passage out of each other's buckets. Signatures are asked before full sets are: they
lose a pair at the limit with 4e-9 (six deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.apart import LEAST_AGREEMENT, joined_parts, keyed, links_apart, open_members
from textloom.llm.rowkeys import row_keyed
from textloom.operators.components import connected_components
from textloom.plans.materialize import materialize

WORDS = 5
BANDS, ROWS = 80, 6
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(1, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
_BAND_SEED = tb.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_PLACES = np.uint64(1) << (8 * np.arange(ROWS, dtype=np.uint64))


def shingle_sets(texts: pa.Array, n_words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle, an empty one none."""
    for _, data, offsets in tb.chunks(texts):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        hashes = tb.identity(data, starts, ends)
        runs = tb.windows(hashes, n_words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n_words:
                yield np.unique(runs[a : b - n_words + 1])
            elif b > a:
                yield tb.windows(hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """8 bits of each minimum of the universal hashes over the set."""
    x = shingles.astype(np.uint32)[None, :]
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, x.shape[1], 256):
        y = _A * x[:, k : k + 256]
        y += _B
        np.minimum(low, y.min(axis=1), out=low)
    low ^= low >> np.uint32(16)
    low *= np.uint32(0x85EBCA6B)
    low ^= low >> np.uint32(13)
    return low.astype(np.uint8)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signs = [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            both = np.array([tb.mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)] + [len(s)], np.uint64)
            keys.append(both.tobytes())
            signs.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["row", "doc_id", "n_shingles", "set_key", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 1024):
            some = batch.slice(part, 1024)
            rows = np.frombuffer(b"".join(some.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
            keys = keyed(tb.mix((rows * _PLACES).sum(axis=2, dtype=np.uint64) ^ _BAND_SEED[None, :]))
            node = np.repeat(some.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).mean(axis=1))], ["a", "b", "agreement"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["node", "full"])


def _elements(full: pa.Scalar) -> np.ndarray:
    """A set as a view of the batch that holds it."""
    return full.values.to_numpy()


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link, with their agreement."""
    one, two = (classes.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    near = pairs.join(one, "a").join(two, "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement, "a long, b long, agreement double").where(F.col("agreement") >= LEAST_AGREEMENT)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    one, two = (sets.select(F.col("node").alias(x), F.col("full").alias(f"set_{x}")) for x in "ab")
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = joined.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.where("100 * both >= 75 * (n - both)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows(row, doc_id, text)`` to ``(row, doc_id, n_shingles, part)``: the least row reachable over links."""
    features = rows.mapInArrow(_features, "row long, doc_id long, n_shingles long, set_key binary, signature binary")
    features = materialize(features, "near-features")
    full = features.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("set_key").agg(F.min("row").alias("node"))
    classes = full.join(reps.select("node"), full.row == F.col("node"), "left_semi").select(F.col("row").alias("node"), "n_shingles", "signature")

    banded = classes.select("node", "signature").mapInArrow(_bands, "key long, node long")
    # Which member is the pivot depends on the key: the least after its bits are flipped by those of the key.
    flipped = F.col("node").bitwiseXOR(F.col("key"))
    buckets = banded.groupBy("key").agg(F.min(flipped).alias("low"), F.max(flipped).alias("high")).where("low <> high")
    members = banded.join(buckets, "key").select("key", "node", F.col("low").bitwiseXOR(F.col("key")).alias("pivot"))
    members = materialize(members, "near-members")

    stars = members.where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    stars = materialize(_similar(stars, classes), "near-stars")
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("agreement", "b")).alias("b"))
    best = best.union(stars.groupBy("b").agg(F.max_by("a", F.struct("agreement", "a")).alias("a")).select("a", "b")).distinct()
    best = materialize(best, "near-best")
    wanted = members.select("node").distinct()
    sets = materialize(rows.join(wanted, rows.row == wanted.node, "left_semi").select("row", "text").mapInArrow(_full_sets, "node long, full array<long>"), "near-sets")
    parts = materialize(connected_components(_confirm(best, sets)), "near-parts")

    # The other pivots of members that the best one left in different components.
    one, two = (parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
    rest = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    rest = materialize(rest.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b"), "near-rest")
    if not rest.isEmpty():
        parts = joined_parts(parts, _confirm(rest, sets))

    still = open_members(members, parts)
    if not still.isEmpty():
        signs = classes.select("node", F.col("n_shingles").alias("n"), F.col("signature").alias("sign"))
        parts = joined_parts(parts, links_apart(still, signs, sets, _elements, 0, BANDS))

    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    placed = features.join(reps, "set_key", "left").select("row", "doc_id", "n_shingles", F.when(linked, F.col("node")).otherwise(F.col("row")).alias("node"))
    return placed.join(parts, "node", "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "node").alias("part"))


def _found(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with row keys, the key's name, and ``(row, doc_id, n_shingles, part, first_id, first_row)`` of the part's
    first row by doc_id, and of repeated ids by key."""
    keyed, key, by_id = row_keyed(docs, "near-docs")
    found = _placed(keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if by_id:
        return keyed, key, found.withColumns({"first_id": F.col("part"), "first_row": F.col("part")})
    found = materialize(found, "near-found")
    firsts = found.groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    return keyed, key, found.join(firsts, "part").select("row", "doc_id", "n_shingles", "part", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_shingles, component_id, kept)``, one row per document.

    ``component_id`` is the smallest doc_id reachable over links of similarity 0.75 or more. A null or empty text, or
    one of white space only, has no shingles and is linked with nothing. Repeated texts share a component. A row without
    a doc_id is linked with nothing: its component is null and it is kept. Rows that share a doc_id are documents of
    their own, each placed by its own text; all rows whose id is that of their component are kept. Other columns are
    ignored, and an empty table gives an empty result.
    """
    _, _, found = _found(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group by doc_id: one row a group, also
    where ids repeat. Rows without a doc_id are linked with nothing and stay."""
    keyed, key, found = _found(docs)
    gone = found.where("row <> first_row").select(F.col("row").alias(key))
    return keyed.join(gone, key, "left_anti").select(docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
#: Links between all documents: too slow in SQL for whole tables; tests compare with brute force.
ORACLES: dict[str, str] = {}
