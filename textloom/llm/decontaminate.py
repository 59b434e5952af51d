"""Benchmark decontamination: a set of normalised test n-grams is broadcast, documents are scanned word window by word
window, hits are verified word for word, and hit spans or whole documents are removed.

The set is broadcast only after its size is checked (``max_windows``, ``max_bytes``). A larger benchmark is joined by
shuffle instead, on 64 bits of each window, and hits are verified by their words too; both ways give the same rows. There
rows are known by a key of their own, written once, so that null and repeated doc_ids don't matter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.plans.materialize import materialize

WORDS = 10
MAX_WINDOWS, MAX_BYTES = 1_000_000, 100_000_000
_SIEVE = 1 << 20


def _spans(data: np.ndarray, offsets: np.ndarray):
    """Word starts, ends, first word of each row and word hashes of lowered bytes."""
    starts, ends, first = tb.words(data, offsets, tb.ALNUM)
    return starts, ends, first, tb.identity(data, starts, ends)


def _item_windows(n_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("item_id").to_pylist(), defaultdict(list)
            for row, data, offsets in tb.chunks(batch.column("text")):
                data = tb.LOWER[data]
                starts, ends, first, hashes = _spans(data, offsets)
                raw = data.tobytes()
                for r in range(len(offsets) - 1):
                    a, b = int(first[r]), int(first[r + 1])
                    size = min(n_words, b - a)
                    if size:
                        keys = tb.windows(hashes[a:b], size).astype(np.int64).tolist()
                        for k, key in enumerate(keys, a):
                            out["item_id"].append(ids[row + r])
                            out["key"].append(key)
                            out["size"].append(size)
                            out["words"].append(b" ".join(raw[s:e] for s, e in zip(starts[k : k + size].tolist(), ends[k : k + size].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["key"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["words"], pa.binary())], ["item_id", "key", "size", "words"])

    return run


def item_windows(benchmark: DataFrame, n_words: int = WORDS) -> DataFrame:
    """``(item_id string, key, size, words)``, one row per item and distinct window; items without id are left out."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    return items.mapInArrow(_item_windows(n_words), "item_id string, key long, size int, words binary").distinct()


class _Index:
    """The broadcast set as flat arrays: rows in order of window size and key, all words in one byte string.

    A window takes its words (some 60 bytes) and 20 bytes more, so the bounds keep it under 200 MB in a worker.
    """

    def __init__(self, rows: list) -> None:
        rows = sorted((r["size"], r["key"] % (1 << 64), bytes(r["words"]), r["item_id"]) for r in rows)
        names = sorted({r[3] for r in rows})
        code = {n: k for k, n in enumerate(names)}
        self.names, self.item = names, np.array([code[r[3]] for r in rows], np.int32)
        self.words, self.at = b"".join(r[2] for r in rows), np.cumsum([0, *(len(r[2]) for r in rows)])
        size_of, keys = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.uint64)
        self.sizes = {}
        for size in np.unique(size_of).tolist():
            mine = np.flatnonzero(size_of == size)
            sieve = np.zeros(_SIEVE, bool)
            sieve[keys[mine] & np.uint64(_SIEVE - 1)] = True
            self.sizes[size] = (keys[mine], sieve, int(mine[0]))

    def items(self, size: int, key: np.uint64, text: bytes) -> list[str]:
        """The items that have a window of these words."""
        keys, _, base = self.sizes[size]
        low, high = base + np.searchsorted(keys, key, "left"), base + np.searchsorted(keys, key, "right")
        return [self.names[self.item[k]] for k in range(low, high) if self.words[self.at[k] : self.at[k + 1]] == text]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, set[str], bytes, np.ndarray, np.ndarray]]:
        """For each text: words, hit words, item ids, its bytes, and the byte starts and ends of its hit words."""
        for _, original, offsets in tb.chunks(texts):
            data = tb.LOWER[original]
            starts, ends, first, hashes = _spans(data, offsets)
            marks, found, raw = np.zeros(len(starts) + 1, np.int64), defaultdict(set), None
            for size, (keys, sieve, _) in self.sizes.items():
                runs = tb.windows(hashes, size)
                maybe = np.flatnonzero(sieve[runs & np.uint64(_SIEVE - 1)])
                place = np.minimum(np.searchsorted(keys, runs[maybe]), len(keys) - 1)
                maybe = maybe[keys[place] == runs[maybe]]
                rows = np.searchsorted(first, maybe, "right") - 1
                inside = maybe + size <= first[rows + 1]
                for k, row in zip(maybe[inside].tolist(), rows[inside].tolist(), strict=True):
                    raw = data.tobytes() if raw is None else raw
                    text = b" ".join(raw[s:e] for s, e in zip(starts[k : k + size].tolist(), ends[k : k + size].tolist(), strict=True))
                    items = self.items(size, runs[k], text)
                    if items:
                        marks[k] += 1
                        marks[k + size] -= 1
                        found[row].update(items)
            hit = np.cumsum(marks[:-1]) > 0
            for row in range(len(offsets) - 1):
                a, b = first[row], first[row + 1]
                mine = hit[a:b]
                at = offsets[row]
                yield int(b - a), int(mine.sum()), found.get(row, set()), original[at : offsets[row + 1]], starts[a:b][mine] - at, ends[a:b][mine] - at


def _bounded_index(windows: DataFrame, max_windows: int, max_bytes: int) -> _Index | None:
    """The index, if the benchmark is within the bounds, else None."""
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    return _Index(windows.collect()) if n <= max_windows and size <= max_bytes else None


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _report(index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, hit, len(items), _digest(items)) for n, hit, items, *_ in index.value.scan(batch.column("text"))]
            n, hit, items, digest = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return run


def _doc_windows(sizes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in tb.chunks(batch.column("text")):
                data = tb.LOWER[data]
                _, _, first, hashes = _spans(data, offsets)
                ids = batch.column("doc_id").slice(row, len(offsets) - 1)
                for size in sizes:
                    runs = tb.windows(hashes, size)
                    k = np.arange(len(runs))
                    rows = np.searchsorted(first, k, "right") - 1
                    ok = k + size <= first[rows + 1]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[ok])), pa.array(runs[ok].astype(np.int64)), pa.array(np.full(ok.sum(), size, np.int32)), pa.array(k[ok] - first[rows[ok]])], ["doc_id", "key", "size", "at"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(tb.words(tb.LOWER[d], o, tb.ALNUM)[2]) for _, d, o in tb.chunks(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "n_words"])


def _hit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, places, out = batch.column("row").to_pylist(), batch.column("places").to_pylist(), defaultdict(list)
        for row, data, offsets in tb.chunks(batch.column("text")):
            data = tb.LOWER[data]
            starts, ends, first = tb.words(data, offsets, tb.ALNUM)
            raw = data.tobytes()
            for r in range(len(offsets) - 1):
                for p in places[row + r]:
                    k = int(first[r]) + p["at"]
                    out["row"].append(ids[row + r])
                    out["at"].append(p["at"])
                    out["size"].append(p["size"])
                    out["words"].append(b" ".join(raw[s:e] for s, e in zip(starts[k : k + p["size"]].tolist(), ends[k : k + p["size"]].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["words"], pa.binary())], ["row", "at", "size", "words"])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, written once so that it stays the same."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "bench-docs")


def _shuffled_hits(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """``(__row, at, size, item_id)`` of the windows of ``keyed(__row, text, ...)`` whose words are those of an item."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]
    found = keyed.select(F.col("__row").alias("doc_id"), "text").mapInArrow(_doc_windows(sizes), "doc_id long, key long, size int, at long")
    maybe = found.join(windows.select("key", "size").distinct(), ["key", "size"], "left_semi")
    places = maybe.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("at", "size")).alias("places"))
    texts = places.join(keyed.select(F.col("__row").alias("row"), "text"), "row").select("row", "text", "places")
    said = texts.mapInArrow(_hit_words, "row long, at long, size int, words binary")
    hits = said.join(windows.select("item_id", "size", "words"), ["size", "words"])
    return materialize(hits.select(F.col("row").alias("__row"), "at", "size", "item_id"), "bench-hits")


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows for a benchmark of any size."""
    keyed = _keyed(docs)
    hits = _shuffled_hits(keyed, windows)
    words = hits.select("__row", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")).distinct().groupBy("__row").agg(F.count("*").alias("n_hit"))
    items = hits.select("__row", "item_id").distinct()
    items = items.groupBy("__row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    counts = keyed.select(F.col("__row").alias("doc_id"), "text").mapInArrow(_word_counts, "doc_id long, n_words long").withColumnRenamed("doc_id", "__row")
    joined = keyed.select("__row", "doc_id").join(counts, "__row").join(words, "__row", "left").join(items, "__row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, n_words: int = WORDS, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs(doc_id, text, ...)``.

    A null or empty text has no words; an item without words, or without an id, matches nothing; repeated items and
    rows count as they stand. Other columns are ignored. An empty benchmark leaves every document clean.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = item_windows(benchmark, n_words)
    index = _bounded_index(windows, max_windows, max_bytes)
    if index is None:
        out = _by_shuffle(docs, materialize(windows, "bench-windows"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = docs.mapInArrow(_report(shared), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _without(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    gone = np.zeros(len(text) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    return text[np.cumsum(gone[:-1]) == 0].tobytes()


def _cleaned(index, remove: str, columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, keep = columns.index("text"), [], []
            for (_, hit, _, text, starts, ends), null in zip(index.value.scan(batch.column(at)), batch.column(at).is_null().to_pylist(), strict=True):
                keep.append(remove == "spans" or not hit)
                texts.append(None if null else _without(text, starts, ends).decode() if hit and remove == "spans" else text.tobytes().decode())
            columns_out = list(batch.columns)
            columns_out[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns_out, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return run


def _cut(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index("text")
            places, nulls, texts = batch.column(len(columns)).to_pylist(), batch.column(at).is_null().to_pylist(), []
            for row, original, offsets in tb.chunks(batch.column(at)):
                starts, ends, first = tb.words(tb.LOWER[original], offsets, tb.ALNUM)
                for r in range(len(offsets) - 1):
                    a, b, here = int(first[r]), int(first[r + 1]), int(offsets[r])
                    hit = np.zeros(b - a, bool)
                    for p in places[row + r] or ():
                        hit[p["at"] : p["at"] + p["size"]] = True
                    text = _without(original[here : offsets[r + 1]], starts[a:b][hit] - here, ends[a:b][hit] - here)
                    texts.append(None if nulls[row + r] else text.decode())
            columns_out = list(batch.columns[: len(columns)])
            columns_out[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns_out, batch.schema.names[: len(columns)])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n_words: int = WORDS, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with its own columns, without contaminated documents or (``remove='spans'``) without their hit words.

    A null text stays as it is; rows with a null or repeated doc_id are judged by their own text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = item_windows(benchmark, n_words)
    index = _bounded_index(windows, max_windows, max_bytes)
    if index is None:
        keyed = _keyed(docs)
        hits = _shuffled_hits(keyed, materialize(windows, "bench-windows"))
        if remove == "documents":
            return keyed.join(hits.select("__row").distinct(), "__row", "left_anti").select(docs.columns)
        places = hits.groupBy("__row").agg(F.collect_set(F.struct("at", "size")).alias("__places"))
        return keyed.join(places, "__row", "left").select(*docs.columns, "__places").mapInArrow(_cut(docs.columns), docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(_cleaned(shared, remove, docs.columns), docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": f"""
    WITH items AS (SELECT item_id, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
    placed AS (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized),
    wanted AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words FROM placed),
    docs AS (SELECT doc_id, coalesce({_SPLIT}, []) AS w FROM documents),
    runs AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
             FROM docs CROSS JOIN (SELECT DISTINCT size FROM wanted) WHERE len(w) >= size),
    hits AS (SELECT r.doc_id, r.i, r.size, t.item_id FROM
             (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words FROM runs) r
             JOIN wanted t ON t.words = r.words AND t.size = r.size),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM
                (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
              (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
           coalesce(c.n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
    """
}
