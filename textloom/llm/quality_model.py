"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, a batch at a time in numpy. Trees are grown on the driver from a bounded sample of
labelled rows (``MAX_TRAIN`` for each label), then laid out as complete binary trees in flat arrays, so that scoring
is a few vector operations per tree level. Scoring is one narrow pass over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.labelled import bounded_sample, in_fold

MAX_TRAIN = 10_000
CUT = 0.3
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 120, 4, 64, 0.1, 2.0, 1.0

_CLASSES = ["other", "upper", "lower", "digit", "space", "newline", "end", "mark", "symbol", "bar", "high"]
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[[ord(c) for c in ".?:;,"]] = 6
_CLASS[ord("!")] = 7
_CLASS[[ord(c) for c in "#*$%&<>@^~=+_/\\{}[]"]] = 8
_CLASS[ord("|")] = 9
_CLASS[0x80:] = 10
_NEWLINE = np.ones(256, bool)
_NEWLINE[0x0A] = False
FEATURES = [*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_mean", "word_sd", "share_short", "share_long", "distinct_words", "distinct_pairs", "distinct_fives", "log_lines", "line_mean", "distinct_lines", "closed_lines", "words_with_symbol"]


def _distinct(hashes: np.ndarray) -> float:
    return len(np.unique(hashes)) / len(hashes) if len(hashes) else 1.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; zeros (and ones for shares of distinct parts) where there is no text."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, data, offsets in tb.chunks(texts):
        rows, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
        of_row = np.repeat(np.arange(rows), np.diff(offsets))
        kinds = _CLASS[data]
        counts = np.bincount(of_row * len(_CLASSES) + kinds, minlength=rows * len(_CLASSES)).reshape(rows, -1)
        prefix = tb.prefix_hash(data)
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        hashes, lengths = tb.span_hash(prefix, starts, ends), (ends - starts).astype(float)
        pairs, fives = tb.windows(hashes, 2), tb.windows(hashes, 5)
        odd = np.concatenate([[0], np.cumsum((kinds == 8) | (kinds == 9))])
        with_symbol = (odd[ends] - odd[starts]) > 0
        l_starts, l_ends, l_first = tb.words(data, offsets, _NEWLINE)
        l_hashes, closed = tb.span_hash(prefix, l_starts, l_ends), np.isin(data[l_ends - 1], np.frombuffer(b".?:;!", np.uint8)) if len(l_ends) else np.zeros(0, bool)
        x = np.zeros((rows, len(FEATURES)))
        x[:, : len(_CLASSES)] = counts / size[:, None]
        k = len(_CLASSES)
        for r in range(rows):
            a, b, c, d = first[r], first[r + 1], l_first[r], l_first[r + 1]
            w = lengths[a:b]
            some = len(w) > 0
            x[r, k:] = (
                np.log1p(offsets[r + 1] - offsets[r]),
                np.log1p(len(w)),
                w.mean() if some else 0,
                w.std() if some else 0,
                (w <= 3).mean() if some else 0,
                (w >= 15).mean() if some else 0,
                _distinct(hashes[a:b]),
                _distinct(pairs[a : max(a, b - 1)]),
                _distinct(fives[a : max(a, b - 4)]),
                np.log1p(d - c),
                (l_ends[c:d] - l_starts[c:d]).mean() if d > c else 0,
                _distinct(l_hashes[c:d]),
                closed[c:d].mean() if d > c else 0,
                with_symbol[a:b].mean() if some else 0,
            )
        out.append(x)
    return np.concatenate(out)


class Trees:
    """Boosted trees in flat arrays: of node i the children are 2i and 2i + 1; the last level holds values."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = self.value.shape[1].bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(value)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss, second order; splits are sought over histograms of quantile bins."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    leaves = 1 << depth
    feature, threshold, value = [], [], []
    if n and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        total = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            node = np.ones(n, np.int64)
            feat, thr = np.zeros(leaves, np.int64), np.full(leaves, np.inf)
            for level in range(depth):
                at, wide = node - (1 << level), 1 << level
                best = np.full(wide, 1e-6)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    cell = at * BINS + bins[:, f]
                    g, h = (np.bincount(cell, v, wide * BINS).reshape(wide, BINS).cumsum(axis=1) for v in (grad, hess))
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                    gain = gain[:, : len(edges[f])]
                    k = gain.argmax(axis=1)
                    better = np.flatnonzero(gain[np.arange(wide), k] > best)
                    best[better] = gain[better, k[better]]
                    feat[wide + better], thr[wide + better] = f, edges[f][k[better]]
                node = 2 * node + (x[np.arange(n), feat[node]] > thr[node])
            g, h = np.bincount(node - leaves, grad, leaves), np.bincount(node - leaves, hess, leaves)
            val = -RATE * g / (h + RIDGE)
            total += val[node - leaves]
            feature.append(feat)
            threshold.append(thr)
            value.append(val)
    return Trees(base, np.array(feature, np.int64).reshape(-1, leaves), np.array(threshold).reshape(-1, leaves), np.array(value).reshape(-1, leaves))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Trees:
    """Trees from at most ``most`` rows of each label outside the held-out fold; the labelled rows alone are collected."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~in_fold(F.col("doc_id"), 5, 0)).select("doc_id", "quality")
    chosen = F.broadcast(bounded_sample(known, "quality", most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_training, "quality int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("quality").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees however Spark orders the rows
    return grow(x[order], y[order])


def _scores(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(statistics(batch.column("text"))))], ["doc_id", "score"])

    return run


def _accepted(model, columns: list[str], cut: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(statistics(batch.column(columns.index("text")))) >= cut))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text, ...)``.

    A null text is scored as an empty one. Labels other than 0 and 1 are ignored; without labels of both kinds the
    score is the share of ones learned (0.5 without any). Rows may repeat; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select("doc_id", "text").mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``cut`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_accepted(model, docs.columns, cut), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
#: Boosting isn't SQL; tests check held-out accuracy and the flat trees against a walk node by node.
ORACLES: dict[str, str] = {}
