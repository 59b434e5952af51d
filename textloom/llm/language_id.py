"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

N-grams of one to three characters are hashed to ``DIM`` columns. Document frequencies are counted over all rows to
learn from; the weights are trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample
(``MAX_TRAIN`` rows a language), and a temperature is fitted on a part of the sample kept apart. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.labelled import bounded_sample, in_fold

DIM = 1 << 15
MAX_TRAIN = 1_500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.02
#: N-grams are counted over this many characters at a time, so that memory stays bounded for any text.
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns of the text's n-grams and their counts; None where there is no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(c), PIECE):
        p = c[at : at + PIECE + 2]
        h = p * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + p[n - 1 :] * np.uint32(0xC2B2AE35)
            total += np.bincount(h[:PIECE] >> np.uint32(32 - 15), minlength=DIM)
    found = np.flatnonzero(total)
    return found, total[found]


def weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[found]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            got = counts(text.as_py())
            docs += 1
            if got:
                df[got[0]] += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1]])), pa.array(np.concatenate([df[some], [docs]]))], ["bucket", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [counts(t) or (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([g[0].astype(np.int32).tobytes() for g in got]), pa.array([g[1].astype(np.int32).tobytes() for g in got])], ["doc_id", "lang", "found", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 5) -> np.ndarray:
    """Weights (DIM + 1, classes) by follow-the-regularised-leader, proximal; the last row is the bias."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at) -> np.ndarray:
        low = np.abs(z[at]) <= L1
        return np.where(low, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss over a grid from 0.2 to 5."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.names, self.idf, self.weights, self.heat = names, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        got = counts(text)
        if got is None or not self.names:
            return "und", 0.0
        p = _softmax((weighted(*got, self.idf) @ self.weights[got[0]] + self.weights[DIM]) / self.heat)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def train(docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    """The model from rows of ``docs(doc_id, text, lang)`` with a language outside the held-out fold."""
    known = docs.where("lang is not null and doc_id is not null").where(~in_fold(F.col("doc_id"), 4, 2))
    df = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    have = {r["bucket"]: r["n"] for r in df}
    total = have.pop(-1, 0)
    idf = np.full(DIM, np.log(1.0 + total))
    idf[np.array(list(have), np.int64)] = np.log((1.0 + total) / (1.0 + np.array(list(have.values()), float)))
    idf += 1
    chosen = F.broadcast(bounded_sample(known.select("doc_id", "lang"), "lang", most))
    rows = known.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "lang", "text").mapInArrow(_examples, "doc_id long, lang string, found binary, n binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["found"]), key=lambda r: (r["doc_id"], r["lang"], r["found"], r["n"]))
    names = sorted({r["lang"] for r in rows})
    data = []
    for r in rows:
        found = np.frombuffer(r["found"], np.int32).astype(np.int64)
        x = weighted(found, np.frombuffer(r["n"], np.int32).astype(float), idf)
        data.append((np.concatenate([found, [DIM]]), np.concatenate([x, [1.0]]), names.index(r["lang"])))
    fit, apart = [d for i, d in enumerate(data) if i % 5], data[::5]
    w = ftrl(fit or data, len(names)) if names else np.zeros((DIM + 1, 0))
    heat = temperature(np.array([x @ w[at] for at, x, _ in apart]), np.array([y for *_, y in apart], np.int64)) if len(names) > 1 else 1.0
    return Model(names, idf, w, heat)


def _predicted(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs(doc_id, text, lang, ...)``.

    A null or empty text, or one without a letter, gives ``und`` with score 0; so does every text where there is
    nothing to learn from. Rows may repeat; other columns are ignored. Only ``text`` enters a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text", "lang")))
    out = docs.select("doc_id", "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_language_id": op3_language_id}
#: Training isn't SQL; tests check held-out accuracy and calibration.
ORACLES: dict[str, str] = {}
