"""The language model against the recursion written out in plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import frame
from textloom.llm import language_model as lm

FOLDS = "doc_id long, text string, fold int, lang string"


def tokens(text: str | None) -> list[str]:
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return [*re.findall("[^\x20\x09-\x0d]+", low), "</s>"]


def plain(rows: list[tuple], order: int, prior: float) -> list[tuple]:
    """(id, tokens, known, learned, base, score) of rows (id, text, learns)."""
    c: Counter = Counter()
    for _, text, learns in rows:
        if learns:
            t = tokens(text)
            c.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(h: tuple, w: str) -> float:
        if not h:
            return (c[(w,)] + 1) / (n + v + 1)
        return (c[(*h, w)] + prior * p(h[1:], w)) / (c[h] + prior)

    out = []
    for i, text, _ in rows:
        t, score = tokens(text), 0.0
        for k, w in enumerate(t):
            h = tuple(t[max(0, k - order + 1) : k])
            while h and not c[h]:  # a context that wasn't seen is no state
                h = h[1:]
            score += math.log10(p(h, w))
        out.append((i, len(t), sum(c[(w,)] > 0 for w in t), n, sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in t), score))
    return out


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "THE", "the", "x" * 300]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choice(words[: rng.choice([3, 10, 34])]) for _ in range(rng.choice([0, 1, 2, 5, 40, 700])))
    rows = [(k, text(), rng.random() < 0.7) for k in range(n)]
    return rows + [(n, None, True), (n + 1, "", False), (n + 2, " \t\n", True), (None, rows[0][1], True), (3, rows[1][1], False), (5, "a  b", None)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_the_recursion(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "LANE", 7)
    rows = made(order, 60)
    docs = spark.createDataFrame([(i, t, None if x is None else int(x), "en") for i, t, x in rows], FOLDS).withColumn("block", F.lit(1)).withColumn("learns", F.lit("x"))
    got = lm.scores(docs, F.col("fold") == 1, order, 2.5, block_tokens=900, range_keys=500).collect()
    want = plain(rows, order, 2.5)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9)


def test_blocks_and_ranges_change_nothing(spark):
    rows = [(i, t, int(bool(x)), "") for i, t, x in made(9, 80)]
    docs = spark.createDataFrame(rows, FOLDS).repartition(5)
    one = {(r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in lm.scores(docs, F.col("fold") == 1).collect()}
    two = {(r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in lm.scores(docs, F.col("fold") == 1, block_tokens=1, range_keys=64).collect()}
    assert one == two


def test_probabilities_of_a_state_add_up_to_one():
    """Over all tokens, each with the place after the same context, and one unknown token."""
    text = "a b a c a b b c a b".split()
    c = Counter(tuple(text[i : i + k]) for k in (1, 2) for i in range(len(text) - k + 1))
    words = [*sorted(set(text)), "?"]
    for h in "abc":
        counts = [np.array([x for w in words for x in (c[(h,)], c[(w,)])], float), np.array([x for w in words for x in (0, c[(h, w)])], float)]
        total = 10 ** lm.traverse(counts, np.full(len(words), 2), len(text), 3, 5.0) / ((c[(h,)] + 1) / (len(text) + 4))
        followed = sum(c[(h, w)] for w in "abc")
        # The last token of the text has no follower, so its context keeps that share.
        assert math.isclose(total.sum(), (followed + 5) / (c[(h,)] + 5))


def test_no_rows_and_nothing_to_learn(spark):
    assert lm.scores(frame(spark, []), F.lit(True)).collect() == []
    rows = lm.scores(frame(spark, [(1, "a b", "", "", 0)]), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in rows] == [(0, 0, 0.0, 0.0)]


def test_known_text_scores_better_than_its_words_in_disorder(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    after = {w: rng.sample(words, 3) for w in words}

    def walk(n: int) -> str:
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    rows = [(k, walk(300), 1, "") for k in range(60)] + [(100 + k, walk(300), 0, "") for k in range(10)]
    rows += [(200 + k, " ".join(rng.sample(t.split(), 300)), 0, "") for k, (_, t, _, _) in enumerate(rows[60:])]
    got = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame(rows, FOLDS), F.col("fold") == 1).collect()}
    for k in range(10):
        assert math.isclose(got[100 + k]["base_score"], got[200 + k]["base_score"], rel_tol=1e-9)
        assert got[100 + k]["score"] > 0.6 * got[200 + k]["score"] and got[100 + k]["score"] > got[100 + k]["base_score"]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in lm.QUERIES["op13_lm_scores"](spark, folder).collect()}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    want = plain([(d["doc_id"], d["text"], not held[d["doc_id"]]) for d in docs], lm.ORDER, lm.PRIOR)
    for i, n, known, learned, base, score in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, learned)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert len(got) == len(docs)
