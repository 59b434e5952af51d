"""Language models and segments against plain Python, and a control that must fall to chance."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import languages as lg

FOLDER, CLASSES = "/root/testdata/sf0.001", ["de", "en", "es", "fr"]


def features(w: str) -> list[str]:
    out = [f"W:{w}", f"M:{w[:1]}-", f"M:-{w[-1:]}"]
    out += [f"M:{w[:2]}-", f"M:-{w[-2:]}"] if len(w) > 1 else []
    out += [f"M:-{w[-3:]}"] if len(w) > 2 else []
    out += [f"P:{c}" for c in sorted(set(re.findall("[^a-z]", w)))]
    return out + ([f"C:{w}"] if len(w) <= 3 else []) + ([f"A:-{w[-4:]}"] if len(w) >= 5 else [])


def model_of(docs: list[tuple[str, str]], least: int = 3) -> dict[str, dict[str, float]]:
    n = Counter((f, lang) for text, lang in docs for w in re.findall(r"[^\W\d_]+", text.lower()) for f in features(w))
    every = Counter()
    for (f, _), k in n.items():
        every[f] += k
    kept = {f for f in every if f[0] not in "WM" or every[f] >= least}
    total, kinds = Counter(), Counter(f[0] for f in kept)
    for (f, c), k in n.items():
        if f in kept:
            total[f[0], c] += k
    return {f: {c: math.log((n[f, c] + 0.5) / (total[f[0], c] + 0.5 * kinds[f[0]])) for c in CLASSES} for f in kept}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["text"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null and text is not null").collect()]


def test_model_equals_its_counts(spark, docs):
    got = {r["feature"]: [r[c] for c in CLASSES] for r in lg.naive_bayes(spark.createDataFrame(docs, "text string, lang string"), "lang", CLASSES).collect()}
    want = model_of(docs)
    assert set(got) == set(want) and all(np.allclose(got[f], [want[f][c] for c in CLASSES]) for f in want)


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        scores, costs = rng.integers(-3, 4, (n, k)).astype(float), rng.choice([0.0, 0.5, 2.0], n)
        worth = lambda p: sum(scores[i, c] for i, c in enumerate(p)) - sum(costs[i] for i in range(1, n) if p[i] != p[i - 1])  # noqa: B023, E731
        assert worth(lg.best_path(scores, costs).tolist()) == max(map(worth, itertools.product(range(k), repeat=n)))


def test_segments_of_planted_pieces(spark, docs):
    """Pieces of two languages, a piece in another script, neutral marks; places are those of the text."""
    model = lg.naive_bayes(spark.createDataFrame(docs, "text string, lang string"), "lang", CLASSES)
    rng = random.Random(2)
    by = {c: [w for t, lang in docs if lang == c for w in re.findall(r"[^\W\d_]+", t)] for c in CLASSES}
    rows = []
    for k in range(12):
        a, b = rng.sample(CLASSES, 2)
        rows.append((k, " ".join(rng.sample(by[a], 25)) + ". 12 " + " ".join(rng.sample(by[b], 25)) + rng.choice([" слово и ещё", ""]), a, b))
    frame = spark.createDataFrame([(k, t) for k, t, *_ in rows] + [(90, None), (91, "12 -- 3"), (92, "Привет")], "id long, text string")
    labelled = lg.label_words(frame, "id", model, CLASSES)
    got: dict = {}
    for r in lg.segments(labelled, "id").orderBy("id", "first").collect():
        got.setdefault(r["id"], []).append(r)
    right = 0
    for k, text, a, b in rows:
        cut = text.index(". 12 ")
        said = [(s["lang"], s["start"], s["stop"], s["words"]) for s in got[k]]
        end = text.index(" слово") if "слово" in text else len(text)
        if "слово" in text:
            assert said.pop() == ("other", end + 1, len(text), 3)
        right += said == [(a, 0, cut, 25), (b, cut + 5, end, 25)]
    assert right >= 10 and 90 not in got and 91 not in got
    assert [(s["lang"], s["words"], s["start"], s["stop"]) for s in got[92]] == [("other", 1, 0, 6)]
    # The path against one from scores by plain Python.
    want = model_of(docs)
    text = rows[0][1].split(" слово")[0]
    found = list(lg._TOKEN.finditer(text))
    x = np.array([[sum(want[f][c] for f in features(m[0].lower()) if f in want) for c in CLASSES] for m in found])
    costs = np.array([16 / (4 if k and re.search(r"[.!?\n]", text[found[k - 1].end() : m.start()]) else 1) for k, m in enumerate(found)])
    said = [r["said"] for r in labelled.where("id = 0").orderBy("at").collect()][: len(found)]
    assert said == [CLASSES[k] for k in lg.best_path(x, costs)]


def test_drawn_labels_fall_to_chance(spark):
    from textloom import registry

    got = registry.queries()["c16_shuffled_control"](spark, "/root/testdata/sf0.01").collect()
    share = {name: sum(r["right"] for r in got if r["labels"] == name) / sum(r["n"] for r in got if r["labels"] == name) for name in ("own", "drawn")}
    shares = [r["n"] / sum(x["n"] for x in got if x["labels"] == "own") for r in got if r["labels"] == "own"]
    assert share["own"] > 0.97 and share["drawn"] <= max(shares) + 0.05


def test_mixed_documents_are_cut_where_they_are_put_together(spark):
    from textloom import registry

    r = registry.queries()["e19_mixed_documents"](spark, FOLDER).first()
    assert r["words"] > 300 and r["accuracy"] > 0.9 and r["f1"] > 0.7


def test_labels_are_drawn_in_their_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("lang"))
    n = Counter(r["lang"] for r in lg.shuffled(docs, "k", "lang", "s").collect())
    assert abs(n["a"] - 1000) < 150 and n["a"] + n["b"] == 4000
