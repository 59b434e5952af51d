"""Edit distance joins against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import lookups as lk


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_words_within_edits(spark, radius):
    rng = random.Random(radius)
    words = {"".join(rng.choice("abü") for _ in range(rng.randint(0, 7))) for _ in range(150)}
    for _ in range(120):  # longer words with edits at any places
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(5, 14))]
        words.add("".join(w))
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice([[], ["z"], ["q", "q"]])
        words.add("".join(w))
    rows = [(w,) for w in words] + [(None,), ("ab",), ("ab",)]
    words.add("ab")
    got = {(r["a"], r["b"], r["distance"]) for r in lk.within_edits(spark.createDataFrame(rows, "w string"), "w", radius).collect()}
    want = {(a, b, distance(a, b)) for a in words for b in words if a < b and distance(a, b) <= radius}
    assert got == want and len(want) > 100


def test_documents_within_two_edits_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w")).distinct()
    words = sorted(r["w"] for r in docs.orderBy(F.xxhash64("w")).limit(700).collect())
    got = {(r["a"], r["b"], r["distance"]) for r in lk.within_edits(docs, "w", 2).collect()}
    some = set(words)
    want = {(a, b, distance(a, b)) for k, a in enumerate(words) for b in words[k + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert {x for x in got if x[0] in some and x[1] in some} == want and want
