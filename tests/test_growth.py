"""Jobs whose rows between steps once grew with pairs: what they shuffle is bounded, and the results are as by brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.operators import corpus as cp
from textloom.operators import graph as gr
from textloom.operators import models as md
from textloom.operators import products as pr


def shuffled(spark, job):
    """What ``job`` gives, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    quantiles = gateway.new_array(gateway.jvm.double, 0)
    stages = lambda: store.stageList(gateway.jvm.java.util.ArrayList(), False, False, quantiles, gateway.jvm.java.util.ArrayList())

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        all_stages = stages()
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (all_stages.apply(k) for k in range(all_stages.size()))}

    before = rows()
    out = job()
    return out, sum(n for k, n in rows().items() if k not in before)


@pytest.mark.parametrize("share", [0.0, 0.02, 10.0])
def test_best_by_blocks_equal_all_pairs(spark, monkeypatch, share):
    rng = random.Random(3)
    monkeypatch.setattr(pr, "RANGE", 40)
    monkeypatch.setattr(pr, "SHARE", share)
    monkeypatch.setattr(pr, "PAIRS", 100)
    has = {(a * 3, f"f{int(rng.paretovariate(0.7)) % 30}") for a in range(120) for _ in range(rng.randrange(6))}
    weight = {f: rng.choice([0.0, 0.25, 0.5]) for f in sorted({f for _, f in has})}
    entries = spark.createDataFrame([(a, f, weight[f]) for a, f in sorted(has)], "a long, f string, v double")
    of = {}
    for a, f in has:
        of.setdefault(a, set()).add(f)
    sums = {(a, b): sum(weight[f] for f in of[a] & of[b]) for a in of for b in of if a != b and of[a] & of[b]}
    want = {(a, *x) for a in of for x in sorted(((b, s) for (x, b), s in sums.items() if x == a), key=lambda x: (-x[1], x[0]))[:3]}
    assert {tuple(r) for r in pr.shared_best(entries, 3).collect()} == want
    best = sorted(((a, b, s) for (a, b), s in sums.items() if a < b), key=lambda x: (-x[2], *x[:2]))[:20]
    assert sorted(tuple(r) for r in pr.shared_best(entries, 20, each=False).collect()) == sorted(best)


def test_best_keep_what_rounding_may_bring():
    score = np.array([0.3, 0.12345, 0.123449999999, 0.12344, 0.1])
    kept = pr.best_of(np.zeros(5, int), np.array([1, 2, 3, 8, 9]), score, 2, 1e-4)
    assert set(kept) >= {0, 1} and not {3, 4} & set(kept)
    assert set(pr.best_of(np.zeros(3, int), np.array([1, 2, 3]), np.array([0.123449999999, 0.1, 0.12345]), 1, 1e-4)) == {0, 2}


def test_companions_shuffle_words_not_pairs(spark):
    units = spark.createDataFrame([(d, f"w{(d * 7 + k * k) % 900}") for d in range(12) for k in range(300)], "doc_id long, word string")
    rows = {(r["doc_id"], r["word"]) for r in units.collect()}
    got, n = shuffled(spark, lambda: cp.companions(units).collect())
    of = {}
    for d, w in rows:
        of.setdefault(d, []).append(w)
    count = Counter((x, y) for ws in of.values() for x in ws for y in ws if x != y)
    by = {}
    for (x, y), k in count.items():
        by.setdefault(x, []).append((-k, y))
    assert {(r["word"], r["other"], r["n"], r["r"]) for r in got} == {(x, y, -k, r) for x, ys in by.items() for r, (k, y) in enumerate(sorted(ys)[:5], 1)}
    assert n < len(count)


def test_interactions_shuffle_users_not_pairs(spark, tmp_path):
    rows = [(k, u, "view", f"2024-01-01 0{h}:10:00") for k, (u, h) in enumerate((u, h) for u in range(250) for h in range(4) if (u * h) % 3 < 2)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t string")
    e.withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "events.parquet"))
    got, n = shuffled(spark, lambda: registry.queries()["a24_interactions"](spark, str(tmp_path)).collect())
    hours = {}
    for _, u, _, t in rows:
        hours.setdefault(u, set()).add(t)
    want = sorted((-len(hours[a] & hours[b]), a, b) for a in hours for b in hours if a < b)[:30]
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(a, b, -k) for k, a, b in want]
    assert n < 250 * 249 // 4


def test_related_documents_shuffle_no_pairs(spark, tmp_path):
    rows = [(o, p, p) for o in range(300) for p in {o % 3, 10 + o % 7, 100 + o}]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got, n = shuffled(spark, lambda: registry.queries()["g9_related_documents_whole"](spark, str(tmp_path)).collect())
    assert len(got) == 3000 and n < 300 * 100
    # Those with both parts in common come first, by number.
    assert [r["other"] for r in sorted((r for r in got if r["doc"] == 0), key=lambda r: (-r["strength"], r["other"]))] == [21 * k for k in range(1, 11)]


def test_similar_documents_shuffle_keys_not_pairs(spark):
    keys = [(d, f"k{(d + s) % 60}") for d in range(400) for s in (0, 1, 7, 9)]
    got, n = shuffled(spark, lambda: gr.similar_documents(spark.createDataFrame(keys, "doc_id long, key string"), 2).collect())
    assert len(got) == 800 and n < 400 * 399 // 8
    assert {(r["doc_id"], r["other"], r["score"]) for r in got if r["doc_id"] == 5} == {(5, 65, 1.0), (5, 125, 1.0)}


def test_alignment_pairs_classes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 7 % 2], f"B{rng.randrange(4)}", f"T{rng.randrange(5)}") for k in range(900)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got, n = shuffled(spark, lambda: registry.queries()["g13_align_concepts"](spark, str(tmp_path)).collect())
    want = set()
    for a, name, brand, kind in rows[::2]:
        best = min(((-(brand == y) - (kind == z), b) for b, x, y, z in rows[1::2] if x == name), default=(0, 0))
        if best[0]:
            want.add((a, best[1], -best[0]))
    assert {(r["a"], r["b"], r["support"]) for r in got} == want and n < 450 * 450 // 4


def test_neighbourhood_stops_at_full_starts(spark):
    edges = [(s, 1000 + (s * 3 + p * p) % 90, float((s * p) % 11 + 1)) for s in range(40) for p in range(30 if s % 4 else 3)]
    strength = {}
    for a, b, w in edges:
        strength[a, b] = max(strength.get((a, b), 0.0), w)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in sorted(strength.items())], "src long, dst long, strength double")
    starts = spark.createDataFrame([(s,) for s in range(40)], "node long")
    near = {}
    for (a, b), w in strength.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    want = set()
    for s in range(40):
        one, two = near.get(s, {}), {}
        for x, w in one.items():
            for y, u in near[x].items():
                if y != s and y not in one:
                    two[y] = max(two.get(y, 0.0), min(w, u))
        order = sorted([(1, -w, x) for x, w in one.items()] + [(2, -w, y) for y, w in two.items()])[:12]
        want |= {(s, x, d, -w) for d, w, x in order}
    got, n = shuffled(spark, lambda: gr.neighbourhood(df, starts, 2, 12).collect())
    paths = sum(len(near[x]) for s in range(40) for x in near.get(s, {}))
    assert {tuple(r) for r in got} == want and n < paths


def test_power_iteration_reads_entries_once(spark):
    seen = spark.sparkContext.accumulator(0)
    edges = [(a, b, 1.0 + (a * b) % 3) for a in range(12) for b in range(12) if (a + b) % 3]

    @F.udf("double")
    def counted(w):
        seen.add(1)
        return w

    df = spark.createDataFrame(edges, "i long, j long, w double").withColumn("w", counted("w"))
    got = {r["node"]: r["value"] for r in gr.power_iteration(df, 6).collect()}
    m, v = np.zeros((12, 12)), np.ones(12)
    for a, b, w in edges:
        m[a, b] = w
    for _ in range(6):
        v = m @ v
        v /= np.linalg.norm(v)
    assert all(abs(got[k] - v[k]) < 1e-12 for k in range(12)) and seen.value == len(edges)


def test_sections_are_found_whole(spark, tmp_path):
    turns = ["the", "on the day of the other", "on the day", "the", "\n of the day", "Yes", "Yes, on the day of rest", "of", "and\x0bso it  is all", "on the day of the other"]
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c in (1, 2) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plain = list(dict.fromkeys(" ".join(x for x in re.split("[ \t\r\n]+", t) if x) for t in turns))
    got = registry.queries()["c22_story_sections"](spark, str(tmp_path)).collect()
    assert {(r["story"], r["n"], r["section"]) for r in got} == {(c, n, t) for c in (1, 2) for n, t in enumerate(plain, 1)}


def test_originality_of_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    source = [word() for _ in range(40)]
    long = [word() for _ in range(9000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join([*long[:4000], *source, *long[4000:]])), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["words"], r["exact"], r["covered"], r["state"]) for r in cp.originality(docs, spark.createDataFrame([(1, " ".join(source))], "item_id long, text string")).collect()}
    assert got == {1: (9000, 0, 0, "clear"), 2: (9040, 28, 40, "blocked"), 3: (0, 0, 0, "pending")}
    # Seconds; steps as many as the square of the words would take minutes.
    assert time.perf_counter() - began < 45


def test_gap_questions_send_texts_once(spark):
    words = [f"wordlong{chr(97 + k)}" for k in range(20)]
    units = spark.createDataFrame([(i, " ".join(words[i : i + 12]) + " x" * 500, words[i : i + 12]) for i in range(8)] + [(0, "other wordlonga", ["wordlonga"])], "id long, text string, words array<string>")
    lexicon = spark.createDataFrame([(w, 9) for w in words] + [("alone", 5)], "word string, kind int")
    got = md.gap_questions(units, lexicon).collect()
    assert len(got) == 8 * 12 + 1
    for r in got:
        assert len(set(r["wrong"])) == 3 and r["word"] not in r["wrong"] and set(r["wrong"]) <= set(words)
        assert "____" in r["gap"] and r["word"] not in r["gap"].split()
