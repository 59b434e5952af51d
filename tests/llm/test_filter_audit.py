"""The filter audit against filters that are applied one after the other, and its query against SQL."""

from __future__ import annotations

import random
import re
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from textloom.llm import filter_audit as fa

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def failures(rows: list[tuple]) -> list[set[str]]:
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        found = {"A"} if len(w) < 100 else set()
        found |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        found |= {"D"} if re.search("[#$%&*|]", t) else set()
        found |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append(found)
    return out


def plain(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, out = failures(rows), []
    for part in {x or "" for *_, x in rows}:
        mine = [k for k, (*_, x) in enumerate(rows) if (x or "") == part]
        lost = dict.fromkeys("ABCDE", 0)
        told = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                failing = [k for k in mine if f in fails[k]]
                lost[f] += len(gone)
                told.append((f, part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(fails[k] == {f} for k in mine), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)))
        out += [(*x, lost[f]) for f, *x in told]
    return set(map(tuple, out))


def made(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]

    def text() -> str:
        some = rng.sample(words, rng.choice([0, 1, 90, 99, 100, 101, 150]))
        some = [rng.choice(some) if some and rng.random() < rng.choice([0, 0.1, 0.25, 0.5]) else w for w in some]
        some = [w.upper() if rng.random() < rng.choice([0, 0.1, 0.3]) else w for w in some]
        return rng.choice([" ", "\n", " \t"]).join(some) + rng.choice(["", "", "#", " 100%", " ü", "Ä" * 30])

    rows = [(k, text(), rng.choice(["en", "de", "", None])) for k in range(150)]
    rows += [(rng.randrange(-20, 400), rng.choice(rows)[1], rng.choice(["en", "fr", None])) for _ in range(120)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "en"), (None, rows[3][1], "en"), (None, None, None), (500, None, "en"), (501, "", "de"), (502, None, "es"), (3, "x", "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(-20, 380)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    return rows, labels


def test_audit_equals_filters_in_turn(spark):
    for seed in (1, 2):
        rows, labels = made(seed)
        docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(1)).withColumn("mask", F.lit("x")).withColumn("good", F.lit(2))
        got = fa.audit(fa.failure_counts(docs, spark.createDataFrame(labels, LABELS)))
        got = [tuple(r[c] for c in ("part", *fa._REPORT)) for r in got.collect()]
        assert len(got) == 600 * len({x or "" for *_, x in rows}) and set(got) == plain(rows, labels)


def test_contractions_equal_sums_over_masks():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 100, (3, 8))
    for order, step, kept, removed, redundant, alone, good, toxic, shapley in fa.steps("XYZ", counts):
        bit = lambda f: 1 << "XYZ".index(f)
        early, mine = sum(map(bit, order[: step - 1])), bit(order[step - 1])
        of = lambda k, ok: int(sum(counts[k, m] for m in range(8) if ok(m)))
        gone = lambda m: m & mine and not m & early
        assert (kept, removed, redundant) == (of(0, lambda m: not m & (early | mine)), of(0, gone), of(0, lambda m: m & mine and m & early))
        assert (alone, good, toxic) == (counts[0, mine], of(1, gone), of(2, gone))
        assert shapley == sum(of(0, lambda m, o=o, k=k: m & mine and not m & sum(map(bit, o[:k]))) for o in map("".join, permutations("XYZ")) for k in range(3) if o[k] == order[step - 1])


def test_shares_of_the_orders_add_up(spark):
    """The removed documents of all filters are those that fail any, so the shares of 120 orders add up to 120 times as many."""
    rows, labels = made(5)
    got = fa.audit(fa.failure_counts(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))).collect()
    for part in {r["part"] for r in got}:
        mine = [r for r in got if r["part"] == part and r["filter_order"] == "ABCDE"]
        n = sum((x or "") == part for *_, x in rows)
        assert sum(r["shapley"] for r in mine) == 120 * (n - mine[-1]["kept"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert fa.audit(fa.failure_counts(none, spark.createDataFrame([], LABELS))).collect() == []
    one = fa.audit(fa.failure_counts(spark.createDataFrame([(1, "a", None)], DOCS), spark.createDataFrame([], LABELS))).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in one)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(fa.ORACLES["op11_filter_audit"])
    names = [x[0] for x in cur.description]
    df = fa.QUERIES["op11_filter_audit"](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())
