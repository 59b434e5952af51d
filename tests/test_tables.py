"""Ranks over counted values: even ranges whatever repeats, medians and modes of groups."""

from __future__ import annotations

import math
import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from textloom.operators import tables as tb


def test_a_frequent_value_leaves_the_ranges_even(spark, monkeypatch):
    n, dealt = 400_000, []

    def kept(df, name, write=tb.materialize):
        out = write(df, name)
        dealt.append([r["count"] for r in out.groupBy("__part").count().collect()])
        return out

    monkeypatch.setattr(tb, "materialize", kept)
    rows = spark.range(n).select(F.lit(1).alias("g"), F.when(F.col("id") % 10 == 0, F.col("id") * 7919 % n).otherwise(0).cast("double").alias("v"))
    got = tb.hazen_quantiles(rows, ["g"], "v", [0.5, 0.95, 1.0]).first()
    x = sorted(k * 7919 % n if k % 10 == 0 else 0 for k in range(n))
    at = lambda p: min(max(n * p + 0.5, 1), n)
    want = [x[int(at(p)) - 1] * (1 - at(p) % 1) + (x[int(at(p))] * (at(p) % 1) if at(p) % 1 else 0) for p in (0.5, 0.95, 1.0)]
    assert [got["q50"], got["q95"], got["q100"]] == want
    # 40,000 different values: no range has much more than its share of them, though nine rows of ten are equal.
    assert len(dealt) == 1 and sum(dealt[0]) == len(set(x)) and max(dealt[0]) < 1.5 * sum(dealt[0]) / len(dealt[0]) and len(dealt[0]) == 4


def test_medians_and_modes_of_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, 2, 7, None]), rng.choice([0.5, -1.0, 3.25, math.nan, None])) for _ in range(300)] + [("only missing", None, math.nan), ("one", 4, None)]
    got = {r["g"]: r for r in tb.group_summary(spark.createDataFrame(rows, "g string, n int, x double"), ["g"], ["median", "mode", "numel"], ["n", "x"]).collect()}
    assert set(got) == {g for g, *_ in rows}
    for g, r in got.items():
        for k, c in enumerate("nx", 1):
            v = [row[k] for row in rows if row[0] == g and row[k] is not None and not math.isnan(row[k])]
            times = Counter(v)
            mode = min((x for x in times if times[x] == max(times.values())), default=None)
            assert (r[f"median_{c}"], r[f"mode_{c}"], r[f"numel_{c}"]) == (median(v) if v else None, mode, len(v))
    one = tb.group_summary(spark.createDataFrame(rows, "g string, n int, x double"), [], ["median"], ["n"]).collect()
    assert len(one) == 1 and one[0]["median_n"] == median(n for _, n, _ in rows if n is not None)


def test_summary_of_columns_in_one_pass(spark):
    got = {r["column"]: r for r in tb.summarize(spark.createDataFrame([(1, 2.0, "x"), (5, math.nan, None), (None, 8.0, "x")], "a int, b double, c string")).collect()}
    assert [(got[c]["median"], got[c]["missing"], got[c]["distinct_values"]) for c in "abc"] == [(3.0, 1, None), (5.0, 1, None), (None, 1, 1)]
    assert [r["median"] for r in tb.summarize(spark.createDataFrame([("x",)], "c string")).collect()] == [None]
