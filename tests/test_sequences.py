"""Batches, isotonic fits and seats against plain Python, with keys that lie in many ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import sampling as sm
from textloom.operators import sequences as sq


def filled(rows: list[tuple], most: int) -> set[tuple]:
    out, keys = set(), {k for k, *_ in rows}
    for k in keys:
        batch, used, before = 0, 0, [None, None]
        for _, o, n in sorted(r for r in rows if r[0] == k):
            if used and used + n > most:
                batch, used = batch + 1, 0
            used += n
            out.add((k, o, n, batch, before[-1], before[-2]))
            before.append(o)
    return out


@pytest.mark.parametrize("most", [1, 7, 60, 5000])
def test_batches_of_keys_in_many_ranges(spark, most):
    rng = random.Random(most)
    rows = [(1, o, rng.choice([0, 0, 1, 2, 5, 9, 100])) for o in range(400)] + [(2, 5, 3)] + [(3, o, 0) for o in range(60)] + [(4, o, rng.randint(0, 9)) for o in range(200)] + [(k, o, rng.randint(0, 30)) for k in range(5, 60) for o in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "k long, o long, n int")
    for parts in (1, 3, 23):
        got = {tuple(r[c] for c in ("k", "o", "n", "batch", "before1", "before2")) for r in sq.greedy_batches(df, "k", "o", "n", most, parts).collect()}
        assert got == filled(rows, most)


def test_one_key_of_a_million_rows_over_many_ranges(spark):
    rows = spark.range(1_000_000).select(F.lit(7).alias("k"), F.col("id").alias("o"), (F.xxhash64("id") % 20 + 20).cast("int").alias("n"))
    out = sq.greedy_batches(rows, "k", "o", "n", 120, 16).toPandas().sort_values("o")
    batch, used, want = 0, 0, []
    for n in out["n"].tolist():
        if used and used + n > 120:
            batch, used = batch + 1, 0
        used += n
        want.append(batch)
    assert out["batch"].tolist() == want and out["before2"].iloc[2:].astype(int).tolist() == list(range(999_998))


def pooled(points: list[tuple]) -> dict:
    at: dict = {}
    for x, y, w in points:
        s, n = at.get(x, (0.0, 0.0))
        at[x] = (s + y * w, n + w)
    blocks: list = []
    for x in sorted(at):
        blocks.append([[x], *at[x]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return {x: s / w for xs, s, w in blocks for x in xs}


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "wave", "empty"])
def test_isotonic_over_ranges(spark, monkeypatch, shape):
    monkeypatch.setattr(sq, "FEW_POOLS", 20)
    rng = random.Random(shape)
    y = {"noise": lambda x: rng.gauss(0, 1), "rising": lambda x: x, "falling": lambda x: -x, "wave": lambda x: (x % 90) + x / 50, "empty": None}[shape]
    points = [] if y is None else [(float(x := rng.randrange(700)), float(y(x)), rng.choice([1.0, 2.0, 0.5])) for _ in range(1500)]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (3.5, None, 1.0), (4.5, 1.0, 0.0)], "x double, y double, w double")
    got = {r["x"]: r["fitted"] for r in sq.isotonic(df, "x", "y", "w").collect()}
    want = pooled(points)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def allocate(sizes: list[tuple], wanted: int) -> dict:
    """Seats by largest remainder in rounds; (name, size, room)."""
    seats = {name: 0 for name, *_ in sizes}
    left = min(wanted, sum(room for *_, room in sizes))
    while left:
        active = [(name, n, room - seats[name]) for name, n, room in sizes if room > seats[name]]
        total = sum(n for _, n, _ in active)
        spare = left - sum(left * n // total for _, n, _ in active)
        more = {name for name, *_ in sorted(active, key=lambda x: (-(left * x[1] % total), x[0]))[:spare]}
        given = {name: min(left * n // total + (name in more), room) for name, n, room in active}
        for name, k in given.items():
            seats[name] += k
        left -= sum(given.values())
    return seats


@pytest.mark.parametrize("wanted", [0, 1, 17, 300, 10**6])
def test_quotas_equal_rounds_of_largest_remainder(spark, wanted):
    rng = random.Random(wanted)
    for sizes in ([("a", 10, 6), ("b", 5, 5), ("c", 1, 1)], [(f"n{k}", n := rng.choice([1, 7, 7, 7, 30, 900]), rng.randint(0, n)) for k in range(300)], [(f"n{k}", 2**40, 5) for k in range(40)], []):
        got = sm.quotas(spark.createDataFrame(sizes, "name string, size long, room long"), "name", "size", "room", wanted)
        assert {r["name"]: r["seats"] for r in got.collect()} == allocate(sizes, wanted)


def test_turns_within_quotas(spark):
    rng = random.Random(11)
    rows = [(b, f"{b}{d}", f"{b}{d}:{k}", rng.random() < p) for b, p in (("a", 0.5), ("b", 0.02), ("c", 0.98), ("d", 0.5)) for d in range(9) for k in range(rng.randint(1, 12))]
    books = [("a", 500), ("b", 300), ("c", 200), ("d", 2), ("none", 50)]
    got = sm.stratified_select(spark.createDataFrame(books, "book string, size long"), spark.createDataFrame(rows, "book string, doc string, key string, kind boolean"), 60, "x").collect()
    have = {b: sum(r[0] == b for r in rows) for b, _ in books}
    seats = allocate([(b, n, have[b]) for b, n in books if have[b]], 60)
    assert len(got) == 60
    for b, k in seats.items():
        n = [sum(r[0] == b and r[3] == kind for r in rows) for kind in (True, False)]
        first = min(k // 2, n[0])
        other = min(k - first, n[1])
        assert [sum(r["book"] == b and r["kind"] == kind for r in got) for kind in (True, False)] == [min(k - other, n[0]), other]
        for kind in (True, False):  # no document has two more than another that has any left
            taken = {d: sum(r["doc"] == d and r["kind"] == kind for r in got) for d in {r[1] for r in rows if r[0] == b}}
            rest = {d: sum(r[1] == d and r[3] == kind for r in rows) - taken[d] for d in taken}
            assert all(taken[x] <= taken[y] + 1 for x in taken for y in taken if rest[y])


def best_total(rows: list[tuple]) -> int:
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    total = [0]
    for k, (_, a, b, w) in enumerate(rows):
        total.append(max(total[-1], total[min(sum(x[2] <= a for x in rows), k)] + w))
    return total[-1]


@pytest.mark.parametrize("seed", range(4))
def test_schedules_of_keys_in_many_ranges(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key, n, width, most in ((1, 150, 60, 25), (2, 150, 200, 190), (3, 1, 9, 3), (4, 60, 30, 4), (5, 40, 5, 1), (6, 90, 10_000, 3000)):
        for i in range(n):
            a = rng.randrange(width)
            rows.append((key, 1000 * key + i, a, a + rng.randint(0 if seed == 3 else 1, most), rng.choice([1, 1, 2, 5, 50])))
    df = spark.createDataFrame(rows, "k long, i long, a long, b long, w long")
    for parts in (1, 4, 31):
        got: dict = {}
        for r in sq.weighted_schedule(df, "k", "i", "a", "b", "w", parts).collect():
            got.setdefault(r["k"], []).append(tuple(r))
        assert set(got) == {r[0] for r in rows}
        for key, some in got.items():
            assert set(some) <= set(rows) and len(set(some)) == len(some)
            some.sort(key=lambda r: (r[3], r[2]))
            assert all(x[3] <= y[2] for x, y in zip(some[:-1], some[1:], strict=True))
            assert sum(r[4] for r in some) == best_total([r[1:] for r in rows if r[0] == key])
