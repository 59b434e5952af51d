"""Operators over ordered rows: totals, moving windows, islands, runs, intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.tables import ranged
from textloom.plans.materialize import materialize

#: Pools that go into one range at once.
FEW_POOLS = 10_000


def running_total(df: DataFrame, order: str, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Running sum over everything in two passes: within ranges of the order, then the totals of the ranges before."""
    rows = ranged(df, [F.col(order)], partitions)
    local = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("__part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    before = sizes.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))  # one row a range
    out = rows.withColumn("__local", F.sum(value).over(local)).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.coalesce("__local", F.lit(0)) + F.col("__before")).drop("__part", "__local", "__before")


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running sum and product and the first two differences. Missing values are passed over."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    diff = v - F.lag(value).over(w)
    return df.withColumns({"cumsum": F.sum(value).over(run), "cumprod": F.product(v).over(run), "diff1": diff, "diff2": v - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)})


def moving(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """Mean, sum, least, greatest and median of a moving window; ends shrink. An even width reaches further back."""
    back, ahead = (width // 2, width // 2 - 1) if width % 2 == 0 else (width // 2, width // 2)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead)
    middle = F.array_sort(F.collect_list(value).over(w))
    n = F.size(middle)
    median = (F.get(middle, F.floor((n - 1) / 2).cast("int")) + F.get(middle, F.floor(n / 2).cast("int"))) / 2
    return df.withColumns({"movmean": F.avg(value).over(w), "movsum": F.sum(value).over(w), "movmin": F.min(value).over(w), "movmax": F.max(value).over(w), "movmedian": median})


def sliding_minimum(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Value and place of the leftmost least value of each complete window, at the window's last row."""
    w = Window.partitionBy(*keys).orderBy(order)
    span = w.rowsBetween(-(width - 1), 0)
    low = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("p"))).over(span)
    out = df.select(*keys, order, low.alias("low"), F.row_number().over(w).alias("r")).where(F.col("r") >= width)
    return out.select(*keys, order, F.col("low.v").alias("least"), F.col("low.p").alias("least_at"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], starts: Column, name: str) -> DataFrame:
    """Numbers the islands of each key: a row where ``starts`` holds (or the first) opens a new one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w))


def interval_union(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Touching or overlapping intervals merged: one row for each with its length."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.where(F.col(end) > F.col(start)).withColumn("__reach", F.max(end).over(before))
    marked = islands(seen, keys, [start, end], F.col(start) > F.col("__reach"), "island")
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).withColumn("length", F.col("end") - F.col("start"))


def run_lengths(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbours: value, first place and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = df.withColumn("__changed", ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1))
    return islands(changed, keys, [order], F.col("__changed"), "run").groupBy(*keys, "run").agg(F.first(value).alias("value"), F.min(order).alias("first_at"), F.count("*").alias("length"))


_LEAST = -(1 << 62)
_FRAGMENT, _ASKED, _CHOSEN, _ROW = range(4)


class _Fragment:
    """The intervals of one key in one range, by their ends; ``prev``: the last end of the key in the ranges before.

    What is best up to a row is a maximum of sums, linear in (max, +) in what is best before the fragment: up to all of
    its rows (None), and up to the starts ``deferred`` that lie before ``prev``.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray, prev: int | None) -> None:
        self.start, self.end, self.weight, self.prev = start, end, weight.tolist(), prev
        self.before = np.minimum(np.searchsorted(end, start, "right"), np.arange(len(end))).tolist()
        late = (np.array(self.before) == 0) & (start < (prev if prev is not None else _LEAST))
        self.late, self.deferred = late.tolist(), np.unique(start[late]).tolist()

    def place(self, upto: int | None) -> int:
        return len(self.end) if upto is None else int(np.searchsorted(self.end, upto, "right"))

    def matrix(self, asked: list[int | None], columns: int = 64) -> Iterator[tuple]:
        """(what is asked, what it rests on, the sum between) of all that are connected."""
        inputs: list[int | None] = [None, *self.deferred]
        at = {d: k for k, d in enumerate(inputs)}
        for low in range(0, len(inputs), columns):
            width = min(columns, len(inputs) - low)
            best = np.full((len(self.end) + 1, width), _LEAST, np.int64)
            if low == 0:
                best[0, 0] = 0
            for k, q in enumerate(self.before):
                np.copyto(best[k + 1], best[k])
                if not self.late[k]:
                    np.maximum(best[k + 1], best[q] + self.weight[k], out=best[k + 1])
                elif low <= (j := at[int(self.start[k])]) < low + width:
                    best[k + 1, j - low] = max(best[k + 1, j - low], self.weight[k])
            for out in asked:
                row = best[self.place(out)]
                for j in np.flatnonzero(row > _LEAST // 2).tolist():
                    yield out, inputs[low + j], int(row[j])

    def taken(self, out: int | None, on: int | None) -> list[int]:
        """The rows of the best choice up to ``out`` that rests on ``on``."""
        best = [0 if on is None else _LEAST]
        for k, q in enumerate(self.before):
            own = best[q] if not self.late[k] else (0 if on is not None and self.start[k] == on else _LEAST)
            best.append(max(best[-1], own + self.weight[k]))
        rows, k = [], self.place(out)
        while k:
            if best[k] == best[k - 1]:
                k -= 1
            else:
                rows.append(k - 1)
                k = 0 if self.late[k - 1] else self.before[k - 1]
        return rows


def _by_key(f: Callable, names: list[str], types: list) -> Callable[[pa.Table], pa.RecordBatch]:
    """``f(part, key, fragment, controls, whether the key has other ranges, its rows)`` to rows, over the keys of a range."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        part, k, kind = rows.column("__part")[0].as_py(), rows.column("key").to_numpy(), rows.column("kind").to_numpy()
        out: list[tuple] = []
        bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in pairwise(bounds):
            first = a + int(np.searchsorted(kind[a:b], _ROW))
            controls = rows.slice(a, first - a).select(["kind", "x", "y"]).to_pylist()
            own = rows.slice(first, b - first)
            prev = next((c["x"] for c in controls if c["kind"] == _FRAGMENT), None)
            fragment = _Fragment(*(own.column(c).to_numpy() for c in ("start", "end", "weight")), prev)
            out += f(part, int(k[a]), fragment, [c for c in controls if c["kind"] != _FRAGMENT], any(c["kind"] == _FRAGMENT for c in controls), own)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _chain(rows: pa.Table) -> pa.Table:
    """The matrices of a key's fragments to what is chosen: from the end back, what each fragment is asked and rests on."""
    parts: dict[int, dict] = {}
    of = {}
    for r in rows.to_pylist():
        parts.setdefault(r["part"], {}).setdefault(r["asked"], []).append((r["rests"], r["total"]))
        of[r["asked"]] = r["part"]
    order, known, chosen = sorted(parts), {None: 0}, {}
    for p in order:
        found = {}
        for out, ways in parts[p].items():
            total, rests = max(((known[d] + t, d) for d, t in ways), key=lambda w: (w[0], w[1] is None, -(w[1] or 0)))
            found[out], chosen[p, out] = total, rests
        known |= found
    path, at, asked = [], len(order) - 1, None
    while at >= 0:
        rests = chosen[order[at], asked]
        path.append((order[at], rows.column("key")[0].as_py(), asked, rests))
        at, asked = (at - 1, None) if rests is None else (order.index(of[rests]), rests)
    columns = list(zip(*path, strict=True))
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["__part", "key", "x", "y"])


def weighted_schedule(df: DataFrame, key: str, item: str, start: str, end: str, weight: str, partitions: int | None = None) -> DataFrame:
    """For each key the intervals of the compatible subset of greatest total weight; touching ones are compatible.

    Intervals are dealt into ranges of (key, end), and a key may lie in many. The best choice of a range rests on the best
    ones up to the range and up to those earlier starts that its intervals have: a small (max, +) matrix, as large as
    intervals overlap where a range begins. The matrices of a key are chained; then each range takes its own part of the
    choice. Keys, items, weights (over 0) and times are whole numbers; an interval doesn't end before it starts.
    """
    names = {"key": key, "item": item, "start": start, "end": end, "weight": weight}
    rows = ranged(df.select(*(F.col(c).cast("long").alias(n) for n, c in names.items())), [F.col(c) for c in ("key", "end", "start", "item")], partitions)
    nothing = F.lit(None).cast("long")
    data = rows.select("__part", "key", F.lit(_ROW).alias("kind"), nothing.alias("x"), nothing.alias("y"), "item", "start", "end", "weight")
    mine = Window.partitionBy("key")  # a row for each range that the key lies in
    told = rows.groupBy("key", "__part").agg(F.max("end").alias("last"))
    told = told.select("key", "__part", "last", F.lag("last").over(mine.orderBy("__part")).alias("prev"), F.count("*").over(mine).alias("n")).where("n > 1")
    fragments = materialize(told, "schedule-fragments")
    heads = fragments.select("__part", "key", F.lit(_FRAGMENT).alias("kind"), F.col("prev").alias("x"), F.col("last").alias("y"))

    def over(f: Callable, controls: DataFrame, fields: list[str], types: list) -> DataFrame:
        both = data.unionByName(controls, allowMissingColumns=True).repartition("__part").sortWithinPartitions("__part", "key", "kind", "end", "start", "item")
        arrow = {pa.int32(): "int", pa.int64(): "long"}
        return both.mapInArrow(_each_part(_by_key(f, fields, types)), ", ".join(f"{n} {arrow[t]}" for n, t in zip(fields, types, strict=True)))

    long = pa.int64()
    asks = over(lambda part, k, own, _c, many, _r: [(k, d) for d in own.deferred] if many else [], heads, ["key", "at"], [long, long]).distinct()
    # Each start belongs to the one range of the key in which the first interval ends after it.
    routed = asks.join(fragments, "key").where("at < last and (prev is null or prev <= at)").select("__part", "key", F.lit(_ASKED).alias("kind"), F.col("at").alias("x"))
    routed = materialize(heads.unionByName(routed, allowMissingColumns=True), "schedule-asked")
    tables = over(lambda part, k, own, asked, many, _r: [(part, k, *m) for m in own.matrix([None, *(c["x"] for c in asked)])] if many else [], routed, ["part", "key", "asked", "rests", "total"], [pa.int32(), long, long, long, long])
    chosen = tables.groupBy("key").applyInArrow(_chain, "__part int, key long, x long, y long").withColumn("kind", F.lit(_CHOSEN))

    def take(part: int, k: int, own: _Fragment, wanted: list[dict], many: bool, table: pa.Table) -> list[tuple]:
        at = sorted({r for c in wanted for r in own.taken(c["x"], c["y"])} if many else own.taken(None, None))
        return [(k, *(table.column(c)[r].as_py() for c in ("item", "start", "end", "weight"))) for r in at]

    out = over(take, heads.unionByName(chosen, allowMissingColumns=True), list(names), [long] * 5)
    return out.withColumnsRenamed(names)


def carried_forward(df: DataFrame, order: Sequence[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """The last known value at or before each row of everything in ``order``, by ranges and what the ranges before end with."""
    rows = ranged(df, order, partitions)
    last = lambda c: F.last(c, ignorenulls=True)
    local = rows.withColumn("__local", last(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("__part").agg(F.max_by("__local", F.struct(*order)).alias("__end"))
    before = ends.select("__part", last("__end").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # one row a range
    return local.join(F.broadcast(before), "__part").withColumn(name, F.coalesce("__local", "__before")).drop("__part", "__local", "__before")


def _each_part(f: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """``f`` over the rows of each range, from rows in order of ``__part``; a range fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("__part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for a, b in pairwise(cuts):
                if rest and rest[0].column("__part")[0].as_py() != part[a]:
                    yield f(pa.Table.from_batches(rest))
                    rest = []
                rest.append(batch.slice(a, b - a))
        if rest:
            yield f(pa.Table.from_batches(rest))

    return run


def _pooled(rows: pa.Table) -> pa.RecordBatch:
    """Neighbours of a range pooled until means don't fall."""
    low, high, total, weight = [], [], [], []
    for a, b, s, w in zip(*(rows.column(c).to_pylist() for c in ("low", "high", "s", "w")), strict=True):
        while low and total[-1] * w >= s * weight[-1]:
            a, s, w = low.pop(), s + total.pop(), w + weight.pop()
            high.pop()
        low.append(a)
        high.append(b)
        total.append(s)
        weight.append(w)
    part = rows.column("__part")[0].as_py()
    return pa.RecordBatch.from_arrays([pa.array([part] * len(low), pa.int32()), *(pa.array(c, pa.float64()) for c in (low, high, total, weight))], ["__part", "low", "high", "s", "w"])


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Non-decreasing least squares of ``y`` over ``x``: ``(x, mean, weight, fitted)`` of each value of ``x``.

    Neighbours whose means fall are pooled within ranges of ``x``; pools are dealt into other ranges and pooled on as long
    as a mean falls from one range to the next. Any order of pooling gives the one best fit, so no task and no driver
    needs all of it; the driver sees the ends of ranges. Rows without x or y are left out, as are weights of 0 or less;
    values are doubles.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = df.select(F.col(x).cast("double").alias("low"), F.col(y).cast("double").alias("y"), w.alias("w")).where("low is not null and y is not null and w > 0 and not isnan(low) and not isnan(y)")
    points = materialize(known.groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").alias("w")), "isotonic-points")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, step = points.select("low", F.col("low").alias("high"), "s", "w"), 0
    while True:
        # Another number of ranges has other bounds, so that what met at a bound lies within one.
        rows = ranged(blocks, [F.col("low")], max(1, parts - step % 2 * (parts // 3)))
        rows = rows.select("__part", "low", "high", "s", "w").repartition("__part").sortWithinPartitions("__part", "low")
        pooled = materialize(rows.mapInArrow(_each_part(_pooled), "__part int, low double, high double, s double, w double"), "isotonic")
        ends = pooled.groupBy("__part").agg(F.count("*").alias("n"), F.min_by(F.struct("s", "w"), "low").alias("first"), F.max_by(F.struct("s", "w"), "low").alias("last")).orderBy("__part").collect()
        blocks = pooled.drop("__part")
        if not any(a["last"]["s"] * b["first"]["w"] > b["first"]["s"] * a["last"]["w"] for a, b in pairwise(ends)):
            break
        step += 1
        if sum(r["n"] for r in ends) <= FEW_POOLS:
            parts = 1
    told = points.select("low", F.lit(1).alias("kind"), "s", "w", F.lit(None).cast("double").alias("fit"))
    told = told.unionByName(blocks.select("low", F.lit(0).alias("kind"), (F.col("s") / F.col("w")).alias("fit")), allowMissingColumns=True)
    fitted = carried_forward(told, [F.col("low"), F.col("kind")], "fit", "fitted").where("kind = 1")
    return fitted.select(F.col("low").alias(x), (F.col("s") / F.col("w")).alias("mean"), F.col("w").alias("weight"), "fitted")


def _next_start(upto: np.ndarray, base: np.ndarray, from_: np.ndarray, most: int) -> np.ndarray:
    """For batches that hold ``upto[k - 1] - base`` before row k: the first row from ``from_`` on that doesn't fit. The
    first row with a size always fits."""
    over = np.searchsorted(upto, base + most, "right")
    filled = np.searchsorted(upto, base, "right") + 1  # the row after the first that has a size
    return np.maximum(np.maximum(over, filled), from_)


def _first_start(upto: np.ndarray, used: int, most: int) -> int:
    """The first row that doesn't fit a batch that holds ``used`` before all of them."""
    over = np.searchsorted(upto, most - used, "right")
    return int(over if used else max(over, np.searchsorted(upto, 0, "right") + 1))


def _fragments(key: str, order: str, size: str, most: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """A range to what its first and its last key tell the ranges after it: the total, the last two places, and for each
    row that can be the first of a batch how full the last batch is then and how many batches begin."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        k, n, place = (rows.column(c).to_numpy() for c in (key, size, order))
        out = []
        bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in dict.fromkeys(((bounds[0], bounds[1]), (bounds[-2], bounds[-1]))):
            upto = np.cumsum(n[a:b], dtype=np.int64)
            before = np.concatenate([[0], upto[:-1]])
            then = np.minimum(_next_start(upto, before, np.arange(1, b - a + 1), most), b - a).tolist()
            used, begun = (upto[-1] - before).tolist(), [1] * (b - a)
            for i in range(b - a - 1, -1, -1):
                if then[i] < b - a:
                    used[i], begun[i] = used[then[i]], 1 + begun[then[i]]
            heads = min(int(np.searchsorted(upto, most, "right")) + 2, b - a)
            out.append((int(k[a]), int(upto[-1]), place[max(a, b - 2) : b].tolist(), upto[:heads].tolist(), used[:heads], begun[:heads]))
        columns = list(zip(*out, strict=True))
        part = rows.column("__part")[0].as_py()
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4)
        return pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["part", "key", "total", "tail", "upto", "used", "begun"])

    return run


def _chained(most: int) -> Callable[[pa.Table], pa.Table]:
    """The fragments of a key, in order of ranges, to how full the open batch is where each begins, and its number."""

    def run(rows: pa.Table) -> pa.Table:
        out, used, batch, tail = [], 0, 0, []
        for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
            out.append((r["part"], used, batch, tail))
            upto = np.array(r["upto"])
            at = _first_start(upto, used, most)
            if at < len(upto):
                used, batch = r["used"][at], batch + r["begun"][at]
            else:
                used += r["total"]
            tail = [*tail, *r["tail"]][-2:]
        columns = list(zip(*out, strict=True))
        return pa.table({"part": pa.array(columns[0], pa.int32()), "used": pa.array(columns[1], pa.int64()), "batch": pa.array(columns[2], pa.int64()), "tail": pa.array(columns[3], pa.list_(pa.int64()))})

    return run


def _numbered(key: str, order: str, size: str, most: int, begins: dict[int, tuple]) -> Callable[[pa.Table], pa.RecordBatch]:
    """The rows of a range with their batches and the two places before; ``begins`` says how its first key goes on."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        k, n, place = (rows.column(c).to_numpy() for c in (key, size, order))
        used, batch, tail = begins.get(rows.column("__part")[0].as_py(), (0, 0, []))
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        end = np.repeat(np.append(first[1:], len(k)), np.diff(np.append(first, len(k))))
        upto = np.cumsum(n, dtype=np.int64)
        before = np.concatenate([[0], upto[:-1]])
        then = np.minimum(_next_start(upto, before, np.arange(1, len(k) + 1), most), end).tolist()
        at = min(_first_start(upto, used, most), int(end[0]))
        starts = []
        while at < len(k):  # the end of a key is the first row of the next one, which begins a batch too
            starts.append(at)
            at = then[at]
        begun = np.zeros(len(k), np.int64)
        begun[starts] = 1
        opened = np.cumsum(begun)
        base = np.repeat(opened[first], np.diff(np.append(first, len(k))))
        number = opened - base
        if len(first):
            number[: end[0]] = opened[: end[0]] + batch
        row = np.arange(len(k))
        since = row - np.repeat(first, np.diff(np.append(first, len(k))))
        lags = []
        for step in (1, 2):
            lag = np.full(len(k), None, object)
            inside = since >= step
            lag[inside] = place[row[inside] - step]
            for i in range(min(step, int(end[0]))):
                if step - i <= len(tail):
                    lag[i] = tail[i - step]
            lags.append(pa.array(lag, pa.int64()))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in (key, order, size)), pa.array(number), *lags], [key, order, size, "batch", "before1", "before2"])

    return run


def greedy_batches(df: DataFrame, key: str, order: str, size: str, most: int, partitions: int | None = None) -> DataFrame:
    """Consecutive rows of a key in batches of at most ``most``, numbered from 0, with the two places before each row. A
    row that doesn't fit opens the next batch; one that is larger than ``most`` is a batch of its own.

    Which row opens the next batch follows from prefix sums, so each row points to the one that would begin after a batch
    begun there. Rows are dealt into ranges, and a key may lie in many: a range tells for each row near its start how full
    its last batch is if a batch begins there. These short tables are chained along a key, and then each range follows
    its own pointers. Keys, places and sizes (0 or more) are whole numbers and not null; a place is in a key once.
    """
    picked = df.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(size).cast("int").alias(size))
    rows = ranged(picked, [F.col(key), F.col(order)], partitions)
    dealt = rows.select("__part", key, order, size).repartition("__part").sortWithinPartitions("__part", key, order)
    told = dealt.mapInArrow(_each_part(_fragments(key, order, size, most)), "part int, key long, total long, tail array<long>, upto array<long>, used array<long>, begun array<long>")
    several = F.count("*").over(Window.partitionBy("key"))  # two rows a range at most
    chained = told.withColumn("n", several).where("n > 1").drop("n").groupBy("key").applyInArrow(_chained(most), "part int, used long, batch long, tail array<long>")
    # A range begins with one key; a row for each range that begins inside one.
    begins = {r["part"]: (r["used"], r["batch"], r["tail"]) for r in chained.where("size(tail) > 0").collect()}
    return dealt.mapInArrow(_each_part(_numbered(key, order, size, most, begins)), f"{key} long, {order} long, {size} int, batch long, before1 long, before2 long")


def paragraph_windows(df: DataFrame, key: str, text: str, sentences: int, salt: str) -> DataFrame:
    """Of each document, whole paragraphs from a hashed start until they hold ``sentences`` sentences."""
    from textloom.operators.sampling import hash_order

    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)
    parts = df.select(key, paragraphs.alias("p")).where("size(p) > 0").select(key, (hash_order(F.col(key), salt) % F.size("p")).alias("start"), F.posexplode("p").alias("at", "paragraph"))
    counted = parts.where("at >= start").withColumn("n", F.size(F.regexp_extract_all("paragraph", F.lit(r"[.!?]+"), 0)))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    grown = counted.withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("upto") < sentences)
    return grown.groupBy(key).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("sentences"))


def within_quotas(windows: DataFrame, books: DataFrame, key: str, book: str, order: str, size: str, total: int) -> DataFrame:
    """Windows in ``order`` (then ``key``) within each book as long as their sizes stay within the book's quota.

    ``books(book, weight)``: a quota is ``total`` by the book's share of all weights, rounded. The running sums are taken
    over ranges of all windows, so that a book may hold most of them.
    """
    rows = windows.withColumn("__at", F.struct(book, order, key))
    summed = running_total(rows, "__at", size, "__upto")
    base = summed.groupBy(book).agg(F.min(F.col("__upto") - F.col(size)).alias("__base"))
    whole = F.broadcast(books.agg(F.sum("weight").alias("__whole")))  # one row
    quota = books.join(whole).select(book, F.round(total * F.col("weight") / F.col("__whole")).cast("long").alias("__quota"))
    kept = summed.join(base, book).join(quota, book).where(F.col("__upto") - F.col("__base") <= F.col("__quota"))
    return kept.drop("__at", "__upto", "__base", "__quota")
