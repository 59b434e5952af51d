"""Links inside buckets between members that are still in different components.

Work is dealt in units of a bucket: a bucket of up to ``UNIT`` members is one, a larger one is cut into blocks, of which
any two make a unit, so a task holds two blocks at most however large a bucket is. No row is made for a pair: a unit
first gives each member the list of partners whose signatures are like its own, then, with the sets of only the members
that have partners, the links that join components (fewer than its members). Signatures have one size, sets don't: for the
second step members are cut into shares of at most ``SHARE`` elements (one larger set is a share of its own), of which
again any two that hold partners make a unit, so long texts don't fill a task either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.components import connected_components
from textloom.plans.materialize import materialize

#: Members of a block.
UNIT = 1024
#: Units of up to FEW members are compared together, PAIRS pairs at once.
FEW, PAIRS = 64, 1 << 12
#: Elements of the sets of a share.
SHARE = 1 << 21
#: Minima of a signature, 8 bits each, and the share of them that a pair of 0.75 has in common but for six deviations.
SIGNS, LEAST_AGREEMENT = 480, 0.63
#: The band of a bucket is in the low bits of its key.
BAND_BITS = 127

_UNIT_KEYS = ["key", "i", "j"]
_SHARE_KEYS = [*_UNIT_KEYS, "k", "l"]


def keyed(hashes: np.ndarray) -> np.ndarray:
    """Bucket keys from 64-bit hashes (rows, bands)."""
    return ((hashes & ~np.uint64(BAND_BITS)) | np.arange(hashes.shape[1], dtype=np.uint64)).astype(np.int64)


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows in the order of ``keys``, cut between units (a batch and a unit at most), and where each unit begins and the last ends."""
    rest: list[pa.RecordBatch] = []

    def told() -> tuple[pa.Table, list[int]]:
        table = pa.Table.from_batches(rest)
        return table, [0, *_cuts(table, keys), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and any(batch.column(c)[0].as_py() != rest[0].column(c)[0].as_py() for c in keys):
            yield told()
            rest = []
        cuts = _cuts(batch, keys)
        if cuts:
            rest.append(batch.slice(0, cuts[-1]))
            yield told()
            rest = []
        rest.append(batch.slice(cuts[-1] if cuts else 0))
    if rest:
        yield told()


def _cuts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> list[int]:
    ids = np.stack([rows.column(c).to_numpy() for c in keys])
    return (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()


def units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each unit, from rows in the order of ``keys``."""
    for table, bounds in whole_units(batches, keys):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(a, b - a)


def partners(start: int, bands: int) -> Callable:
    """Members of units to those with partners. Bytes from ``start`` of a signature tell which of the bands two share."""

    def pairs(unit: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sign = np.frombuffer(b"".join(unit["sign"].to_pylist()), np.uint8).reshape(unit.num_rows, -1)
        head, tail = np.ascontiguousarray(sign[:, :SIGNS]), sign[:, start:].reshape(len(sign), bands, -1)
        part, n, block = (unit[c].to_numpy() for c in ("part", "n", "block"))
        i, j, band = unit["i"][0].as_py(), unit["j"][0].as_py(), unit["key"][0].as_py() & BAND_BITS
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(one), 16):
            x = one[at : at + 16]
            y = two if i != j else two[two > x[0]]
            apart = part[x][:, None] != part[y][None, :]
            if i == j:
                apart &= x[:, None] < y[None, :]
            apart &= 100 * np.minimum(n[x][:, None], n[y]) >= 75 * np.maximum(n[x][:, None], n[y])
            if not apart.any():
                continue
            equal = head[x][:, None, :] == head[y][None, :, :]
            common = np.bitwise_count(equal.view(np.uint64)).sum(axis=2, dtype=np.uint16)
            a, b = np.nonzero(apart & (common >= LEAST_AGREEMENT * SIGNS))
            a, b = x[a], y[b]
            shared = (tail[a] == tail[b]).all(axis=2)
            mine = shared[:, band] & (shared.argmax(axis=1) == band)  # a pair belongs to the first band that it shares
            found.append((a[mine], b[mine]))
        return (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def small(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Members of units of one block and one share, each with the end of its unit: all pairs, PAIRS at once."""
        sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        head, tail = np.ascontiguousarray(sign[:, :SIGNS]), sign[:, start:].reshape(len(sign), bands, -1)
        part, n, band = rows["part"].to_numpy(), rows["n"].to_numpy(), rows["key"].to_numpy() & BAND_BITS
        others = ends - np.arange(len(ends)) - 1
        upto = np.cumsum(others)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(at, to), others[at:to])
            b = a + 1 + np.arange(len(a)) - np.repeat(upto[at:to] - others[at:to] - (upto[at] - others[at]), others[at:to])
            at = to
            ok = (part[a] != part[b]) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            common = np.bitwise_count((head[a] == head[b]).view(np.uint64)).sum(axis=1, dtype=np.uint16)
            ok = common >= LEAST_AGREEMENT * SIGNS
            a, b = a[ok], b[ok]
            shared = (tail[a] == tail[b]).all(axis=2)
            mine = shared[np.arange(len(a)), band[a]] & (shared.argmax(axis=1) == band[a])
            found.append((a[mine], b[mine]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            node, kept = rows["node"].to_numpy(), np.unique(np.concatenate([a, b]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(a, kept), len(a)), pa.int32()), pa.array(node[b]))
            ids = [pa.array(rows[c].to_numpy()[kept]) for c in _UNIT_KEYS] + [pa.array(np.zeros(len(kept), np.int32))] * 2
            yield pa.RecordBatch.from_arrays([*ids, pa.array(node[kept]), pa.array(part[kept]), lists], [*_SHARE_KEYS, "node", "part", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_units(batches, _UNIT_KEYS):
            begin, size = np.array(bounds[:-1]), np.diff(bounds)
            few = (size <= FEW) & (table["i"].to_numpy() == table["j"].to_numpy())[begin]
            few &= np.add.reduceat(table["n"].to_numpy().astype(np.int64), begin) <= SHARE
            if few.any():
                yield from small(table.filter(pa.array(np.repeat(few, size))), np.repeat(np.cumsum(size[few]), size[few]))
            for k in np.flatnonzero(~few).tolist():
                yield from large(table.slice(bounds[k], int(size[k])))

    def large(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = pairs(unit)
        if not len(a):
            return
        node, part = unit["node"].to_numpy(), unit["part"].to_numpy()
        share = shares(unit["n"].to_numpy(), np.unique(np.concatenate([a, b])))
        k, l = np.minimum(share[a], share[b]), np.maximum(share[a], share[b])
        order = np.lexsort((a, l, k))
        a, b, k, l = a[order], b[order], k[order], l[order]
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (l[1:] != l[:-1])) + 1).tolist(), len(a)]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = a[first:end], b[first:end]
            rows = np.unique(np.concatenate([x, y]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.searchsorted(x, rows), [len(x)]]), pa.int32()), pa.array(node[y]))
            ids = [*(unit[c][0].as_py() for c in _UNIT_KEYS), int(k[first]), int(l[first])]
            same = [pa.array(np.full(len(rows), v), pa.int64() if c == "key" else pa.int32()) for c, v in zip(_SHARE_KEYS, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(node[rows]), pa.array(part[rows]), lists], [*_SHARE_KEYS, "node", "part", "partners"])

    return run


def shares(n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The share of each of ``rows``, whose sets have ``n`` elements: no share has more than SHARE, but for a single set."""
    share, at, held = np.zeros(len(n), np.int32), 0, 0
    for row in rows.tolist():
        if held and held + n[row] > SHARE:
            at, held = at + 1, 0
        share[row] = at
        held += int(n[row])
    return share


def joining_links(as_set: Callable) -> Callable:
    """Members with partners and sets to the links that join components of the unit. ``as_set`` makes a value of ``full``
    an array of distinct elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, _SHARE_KEYS):
            node, part = unit["node"].to_pylist(), unit["part"].to_pylist()
            up = {p: p for p in part}

            def top(p: int, up: dict = up) -> int:
                while up[p] != p:
                    up[p] = p = up[up[p]]
                return p

            part_of, full = dict(zip(node, part, strict=True)), dict(zip(node, unit["full"], strict=True))
            sets: dict[int, np.ndarray] = {}
            links = []
            for x, ys in zip(node, unit["partners"].to_pylist(), strict=True):
                for y in ys:
                    if top(part_of[x]) == top(part_of[y]):
                        continue
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = as_set(full[z])
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                        up[top(part_of[x])] = top(part_of[y])
                        links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``(key, size, node, part)`` of buckets of three or more whose members are in different components."""
    placed = members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2")
    return materialize(placed.join(split.select("key", "size"), "key"), "open")


def links_apart(still: DataFrame, signs: DataFrame, full: DataFrame, as_set: Callable, start: int, bands: int) -> DataFrame:
    """Links (u, v) that join different parts of the buckets of ``still(key, size, node, part)``.

    ``signs(node, n, sign)`` are signatures with the sizes of the sets, ``full(node, full)`` what ``as_set`` makes arrays of.
    """
    blocks = F.ceil(F.col("size") / UNIT).cast("int")
    dealt = still.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part").join(signs, "node")
    rows = dealt.select(*_UNIT_KEYS, "block", "node", "part", "n", "sign").repartition(*_UNIT_KEYS).sortWithinPartitions(*_UNIT_KEYS)
    met = materialize(rows.mapInArrow(partners(start, bands), "key long, i int, j int, k int, l int, node long, part long, partners array<long>"), "partners")
    rows = met.join(full, "node").select(*_SHARE_KEYS, "node", "part", "partners", "full").repartition(*_SHARE_KEYS).sortWithinPartitions(*_SHARE_KEYS)
    return rows.mapInArrow(joining_links(as_set), "u long, v long")


def joined_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links (u, v); those found before stand in for the links that they came from."""
    links = materialize(links, "more-links")
    if links.isEmpty():
        return parts
    edges = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)
    return materialize(connected_components(edges), "parts")
