"""Exact substring deduplication by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus is removed.

Distribution. In each window of ``LENGTH`` bytes the least hash among its ``CORE``-byte substrings marks an anchor.
Equal windows have equal anchors, so a repeated window is found among the occurrences of one anchor. Anchors that occur
once are dropped. An occurrence stands for a run of windows, those whose anchor it is. Where all runs of an anchor have
one digest they are the same string, and all of it is repeated (two different strings pass for one only if they share
the anchor's 64 bits and 64 bits of a cryptographic digest). The other runs differ somewhere around an equal core, which becomes a single
symbol: what is left of a run is at most SLACK bytes on either side of that symbol. Suffix arrays are built over blocks
of such short strings, all runs of an anchor in one block; two neighbours that agree on SLACK + 1 symbols are equal
windows. A run that occurs more than once in one document is repeated for certain: it is sent once, with the ranges that
its occurrences cover, so that a long text of one letter, or of a short phrase over and over, is a few rows. The runs of
an anchor with more than ``MANY_RUNS`` different ones don't go into one task: each of their windows
is known by a 128-bit digest and counted wherever it is. Both ways give the same rows.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes in descending order with
pointers to the previous smaller suffix, and the order of the groups then gives the order of the suffixes, without
renaming or recursion (Baier, "Linear-time suffix sorting - a new approach for suffix array construction", 2016).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.rowkeys import row_keyed
from textloom.plans.materialize import materialize

LENGTH = 400
SLACK = 128
CORE = LENGTH - SLACK
#: An anchor with more different runs than this has its windows compared by their hashes, wherever they are.
MANY_RUNS = 2_000
#: Symbols of one suffix array.
BLOCK = 200_000


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """First phase: for each suffix the start of its group in suffix order, and its previous smaller suffix (or -1)."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, end = [0] * n, [0] * n, [0] * (n + 1)
    low = 0
    for k, s in enumerate(order):
        place[s] = k
        if text[s] != text[order[low]]:
            end[low] = k
            low = k
        start[s] = low
    if n:
        end[low] = n
    prev = [-1] * n
    high = n
    while high:
        s = order[high - 1]
        low = start[s]
        if high - low == 1:  # one member: the suffix that it points to leaves its group alone
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = prev[j]
            prev[s] = j
            high = low
            if j >= 0 and (last := end[g := start[j]] - 1) > g:
                k, other = place[j], order[last]
                order[k], order[last], place[other], place[j] = other, j, k, last
                end[last], end[g], start[j] = last + 1, last, last
            continue
        times: dict[int, int] = {}
        for s in sorted(order[low:high]):
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = prev[j]
            prev[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        high = low
        if not times:
            continue
        # Suffixes to which more of the group point come later; they leave their groups for one just behind.
        by_times: dict[int, list[int]] = {}
        for j, t in times.items():
            by_times.setdefault(t, []).append(j)
        for t in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for j in by_times[t]:
                g = start[j]
                last = end[g] - 1 - moved.get(g, 0)
                moved[g] = moved.get(g, 0) + 1
                k, other = place[j], order[last]
                order[k], order[last], place[other], place[j] = other, j, k, last
            for g, m in moved.items():
                new = end[g] - m
                if new > g:
                    end[new], end[g] = end[g], new
                    for k in range(new, new + m):
                        start[order[k]] = new
    return start, prev


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last symbol must be smaller than all others."""
    start, prev = lyndon_groups(text)
    n = len(text)
    free, out, placed = list(range(n)), [-1] * n, [False] * n
    if n:
        out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = prev[s]
    return out


def repeated(strings: list[tuple[bytes, bytes, bytes]]) -> list[list[int]]:
    """For strings ``(core, left, right)`` the offsets in ``left`` + core + ``right`` at which repeated windows start.

    A window is SLACK + 1 symbols with the core among them.
    """
    text: list[int] = []
    begin, owner = [], []
    names: dict[bytes, int] = {}
    ends = len(strings)
    first_byte, first_core = ends + 1, ends + 1 + 256
    for k, (core, left, right) in enumerate(strings):
        name = first_core + names.setdefault(core, len(names))
        begin.append(len(text))
        text += [b + first_byte for b in left]
        text.append(name)
        text += [b + first_byte for b in right]
        owner += [k] * (len(text) - len(owner))
        text.append(ends - k)  # a different end for each string, so that no match runs over it
        owner.append(k)
    text.append(0)
    order = suffix_array(text)
    raw = np.array(text, np.int32).tobytes()
    size = 4 * (SLACK + 1)
    found: list[list[int]] = [[] for _ in strings]
    hit = set()
    for a, b in pairwise(order):
        if raw[4 * a : 4 * a + size] == raw[4 * b : 4 * b + size]:
            hit.add(a)
            hit.add(b)
    for a in hit:
        k = owner[a]
        at = a - begin[k]
        left, right = len(strings[k][1]), len(strings[k][2])
        if at <= left and at + SLACK <= left + right:
            found[k].append(at)
    return found


_HIGH = np.uint64(0xFFFFFFFF00000000)
_STIR = np.uint64(0xC4CEB9FE1A85EC53)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor places, their hashes, and the first and last window that each is the anchor of."""
    windows, n = len(data) - LENGTH + 1, len(data) - CORE + 1
    prefix = tb.prefix_hash(data)
    low = prefix[CORE:] - prefix[:-CORE]
    low *= tb.powers(len(data))[1][:n]
    low ^= low >> np.uint64(32)
    low *= _STIR
    # Half of the hash above the place: the least of SLACK + 1 consecutive cores, the leftmost of equals.
    low &= _HIGH
    low |= np.arange(n, dtype=np.uint64)
    width = 1
    while width < SLACK + 1:
        step = min(width, SLACK + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = low[:windows].astype(np.uint32)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [windows - 1]])
    place = at[first].astype(np.int64)
    return place, tb.span_hash(prefix, place, place + CORE).astype(np.int64), first, last


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text (anchor, digest of the run, place, first, last), a run that is there more than once as one of them and
    the ranges that all of them cover (place -1, the first and last window of a range)."""
    place, h, first, last = anchors(data)
    step = 1 << 16  # spans are long, so a slice costs no more than its digests
    run = np.concatenate([tb.identity(data, first[k : k + step], last[k : k + step] + LENGTH) for k in range(0, len(first), step)])
    key = tb.mix(run ^ tb.mix(h.astype(np.uint64)))
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[of] > 1
    if again.any():
        at = np.flatnonzero(again)
        at = at[np.argsort(of[at], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = of[at][1:] != of[at][:-1]
        opens = new.copy()
        opens[1:] |= first[at][1:] > last[at][:-1] + LENGTH
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(at)) - 1
        keep = np.concatenate([np.flatnonzero(~again), at[new]])
        spans = at[begin]
        place = np.concatenate([place[keep], np.full(len(spans), -1)])
        h, run = (np.concatenate([x[keep], x[spans]]) for x in (h, run))
        first, last = np.concatenate([first[keep], first[spans]]), np.concatenate([last[keep], last[at[end]]])
    return h, run.astype(np.int64), place, first, last


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        out: list[list] = [[], [], [], [], []]
        rows: list[int] = []
        for row, data, offsets in tb.chunks(batch.column("text")):
            for r in range(len(offsets) - 1):
                if offsets[r + 1] - offsets[r] < LENGTH:
                    continue
                found = _runs(data[offsets[r] : offsets[r + 1]])
                for k, v in enumerate(found):
                    out[k].append(v)
                rows.append(np.full(len(found[0]), row + r))
        if rows:
            taken = ids.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([taken, *(pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, (np.int64, np.int64, np.int32, np.int32, np.int32), strict=True))], ["doc_id", "anchor", "run", "place", "first", "last"])


_OCCURRENCE = "doc_id long, anchor long, run long, place int, first int, last int"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their open runs to one row each: digests of the run and of its core, and the bytes beside it."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, text, of in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("runs").to_pylist(), strict=True):
            raw = text.as_py()
            for run in of:
                p, a, b = run["place"], run["first"], run["last"] + LENGTH
                row = (doc, a, b, _digest((p - a).to_bytes(4, "little") + raw[a:b]), _digest(raw[p : p + CORE]), raw[a:p], raw[p + CORE : b])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), *(pa.array(c, pa.binary()) for c in out[3:])], ["doc_id", "from", "to", "run", "core", "left", "right"])


#: Sides of runs are compared at multiples of this many bytes before they are sorted.
STEP = 16


def candidates(strings: list[tuple[bytes, bytes, bytes]]) -> list[tuple[int, bytes, bytes, int]]:
    """Of the runs of one core those that can hold a repeated window: (place, left, right, bytes cut from the left).

    A repeated window has between k * STEP and (k + 1) * STEP bytes on the left for some k, so it shares the last
    k * STEP bytes there and the first SLACK - (k + 1) * STEP on the right with another run. What lies a whole step
    beyond the longest shared part of a side is in no repeated window and is cut off.
    """
    shared: dict[tuple, int] = {}
    mine = []
    for _, left, right in strings:
        m, n = len(left), len(right)
        own = [(left[m - k :], right[: SLACK - STEP - k]) for k in range(0, SLACK, STEP) if m >= k and n >= SLACK - STEP - k]
        sides = [(0, left[m - k :]) for k in range(STEP, m + 1, STEP)], [(1, right[:k]) for k in range(STEP, n + 1, STEP)]
        for key in (*own, *sides[0], *sides[1]):
            shared[key] = shared.get(key, 0) + 1
        mine.append((own, sides))
    out = []
    for i, (own, sides) in enumerate(mine):
        if any(shared[key] > 1 for key in own):
            _, left, right = strings[i]
            near, far = (STEP + max((len(x[1]) for x in side if shared[x] > 1), default=0) for side in sides)
            out.append((i, left[max(0, len(left) - near) :], right[:far], max(0, len(left) - near)))
    return out


def _suffix_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of their cores to the windows that are repeated among those of a core; one array per block."""
    strings: list[tuple[bytes, bytes, bytes]] = []
    runs: list[tuple[bytes, int]] = []
    group: list[tuple[bytes, tuple[bytes, bytes, bytes]]] = []
    symbols = 0

    def done() -> pa.RecordBatch:
        found = repeated(strings)
        return pa.RecordBatch.from_arrays([pa.array([r for (r, _), f in zip(runs, found, strict=True) for _ in f], pa.binary()), pa.array([at + cut for (_, cut), f in zip(runs, found, strict=True) for at in f], pa.int32())], ["run", "at"])

    def close() -> None:
        nonlocal symbols
        for i, left, right, cut in candidates([x for _, x in group]):
            run, (core, _, _) = group[i]
            runs.append((run, cut))
            strings.append((core, left, right))
            symbols += len(left) + len(right) + 2
        group.clear()

    for batch in batches:
        for run, core, left, right in zip(*(batch.column(c).to_pylist() for c in ("run", "core", "left", "right")), strict=True):
            if group and group[0][1][0] != core:
                close()
                if symbols >= BLOCK:
                    yield done()
                    strings, runs, symbols = [], [], 0
            group.append((run, (core, left, right)))
    close()
    if strings:
        yield done()


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of crowded cores to one row for each window: a digest of it, and where it is."""
    for batch in batches:
        for run, core, left, right in zip(*(batch.column(c).to_pylist() for c in ("run", "core", "left", "right")), strict=True):
            ats = [a for a in range(len(left) + 1) if a + SLACK <= len(left) + len(right)]
            windows = [_digest((len(left) - a).to_bytes(4, "little") + core + left[a:] + right[: SLACK - (len(left) - a)]) for a in ats]
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array([run] * len(ats), pa.binary()), pa.array(ats, pa.int32())], ["window", "run", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            raw = text.as_py() or b""
            spans = sorted((s["from"], s["to"]) for s in spans.as_py() or [])
            kept, at, n = [], 0, 0
            for a, b in spans:
                if a > at or n == 0:
                    n += 1
                    kept.append(raw[at:a])
                at = max(at, b)
            kept.append(raw[at:])
            rest = b"".join(kept)
            for c, v in zip(out, (len(raw), len(raw) - len(rest), n, rest), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, spans, runs)`` of documents with repeated anchors: byte ranges that are
    repeated for certain, and the runs of anchors whose runs differ."""
    found = docs.mapInArrow(_occurrences, _OCCURRENCE)
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("least"), F.max("run").alias("most")).where("n > 1")
    twice = found.join(counts.select("anchor", (F.col("least") == F.col("most")).alias("same")), "anchor")
    sure, open_ = F.col("same") | (F.col("place") < 0), ~F.col("same") & (F.col("place") >= 0)
    return twice.groupBy("doc_id").agg(
        F.collect_list(F.when(sure, F.struct(F.col("first").alias("from"), (F.col("last") + LENGTH).alias("to")))).alias("spans"),
        F.collect_list(F.when(open_, F.struct("place", "first", "last"))).alias("runs"),
    )


def repeated_spans(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """The ranges to remove by document, from what ``repeated_runs`` found: ``(doc_id, spans)``; ranges may overlap."""
    whole = per_doc.where("size(spans) > 0").select("doc_id", F.explode("spans").alias("span"))
    open_runs = per_doc.where("size(runs) > 0").select("doc_id", "runs").join(docs, "doc_id").select("doc_id", "text", "runs")
    strings = open_runs.mapInArrow(_strings, "doc_id long, from int, to int, run binary, core binary, left binary, right binary")
    kinds = strings.groupBy("run").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("core", "left", "right")))
    kinds = materialize(kinds, "suffix-runs")
    crowd = kinds.groupBy("core").agg(F.count("*").alias("runs"))
    few, many = ((crowd.where(c).select("core")) for c in ((F.col("runs") > 1) & (F.col("runs") <= MANY_RUNS), F.col("runs") > MANY_RUNS))
    sides = kinds.select("run", "core", "left", "right")
    by_array = sides.join(few, "core", "left_semi").repartition("core").sortWithinPartitions("core").select("run", "core", "left", "right").mapInArrow(_suffix_sorted, "run binary, at int")
    every = sides.join(many, "core", "left_semi").select("run", "core", "left", "right").mapInArrow(_single_windows, "window binary, run binary, at int")
    again = every.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    ats = by_array.union(every.join(again, "window", "left_semi").select("run", "at")).groupBy("run").agg(F.collect_set("at").alias("ats"))
    # A run found twice is repeated as a whole; of others, the windows that the arrays found.
    judged = kinds.select("run", "n").join(ats, "run", "left").where("n > 1 or ats is not null")
    judged = materialize(judged, "suffix-judged")
    windows = F.transform("ats", lambda a: F.struct((F.col("from") + a).alias("from"), (F.col("from") + a + LENGTH).alias("to")))
    placed = strings.select("doc_id", "from", "to", "run").join(judged, "run")
    parts = placed.select("doc_id", F.explode(F.when(F.col("n") > 1, F.array(F.struct("from", "to"))).otherwise(windows)).alias("span"))
    return whole.union(parts).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row per document.

    ``kept`` is what is left, as bytes (a cut may fall inside a character). A null text counts as an empty one; texts
    under 400 bytes are never cut. Rows with null or repeated doc_ids are documents of their own, cut by their own text;
    other columns are ignored; an empty table gives none.
    """
    keyed, key, _ = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "suffix-docs")
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    per_doc = materialize(repeated_runs(rows), "suffix-anchors")
    spans = repeated_spans(rows, per_doc).withColumnRenamed("doc_id", key)
    joined = keyed.join(spans, key, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
#: All strings of 400 bytes of whole tables are too many for SQL; tests compare with brute force.
ORACLES: dict[str, str] = {}
