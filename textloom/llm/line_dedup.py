"""Fuzzy line deduplication: minima of character shingles, banded, confirmed by exact Jaccard, and joined by union-find.

Of all lines of the corpus that are alike, directly or over others, the first by (doc_id, line number) stays.

Scale: a line is known by 64 bits, so equal lines are one node, and each task sends a repeated line once per batch.
What lines send (bucket keys, places, texts) is shuffled in ranges of their hashes, many entries to a row, and sorted as
arrays in pieces of about PIECE entries; a range longer than that is cut and hands one entry a key on to its next piece, so a
task holds what is different in a range, however often it repeats. Texts are sent for the lines that are in a bucket, as
told by a map of fixed size; at billions of such lines it is full and most lines are sent. In a bucket all members are compared with one pivot,
which differs from band to band: one row a member. Members still apart after that meet inside their bucket, where no row
is made for a pair (see ``apart``). With 24 bands of 3 minima a pair at the limit of
similarity, 0.75, shares no band with a probability of (1 - 0.75**3)**24, about 1.9e-6, and one of 0.8 with 3e-8. A
pair at 0.75 that only the last meeting compares is lost to its signature with a further 4e-9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.apart import SIGNS, joined_parts, keyed, links_apart, open_members
from textloom.llm.rowkeys import row_keyed, unused
from textloom.operators.components import connected_components
from textloom.plans.materialize import materialize

#: Ranges of hashes are numbered by this many high bits, and sorted in pieces of so many entries.
RANGE_BITS, PIECE = 12, 1 << 20
#: Lines that nobody asks for mostly aren't sent: asked hashes are marked in a map by this many high bits (8 MB, broadcast).
MARK_BITS = 26
#: Bytes of lines that a task sends at once.
LINES_BYTES = 1 << 25
CHARS = 8
BANDS, ROWS = 24, 3
#: Lines are alike at this Jaccard similarity of their character shingles, in hundredths.
SIMILAR = 75

_RNG = np.random.default_rng(20240911)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_SIGN_A = _RNG.integers(1, 1 << 32, SIGNS, np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_SEED = tb.mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
_MARK = "__lines_to_drop"
_BLANK = " \t\n\r\x0b\f"


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with a word of a chunk: row, number within the row, start and end in the bytes, and hash (A-Z lowered)."""
    raw = data.tobytes()
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, breaks + 1]))
    starts, ends = cuts[:-1], cuts[1:] - (data[cuts[1:] - 1] == 10)
    row = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[row])
    full = starts < ends
    for k in np.flatnonzero(full & tb.SPACES[data[starts]]).tolist():
        full[k] = bool(raw[starts[k] : ends[k]].strip())
    row, number, starts, ends = row[full], number[full], starts[full], ends[full]
    lowered = raw.lower()
    digests = [hashlib.blake2b(lowered[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return row, number, starts, ends, np.frombuffer(b"".join(digests), np.int64)


@cache
def _wide_values() -> np.ndarray:
    """A fixed 64-bit value for each character below 2**16: itself if it is ASCII."""
    out = tb.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out[:128] = np.arange(128)
    return out


def _values(code: np.ndarray) -> np.ndarray:
    low = _wide_values()[np.minimum(code, np.uint32(0xFFFF))]
    high = np.flatnonzero(code > 0xFFFF)
    low[high] = tb.mix((code[high].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    return low


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Hashed(NamedTuple):
    """Lines (A-Z lowered) by the hashes of the shingles that start at their characters: of line k those from start[k] to
    before end[k] - CHARS + 1 (other entries mean nothing). A line of fewer characters is one shingle, told in ``whole``."""

    order: np.ndarray  # the lines by start
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    whole: dict[int, np.uint64]


def hashed(lines: list[bytes]) -> Hashed:
    """A shingle is known by the values of its characters, the k-th rotated by k bytes; so eight ASCII ones are their bytes."""
    plain = np.fromiter(map(bytes.isascii, lines), bool, len(lines))
    order = np.argsort(~plain, kind="stable")
    many = int(plain.sum())
    ascii_ = [lines[k] for k in order[:many].tolist()]
    other = [lines[k].lower().decode(errors="replace") for k in order[many:].tolist()]
    size = np.fromiter(map(len, [*ascii_, *other]), np.int64, len(lines))
    end = np.cumsum(size)
    data = b"".join(ascii_).lower() + bytes(CHARS)
    low = np.zeros(int(size.sum()) + 1, np.uint64)
    n = len(data) - CHARS
    low[:n] = np.ndarray((n,), "<u8", data, strides=(1,))
    if other:
        x = np.append(_values(np.frombuffer("".join(other).encode("utf-32-le", "surrogatepass"), np.uint32)), np.zeros(CHARS, np.uint64))
        for k in (1, 2, 4):
            x = x[:-k] ^ _rotated(x[k:], 8 * k)
        low[n:] = x[: len(low) - n]
    at, to = np.empty_like(end), np.empty_like(end)
    at[order], to[order] = end - size, end
    whole = {k: _whole(lines[k]) for k in order[size < CHARS].tolist()}
    return Hashed(order, at, to, tb.mix(low), whole)


def _whole(line: bytes) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(line.lower().decode(errors="replace").encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]


def minima(lines: Hashed, a: np.ndarray) -> np.ndarray:
    """Minima of the products of shingle hashes with odd ``a``, modulo 2**32, over the shingles of lines, (lines, products)."""
    order, start, end, low, whole = lines
    x = low.astype(np.uint32)
    long = np.flatnonzero(end - start >= CHARS)
    for k in range(1, CHARS):  # in place of what reaches into the next line, one of its own shingles again
        x[end[long] - k] = x[start[long]]
    best, y, first = np.empty((len(a), len(order)), np.uint32), np.empty_like(x), start[order]
    x[-1] = x[first[-1]]
    for k in range(len(a)):
        np.multiply(x, a[k], out=y)
        np.minimum.reduceat(y, first, out=best[k])
    out = np.empty((len(order), len(a)), np.uint32)
    out[order] = best.T
    for k, w in whole.items():
        out[k] = np.uint32(w & np.uint64(0xFFFFFFFF)) * a
    return out


def shingles(lines: Hashed) -> list[np.ndarray]:
    """For each line the sorted distinct 64-bit hashes of its shingles."""
    _, start, end, low, whole = lines
    low = low.copy()
    spans = [(i, max(i, j - CHARS + 1)) for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    for i, j in spans:
        low[i:j].sort()
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[start] = True
    return [low[i:j][new[i:j]] if j > i else np.array([whole[k]]) for k, (i, j) in enumerate(spans)]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, bytes, parts of ``split``) of runs of rows."""
    for row, data, offsets in tb.chunks(batch.column("text"), 1 << 16):
        if len(data):
            yield row, data.tobytes(), split(data, offsets)


def _new(ids: np.ndarray, sent: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids that weren't sent before, and where each stands first; they count as sent from now on."""
    ids, which = np.unique(ids, return_index=True)
    fresh = np.array([i not in sent for i in ids.tolist()], bool)
    sent.update(ids[fresh].tolist())
    order = np.argsort(which[fresh])
    return ids[fresh][order], which[fresh][order]


def _keys(low: np.ndarray) -> np.ndarray:
    """Bucket keys (lines, bands) of minima."""
    key = np.zeros((len(low), BANDS), np.uint64) + _BAND_SEED[None, :]
    for k in range(ROWS):
        key = tb.mix(key ^ low[:, k::ROWS].astype(np.uint64))
    return keyed(key)


def _ranges(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of hashes by range, the ranges that occur, and where each begins in that order."""
    of = (hashes.view(np.uint64) >> np.uint64(64 - RANGE_BITS)).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    of = of[order]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return order, of[begin].astype(np.int32), begin


def _binary(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _dealt(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Entries of 64-bit numbers, dealt by the first of them, to one row a range."""
    order, of, begin = _ranges(columns[0])
    entries = np.take(np.stack(columns, axis=1), order, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(of), _binary(entries, np.append(begin, len(order)) * 8 * len(columns))], ["range", "entries"])


def _by_range(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("range").sortWithinPartitions("range", *order)


def _range_of(column: str) -> F.Column:
    return F.shiftrightunsigned(column, 64 - RANGE_BITS).cast("int").alias("range")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        sent: set[int] = set()
        for _, raw, (_, _, starts, ends, all_ids) in _chunks(batch):
            ids, which = _new(all_ids, sent)
            lines = hashed([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            whole = lines.end - lines.start >= CHARS  # shorter ones are alike only if equal
            if not whole.any():
                continue
            key = _keys(minima(lines, _A)[whole])
            held.append((key.ravel(), (ids[whole][:, None] ^ key).ravel()))
            size += key.size
            if size >= PIECE:
                yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
    if held:
        yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)])


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Entries of rows in order of ranges, and whether the range of the last entry goes on in the next piece.

    A piece ends with a range where it can: only a range of more than PIECE entries is cut.
    """
    held: list[bytes] = []
    size, mine, at = 0, 0, -1
    for batch in batches:
        for k, raw in zip(batch.column("range").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            mine = mine if k == at else 0
            if (mine or size) >= PIECE * 8 * width:
                yield np.frombuffer(b"".join(held), np.int64).reshape(-1, width), k == at
                held, size, mine = [], 0, 0
            held.append(raw)
            size, mine, at = size + len(raw), mine + len(raw), k
    if held:
        yield np.frombuffer(b"".join(held), np.int64).reshape(-1, width), False


def _of_last_range(hashes: np.ndarray, last: int) -> np.ndarray:
    shift = np.uint64(64 - RANGE_BITS)
    return hashes.view(np.uint64) >> shift == np.array([last]).view(np.uint64)[0] >> shift


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and flipped ids by range to what ``_buckets`` tells, and whether the bucket may have more than two members.

    A range of several pieces passes on one member of each of its buckets, which the next piece's members meet; a member
    may then be told twice, with different pivots. Only of a bucket in such a range isn't known here how many it has.
    """
    carry = np.zeros((0, 2), np.int64)
    for entries, goes_on in _pieces(batches, 2):
        last, before = entries[-1, 0], carry[:1, 0]
        entries = np.concatenate([carry, entries])
        k, v = np.ascontiguousarray(entries[:, 0]), entries[:, 1]
        # High bits of the key over the place: one sort of numbers brings all but a few different keys apart.
        bits = np.uint64(len(k).bit_length())
        high = (k.view(np.uint64) >> bits) << bits
        high |= np.arange(len(k), dtype=np.uint64)
        high.sort()
        place = (high & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        high >>= bits
        same = high[1:] == high[:-1]
        mine = place[np.append(False, same) | np.append(same, False)]
        mine = mine[np.lexsort((v[mine], k[mine]))]
        for out in _buckets(iter([pa.RecordBatch.from_arrays([pa.array(k[mine]), pa.array(v[mine])], ["key", "flipped"])])):
            key = out.column("key").to_numpy()
            _, of, n = np.unique(key, return_inverse=True, return_counts=True)
            many = n[of] > 2
            for end in [*before.tolist(), *[last] * goes_on]:
                many |= _of_last_range(key, end)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(many)], [*out.schema.names, "many"])
        carry = carry[:0]
        if goes_on:
            tail = entries[_of_last_range(k, last)]
            carry = tail[np.unique(tail[:, 0], return_index=True)[1]]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, flipped) to the members and pivots of buckets of two or more different lines."""
    key, pivot, told, last = None, 0, False, None
    for batch in batches:
        k, v = (batch.column(c).to_numpy() for c in ("key", "flipped"))
        if not len(k):
            continue
        same = np.zeros(len(k), bool)
        same[1:] = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        same[0] = last == (k[0], v[0])
        last = (k[-1], v[-1])
        k, v = k[~same], v[~same]
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key != k[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        lead = np.where(first >= 0, v[np.maximum(first, 0)], pivot)
        member = ~new
        starts = np.flatnonzero(member & np.concatenate([[True], new[:-1]]))  # each first member tells its pivot too
        starts = starts[(first[starts] >= 0) | (not told)]
        keys = np.concatenate([k[member], k[starts]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([v[member], lead[starts]]) ^ keys), pa.array(np.concatenate([lead[member], lead[starts]]) ^ keys)], ["key", "node", "pivot"])
        told = (bool(member[first == first[-1]].any()) or told) if first[-1] < 0 else bool((member & (first == first[-1])).any())
        if first[-1] >= 0:
            pivot = v[first[-1]]
        key = k[-1]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asked nodes in order of ranges to one map a range."""
    marked: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, want in zip(batch.column("range").to_pylist(), batch.column("want").to_pylist(), strict=True):
            if k not in marked and marked:
                yield _packed(marked)
                marked = {}
            bits = marked.setdefault(k, np.zeros(1 << (MARK_BITS - RANGE_BITS), bool))
            bits[_mark(np.frombuffer(want, np.int64)) & (len(bits) - 1)] = True
    if marked:
        yield _packed(marked)


def _packed(marked: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(marked), pa.int32()), pa.array([np.packbits(x).tobytes() for x in marked.values()], pa.binary())], ["range", "bits"])


def _mark(nodes: np.ndarray) -> np.ndarray:
    return (nodes.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _marked_nodes(nodes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = _mark(nodes)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _all_marks(asked: DataFrame) -> np.ndarray:
    """The map of all ranges; its size doesn't depend on the input."""
    width = 1 << (MARK_BITS - RANGE_BITS - 3)
    out = np.zeros(width << RANGE_BITS, np.uint8)
    for r in _by_range(asked).mapInArrow(_marks, "range int, bits binary").toLocalIterator():
        out[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def _texts(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of documents to two kinds of rows a range: the ids of different marked lines of a task with their sizes and
    all their bytes, and entries (node, doc_id, line number, row) of all lines."""
    ids_held: list[np.ndarray] = []
    held: list[bytes] = []
    placed: list[list[np.ndarray]] = []
    size, names = 0, ["range", "nodes", "sizes", "lines", "entries"]

    def dealt() -> Iterator[pa.RecordBatch]:
        places = _dealt([np.concatenate(x) for x in zip(*placed, strict=True)])
        none = pa.nulls(places.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([places.column("range"), none, none, none, places.column("entries")], names)
        ids = np.concatenate(ids_held)
        if not len(ids):
            return
        order, of, begin = _ranges(ids)
        lines = [held[k] for k in order.tolist()]
        sizes, cuts = np.array([len(x) for x in lines], np.int32), np.append(begin, len(order))
        at = np.append(0, np.cumsum(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(of), _binary(ids[order], cuts * 8), _binary(sizes, cuts * 4), _binary(b"".join(lines), at[cuts]), pa.nulls(len(of), pa.binary())], names)

    for batch in batches:
        sent: set[int] = set()
        docs, rows = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
        for first, raw, (row, number, starts, ends, all_ids) in _chunks(batch):
            if not len(all_ids):
                continue
            placed.append([all_ids, docs[first + row], number.astype(np.int64), rows[first + row]])
            asked = np.flatnonzero(_marked_nodes(all_ids, marks))
            ids, which = _new(all_ids[asked], sent)
            which = asked[which]
            ids_held.append(ids)
            held += [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            size += 32 * len(all_ids) + int((ends[which] - starts[which]).sum())
            if size >= LINES_BYTES:
                yield from dealt()
                ids_held, held, placed, size = [], [], [], 0
    if placed:
        yield from dealt()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes to one row a range with the different ones of a task's piece."""
    held: list[np.ndarray] = []

    def dealt() -> pa.RecordBatch:
        ids = np.unique(np.concatenate(held))
        order, of, begin = _ranges(ids)
        return pa.RecordBatch.from_arrays([pa.array(of), _binary(ids[order], np.append(begin, len(order)) * 8)], ["range", "want"])

    for batch in batches:
        held.append(batch.column("node").to_numpy())
        if sum(map(len, held)) >= PIECE:
            yield dealt()
            held = []
    if sum(map(len, held)):
        yield dealt()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted nodes, then what ``_texts`` sent, in order of ranges, to the lines wanted, each once. Entries pass."""
    want, at, names = np.zeros(0, np.int64), -1, ["node", "line", "range", "entries"]
    for batch in batches:
        if not batch.num_rows:
            continue
        passed = batch.filter(batch.column("entries").is_valid())
        if passed.num_rows:
            none = [pa.nulls(passed.num_rows, t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, passed.column("range"), passed.column("entries")], names)
        of = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        nodes_out, lines_out = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if of[a] != at:
                want, at = want[:0], of[a]
            asked = part.column("want").drop_null().to_pylist()
            want = np.union1d(want, np.frombuffer(b"".join(asked), np.int64)) if asked else want
            if not len(want) or len(asked) == b - a:
                continue
            nodes, sizes, lines = (b"".join(part.column(c).drop_null().to_pylist()) for c in ("nodes", "sizes", "lines"))
            nodes, end = np.frombuffer(nodes, np.int64), np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)
            hit = np.flatnonzero(np.isin(nodes, want))
            found, which = np.unique(nodes[hit], return_index=True)
            nodes_out.append(found)
            lines_out += [lines[e - n : e] for e, n in zip(end[hit[which]].tolist(), np.frombuffer(sizes, np.int32)[hit[which]].tolist(), strict=True)]
            want = np.setdiff1d(want, found, assume_unique=True)
        if lines_out:
            none = [pa.nulls(len(lines_out), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes_out)), pa.array(lines_out, pa.binary()), *none], names)


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open lines to their numbers of shingles and signatures: 8 bits of each of SIGNS minima, and all bucket keys."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            lines = hashed(part.column("line").to_pylist())
            low, keys = minima(lines, _SIGN_A), _keys(minima(lines, _A))
            signs = [s.tobytes() + k.tobytes() for s, k in zip((low >> np.uint32(3)).astype(np.uint8), keys, strict=True)]
            n = [len(x) for x in shingles(lines)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n, pa.int32()), pa.array(signs, pa.binary())], ["node", "n", "sign"])


def line_set(line: pa.Scalar) -> np.ndarray:
    return shingles(hashed([line.as_py()]))[0]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two lines reach the similarity, by their distinct shingles."""
    if 100 * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    merged = np.concatenate([x, y])
    merged.sort()
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return 100 * both >= SIMILAR * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            one, two = (part.column(c).to_pylist() for c in ("line_a", "line_b"))
            kinds = list(dict.fromkeys(one + two))  # a pivot stands in many pairs
            sets = dict(zip(kinds, shingles(hashed(kinds)), strict=True))
            ok = [alike(sets[x], sets[y]) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = (texts.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "line_a", "line_b").mapInArrow(_confirmed, "u long, v long")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components and places of lines by range to the places that an earlier equal line takes (no part), and to the first
    place of each line that has a component (with it)."""
    parts: list[tuple[int, int, int]] = []

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_part = batch.column("node").is_valid()
            told = batch.filter(is_part)
            parts.extend(zip(*(told.column(c).to_pylist() for c in ("range", "node", "component")), strict=True))
            yield batch.filter(pc.invert(is_part)).select(["range", "entries"])

    carry = np.zeros((0, 4), np.int64)
    for entries, goes_on in _pieces(places(batches), 4):
        last = entries[-1, 0]
        e = np.concatenate([carry, entries])
        e = e[np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0]))]
        first = np.append(True, e[1:, 0] != e[:-1, 0])
        gone, heads = e[~first], e[first]
        carry = carry[:0]
        if goes_on:
            later = _of_last_range(np.ascontiguousarray(heads[:, 0]), last)
            carry, heads = heads[later], heads[~later]
        # Components come before the places of their range, so those of all but an unfinished range are done with.
        told = np.array([p[1:] for p in parts], np.int64).reshape(-1, 2)
        told = told[np.argsort(told[:, 0])]
        at = np.searchsorted(told[:, 0], heads[:, 0]) if len(told) else np.zeros(0, np.int64)
        if len(told):
            at = np.minimum(at, len(told) - 1)
            of = told[at, 0] == heads[:, 0]
            heads, component = heads[of], told[at[of], 1]
        else:
            heads, component = heads[:0], np.zeros(0, np.int64)
        now = int(np.array([last]).view(np.uint64)[0] >> np.uint64(64 - RANGE_BITS))
        parts[:] = [p for p in parts if p[0] > now or (goes_on and p[0] == now)]
        both = np.concatenate([gone, heads])
        part = pa.array(np.concatenate([np.zeros(len(gone), np.int64), component]), mask=np.arange(len(both)) < len(gone))
        yield pa.RecordBatch.from_arrays([part, pa.array(both[:, 1].copy()), pa.array(both[:, 2].astype(np.int32)), pa.array(both[:, 3].copy())], ["part", "doc_id", "line_no", "row"])


def line_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(row, doc_id, text)`` to ``(node, component)`` of line hashes, for lines that are like another one, and
    ``(range, entries)`` of the places of all lines."""
    banded = rows.select("text").mapInArrow(_bands, "range int, entries binary")
    members = materialize(_by_range(banded).mapInArrow(_members, "key long, node long, pivot long, many boolean"), "line-buckets")
    pairs = members.where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    asked = materialize(members.select("node").mapInArrow(_asked, "range int, want binary"), "line-asked")
    marks = rows.sparkSession.sparkContext.broadcast(_all_marks(asked))
    sent = rows.select("row", "doc_id", "text").mapInArrow(lambda batches: _texts(batches, marks.value), "range int, nodes binary, sizes binary, lines binary, entries binary")
    found = _by_range(sent.unionByName(asked, allowMissingColumns=True), F.col("want").isNull()).mapInArrow(_wanted, "node long, line binary, range int, entries binary")
    found = materialize(found, "line-texts")
    texts, places = found.where("node is not null").select("node", "line"), found.where("entries is not null").select("range", "entries")
    parts = materialize(connected_components(_confirm(pairs, texts)), "line-parts")

    still = open_members(members.where("many"), parts)
    if still.isEmpty():
        return parts, places
    lines = materialize(texts.join(still.select("node").distinct(), "node", "left_semi"), "line-open-texts")
    signs = materialize(lines.select("node", "line").mapInArrow(_signs, "node long, n int, sign binary"), "line-signs")
    return joined_parts(parts, links_apart(still, signs, lines.select("node", F.col("line").alias("full")), line_set, SIGNS, BANDS)), places


def lines_to_drop(rows: DataFrame) -> DataFrame:
    """``rows(row, doc_id, text)`` to ``(row, lines)``: for rows that lose any, the numbers (from 0) of the lines that
    aren't the first by doc_id, line number and row."""
    parts, places = line_components(rows.where("doc_id is not null"))
    told = parts.select(_range_of("node"), "node", "component")
    judged = _by_range(places.unionByName(told, allowMissingColumns=True), F.col("node").isNull()).mapInArrow(_judged, "part long, doc_id long, line_no int, row long")
    judged = materialize(judged, "line-places")
    heads = judged.where("part is not null")
    firsts = heads.groupBy("part").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    later = heads.join(firsts, "part").where((F.col("row") != F.col("first.row")) | (F.col("line_no") != F.col("first.line_no")))
    gone = judged.where("part is null").select("row", "line_no").union(later.select("row", "line_no"))
    return gone.groupBy("row").agg(F.collect_list("line_no").alias("lines"))


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the lines that each row loses, in the column of that name."""
    keyed, key, _ = row_keyed(docs, "line-docs")
    mark = unused(_MARK, keyed.columns)
    gone = lines_to_drop(keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = gone.select(F.col("row").alias(key), F.col("lines").alias(mark))
    return keyed.join(gone.hint("shuffle_hash"), key, "left").select(*docs.columns, mark), mark


def _without(columns: list[str], drop_emptied: bool = False):
    """Texts without the lines told in the column after ``columns``."""
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if gone and text is not None:
                    drop = set(gone)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                texts.append(text)
                keep.append(not (drop_emptied and gone and text is not None and not text.strip(_BLANK)))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(out, batch.schema.names[: len(columns)]).filter(pa.array(keep, pa.bool_()))

    return run


def drop_repeated_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the same columns, and without lines that are like an earlier one.

    Lines without a word stay, as do rows with a null text or doc_id. Rows that lose all lines stay with an empty text,
    or go (``drop_emptied``). Case of A-Z doesn't count; lines shorter than 8 characters are alike only if equal.
    Rows that share a doc_id are documents of their own: of their lines that are alike the one with the least number
    stays, and of equal numbers that of either row. An empty table gives an empty one.
    """
    joined, _ = _marked(docs)
    return joined.mapInArrow(_without(docs.columns, drop_emptied), docs.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the lines that they lose to their counts, and digests of what is left."""
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    for batch in batches:
        full, lost, left = [], [], []
        for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            full.append(sum(1 for x in lines if x.strip()))
            lost.append(len(gone or ()))
            if gone:
                drop = set(gone)
                text = b"\n".join([x for k, x in enumerate(lines) if k not in drop])
            left.append(hashlib.sha256(text or b"").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(full, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.string())], names)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines with a word, lines dropped, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined, _ = _marked(docs)
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


QUERIES = {"op9_line_dedup": op9_line_dedup}
#: Links between all lines: too slow in SQL for whole tables; tests compare with brute force.
ORACLES: dict[str, str] = {}
