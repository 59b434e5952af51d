"""SentencePiece encoding and decoding as the shortest path through a weighted transducer.

``compile_model`` turns a vocabulary file into tables of arcs. The normaliser reads a character and writes a symbol
(white space becomes U+2581, and one is written in front of a text); the pieces are a tree of states, each arc reading
one symbol, and a state that ends a piece has an arc back to the start that writes the piece's id and weighs its
negated score; a character without a piece has an arc that writes its bytes. An input is composed with these tables
place by place, and the ids are those of the path of least weight (weights add up along a path, the least wins: the
tropical semiring).

For a BPE model the transducer also keeps the last piece, and an arc whose two pieces wouldn't stay apart when their
letters are merged by rank weighs infinity (such arcs are judged when a composition first meets them). A path of finite
weight is then the model's own segmentation, since merges between two pieces depend on these two alone; each place has
one such path. For a unigram model no pair is forbidden and the scores decide.

Where no piece holds a blank after another character, runs from blank to blank are composed by themselves, many at
once in arrays, and remembered. Longer runs than ``BLOCK_CHARS`` are composed one by one over the same tables.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import textbytes as tb

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, BPE = 1, 2
#: Runs remembered by a worker; beyond it the memory is emptied and filled anew.
REMEMBERED = 500_000
#: Pairs of pieces remembered by a worker (each place holds the latest).
PAIRS = 1 << 20
#: Runs of so many characters at most are composed in arrays, so many at once.
BLOCK_CHARS, BLOCK_RUNS = 48, 20_000
#: Characters of the texts that are encoded together.
SLICE_CHARS = 1 << 21
_BYTE_COST = 1e6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffers message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + n])[0]
            at += n


@dataclass(frozen=True)
class Arcs:
    """The tables of one transducer. Pieces are known by their ids, -1 is none."""

    bpe: bool
    prefix: str  # what the normaliser puts in front of a text
    runs: str  # pattern of the runs that are composed by themselves
    names: list[str]  # text of each piece; empty if no text gives it
    symbol: np.ndarray  # normaliser: the symbol of each code point, 0 if no piece has it
    single: np.ndarray  # whether a symbol is a piece by itself; others have byte arcs
    base: np.ndarray  # arc of state s over symbol c: place base[s] + c, if that place is owned by s
    owner: np.ndarray
    target: np.ndarray
    ends: np.ndarray  # the piece that a state ends
    cost: np.ndarray  # of each piece
    bytes: np.ndarray  # piece of each byte
    made: np.ndarray  # rank of the merge that makes a piece, -1 for characters
    left: np.ndarray  # what that merge joins
    right: np.ndarray
    stable: np.ndarray  # whether a piece's own letters merge to it
    plain: np.ndarray  # whether all merges below it come in order of their ranks
    pair_keys: np.ndarray  # left * pieces + right of any two pieces that join to one, sorted
    pair_makes: np.ndarray
    raw: np.ndarray  # decoded bytes of all pieces in a row, and where each stands
    raw_at: np.ndarray
    raw_size: np.ndarray


def merged(score: dict[str, float], text: str) -> tuple[list[str], tuple[str, str] | None]:
    """Merges by score, the leftmost of equals first, until no two neighbours form a piece; and the last merge."""
    parts, latest = list(text), None
    while True:
        best, where = None, -1
        for k in range(len(parts) - 1):
            found = score.get(parts[k] + parts[k + 1])
            if found is not None and (best is None or found > best):
                best, where = found, k
        if best is None:
            return parts, latest
        latest = (parts[where], parts[where + 1])
        parts[where : where + 2] = [parts[where] + parts[where + 1]]


def _packed(children: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs of all states in one array: each state gets a base at which all its symbols find free places."""
    owner: list[int] = [-1] * (symbols + 1)
    target, base = [0] * len(owner), [0] * len(children)
    hint = 0  # below it few places are free
    for s in sorted(range(len(children)), key=lambda s: -len(children[s])):
        arcs = children[s]
        if not arcs:
            break
        least, tries = min(arcs), 0
        at = max(hint, least)
        while True:
            if at + symbols >= len(owner):
                owner += [-1] * (symbols + 1000)
                target += [0] * (symbols + 1000)
            if owner[at] < 0 and all(owner[at - least + c] < 0 for c in arcs):
                break
            at += 1
            tries += 1
        if tries > 20:
            hint = at - 10
        base[s] = at - least
        for c, to in arcs.items():
            owner[base[s] + c], target[base[s] + c] = s, to
    owner += [-1] * (symbols + 1)  # a look-up may go past the last arc
    target += [0] * (symbols + 1)
    return np.array(base, np.int32), np.array(owner, np.int32), np.array(target, np.int32)


def compile_model(proto: bytes) -> Arcs:
    """The transducer of a model file: normaliser, pieces and byte fallback."""
    pieces, kind, prefix, escape = [], UNIGRAM, True, True
    for number, value in _fields(proto):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            normal = dict(_fields(value))
            if normal.get(2) or normal.get(4, 1):
                raise ValueError("only models with the identity normaliser that keep all white space are supported")
            prefix, escape = bool(normal.get(3, 1)), bool(normal.get(5, 1))
    byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
    if kind not in (UNIGRAM, BPE) or len(byte_ids) != 256:
        raise ValueError("only unigram and BPE models with byte fallback are supported")
    ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)}
    score = {p: pieces[i][1] for p, i in ids.items()}
    n = len(pieces)

    letters = {c: k + 1 for k, (c, _) in enumerate(Counter(c for p in ids for c in p).most_common())}
    symbol = np.zeros(0x110000, np.int32)
    for c, k in letters.items():
        symbol[ord(c)] = k
    if escape:
        symbol[ord(" ")] = symbol[ord(BLANK)]
    single = np.zeros(len(letters) + 1, bool)
    single[[letters[p] for p in ids if len(p) == 1]] = True
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for p, i in ids.items():
        state = 0
        for c in p:
            to = children[state].get(letters[c])
            if to is None:
                to = children[state][letters[c]] = len(children)
                children.append({})
                ends.append(-1)
            state = to
        ends[state] = i
    base, owner, target = _packed(children, len(letters))

    made, left, right = np.full(n, -1), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    stable, plain = np.ones(n, bool), np.ones(n, bool)
    pairs: dict[int, int] = {}
    if kind == BPE:
        for rank, p in enumerate(sorted(ids, key=lambda p: -score[p])):
            i = ids[p]
            if len(p) > 1:
                made[i] = rank
                parts, last = merged(score, p)
                stable[i] = len(parts) == 1
                if stable[i]:
                    left[i], right[i] = (ids.get(x, -1) for x in last)
                for k in range(1, len(p)):
                    if p[:k] in ids and p[k:] in ids:
                        pairs[ids[p[:k]] * n + ids[p[k:]]] = i
        times = Counter(s for p, s in score.items() if len(p) > 1)
        for i in np.argsort(made, kind="stable").tolist():
            if made[i] >= 0:  # ranks don't say which of two equal scores goes first
                plain[i] = stable[i] and times[pieces[i][1]] == 1 and min(left[i], right[i]) >= 0 and plain[left[i]] and plain[right[i]] and max(made[left[i]], made[right[i]]) < made[i]
    keys = np.array(sorted(pairs), np.int64)

    blanks = f" {BLANK}" if escape else BLANK
    barriers = "" if any("\n" in p for p in ids) else "\n"
    whole = any(BLANK in p.lstrip(BLANK) for p in ids)
    raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() if k in (NORMAL, USER_DEFINED) else b"" for p, _, k in pieces]
    size = np.array([len(r) for r in raw], np.int64)
    return Arcs(
        kind == BPE, " " if prefix and escape else BLANK if prefix else "", r"(?s).+" if whole else f"[{blanks}]*[^{blanks}{barriers}]+|[{blanks}]+|\n", [p if k in (NORMAL, USER_DEFINED) else "" for p, _, k in pieces],
        symbol, single, base, owner, target, np.array(ends, np.int32), -np.array([s for _, s, _ in pieces]), np.array([byte_ids[b] for b in range(256)], np.int32),
        made.astype(np.int32), left, right, stable, plain, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1], size,
    )


class Transducer:
    """Composes texts with the tables of ``arcs``; remembers runs and pairs."""

    def __init__(self, arcs: Arcs) -> None:
        self.arcs = arcs
        self.runs = re.compile(arcs.runs)
        self.known: dict[str, bytes] = {}
        self.score = {p: -arcs.cost[i] for i, p in enumerate(arcs.names) if p}
        self.pairs = np.full(PAIRS, -1, np.int64)
        self.finite = np.zeros(PAIRS, bool)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of two pieces by rank gives the two pieces.

        Backwards in time: of the two neighbours the one that was made last is taken apart again, and the halves that
        were neighbours before mustn't join to a piece of a lower rank than that merge.
        """
        x, n = self.arcs, len(self.arcs.names)
        out = np.ones(len(a), bool)
        odd = np.flatnonzero(~(x.plain[a] & x.plain[b]))
        for k in odd.tolist():
            two = [x.names[a[k]], x.names[b[k]]]
            out[k] = merged(self.score, "".join(two))[0] == two
        live = np.flatnonzero(x.plain[a] & x.plain[b])
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), len(x.names) + 1)
        while len(live):
            key = a[live].astype(np.int64) * n + b[live]
            at = np.minimum(np.searchsorted(x.pair_keys, key), max(len(x.pair_keys) - 1, 0))
            joined = x.pair_keys[at] == key if len(x.pair_keys) else np.zeros(len(key), bool)
            bad = joined & (x.made[x.pair_makes[at]] < limit[live]) if len(x.pair_keys) else joined
            out[live[bad]] = False
            live = live[~bad]
            of_a, of_b = x.made[a[live]], x.made[b[live]]
            back = of_a > of_b
            one, two = live[back], live[~back & (of_b >= 0)]
            limit[one], a[one] = x.made[a[one]], x.right[a[one]]
            limit[two], b[two] = x.made[b[two]] + 1, x.left[b[two]]
            live = np.concatenate([one, two])
        return out

    def allowed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the arc of ``piece`` has finite weight after ``last`` (-1 for the start or a byte arc)."""
        if not self.arcs.bpe:
            return np.ones(len(piece), bool)
        n = len(self.arcs.names)
        key = (last.astype(np.int64) + 1) * n + piece
        at = (tb.mix(key.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out, strange = self.finite[at], np.flatnonzero(self.pairs[at] != key)
        if len(strange):
            new, which = np.unique(key[strange], return_inverse=True)
            before, after = new // n - 1, (new % n).astype(np.int64)
            found = self.arcs.stable[after]
            two = np.flatnonzero(found & (before >= 0))
            found[two] = self.stay_apart(before[two], after[two])
            to = (tb.mix(new.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
            self.pairs[to], self.finite[to] = new, found
            # Where two new pairs share a place the later one stays in both arrays.
            out[strange] = found[which]
        return out

    def shortest_paths(self, runs: list[str]) -> list[bytes]:
        """Ids of the shortest path over each of some runs, composed place by place in arrays."""
        x = self.arcs
        size = np.array([len(r) for r in runs])
        width = int(size.max())
        code = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)
        read = np.zeros((len(runs), width), np.int32)
        read[np.arange(width) < size[:, None]] = x.symbol[code]
        cost = np.full((len(runs), width + 1), np.inf)
        cost[:, 0] = 0
        last = np.full((len(runs), width + 1), -1, np.int32)
        step = np.zeros((len(runs), width + 1), np.int32)

        def reach(rows: np.ndarray, to: int, total: np.ndarray, piece: np.ndarray | int, by: int) -> None:
            cost[rows, to], last[rows, to], step[rows, to] = total, piece, by

        for i in range(width):
            rows = np.flatnonzero((size > i) & np.isfinite(cost[:, i]))
            here, before = cost[rows, i], last[rows, i]
            at, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, width):
                more = size[rows[at]] > j
                at, state = at[more], state[more]
                place = x.base[state] + read[rows[at], j]
                on = x.owner[place] == state
                at, state = at[on], x.target[place[on]]
                if not len(at):
                    break
                ending = np.flatnonzero(x.ends[state] >= 0)
                k, piece = at[ending], x.ends[state[ending]]
                total = here[k] + x.cost[piece]
                better = np.flatnonzero(total < cost[rows[k], j + 1])
                better = better[self.allowed(before[k[better]], piece[better])]
                reach(rows[k[better]], j + 1, total[better], piece[better], j + 1 - i)
            spelled = np.flatnonzero(~x.single[read[rows, i]])
            spelled = spelled[here[spelled] + _BYTE_COST < cost[rows[spelled], i + 1]]
            reach(rows[spelled], i + 1, here[spelled] + _BYTE_COST, -1, 1)

        ids, count, at = np.zeros((len(runs), width), np.int32), np.zeros(len(runs), np.int64), size.copy()
        bytes_in = np.zeros(len(runs), bool)
        rows = np.arange(len(runs))
        while len(rows):
            piece = last[rows, at[rows]]
            bytes_in[rows[piece < 0]] = True
            count[rows] += 1
            ids[rows, width - count[rows]] = piece
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        flat = ids.tobytes()
        end = (np.arange(len(runs)) + 1) * width * 4
        out = [flat[a:b] for a, b in zip((end - 4 * count).tolist(), end.tolist(), strict=True)]
        for k in np.flatnonzero(bytes_in).tolist():
            out[k] = self._spelled(runs[k], np.frombuffer(out[k], np.int32))
        return out

    def _spelled(self, run: str, path: np.ndarray) -> bytes:
        """Ids of a path in which -1 stands for the bytes of one character."""
        out, at = [], 0
        for piece in path.tolist():
            out.append(self.arcs.bytes[list(run[at].encode())] if piece < 0 else np.array([piece], np.int32))
            at += 1 if piece < 0 else len(self.arcs.names[piece])
        return np.concatenate(out).astype(np.int32).tobytes()

    def long_path(self, run: str) -> bytes:
        """Ids of the shortest path over one long run, place by place."""
        x, n = self.arcs, len(run)
        read = x.symbol[np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cost = np.full(n + 1, np.inf)
        cost[0] = 0
        last, step = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        for i in range(n):
            if np.isinf(cost[i]):
                continue
            state, ahead = 0, []
            for j in range(i, n):
                place = x.base[state] + read[j]
                if x.owner[place] != state:
                    break
                state = x.target[place]
                if x.ends[state] >= 0 and cost[i] + x.cost[x.ends[state]] < cost[j + 1]:
                    ahead.append((j + 1, x.ends[state]))
            if ahead:
                to, piece = (np.array(c) for c in zip(*ahead, strict=True))
                fine = self.allowed(np.full(len(piece), last[i]), piece)
                to, piece = to[fine], piece[fine]
                cost[to], last[to], step[to] = cost[i] + x.cost[piece], piece, to - i
            if not x.single[read[i]] and cost[i] + _BYTE_COST < cost[i + 1]:
                cost[i + 1], last[i + 1], step[i + 1] = cost[i] + _BYTE_COST, -1, 1
        path, at = [], n
        while at:
            path.append(int(last[at]))
            at -= int(step[at])
        return self._spelled(run, np.array(path[::-1]))

    def learn(self, runs: set[str]) -> None:
        """Composes runs that aren't known."""
        if len(self.known) + len(runs) > REMEMBERED:
            self.known.clear()
        new = sorted(runs.difference(self.known), key=len)
        short = next((k for k, r in enumerate(new) if len(r) > BLOCK_CHARS), len(new))
        for at in range(0, short, BLOCK_RUNS):
            some = new[at : min(short, at + BLOCK_RUNS)]
            self.known.update(zip(some, self.shortest_paths(some), strict=True))
        for run in new[short:]:
            self.known[run] = self.long_path(run)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as int32 bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= SLICE_CHARS:
                size += len(texts[end])
                end += 1
            if size > SLICE_CHARS:  # one very long text: some runs at a time
                found, parts = self.runs.finditer(self.arcs.prefix + texts[at]), []
                while some := [m[0] for m in islice(found, SLICE_CHARS >> 3)]:
                    parts += self._ids([some])
                out.append(b"".join(parts))
            else:
                out += self._ids([self.runs.findall(self.arcs.prefix + t) if t else [] for t in texts[at:end]])
            at = end
        return out

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        runs = set().union(*split)
        self.learn(runs)
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for run in runs:
            if len(run) > BLOCK_CHARS:
                del self.known[run]
        return out

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 bytes of each text's ids."""
        x, counts = self.arcs, [len(t) for t in texts]
        ids = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
        size = x.raw_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = x.raw[np.repeat(x.raw_at[ids] - (ends - size), size) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].tolist()
        out = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [t[1:] if x.prefix and t[:1] == b" " else t for t in out]


_BUILT: dict[int, tuple[Arcs, Transducer]] = {}


def _transducer(shared) -> Transducer:
    """The transducer of a broadcast model; a worker keeps the latest over its tasks."""
    arcs = shared.value
    found = _BUILT.get(0)
    if found is None or found[0] is not arcs:
        found = _BUILT[0] = (arcs, Transducer(arcs))
    return found[1]


def _encoded(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _transducer(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(i, np.int32) for i in model.encode(texts)]
                same = [got == text.encode() for got, text in zip(model.decode(ids), texts, strict=True)]
                sizes = [len(i) for i in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "piece_ids", "round_trip"])

    return run


def _decoded(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _transducer(shared)
        for batch in batches:
            rows = batch.column("piece_ids").to_pylist()
            out = model.decode([np.array(r or [], np.int64) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if r is None else t.decode(errors="replace") for r, t in zip(rows, out, strict=True)], pa.string())], ["doc_id", "text"])

    return run


def _model_file(spark: SparkSession, path: str):
    """The arcs of a vocabulary file (some hundred KB; its tables are a few MB), compiled by the driver and broadcast."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(compile_model(file.read()))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_pieces, piece_ids, round_trip)``, one row per row.

    A null or empty text has no pieces. ``round_trip`` tells whether decoding gives the text back, which fails only
    for texts that hold U+2581 itself. Rows with a null or repeated doc_id are encoded like others. Other columns are
    ignored; an empty table gives an empty result.
    """
    shared = _model_file(docs.sparkSession, model_path)
    return docs.select("doc_id", "text").mapInArrow(_encoded(shared), "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``(doc_id, piece_ids, ...)`` to ``(doc_id, text)``; null ids give a null text."""
    shared = _model_file(encoded.sparkSession, model_path)
    return encoded.select("doc_id", "piece_ids").mapInArrow(_decoded(shared), "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
#: Tests compare with the sentencepiece library and with merging by rank, and check the round trip.
ORACLES: dict[str, str] = {}
