"""Scores of a smoothed n-gram language model, read off a weighted backoff automaton.

States are the n-grams of fewer than ``ORDER`` tokens that occur in the rows to learn from, the empty one included. The
arc of state h for token w is there if hw occurs; it weighs log10 P(w | h) and leads to the longest state that ends
what was read. Any other token takes the failure arc, which leads to h without its first token. With counts c and a
prior of weight mu (hierarchical Dirichlet, MacKay and Peto 1995)

    P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu)        the failure arc weighs log10(mu / (c(h) + mu))
    P(w)     = (c(w) + 1) / (N + V + 1)                      unknown tokens share one arc

so the probabilities after each state add up to 1. One traversal from left to right carries the state and adds weights.

Scale: the model grows with the corpus, so no task holds it. Documents are put into blocks of bounded size. A block
sends its different n-grams, packed, to ranges of their 64-bit hashes; a range adds up the counts and answers each block
with the totals of just those n-grams, in their order. With them the block has the part of the automaton that its own
documents can reach, and walks it. So each different n-gram of a block is shuffled once, as some seven bytes, and answered
with a byte or less, and neither frequent words nor frequent documents make a large task. The driver gets two numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.labelled import in_fold
from textloom.plans.materialize import materialize

ORDER = 3
#: Weight of the shorter context's probability, in tokens.
PRIOR = 5.0
#: Tokens of a block (a longer document is a block of its own), and n-grams of a range at most, as it is planned.
BLOCK_TOKENS, RANGE_KEYS = 1 << 21, 1 << 21
#: Tokens of a lane of the traversal.
LANE = 512
_END = tb.mix(np.array([0x5EAF00D], np.uint64))
_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers to bytes: all lowest bytes, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True) if len(values) else b""


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts to the hashes of their tokens (lower-cased words, then an end each) and tokens of each text."""
    for _, data, offsets in tb.chunks(texts):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        yield np.insert(tb.identity(data, starts, ends), first[1:], _END[0]), np.diff(first) + 1


_BLOCK = "doc_ids array<long>, learns array<boolean>, lengths array<long>, words binary, ranks binary, tokens binary, n_tokens long, n_learned long"


def _blocks(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learns, lengths, parts, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            n, learned = np.concatenate(lengths), np.concatenate(learns)
            words, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            rank = np.argsort(np.argsort(-times, kind="stable"))  # frequent words get small numbers, which pack well
            listed = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())), listed(learned, pa.bool_()), listed(n, pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in (np.diff(words, prepend=np.uint64(0)), rank, rank[which])), pa.array([int(n.sum())]), pa.array([int(n[learned].sum())])],
                ["doc_ids", "learns", "lengths", "words", "ranks", "tokens", "n_tokens", "n_learned"],
            )

        for batch in batches:
            row, doc_ids, learn = 0, batch.column("doc_id").to_pylist(), batch.column("learns").to_numpy(zero_copy_only=False).astype(bool)
            for hashes, counts in tokens(batch.column("text")):
                ids.append(doc_ids[row : row + len(counts)])
                learns.append(learn[row : row + len(counts)])
                lengths.append(counts)
                parts.append(hashes)
                row, size = row + len(counts), size + len(hashes)
                if size >= most:
                    yield block()
                    ids, learns, lengths, parts, size = [], [], [], [], 0
        if ids:
            yield block()

    return run


def grams(hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``size`` tokens that lie in one document: place of the last token, and hash."""
    ends = np.cumsum(lengths)
    start = np.repeat(ends - lengths, lengths)
    at = np.arange(size - 1, len(hashes))
    at = at[at - start[at] >= size - 1]
    return at, hashes[at] if size == 1 else tb.windows(hashes, size)[at - size + 1]


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of the hashes each key lies in; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _sent(order: int, ranges: int) -> Callable:
    """Blocks to their different n-grams by range: (size, range, block, n-grams, how often each occurs to learn from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, lengths, learns in _opened(batch):
                learned = np.repeat(learns, lengths)
                for size in range(1, order + 1):
                    at, keys = grams(hashes, lengths, size)
                    kinds, which = np.unique(keys, return_inverse=True)
                    times = np.bincount(which, learned[at], len(kinds)).astype(np.uint64)
                    cuts = np.searchsorted(range_of(kinds, ranges), np.arange(ranges + 1))
                    filled = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                    parts = [(pack(np.diff(kinds[cuts[r] : cuts[r + 1]], prepend=np.uint64(0))), pack(times[cuts[r] : cuts[r + 1]])) for r in filled]
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(filled), pa.int32()), pa.array(filled, pa.int64()), pa.array([block] * len(filled), pa.int64()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))], ["size", "range", "block", "keys", "times"])

    return run


def _opened(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, token hashes, tokens of each document, whether it is learned from) of rows of blocks."""
    columns = ("block", "words", "ranks", "tokens", "lengths", "learns")
    for block, words, ranks, packed, lengths, learns in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
        kinds = np.cumsum(unpack(words), dtype=np.uint64)
        by_rank = np.empty_like(kinds)
        by_rank[unpack(ranks)] = kinds
        yield block, by_rank[unpack(packed)], np.array(lengths, np.int64), np.array(learns, bool)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (size, range) to answers: for each block the totals of its n-grams, in their order. The first
    row of a range also says how many of its n-grams occur in the rows to learn from."""
    group: list[tuple[int, bytes, bytes]] = []
    of = None

    def answer() -> pa.RecordBatch:
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for _, k, _ in group]
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate([unpack(t) for _, _, t in group])
        totals = np.zeros(len(kinds), np.uint64)
        np.add.at(totals, which, times)
        cuts = np.cumsum([0, *map(len, keys)])
        mine = [pack(totals[which[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        known = [int((totals > 0).sum()), *[0] * (len(group) - 1)]
        return pa.RecordBatch.from_arrays([pa.array([of[0]] * len(group), pa.int32()), pa.array([of[1]] * len(group), pa.int64()), pa.array([b for b, _, _ in group], pa.int64()), pa.array(mine, pa.binary()), pa.array(known, pa.int64())], ["size", "range", "block", "totals", "known"])

    for batch in batches:
        for size, part, block, keys, times in zip(*(batch.column(c).to_pylist() for c in ("size", "range", "block", "keys", "times")), strict=True):
            if group and of != (size, part):
                yield answer()
                group.clear()
            of = (size, part)
            group.append((block, keys, times))
    if group:
        yield answer()


class Arcs:
    """Weights of arcs, worked out where they are asked for. ``counts[k]`` has the count of the n-gram of k + 1 tokens
    that ends at a place."""

    def __init__(self, counts: list[np.ndarray], n: int, kinds: int, prior: float) -> None:
        self.counts, self.all, self.prior = counts, n + kinds + 1, prior

    def found(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the arcs for the tokens at these places out of states of k tokens."""
        p = (self.counts[0][at] + 1) / self.all
        for j in range(1, k + 1):
            p = (self.counts[j][at] + self.prior * p) / (self.counts[j - 1][at - 1] + self.prior)
        return np.log10(p)

    def failed(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the failure arcs of the states of k tokens before these places."""
        return np.log10(self.prior / (self.counts[k - 1][at - 1] + self.prior))


def traverse(counts: list[np.ndarray], lengths: np.ndarray, n: int, kinds: int, prior: float, lane: int = LANE) -> np.ndarray:
    """log10 probability of each document: many lanes of consecutive tokens are read at once, each from left to right.

    A lane that doesn't begin a document starts some tokens early: after as many tokens as the longest state has, its
    state is that of a traversal from the beginning. ``counts`` are those of the n-grams that end at each place, 0 where
    a document has no such n-gram.
    """
    arcs = Arcs(counts, n, kinds, prior)
    most = len(counts) - 1
    ends = np.cumsum(lengths)
    parts = -(-lengths // lane)
    doc = np.repeat(np.arange(len(lengths)), parts)
    begin = (ends - lengths)[doc] + lane * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(begin + lane, ends[doc])
    early = np.maximum(begin - most, (ends - lengths)[doc])
    order = np.argsort(early - end, kind="stable")  # longest first
    doc, begin, end, early = doc[order], begin[order], end[order], early[order]
    state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    span = end - early
    live = len(doc)
    for step in range(int(span[0]) if len(span) else 0):
        live = int(np.searchsorted(-span[:live], -step, "left"))
        at, s = early[:live] + step, state[:live]
        counted = at >= begin[:live]
        gone = np.zeros(live)  # the weight of failure arcs
        to = np.zeros(live, np.int64)
        todo = np.ones(live, bool)
        for k in range(most, 0, -1):
            here = np.flatnonzero(todo & (s >= k))
            there = counts[k][at[here]] > 0
            hit, miss = here[there], here[~there]
            gone[hit] += arcs.found(k, at[hit])
            to[hit] = min(k + 1, most)
            todo[hit] = False
            gone[miss] += arcs.failed(k, at[miss])
        rest = np.flatnonzero(todo)
        gone[rest] += arcs.found(0, at[rest])
        to[rest] = np.minimum(counts[0][at[rest]] > 0, most)
        total[:live] += np.where(counted, gone, 0.0)
        state[:live] = to
    return np.bincount(doc, total, len(lengths))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _walked(order: int, n: int, kinds: int, prior: float) -> Callable:
    """A block and the answers to it to one row for each of its documents."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (_, hashes, lengths, learns) = next(_opened(blocks))
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("size", "range", "totals")), strict=True))
        counts = []
        for size in range(1, order + 1):
            at, keys = grams(hashes, lengths, size)
            which = np.unique(keys, return_inverse=True)[1]
            del keys
            totals = np.concatenate([np.zeros(0, np.uint64), *(unpack(t) for s, _, t in rows if s == size)])
            count = np.zeros(len(hashes))
            count[at] = totals[which]
            counts.append(count)
        del hashes, which, at
        doc = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(doc, np.log10((counts[0] + 1) / (n + kinds + 1)), len(lengths))
        known = np.bincount(doc, counts[0] > 0, len(lengths)).astype(np.int64)
        score = traverse(counts, lengths, n, kinds, prior)
        ids = blocks.column("doc_ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "held_out": pa.array(~learns), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(lengths), n)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def scores(docs: DataFrame, learns: Column, order: int = ORDER, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row for each: ``(doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score)``, of a model of the rows for which ``learns`` is true.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end a text; a null or empty text has the end
    alone. A null in ``learns`` counts as false. Rows with null or repeated doc_ids are rows like any other; equal texts
    get equal scores. Where no row is learned from, all tokens share the arc of unknown ones. An empty table gives none;
    other columns are ignored. N-grams are known by 64 bits of a hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    blocks = materialize(rows.mapInArrow(_blocks(block_tokens), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    size, n = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_learned"), F.lit(0))).first()
    ranges = max(1, -(-size // range_keys))
    sent = blocks.select("block", "words", "ranks", "tokens", "lengths", "learns").mapInArrow(_sent(order, ranges), "size int, range long, block long, keys binary, times binary")
    dealt = sent.repartition("size", "range").sortWithinPartitions("size", "range")
    answers = materialize(dealt.mapInArrow(_answered, "size int, range long, block long, totals binary, known long"), "lm-answers")
    kinds = answers.where("size = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    return blocks.groupBy("block").cogroup(answers.select("size", "range", "block", "totals").groupBy("block")).applyInArrow(_walked(order, n, kinds, prior), _SCORES)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~in_fold(F.col("doc_id"), 7, 2))


QUERIES = {"op13_lm_scores": op13_lm_scores}
#: The automaton isn't SQL; tests compare with the recursion written out in plain Python.
ORACLES: dict[str, str] = {}
