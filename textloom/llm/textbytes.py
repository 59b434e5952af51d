"""Arrow text columns as byte buffers: words, spans and hashes for a whole batch at once with numpy.

All word classes used here end at ASCII bytes, and every byte of a non-ASCII character is 0x80 or above, so splitting
UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Spans from this many bytes on are known by a digest (see ``identity``).
LONG_SPAN = 256
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_U33, _C1, _C2 = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of near-duplicate search: anything but ASCII white space.
NOT_SPACE = ~SPACES
#: Words of decontamination: digits, a-z and all non-ASCII (upper case is lowered first).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U33)
    h *= _C1
    h ^= h >> _U33
    h *= _C2
    h ^= h >> _U33
    return h


@cache
def byte_values(seed: int = 0) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_PRIME, inverse))
        if size <= 16 * CHUNK_BYTES:
            _POWERS[0] = have
    return have


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running polynomial hash: entry i covers data[:i]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(seed)[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], the same wherever the bytes stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def identity(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits by which each data[start:end] is known, the same wherever the bytes stand.

    A polynomial modulo 2**64 has strings that collide by their form whatever its multiplier (Thue-Morse words, from
    512 bytes on), so long spans are digested instead.
    """
    out, raw = np.zeros(len(starts), np.uint64), memoryview(data)
    long = ends - starts >= LONG_SPAN
    if not long.all():
        out[~long] = span_hash(prefix_hash(data), starts[~long], ends[~long])
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
    out[long] = np.frombuffer(digests, np.uint64)
    return out


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row and the end) of runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the place of its first word (one more entry at the end)."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = is_word[data]
    here, before, after = mask[1:-1], mask[:-2].copy(), mask[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (by its first word)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out *= _PRIME
        out += hashes[k : k + n]
    return mix(out)
