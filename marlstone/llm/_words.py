"""Words of many texts at once, as arrays over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A piece of text that is hashed at once; a longer document is hashed in pieces cut between words.
PIECE = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all 64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


_BYTE = numbers(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[name] = np.multiply.accumulate(steps)
    return _power["up"], _power["down"]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and where each document's words begin in them."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the documents data[offsets[i]:offsets[i+1]], and each one's first word."""
    if len(data) > 2 * PIECE and len(offsets) == 2:
        found, at = [], 0
        while at < len(data):
            to = min(len(data), at + PIECE)
            while to < len(data):
                gap = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                to = to + int(gap[0]) if len(gap) else min(len(data), to + PIECE)
                if len(gap):
                    break
            found.append(word_hashes(data[at:to], np.array([0, to - at]), lower)[0] if to - at <= 2 * PIECE else _hashes(data[at:to], np.array([0, to - at]), lower)[0])
            at = to
        return np.concatenate(found), np.array([0, sum(map(len, found))])
    return _hashes(data, offsets, lower)


def _hashes(data, offsets, lower):
    starts, ends, words = spans(data, offsets)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD), words


def groups(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of rows with about `limit` bytes; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def flat_shingles(words: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles of several documents, words[begin[i]:begin[i+1]], and where each one's begin. A document of
    fewer words has its whole sequence as one; one without words has none."""
    n = np.diff(begin)
    salt = numbers(97, k + 1)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), np.uint64)
    for width in range(1, k + 1):
        mine = np.flatnonzero(n == width if width < k else n >= k)
        if len(mine):
            at = ranges(begin[mine], count[mine])
            h = np.full(len(at), salt[k] + np.uint64(width), np.uint64)
            for i in range(width):
                h += mix64(words[at + i] + salt[i])
            out[ranges(first[mine], count[mine])] = mix64(h)
    return out, first


def flat_sets(words: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As flat_shingles, each document's distinct ones in order."""
    h, first = flat_shingles(words, begin, k)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(first))
    h = h[np.lexsort((h, doc))]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(begin)))


def least_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least of values[first[i]:first[i+1]], none of which is empty."""
    return np.minimum.reduceat(values, first[:-1]) if len(first) > 1 else values[:0]


def fingerprints(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the same whatever its order; an empty one has 0."""
    out = []
    for seed in (0, 0x5851F42D4C957F2D):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).astype(np.int64))
    return out[0], out[1]
