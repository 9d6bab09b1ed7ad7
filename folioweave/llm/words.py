"""Words and word shingles of Arrow text columns as numpy arrays, hashed without a Python object per word.

Used inside tasks only. Hashes have 64 bits; equal texts have equal hashes wherever and whenever they are computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; a longer text is taken alone and whole.
CHUNK_BYTES = 2 << 20

_STEP = 0x9E3779B97F4A7C15
_MULTIPLIER = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser of unsigned 64-bit numbers."""
    x = x + np.uint64((salt * _STEP + _STEP) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64), 77)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_grown: dict[str, np.ndarray] = {}


def _enough_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _grown or n > len(_grown["up"]):
        _grown["up"], _grown["down"] = _powers(_MULTIPLIER, n), _powers(_INVERSE, n)
    return _grown["up"], _grown["down"]


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Yield (first, last, bytes, offsets) for runs of rows of about ``size`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, inside: np.ndarray):
    """(hash of each word, index of the first word of each text and the end).

    ``inside`` marks the byte values that belong to words, ``values`` maps each byte before hashing (case folding).
    Words end at a text's end.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    member = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | edge[1:n]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    forward, backward = _enough_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[values][data] * forward[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * backward[starts], 1)
    return hashes, np.searchsorted(starts, offsets)


def text_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of a text, given by their first and the first character behind them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    forward, backward = _enough_powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64), 78) * forward[: len(points)], out=total[1:])
    return mixed((total[ends] - total[starts]) * backward[starts], 2)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, length: int):
    """(hash of each run of ``length`` words inside a text, index of the first run of each text and the end).

    A text of fewer words, but not none, has its whole sequence as one run.
    """
    counts = np.diff(firsts)
    runs = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(begin[-1], np.uint64)
    if not len(words):
        return out, begin
    if len(words) >= length:
        acc = np.zeros(len(words) - length + 1, np.uint64)
        for j in range(length):
            acc = mixed(acc ^ words[j : len(words) - length + 1 + j], j)
        text = np.repeat(np.arange(len(counts)), runs)
        place = np.arange(begin[-1]) - begin[text] + firsts[text]
        full = counts[text] >= length
        out[full] = acc[place[full]]
    for t in np.flatnonzero((counts > 0) & (counts < length)):
        acc = np.uint64(counts[t])
        for j, w in enumerate(words[firsts[t] : firsts[t + 1]]):
            acc = mixed(np.array([acc ^ w]), 100 + j)[0]
        out[begin[t]] = acc
    return out, begin
