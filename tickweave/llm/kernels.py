"""Columnar text kernels: numpy over the UTF-8 buffers of Arrow string columns.

Every kernel works on whole texts; nulls count as empty texts. Words are maximal
runs of bytes outside a separator set of ASCII bytes, which is safe in UTF-8
because continuation bytes are never ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, as the contracts define it.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are processed in groups of about this many bytes; one longer text is a group of its own.
CHUNK_BYTES = 4 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together, at least one row each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each row's words begin (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = before  # reuse the buffer
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes a step over the words that still have any."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = mix64(left.astype(np.uint64) * _STEP)
    h = mix64(h ^ (at[starts] & _TAIL[np.minimum(left, 8)]))
    rows = np.flatnonzero(left > 8)
    step = 8
    while len(rows):
        part = at[starts[rows] + step] & _TAIL[np.minimum(left[rows] - step, 8)]
        h[rows] = mix64(h[rows] * _STEP ^ part)
        step += 8
        rows = rows[left[rows] > step]
    return h


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of white-space separated words of each row."""
    data, offsets = utf8(column)
    out = np.empty(len(offsets) - 1, np.int64)
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        out[a:b] = np.diff(word_spans(part, offsets[a : b + 1] - offsets[a])[2])
    return out


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: first row, end row, hashes of lower-cased (A-Z) words, where each row's words begin."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        yield a, b, word_hashes(part, starts, ends), first


_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its word shingles.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    places = mix64(np.arange(1, width + 1, dtype=np.uint64) * _PLACE[0]) | np.uint64(1)
    for a, b, words, first in hashed_words(column):
        n = len(words)
        whole = max(0, n - width + 1)
        rolled = np.zeros(whole, np.uint64)
        for k in range(width):
            rolled += words[k : k + whole] * places[k]
        rolled = mix64(rolled)
        for row in range(b - a):
            lo, hi = int(first[row]), int(first[row + 1])
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    total = (words[lo:hi] * places[: hi - lo]).sum(dtype=np.uint64) ^ (short * _STEP)
                yield mix64(np.array([total], dtype=np.uint64))
            else:
                yield np.empty(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a set of token hashes (0 for the empty set), signed."""
    if not len(tokens):
        return 0
    total = np.array([tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(tokens ^ _PLACE[1])), len(tokens)], dtype=np.uint64)
    key = mix64(mix64(mix64(total[:1]) + total[1:2]) * _STEP + total[2:])
    return int(key.view(np.int64)[0])
