"""Variable-capacity best-fit packing, and the segment tree that both packers search."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Pieces that are packed together: the memory of a task is bounded, and a run of so many pieces leaves little room unused.
WINDOW = 16_384


class Room:
    """Open bins by free room, 0 to most: a segment tree over the room values holds how many bins have each."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << (most + 1 - 1).bit_length() if most else 1
        self.tree = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, item: int) -> None:
        self.bins.setdefault(room, []).append(item)
        k = room + self.leaves
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room that holds need."""
        if need >= self.leaves:
            return None
        tree, k = self.tree, need + self.leaves
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            tree[k] -= 1
            k >>= 1
        return room, self.bins[room].pop()


def split(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and lengths of pieces of at most ``most``; a row of size 0 is one piece of length 0."""
    parts = np.maximum(1, -(-sizes // most))
    row = np.repeat(np.arange(len(sizes)), parts)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    return row, start, np.minimum(sizes[row] - start, most)


def _opened(order: list[int], lengths: np.ndarray, sizes: list[int], cost: dict[int, float]) -> list[list[int]]:
    """Bins (indices into lengths) by best fit in falling order of length.

    A piece that no open bin can hold opens the size with the least cost for the words that it can expect to hold: the
    piece and as much of the rest as fits beside it, by the lengths still to come and the room that open bins offer them.
    """
    room = Room(sizes[-1])
    bins: list[list[int]] = []
    falling = lengths[order]
    after = np.r_[np.cumsum(falling[::-1])[::-1], 0]  # words from a place of the order on
    rising = falling[::-1]
    free_words = 0
    for at, k in enumerate(order):
        need = int(lengths[k])
        found = room.take(need)
        if found is None:
            best = None
            for s in sizes:
                if s >= need:
                    # the rest that fits beside the piece begins at the first shorter piece
                    begin = max(at + 1, len(order) - int(np.searchsorted(rising, s - need, side="right")))
                    rest = max(0, int(after[min(begin, len(order))]) - free_words)
                    each = cost[s] / max(1, need + min(s - need, rest))
                    if best is None or each < best[0]:
                        best = (each, s)
            found = (best[1], len(bins))
            bins.append([])
            free_words += best[1]
        free, b = found
        bins[b].append(k)
        room.add(free - need, b)
        free_words -= need
    return bins


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: float = 0, square: float = 0) -> tuple[list[list[int]], list[int]]:
    """Bins (indices into lengths) and their capacities, at the least cost found over the sizes that may be opened.

    A bin of capacity s costs ``overhead + s``, and ``s * s / square`` if square is given: attention over a row grows with
    its square. Pieces are packed once for each set of permitted sizes that holds the largest; at the end each bin
    shrinks to the least permitted size that holds its contents, and the cheapest packing wins, ties by fewer bins, then
    by the smaller set.
    """
    sizes = sorted(set(capacities))
    cost = {s: overhead + s + (s * s / square if square else 0) for s in sizes}
    order = np.argsort(-lengths, kind="stable").tolist()
    best = None
    for many in range(len(sizes)):
        for others in combinations(sizes[:-1], many):
            bins = _opened(order, lengths, [*others, sizes[-1]], cost)
            caps = [sizes[bisect_left(sizes, int(lengths[b].sum()))] for b in bins]
            rank = (sum(cost[c] for c in caps), len(bins))
            if best is None or rank < best[0]:
                best = rank, bins, caps
    return best[1], best[2]


def _pack(capacities: tuple[int, ...], overhead: float, square: float, window: int):
    """Texts to bins. Holds the word counts and ids of one window's pieces, and about 4 MB of text while its words are counted."""
    names = ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        ids: list = []
        cols: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def done() -> pa.RecordBatch:
            nonlocal ids, cols, held, serial
            rows, starts, lengths = (np.concatenate(c) for c in cols)
            doc = pa.concat_arrays(ids)
            bins, caps = best_fit(lengths, capacities, overhead, square)
            flat = np.array([k for b in bins for k in b], np.int64)
            ends = np.r_[0, np.cumsum([len(b) for b in bins])].astype(np.int32)
            used = np.add.reduceat(lengths[flat], ends[:-1])
            lists = [pa.ListArray.from_arrays(ends, x) for x in (doc.take(pa.array(rows[flat])), pa.array(starts[flat]), pa.array(lengths[flat]))]
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(len(bins)) + serial), pa.array(caps, pa.int32()), pa.array(used, pa.int64()), *lists], names=names)
            serial += len(bins)
            ids, cols, held = [], [[], [], []], 0
            return out

        base = 0
        for batch in batches:
            row, start, length = split(K.word_counts(batch.column(1)), max(capacities))
            at, doc = 0, batch.column(0)
            while at < len(row):
                stop = min(len(row), at + window - held)
                if not held:
                    base = 0
                lo, hi = int(row[at]), int(row[stop - 1]) + 1
                ids.append(doc.slice(lo, hi - lo))
                for c, x in zip(cols, (row[at:stop] - lo + base, start[at:stop], length[at:stop]), strict=True):
                    c.append(x.astype(np.int64))
                base += hi - lo
                held += stop - at
                at = stop
                if held >= window:
                    yield done()
        if held:
            yield done()

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: float = 64, square: float = 16_384, window: int = WINDOW) -> DataFrame:
    """Bins of whole documents by word counts: bin_id, capacity, used, doc_ids, starts, lengths (parallel arrays).

    A document longer than the largest capacity is split into pieces without loss: starts are word positions within its
    document. The sizes are chosen jointly, at the least cost of a window's bins, where one of capacity s costs
    overhead + s + s * s / square. Every row is packed, blank and null texts as pieces of length 0, repeated rows each
    for itself, null ids as null entries. Pieces are packed in windows of bounded size within their input partition, so
    nothing is shuffled. An empty table gives no bins. bin_id is unique; it depends on how the input is partitioned.
    Other columns are ignored.
    """
    if min(capacities) < 1:
        raise ValueError("capacities must be positive")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pack(tuple(capacities), overhead, square, window), "bin_id long, capacity int, used long, doc_ids array<long>, starts array<long>, lengths array<long>")
