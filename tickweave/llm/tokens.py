"""Token ids in packed binary matrices: best-fit-decreasing over a segment tree of free room."""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .packing import Room, split

#: Pre-tokenizer pattern of the byte-level vocabulary of 50,256 entries, and the id that it leaves free.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Distinct spans whose ids a worker remembers; then it starts anew.
REMEMBERED = 400_000
#: Pieces that are packed together.
WINDOW = 4096

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def span_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer surely cuts, whatever the context; spans between them can be encoded alone.

    Those are text starts; a single space or newline between two other characters (before it, and after a newline); and
    between an ASCII letter and an ASCII mark but the apostrophe. Runs of white space and other scripts stay whole.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if not n:
        return np.empty(0, np.int64)
    space = K.IS_SPACE[data] | (data >= 0x1C) & (data <= 0x1F)
    wide = data >= 0x80  # may be white space of another script
    plain = ~space & ~wide
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    letter, mark = _LETTER[data], _PUNCT[data]
    inner = ~edge[1:-1]
    cut[1:] |= inner & ((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:]))
    if n > 2:
        # a lone space or newline: ASCII non-space on the left, and ASCII non-space on the right
        lone = space[1:-1] & ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & plain[:-2] & plain[2:] & ~edge[1:-2] & ~edge[2:-1]
        cut[1:-1] |= lone
        cut[2:] |= lone & (data[1:-1] == 0x0A)
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of texts; the ids of distinct spans are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import tiktoken

        self.plain = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's begin. Equal to encoding every text whole; spans are told apart by 64-bit hashes."""
        starts = span_starts(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.r_[starts[1:], len(data)]
        h = K.word_hashes(data, starts, ends)
        keys, first, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at] != keys
        if new.any():
            raw = data.tobytes()
            got = [self.plain.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            size = np.array([len(x) for x in got], np.int64)
            begin = len(self.ids) + np.r_[0, np.cumsum(size)[:-1]]
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.int32)])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.begin, self.size = merged[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        at = np.searchsorted(self.keys, keys)
        size = self.size[at][where]
        stop = np.cumsum(size)
        take = np.repeat(self.begin[at][where] - (stop - size), size) + np.arange(stop[-1])
        return self.ids[take], np.r_[0, stop][np.searchsorted(starts, offsets)]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: pieces by falling length, each into the open bin with the least room that holds it."""
    room, bins = Room(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        free, b = room.take(need) or (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
        room.add(free - need, b)
    return bins


def _pack(ranks, pattern: str, end: int, length: int, window: int):
    """Texts to rows of ids. Holds the ids of one window's pieces, window * length at most, about 4 MB of text while it is encoded, and REMEMBERED spans."""
    names = ["bin_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "starts", "resets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(ranks.value, pattern)
        serial = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (ids, doc, start)

        def done() -> pa.RecordBatch:
            nonlocal held, serial
            sizes = np.array([len(x[0]) for x in held], np.int64)
            bins = best_fit_decreasing(sizes, length)
            cols: list[list] = [[] for _ in names]
            for b in bins:
                ids = np.concatenate([held[k][0] for k in b])
                cu = np.r_[0, np.cumsum(sizes[b])].astype(np.int32)
                matrix = np.full(length, end, "<u2")
                matrix[: len(ids)] = ids
                for c, v in zip(cols, (serial, len(ids), matrix.tobytes(), cu, [held[k][1] for k in b], [held[k][2] for k in b], cu[:-1]), strict=True):
                    c.append(v)
                serial += 1
            held = []
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), ints, longs, longs, ints), strict=True)], names=names)

        for batch in batches:
            doc = batch.column(0).to_pylist()
            data, offsets = K.utf8(batch.column(1))
            for a, b in K.chunks(offsets):
                ids, first = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(first) + 1
                row, start, part = split(size, length)
                for r, s, m in zip(row.tolist(), start.tolist(), part.tolist(), strict=True):
                    at = int(first[r]) + s
                    piece = ids[at : min(at + m, int(first[r + 1]))].astype(np.uint16)
                    held.append((piece if len(piece) == m else np.append(piece, np.uint16(end)), doc[a + r], s))
                    if len(held) >= window:
                        yield done()
        if held:
            yield done()

    return run


@functools.lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str) -> Encoder:
    """One encoder for a worker process: the vocabulary is parsed once, not in each task."""
    return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}, pattern)


def pack_tokens(docs: DataFrame, ranks: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, end: int = END, length: int = 2048, window: int = WINDOW) -> DataFrame:
    """Rows of ``length`` token ids: bin_id, n_tokens, ids (little-endian uint16, padded with ``end``), cu_seqlens, doc_ids, starts, resets.

    Every text, null ones as empty, becomes its ids and one ``end``. A longer document is split into pieces without loss:
    starts are token positions within its document. cu_seqlens are the cumulative segment lengths of a row, resets the
    positions at which position ids start again at 0. Texts are never cut before encoding. Pieces are packed in windows of
    bounded size within their input partition; nothing is shuffled. The vocabulary file at ``ranks`` is read on the
    driver and broadcast. An empty table gives no rows; bin_id depends on the input's partitions.
    """
    with open(ranks) as f:
        vocabulary = f.read()
    if end >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "bin_id long, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, resets array<int>"
    return texts.mapInArrow(_pack(docs.sparkSession.sparkContext.broadcast(vocabulary), pattern, end, length, window), schema)


_INDEX = "shard string, first long, bin_id long, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _shards(folder: str, rows: int):
    """Rows to files of ``rows`` matrix rows each, and their index; every attempt of a task writes files of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, first = "", None, 0
        try:
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    if out is None:
                        name, first = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin", 0
                        out = store.open_output_stream(f"{base}/{name}")
                    piece = batch.slice(at, rows - first)
                    for ids in piece.column(2):
                        out.write(ids.as_buffer())
                    n = piece.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), *(piece.column(k) for k in (0, 1, 3, 4, 5))], names=[x.split()[0] for x in _INDEX.split(", ")])
                    first, at = first + n, at + n
                    if first >= rows:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()

    return run


def write_shards(packed: DataFrame, folder: str, length: int = 2048, rows: int = 16_384) -> DataFrame:
    """Write packed rows as binary shards, and their index as Parquet, below a folder that driver and executors share.

    A shard is a matrix of little-endian uint16 ids, at most ``rows`` by ``length``, without a header; the index says
    which row of which shard a bin is, with its tokens, cumulative segment lengths, documents and starts. Only files
    that the index names count: those of tasks that were repeated or lost are left aside. Returns the index.
    """
    index = packed.select("bin_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(_shards(f"{folder}/shards", rows), _INDEX)
    index.withColumn("length", F.lit(length)).write.mode("overwrite").parquet(f"{folder}/index")
    return packed.sparkSession.read.parquet(f"{folder}/index")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that write_shards() wrote, with their ids; position ids start at 0 at each of cu_seqlens but the last."""
    index = spark.read.parquet(f"{folder}/index")
    files = spark.read.format("binaryFile").load(f"{folder}/shards").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    joined = index.join(files, "shard")
    return joined.select("bin_id", "n_tokens", F.expr("substring(content, cast(first * length * 2 + 1 as int), length * 2)").alias("ids"), "cu_seqlens", "doc_ids", "starts", F.expr("slice(cu_seqlens, 1, size(cu_seqlens) - 1)").alias("resets"))
