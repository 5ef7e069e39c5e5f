"""xz files of several blocks, each unpacked by a task of its own."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layered import HEAD, _number, cut

#: Sizes of the check after a block's data by the low four bits of the stream's flags, and the filter that blocks have here (fixed values).
CHECKS = (0, 4, 4, 4, 8, 8, 8, 16, 16, 16, 32, 32, 32, 64, 64, 64)
LZMA2 = 0x21


def blocks(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, bytes without padding, bytes unpacked, bytes of the check) of every block, from the indexes alone; [] if data is no row of whole streams."""
    out = []
    for start, end in cut(data):
        check = CHECKS[data[start + 7] & 15]
        index = (int.from_bytes(data[end - 8 : end - 4], "little") + 1) * 4
        count, place = _number(data, end - 12 - index + 1, end - 12)
        at = start + 12
        for _ in range(count):
            unpadded, place = _number(data, place, end - 12)
            size, place = _number(data, place, end - 12)
            out.append((at, unpadded, size, check))
            at += -(-unpadded // 4) * 4
    return out


def unpack_block(block: bytes, check: int) -> bytes:
    """A block's data: its header tells the size of the dictionary. ValueError if it has other filters."""
    size, flags = (block[0] + 1) * 4, block[1]
    at = 2
    for bit in (0x40, 0x80):  # sizes that the header may repeat
        if flags & bit:
            _, at = _number(block, at, size)
    if flags & 3 or block[at] != LZMA2 or block[at + 1] != 1:
        raise ValueError("a block with other filters than LZMA2")
    bits = block[at + 2]
    dictionary = 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << (bits // 2 + 11)
    raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}])
    return raw.decompress(block[size : len(block) - check])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["song_id", "block", "size", "check", "bytes"]
    for batch in batches:
        for song, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py() or b""
            found = blocks(data) if data[:6] == HEAD else []
            rows = [(song, k, size, check, data[at : at + n]) for k, (at, n, size, check) in enumerate(found)] or [(song, 0, -1, 0, data)]
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            body = r["bytes"]
            if r["size"] >= 0:
                body = unpack_block(body, r["check"])
                if len(body) != r["size"]:
                    raise ValueError(f"{r['song_id']}: a block unpacks to another size than its index says")
            yield pa.RecordBatch.from_arrays([pa.array([r["song_id"]]), pa.array([r["block"]]), pa.array([body], pa.binary())], names=["song_id", "block", "bytes"])


def unpack_blocks(files: DataFrame, parts: int | None = None) -> DataFrame:
    """(song_id, content) with the outer xz layer taken off: every block by its own task, put together in order.

    Files that are no row of whole xz streams stay as they are. A file unpacks to at most 2 GiB, as a row holds it.
    """
    parts = parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = files.select("song_id", "content").mapInArrow(_cut, "song_id string, block long, size long, check long, bytes binary")
    plain = pieces.repartition(parts, "song_id", "block").mapInArrow(_unpack, "song_id string, block long, bytes binary")
    in_order = F.array_sort(F.collect_list(F.struct("block", "bytes")))
    return plain.groupBy("song_id").agg(F.aggregate(in_order, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["bytes"])).alias("content"))
