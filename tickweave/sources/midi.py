"""MIDI files: unwrap, find tracks, decode events."""

from __future__ import annotations

import bz2
import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed layers around one file at most, and bytes that one may grow to.
LAYERS, MOST_BYTES = 16, 1 << 31
EVENTS = "song_id string, track_idx int, seq long, tick long, kind string, channel tinyint, key smallint, value smallint, us int, num smallint, dd smallint"
TRACKS = "song_id string, ppqn int, track_idx int, off long, len long, declared long, bytes binary, error string"
SPANS = "song_id string, ppqn int, track_idx int, off long, declared long, error string"
_SEVEN = b"7z\xbc\xaf\x27\x1c"


class TooLong(ValueError):
    """A layer unpacks to more bytes than allowed."""


def _bounded(stream) -> bytes:
    data = stream.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise TooLong("unpacked beyond the limit")
    return data


def unwrap(data: bytes) -> bytes:
    """The innermost bytes of gzip, bzip2, xz, zstd and tar layers; the first file of an archive.

    A layer that grows beyond MOST_BYTES is an error, never cut. What is no archive or filter is returned as it is.
    """
    for depth in range(LAYERS):
        if data[:2] == b"\x1f\x8b":
            data = _inflate(data)
        elif data[:3] == b"BZh":
            data = _bounded(bz2.BZ2File(io.BytesIO(data)))
        elif data[:6] == b"\xfd7zXZ\0":
            data = _bounded(lzma.LZMAFile(io.BytesIO(data)))
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            data = _bounded(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True))
        elif data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                first = next((m for m in archive if m.isfile()), None)
                if first is None:
                    raise ValueError("an archive without a file")
                data = _bounded(archive.extractfile(first))
        elif data[:6] == _SEVEN and depth:
            raise ValueError("a 7z archive inside a compression filter cannot be streamed: its header stands at its end")
        elif data[:6] == _SEVEN or data[:4] in (b"Rar!", b"\x04\x22\x4d\x18"):
            raise ValueError("7z, rar and lz4 need a decoder that is not at hand")
        else:
            return data
    raise ValueError("too many layers")


def _inflate(data: bytes) -> bytes:
    """All members of a gzip file; what follows the last one and is none is left aside."""
    out, size = [], 0
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        while not one.eof:
            piece = one.decompress(data, 1 << 24)
            data = one.unconsumed_tail
            if not piece and not data:
                raise ValueError("a gzip member is cut")
            out.append(piece)
            size += len(piece)
            if size > MOST_BYTES:
                raise TooLong("unpacked beyond the limit")
        data = one.unused_data
    return b"".join(out)


def division(raw: int) -> int:
    """Ticks a quarter note: 15 bits unless the high byte is 0xE7 or more; 0 stands for 480."""
    value = raw & 0x7FFF if raw >> 8 < 0xE7 else raw
    return value or 480


def spans(read, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Division and (offset, declared length) of the MTrk chunks, from chunk headers alone; other chunks are skipped by length.

    read(offset, n) gives up to n bytes.
    """
    head = read(0, 14)
    if head[:4] != b"MThd" or len(head) < 14:
        raise ValueError("not a MIDI file")
    raw = int.from_bytes(head[12:14], "big")
    if raw == 0x4D54:  # a header without a division: the next chunk's tag begins here
        ppqn, at = 480, 12
    else:
        ppqn, at = division(raw), 8 + max(6, int.from_bytes(head[4:8], "big"))
    found = []
    while at + 4 <= size:
        chunk = read(at, 8)
        if len(chunk) < 8:
            raise ValueError("a chunk's length is cut")
        length = int.from_bytes(chunk[4:], "big")
        if chunk[:4] == b"MTrk":
            found.append((at + 8, length))
        at += 8 + length
    return ppqn, found


def tracks(data: bytes) -> tuple[int, list[tuple[int, int, bytes]]]:
    """Division and (offset, declared length, body) of the MTrk chunks; a cut body is what there is."""
    ppqn, found = spans(lambda at, n: data[at : at + n], len(data))
    return ppqn, [(at, length, data[at : at + length]) for at, length in found]


#: Kinds of events by number; events looked at together for a run, the least that make one, and steps after a look that found none.
KINDS = ("on", "off", "cc", "tempo", "timesig", "end")
_WINDOW, _LEAST, _STEPS = 2048, 8, 16
_OF_STATUS = np.full(16, -1, np.int8)
_OF_STATUS[[9, 8, 11]] = 0, 1, 2
#: Status bytes of channel events with two data bytes.
_TWO = np.zeros(256, bool)
_TWO[0x80:0xC0] = _TWO[0xE0:0xF0] = True


def _run(data: np.ndarray, at: int, status: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Events in a row with times of as many bytes and two data bytes, with a status each or all with the held one: their
    size, times, statuses, keys and values; size 0 if there are fewer than _LEAST."""
    held = 0x80 <= status < 0xF0 and status >> 4 not in (12, 13)
    for wide in range(1, 5):
        for own in (1, 0) if held else (1,):
            stride = wide + own + 2
            piece = data[at : at + stride * _WINDOW]
            if len(piece) < stride * _LEAST:
                continue
            rows = piece[: len(piece) // stride * stride].reshape(-1, stride)
            good = (rows[:, wide - 1] < 0x80) & (rows[:, -2] < 0x80) & (rows[:, -1] < 0x80)
            for k in range(wide - 1):
                good &= rows[:, k] >= 0x80
            if own:
                good &= _TWO[rows[:, wide]]
            k = len(good) if good.all() else int(good.argmin())
            if k >= _LEAST:
                rows = rows[:k]
                times = np.zeros(k, np.int64)
                for c in range(wide):
                    times = times << 7 | (rows[:, c] & 0x7F)
                return stride * k, times, rows[:, wide] if own else np.full(k, status, np.uint8), rows[:, -2], rows[:, -1]
    none = np.empty(0, np.uint8)
    return 0, none, none, none, none


def decoded(body: bytes) -> Iterator[dict[str, np.ndarray]]:
    """Events of one track as columns, a batch at a time: tick, kind (a number), channel, key, value, us, num, dd; -1 where none.

    Runs of ordinary events are taken as matrices of their bytes, the others step by step; see decode().
    """
    data = np.frombuffer(body, np.uint8)
    held: list[tuple] = []
    names = ("tick", "kind", "channel", "key", "value", "us", "num", "dd")
    at = tick = status = 0
    steps = _STEPS
    while at < len(body):
        size, times, statuses, keys, values = _run(data, at, status)
        if size:
            if held:
                yield dict(zip(names, np.array(held, np.int64).T, strict=True))
                held = []
            ticks = tick + np.cumsum(times)
            kind = _OF_STATUS[statuses >> 4]
            own = kind >= 0
            none = np.full(int(own.sum()), -1, np.int64)
            cols = (ticks[own], kind[own], statuses[own] & 15, keys[own], values[own], none, none, none)
            yield dict(zip(names, (c.astype(np.int64) for c in cols), strict=True))
            at, tick, status, steps = at + size, int(ticks[-1]), int(statuses[-1]), _STEPS
            continue
        at, tick, status = _advance(body, at, tick, status, steps, held)
        steps = min(2 * steps, 64 * _STEPS)  # where runs are rare, look for them less often
        if len(held) >= 50_000:
            yield dict(zip(names, np.array(held, np.int64).T, strict=True))
            held = []
    held.append((tick, 5, -1, -1, -1, -1, -1, -1))
    yield dict(zip(names, np.array(held, np.int64).T, strict=True))


def decode(body: bytes) -> Iterator[tuple]:
    """Events of one track: (tick, kind, channel, key, value, us, num, dd), at the end one of kind ``end`` at the last tick.

    Numbers have four bytes at most. Time advances before an event is read, so one that is cut still advances it. Status
    bytes below 0xF0 hold for the next event; 0xF0 to 0xF7 and 0xFF clear them, other real-time bytes do not. End of Track
    means nothing: the body ends where its length says. Keys keep their low seven bits. A tempo has three bytes and is
    not 0; a time signature has four.
    """
    for part in decoded(body):
        for row in zip(*(c.tolist() for c in part.values()), strict=True):
            yield row[0], KINDS[row[1]], *(None if x < 0 else x for x in row[2:])


def _advance(body: bytes, at: int, tick: int, status: int, steps: int, out: list[tuple]) -> tuple[int, int, int]:
    """Read so many events, or to the end, into out: the place, time and status that the next one begins with."""
    n = len(body)
    for _ in range(steps):
        if at >= n:
            break
        step = 0
        for _ in range(4):
            if at >= n:
                break
            b = body[at]
            at += 1
            step = step << 7 | b & 0x7F
            if b < 0x80:
                break
        tick += step
        if at >= n:
            break
        b = body[at]
        if b >= 0x80:
            at += 1
            if b < 0xF0:
                status = b
            elif b <= 0xF7 or b == 0xFF:
                status = 0
            event = b
        else:
            event = status
            if not event:
                continue  # a data byte without a status consumes nothing
        if event < 0xF0:
            high = event >> 4
            need = 1 if high in (0xC, 0xD) else 2
            if at + need > n:
                return n, tick, status
            if high in (8, 9, 0xB):
                out.append((tick, int(_OF_STATUS[high]), event & 15, body[at] & 0x7F, body[at + 1], -1, -1, -1))
            at += need
        elif event == 0xFF:
            if at >= n:
                break
            kind = body[at]
            size, at = _number(body, at + 1)
            if at + size > n:
                return n, tick, status
            if kind == 0x51 and size == 3 and any(body[at : at + 3]):
                out.append((tick, 3, -1, -1, -1, int.from_bytes(body[at : at + 3], "big"), -1, -1))
            elif kind == 0x58 and size == 4:
                out.append((tick, 4, -1, -1, -1, -1, body[at], body[at + 1]))
            at += size
        elif event in (0xF0, 0xF7):
            size, at = _number(body, at)
            at += size
        elif event in (0xF1, 0xF3):
            at += 1
        elif event == 0xF2:
            at += 2
    return at, tick, status


def _number(body: bytes, at: int) -> tuple[int, int]:
    """A number of four bytes at most, and the place after it."""
    value = 0
    for b in body[at : at + 4]:
        at += 1
        value = value << 7 | b & 0x7F
        if b < 0x80:
            break
    return value, at


_BROKEN = (ValueError, EOFError, OSError, zlib.error, lzma.LZMAError, tarfile.TarError)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


def _split(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    ppqn, found = tracks(unwrap(content.as_py() or b""))
                except _BROKEN as error:
                    if mode == "fail":
                        raise ValueError(f"{song}: {error}") from error
                    if mode == "rows":
                        yield _rows(TRACKS, [(song, None, None, None, None, None, None, f"{type(error).__name__}: {error}")])
                    continue
                for k, (off, declared, body) in enumerate(found):
                    yield _rows(TRACKS, [(song, ppqn, k, off, len(body), declared, body, None)])

    return run


def _checked(mode: str) -> str:
    if mode not in ("drop", "rows", "fail"):
        raise ValueError("mode must be drop, rows or fail")
    return mode


def read_tracks(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """The tracks of all MIDI files at path, plain or compressed: one row for each. See split_tracks()."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("song_id"), "content")
    return split_tracks(files, mode)


def split_tracks(files: DataFrame, mode: str = "drop") -> DataFrame:
    """(song_id, content) to tracks; declared is the length that a track's header says, more than len where the file is cut.

    A file that cannot be read gives no row (drop), a row with its error and nothing else (rows), or ends the query (fail).
    A file is a row, so it and what it unpacks to must fit in 2 GiB; read_track_spans() has no such limit for plain files.
    """
    return files.select("song_id", "content").mapInArrow(_split(_checked(mode)), TRACKS)


def _plan(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = pyarrow.fs.FileSystem.from_uri(song)
                try:
                    with store.open_input_file(place) as file:
                        ppqn, found = spans(lambda at, n, file=file, size=size: file.read_at(max(0, min(n, size - at)), at), size)
                except _BROKEN as error:
                    if mode == "fail":
                        raise ValueError(f"{song}: {error}") from error
                    if mode == "rows":
                        yield _rows(SPANS, [(song, None, None, None, None, f"{type(error).__name__}: {error}")])
                    continue
                for a in range(0, len(found), 10_000):
                    yield _rows(SPANS, [(song, ppqn, a + k, off, declared, None) for k, (off, declared) in enumerate(found[a : a + 10_000])])

    return run


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each span alone; holds one track."""
    for batch in batches:
        for r in batch.to_pylist():
            body = None
            if r["error"] is None:
                store, place = pyarrow.fs.FileSystem.from_uri(r["song_id"])
                with store.open_input_file(place) as file:
                    size = file.size()
                    body = file.read_at(max(0, min(r["declared"], size - r["off"])), r["off"])
            yield _rows(TRACKS, [(r["song_id"], r["ppqn"], r["track_idx"], r["off"], None if body is None else len(body), r["declared"], body, r["error"])])


def read_track_spans(spark: SparkSession, path: str, mode: str = "drop", each: int = 64 << 20) -> DataFrame:
    """The tracks of plain MIDI files at path, planned from chunk headers: files may be of any size, a track fits in 2 GiB.

    Executors read the headers, then tracks are dealt to tasks of about ``each`` bytes, so one file's tracks are read by
    many. Paths must be ones that executors can open (local or shared folders, object stores, HDFS). mode as in
    split_tracks(); rows as there.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("song_id"), "length")
    found = files.mapInArrow(_plan(_checked(mode)), SPANS)
    whole = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // each))
    return found.repartition(parts, "song_id", "track_idx").mapInArrow(_load, TRACKS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EVENTS.split(", ")]
    kinds = {"channel": pa.int8(), "key": pa.int16(), "value": pa.int16(), "us": pa.int32(), "num": pa.int16(), "dd": pa.int16()}
    words = pa.array(KINDS)
    for batch in batches:
        for song, track, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not body.is_valid:
                continue
            seq = 0
            for part in decoded(body.as_py()):
                n = len(part["tick"])
                own = [pa.array([song] * n, pa.string()), pa.array(np.full(n, track, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(part["tick"]), words.take(pa.array(part["kind"]))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(part[c], mask=part[c] < 0).cast(t) for c, t in kinds.items())], names=names)
                seq += n


def read_events(tracks: DataFrame) -> DataFrame:
    """Events of all tracks, with one of kind ``end`` for each track; rows without a body give none."""
    return tracks.select("song_id", "track_idx", "bytes").mapInArrow(_decode, EVENTS)
