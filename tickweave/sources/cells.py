"""Pre-aggregated .cjcmcg files: note-on and note-off counts by tick."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ticks import held
from .midi import _BROKEN, _checked, division, unwrap

SCHEMA = "song_id string, ppqn int, kind string, seq long, tick long, ons long, offs long, us int, note string"
#: Ticks in a bucket of the song's counter.
BUCKET = 1 << 20


class NotCells(ValueError):
    pass


def synthetic_us(resolution: int) -> int:
    """The three bytes that writers put into a first, meaningless tempo record: 5e9 / resolution, cut to 24 bits."""
    return int(5e9 / resolution) & 0xFFFFFF if resolution else -1


@dataclass
class Cells:
    """Division, tempo changes (tick, us), note-ons and note-offs by tick, the song's last tick, and remarks on the file."""

    ppqn: int
    tempos: list[tuple[int, int]]
    ons: np.ndarray
    offs: np.ndarray
    last: int
    remarks: list[str]


def numbers(data: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """``count`` variable-length numbers at the start of data (seven bits a byte, big-endian), and the bytes they take."""
    if not count:
        return np.empty(0, np.int64), 0
    ends = np.flatnonzero(data < 0x80)[:count]
    if len(ends) < count:
        raise NotCells("cut")
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts + 1
    out = np.zeros(count, np.int64)
    for k in range(min(int(size.max()), 9)):
        own = size > k
        out[own] = out[own] << 7 | (data[starts[own] + k] & 0x7F)
    for k in np.flatnonzero(size >= 9):
        value = 0
        for b in data[starts[k] : ends[k] + 1].tolist():
            value = value << 7 | b & 0x7F
        if size[k] > 10 or value >= 1 << 63:
            raise NotCells("oversized number")
        out[k] = value
    return out, int(ends[-1]) + 1


def parse(data: bytes, named: bool = False) -> Cells:
    """Read a whole file. Data after the table is a remark in a file that is named as one, and else says that it is none."""
    at = 0

    def fixed(size: int) -> int:
        nonlocal at
        if at + size > len(data):
            raise NotCells("cut")
        at += size
        return int.from_bytes(data[at - size : at], "big")

    resolution, count = fixed(4), fixed(4)
    if resolution > 0xFFFF or count * 7 > len(data):
        raise NotCells("not a cell file")
    tempos, last = [], 0
    for k in range(count):
        tick, us = fixed(4), fixed(3)
        if k == 0 and tick == 0 and us == synthetic_us(resolution):
            continue
        if us:
            tempos.append((tick, us))
        last = max(last, tick)
    count = fixed(4)
    if count * 8 > len(data):
        raise NotCells("not a cell file")
    for _ in range(count):
        tick, size = fixed(4), fixed(4)
        if size > len(data) - at:
            raise NotCells("cut")
        at += size
        if size:
            last = max(last, tick)
    rest = np.frombuffer(data, np.uint8)
    declared, used = numbers(rest[at:], 1)
    at += used
    count = fixed(4)
    if count * 2 > len(data):
        raise NotCells("not a cell file")
    table, used = numbers(rest[at:], 2 * count)
    at += used
    ons, offs = table[0::2], table[1::2]
    remarks = []
    if at < len(data):
        if not named:
            raise NotCells("data after the table")
        remarks.append(f"{len(data) - at} bytes after the table are left aside")
    if declared[0] != sum(ons.tolist()):
        remarks.append(f"the file declares {declared[0]} notes, its table has {sum(ons.tolist())}")
    return Cells(division(resolution), tempos, ons, offs, max(last, count - 1, 0), remarks)


def _read(mode: str):
    names, kinds = [x.split()[0] for x in SCHEMA.split(", ")], [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.string()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    got = parse(unwrap(content.as_py() or b""), ".cjcmcg" in (song or "").replace("\\", "/").rsplit("/", 1)[-1].lower())
                except _BROKEN as error:  # NotCells is one
                    if mode == "fail":
                        raise ValueError(f"{song}: {error}") from error
                    if mode == "rows":
                        yield rows([(song, None, "error", 0, None, None, None, None, str(error))])
                    continue
                head = [(song, got.ppqn, "tempo", k, t, 0, 0, us, None) for k, (t, us) in enumerate(got.tempos)]
                head += [(song, got.ppqn, "note", k, None, None, None, None, r) for k, r in enumerate(got.remarks)]
                yield rows([*head, (song, got.ppqn, "end", 0, got.last, 0, 0, None, None)])
                ticks = np.flatnonzero((got.ons != 0) | (got.offs != 0))
                for a in range(0, len(ticks), 100_000):
                    t = ticks[a : a + 100_000]
                    n = len(t)
                    cols = [pa.array([song] * n, pa.string()), pa.array(np.full(n, got.ppqn, np.int32)), pa.array(["cell"] * n), pa.array(np.zeros(n, np.int64)), pa.array(t), pa.array(got.ons[t]), pa.array(got.offs[t]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read_cells(files: DataFrame, mode: str = "drop") -> DataFrame:
    """(song_id, content) to rows of kind tempo, cell and end, and of kind note with a remark on the file.

    Compressed files are unwrapped. Files of another kind give no row (drop), one of kind error (rows), or end the query
    (fail). A file whose name, the end of song_id, says that it is one may have data after its table.
    """
    return files.select("song_id", "content").mapInArrow(_read(_checked(mode)), SCHEMA)


def cell_deltas(rows: DataFrame) -> DataFrame:
    """(song_id, tick, ons, delta, cc): offs beyond what the whole song holds do nothing; ons go first within a tick."""
    cells = rows.where("kind = 'cell'").withColumn("x", F.col("ons") - F.col("offs"))
    return held(cells, ["song_id"], ["tick"], width=BUCKET).select("song_id", "tick", "ons", "delta", F.lit(0).cast("long").alias("cc"))


def cell_frames(rows: DataFrame, fps: float = 60.0, end_delay: float = 0.0) -> DataFrame:
    """Frames of the songs that read_cells() gave: no control changes, no time signatures."""
    from ..plans.frames import frames
    from ..store import materialize

    rows = materialize(rows.where("kind in ('tempo', 'cell', 'end')"))
    songs = rows.where("kind = 'end'").select("song_id", "ppqn", F.col("tick").alias("max_tick"))
    tempo = rows.where("kind = 'tempo'").select("song_id", "tick", "us", F.lit(0).alias("track_idx"), "seq")
    meter = tempo.where("false").select("song_id", "tick", F.lit(4).alias("num"), F.lit(2).alias("dd"), "track_idx", "seq")
    return frames(cell_deltas(rows), tempo, meter, songs, fps, end_delay)
