"""MIDI tracks as a Spark data source, and the decoder as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from .midi import _BROKEN, KINDS, TRACKS, _checked, _rows, decoded, spans, tracks, unwrap

#: First bytes of files that are unwrapped whole, in one task.
_PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\0", b"\x28\xb5\x2f\xfd")


class Spans(InputPartition):
    """Tracks of one file that one task reads: (index, offset, declared length); None for a packed file."""

    def __init__(self, song: str, ppqn: int, found: list[tuple[int, int, int]] | None, error: str | None = None) -> None:
        self.song, self.ppqn, self.found, self.error = song, ppqn, found, error


class MidiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.mode, self.each = _checked(options.get("mode", "drop")), int(options.get("bytesPerPartition", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        """Consecutive tracks of about bytesPerPartition, from chunk headers alone."""
        store, place = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = store.get_file_info(place)
        files = [info] if info.type == pyarrow.fs.FileType.File else [f for f in store.get_file_info(pyarrow.fs.FileSelector(place, recursive=True)) if f.type == pyarrow.fs.FileType.File]
        out: list[InputPartition] = []
        for file in sorted(files, key=lambda f: f.path):
            with store.open_input_file(file.path) as data:
                read = lambda at, n, data=data, size=file.size: data.read_at(max(0, min(n, size - at)), at)
                if read(0, 6).startswith(_PACKED) or read(257, 5) == b"ustar":
                    out.append(Spans(file.path, 0, None))
                    continue
                try:
                    ppqn, found = spans(read, file.size)
                except _BROKEN as error:
                    out.append(Spans(file.path, 0, [], f"{type(error).__name__}: {error}"))
                    continue
            held, size = [], 0
            for k, (off, length) in enumerate(found):
                held.append((k, off, length))
                size += length
                if size >= self.each or k + 1 == len(found):
                    out.append(Spans(file.path, ppqn, held))
                    held, size = [], 0
        return out

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        error = partition.error
        if error is None:
            with store.open_input_file(partition.song) as data:
                if partition.found is None:
                    try:
                        ppqn, found = tracks(unwrap(data.read()))
                        for k, (off, length, body) in enumerate(found):
                            yield _rows(TRACKS, [(partition.song, ppqn, k, off, len(body), length, body, None)])
                    except _BROKEN as broken:
                        error = f"{type(broken).__name__}: {broken}"
                else:
                    size = data.size()
                    for k, off, length in partition.found:
                        body = data.read_at(max(0, min(length, size - off)), off)
                        yield _rows(TRACKS, [(partition.song, partition.ppqn, k, off, len(body), length, body, None)])
        if error and self.mode == "fail":
            raise ValueError(f"{partition.song}: {error}")
        if error and self.mode == "rows":
            yield _rows(TRACKS, [(partition.song, None, None, None, None, None, None, error)])


class MidiSource(DataSource):
    """``spark.read.format("midi").load(path)``: the tracks below a path; options mode (drop, rows, fail) and bytesPerPartition.

    Plain files are read by track, so they may be of any size and one file's tracks go to many tasks; packed files are
    unwrapped by one task each. The driver reads the chunk headers; read_track_spans() does so on executors.
    """

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return TRACKS

    def reader(self, schema) -> MidiReader:
        return MidiReader(self.options)


@udtf(returnType="seq long, tick long, kind string, channel int, key int, value int, us int, num int, dd int")
class DecodeTrack:
    """Events of one track's bytes: ``SELECT * FROM tracks, LATERAL decode_track(bytes)``."""

    def eval(self, body: bytes):
        seq = 0
        for part in decoded(body) if body is not None else ():
            for row in zip(*(c.tolist() for c in part.values()), strict=True):
                yield seq, row[0], KINDS[row[1]], *(None if x < 0 else x for x in row[2:])
                seq += 1


def register(spark: SparkSession) -> None:
    """Make the format ``midi`` and the table function ``decode_track`` known to a session."""
    spark.dataSource.register(MidiSource)
    spark.udtf.register("decode_track", DecodeTrack)
