"""Frames as tables and files, and counters that ride along with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Frames below path, a folder for each song, sorted by frame within its files; Parquet, CSV with a header, or another format."""
    dealt = frames.repartition("song_id").sortWithinPartitions("song_id", "frame_index")
    writer = dealt.write.mode(mode).partitionBy("song_id").format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)


def read_frames(spark, path: str, schema, format: str = "parquet") -> DataFrame:
    """What write_frames() wrote; schema is that of the frames, which CSV does not keep."""
    reader = spark.read.format(format).schema(schema)
    return (reader.option("header", True) if format == "csv" else reader).load(path)


def counted(events: DataFrame, name: str = "events") -> tuple[DataFrame, Observation]:
    """Events, and an observation that has their counters once an action on them has run: events, notes, cc, tracks' ends, last tick.

    The counters cost no pass of their own; ``observation.get`` waits for the action.
    """
    seen = Observation(name)
    kind = F.col("kind")
    metrics = [
        F.count(F.when(kind != "end", 1)).alias("events"), F.count(F.when((kind == "on") & (F.col("value") > 0), 1)).alias("notes"), F.count(F.when(kind == "cc", 1)).alias("cc"),
        F.count(F.when(kind == "end", 1)).alias("tracks"), F.max("tick").alias("last_tick"),
    ]
    return events.observe(seen, *metrics), seen
