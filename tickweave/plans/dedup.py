"""Repeated tracks: decode each distinct content once and count it as often as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ticks import distinct_content, note_deltas, tick_cells
from ..sources.midi import read_events


def distinct_tracks(tracks: DataFrame) -> DataFrame:
    """(song_id, ppqn, track_idx, bytes, mult): one row for each distinct track body of a song, with the times it stands there."""
    hashed = tracks.withColumn("hash", F.sha2("bytes", 256))
    return hashed.groupBy("song_id", "len", "hash").agg(F.max("ppqn").alias("ppqn"), F.min("track_idx").alias("track_idx"), F.count("*").alias("mult"), F.first("bytes").alias("bytes"))


def weighted_cells(tracks: DataFrame, **options) -> DataFrame:
    """Tick cells of songs from their distinct tracks; equal to decoding every track."""
    once = distinct_tracks(tracks)
    deltas = note_deltas(read_events(once), **options)
    times = once.select("song_id", "track_idx", "mult")
    return tick_cells(deltas.join(times, ["song_id", "track_idx"]), ["song_id"], "tick", "mult")


__all__ = ["distinct_content", "distinct_tracks", "weighted_cells"]
