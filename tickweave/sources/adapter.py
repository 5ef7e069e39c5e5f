"""An event table as one song: users are tracks and keys, microseconds are exact time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One "second" and one frame of the adapted song in microseconds, and frames a second.
SECOND, FRAME, LAG = 3_600_000_000, 600_000_000, 6


def span(events: DataFrame) -> tuple[int, int]:
    """First and last microsecond of the table: two numbers, read once by whoever uses the adapted song more than once."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    return first or 0, last or 0


def adapt(events: DataFrame, first: int | None = None) -> DataFrame:
    """(track, seq, exact_t, x, cc): view and click are note-ons, purchase and error note-offs, signup a control change.

    first is the table's first microsecond; without it, it is found in the same query.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    x = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type").isin("purchase", "error"), -1).otherwise(0)
    rows = events.select(F.col("user_id").alias("track"), F.col("event_id").alias("seq"), micros.alias("m"), x.cast("long").alias("x"), (F.col("event_type") == "signup").cast("long").alias("cc"), "event_type")
    start = F.col("t0") if first is None else F.lit(first)
    if first is None:
        rows = rows.crossJoin(F.broadcast(events.agg(F.min(micros).alias("t0"))))  # one row
    return rows.select("track", "seq", (F.col("m") - start).alias("exact_t"), "x", "cc", "event_type")


def deltas(song: DataFrame) -> DataFrame:
    """(song, track, exact_t, ons, delta, cc) of an adapted table, in one pass: control changes leave the counters as they are."""
    from ..operators.ticks import held

    rows = held(song.where("x <> 0 or cc = 1"), ["track"], ["exact_t", "seq"])
    return rows.select(F.lit(0).alias("song"), "track", "exact_t", F.when(F.col("x") > 0, 1).otherwise(0).cast("long").alias("ons"), "delta", "cc")
