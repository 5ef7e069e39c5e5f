"""Events to MIDI files, as column expressions: the sink that the decoder reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hex(value: Column, size: int) -> Column:
    """The low bytes of a whole number, big-endian, as hexadecimal digits."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def number(value: Column) -> Column:
    """A variable-length number of at most four bytes, as hexadecimal digits."""
    v = value.cast("long")
    part = lambda k, more: _hex(F.shiftright(v, 7 * k).bitwiseAND(F.lit(127)) + F.lit(more), 1)
    one, two, three = part(0, 0), F.concat(part(1, 128), part(0, 0)), F.concat(part(2, 128), part(1, 128), part(0, 0))
    return F.when(v < 1 << 7, one).when(v < 1 << 14, two).when(v < 1 << 21, three).otherwise(F.concat(part(3, 128), part(2, 128), part(1, 128), part(0, 0)))


def message(kind: Column) -> Column:
    """An event without its time, as hexadecimal digits, from channel, key, value, us, num and dd."""
    c = F.col
    channel = lambda status: F.concat(_hex(F.lit(status) + c("channel"), 1), _hex(c("key"), 1), _hex(c("value"), 1))
    return (
        F.when(kind == "on", channel(0x90)).when(kind == "off", channel(0x80)).when(kind == "cc", channel(0xB0))
        .when(kind == "tempo", F.concat(F.lit("FF5103"), _hex(c("us"), 3))).when(kind == "timesig", F.concat(F.lit("FF5804"), _hex(c("num"), 1), _hex(c("dd"), 1), F.lit("1808")))
        .when(kind == "end", F.lit("FF2F00"))
    )


def write_songs(events: DataFrame, ppqn: int) -> DataFrame:
    """(song_id, track_idx, seq, tick, kind, channel, key, value, us, num, dd) to (song_id, content): a file for each song.

    Events go by tick and seq within their track; one of kind end at a track's last tick keeps its length. Tracks go by
    track_idx. Other kinds and null ticks are left out. Times between events must fit in 28 bits, a track in 2 GiB.
    """
    order = Window.partitionBy("song_id", "track_idx").orderBy("tick", "seq")
    step = F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0))
    body = events.where("tick is not null").select("song_id", "track_idx", "tick", "seq", F.concat(number(step), message(F.col("kind"))).alias("hex"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("tick", "seq", "hex"))), lambda x: x["hex"])
    tracks = body.where("hex is not null").groupBy("song_id", "track_idx").agg(F.array_join(in_order, "").alias("hex"))
    tracks = tracks.select("song_id", "track_idx", F.concat(F.lit("4D54726B"), _hex(F.length("hex") / 2, 4), "hex").alias("hex"))
    songs = tracks.groupBy("song_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    head = F.concat(F.lit("4D546864000000060001"), _hex(F.least("n", F.lit(65535)), 2), F.lit(f"{ppqn:04X}"))
    return songs.select("song_id", F.unhex(F.concat(head, "hex")).alias("content"))
