"""Tempo and meter maps, and the as-of lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ticks import last_wins

DEFAULT_US = 500_000


def tempo_map(changes: DataFrame, songs: DataFrame) -> DataFrame:
    """(song_id, tick, us, time_sec, exact_t, next_tick, next_sec): changes (song_id, tick, us, track_idx, seq) and songs (song_id, ppqn).

    The last change of a tick wins; 120 beats a minute hold until the first. time_sec adds segment by segment in doubles,
    exact_t in integers (ticks times microseconds a quarter).
    """
    wins = last_wins(changes.where("us > 0"), ["song_id", "tick"], ["track_idx", "seq"], ["us"])
    start = songs.select("song_id", F.lit(0).cast("long").alias("tick")).join(wins.where("tick = 0").select("song_id").distinct(), "song_id", "left_anti")
    whole = wins.select("song_id", "tick", F.col("us").cast("long").alias("us")).unionByName(start.withColumn("us", F.lit(DEFAULT_US).cast("long")))
    whole = whole.join(songs.select("song_id", "ppqn"), "song_id")
    order = Window.partitionBy("song_id").orderBy("tick")
    step, rate = F.col("tick") - F.lag("tick").over(order), F.lag("us").over(order)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = whole.withColumn("d", F.coalesce(step * rate, F.lit(0).cast("long")))
    parts = parts.withColumn("s", F.col("d").cast("double") / (F.col("ppqn") * F.lit(1e6)))
    return parts.select("song_id", "tick", "us", F.sum("s").over(upto).alias("time_sec"), F.sum("d").over(upto).alias("exact_t"), F.lead("tick").over(order).alias("next_tick")).withColumn("next_sec", F.lead("time_sec").over(order))


def asof(rows: DataFrame, at: Column, dim: DataFrame, valid: str, columns: list[str], keys: list[str], first: str, width: float = 1 << 16) -> DataFrame:
    """Add to rows the columns of the dim row with the greatest ``valid`` at most ``at``, within keys: union and carry the last forward.

    Both sides meet in one sorted pass by key and bucket of ``width`` units of the place, so the rows of one huge song
    are spread over its buckets; a dim row goes before the rows at the same place. What holds at a bucket's start is
    copied into it, once for each bucket between the first and the last dim row. Rows in buckets beyond the last dim row
    get that one, rows before the first get the first (by ``first``, the column that orders dim). rows is read once.
    """
    v = F.struct(*columns)
    bucket = F.expr(f"cast(floor(__at / {width}) as bigint)")
    kind = dict(dim.dtypes)[valid]
    dims = dim.select(*keys, F.col(valid).alias("__at"), F.lit(0).alias("__s"), v.alias("__v"), F.col(first).alias("__by")).withColumn("__b", bucket)
    ends = dims.groupBy(*keys).agg(F.min_by("__v", "__by").alias("__first"), F.max_by("__v", "__by").alias("__last"), F.max("__b").alias("__hi"))
    until = F.lead("__b").over(Window.partitionBy(*keys).orderBy("__at"))
    copies = dims.withColumn("__n", until).where("__n > __b").withColumn("__b", F.explode(F.expr("sequence(__b + 1, __n)"))).withColumn("__s", F.lit(-1)).drop("__n")
    left = rows.select(*rows.columns, (at.cast("double") if kind == "double" else at).alias("__at"), F.lit(1).alias("__s")).withColumn("__b", bucket)
    both = left.unionByName(dims.unionByName(copies).drop("__by"), allowMissingColumns=True)
    # a copy stands before all else in its bucket
    seen = Window.partitionBy(*keys, "__b").orderBy(F.col("__s") >= 0, "__at", "__s").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__got", F.last("__v", ignorenulls=True).over(seen)).where("__s = 1").join(ends, keys, "left")
    got = got.withColumn("__got", F.coalesce("__got", F.when(F.col("__b") > F.col("__hi"), F.col("__last")).otherwise(F.col("__first"))))
    return got.select(*rows.columns, *(F.col("__got")[c].alias(c) for c in columns))


def meter_map(changes: DataFrame, songs: DataFrame) -> DataFrame:
    """(song_id, tick, num, dd, beats, measures): beats and measures that precede each segment.

    changes (song_id, tick, num, dd, track_idx, seq). 4/4 holds from the start; numerator 0 and denominators above 2^32
    are ignored; the last of a tick wins; a restatement is none; a change cuts the beat and the measure, which count whole.
    """
    valid = changes.where("num > 0 and dd <= 32")
    wins = last_wins(valid, ["song_id", "tick"], ["track_idx", "seq"], ["num", "dd"])
    start = songs.select("song_id", F.lit(0).cast("long").alias("tick")).join(wins.where("tick = 0").select("song_id").distinct(), "song_id", "left_anti")
    whole = wins.select("song_id", "tick", F.col("num").cast("long"), F.col("dd").cast("long")).unionByName(start.withColumn("num", F.lit(4).cast("long")).withColumn("dd", F.lit(2).cast("long")))
    order = Window.partitionBy("song_id").orderBy("tick")
    before = F.lag(F.struct("num", "dd")).over(order)
    kept = whole.withColumn("same", F.coalesce((F.col("num") == before["num"]) & (F.col("dd") == before["dd"]), F.lit(False))).where("not same").join(songs.select("song_id", "ppqn"), "song_id")
    prior = F.lag(F.struct("tick", "num", "dd")).over(order)
    span = (F.col("tick") - prior["tick"]).cast("decimal(38,0)") * F.pow(F.lit(2), prior["dd"]).cast("decimal(20,0)")
    ceil = lambda n: F.coalesce(F.ceil(span / (F.lit(4) * F.col("ppqn") * n)).cast("long"), F.lit(0).cast("long"))
    cut = kept.withColumn("__b", ceil(F.lit(1))).withColumn("__m", ceil(prior["num"]))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return cut.select("song_id", "tick", "num", "dd", F.sum("__b").over(upto).alias("beats"), F.sum("__m").over(upto).alias("measures"), "ppqn")


def meter_place(tick: Column, end: Column, segment: str = "seg_tick") -> dict[str, Column]:
    """beat, measure and measure_beat at a tick, from the columns of its meter segment; the tick is clamped into [0, end)."""
    at = F.greatest(F.lit(0).cast("long"), F.least(tick, end - 1))
    span = (at - F.col(segment)).cast("decimal(38,0)") * F.pow(F.lit(2), F.col("dd")).cast("decimal(20,0)")
    whole = lambda n: F.floor(F.greatest(span, F.lit(0)) / (F.lit(4) * F.col("ppqn") * n)).cast("long")
    b, m = whole(F.lit(1)), whole(F.col("num"))
    return {"beat": F.col("beats") + b + 1, "measure": F.col("measures") + m + 1, "measure_beat": b - m * F.col("num") + 1}
