"""Saturating counters, tick cells, totals, series and multiplicities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def held(df: DataFrame, keys: list[str], order: list[str], change: str = "x", out: str = "held", width: float | None = None) -> DataFrame:
    """Add the value of a counter that saturates at 0 after each row's change, and ``delta``, what the row really changed.

    With P the sum of the changes before a row, the counter stands at P - min P before it and at S - min(min P, S) after
    it, where S = P + change: two running aggregates, no state. With ``width`` they run in two levels, over buckets of so
    many units of the first order column, for keys with very many rows. Null changes count as 0.
    """
    x = F.coalesce(F.col(change), F.lit(0))
    if width:
        summed = running(df, keys, order, {"__s": ("sum", change)}, width).withColumn("__p", F.col("__s") - x)
        low = running(summed, keys, order, {"__low": ("min", "__p")}, width)
    else:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = df.withColumn("__s", F.sum(x).over(upto)).withColumn("__p", F.col("__s") - x)
        low = summed.withColumn("__low", F.min("__p").over(upto))
    counted = low.withColumn(out, F.col("__s") - F.least("__low", "__s"))
    return counted.withColumn("delta", F.col(out) - (F.col("__p") - F.col("__low"))).drop("__s", "__p", "__low")


def status_kind(status: Column) -> tuple[Column, Column]:
    """Kind and channel of a status byte; system bytes have the kind system."""
    names = F.array(*map(F.lit, ("off", "on", "touch", "cc", "program", "pressure", "bend", "system")))
    high = F.shiftright(status.cast("int"), 4)
    return F.when(high.between(8, 15), F.element_at(names, high - 7)), status.cast("int").bitwiseAND(F.lit(15))


def note_deltas(events: DataFrame, vel0_is_off: bool = True, close_held: bool = False) -> DataFrame:
    """Events (song_id, track_idx, seq, tick, kind, channel, key, value) to (song_id, track_idx, tick, ons, delta, cc).

    A note-off counts only while its key is held in its track and channel. With close_held, what a track still holds is
    released at its last tick.
    """
    on = (F.col("kind") == "on") & ((F.col("value") > 0) | F.lit(not vel0_is_off))
    off = (F.col("kind") == "off") | ((F.col("kind") == "on") & ~on)
    notes = events.where(F.col("kind").isin("on", "off")).withColumn("x", F.when(on, 1).when(off, -1).otherwise(0).cast("long"))
    counted = held(notes, ["song_id", "track_idx", "channel", "key"], ["seq"])
    out = counted.select("song_id", "track_idx", "tick", F.when(F.col("x") > 0, 1).otherwise(0).cast("long").alias("ons"), "delta", F.lit(0).cast("long").alias("cc"))
    zero = F.lit(0).cast("long")
    out = out.unionByName(events.where("kind = 'cc'").select("song_id", "track_idx", "tick", zero.alias("ons"), zero.alias("delta"), F.lit(1).cast("long").alias("cc")))
    if close_held:
        ends = events.groupBy("song_id", "track_idx").agg(F.max("tick").alias("tick"))
        left = out.groupBy("song_id", "track_idx").agg((-F.sum("delta")).alias("delta")).where("delta <> 0")
        out = out.unionByName(left.join(ends, ["song_id", "track_idx"]).select("song_id", "track_idx", "tick", zero.alias("ons"), "delta", zero.alias("cc")))
    return out


def tick_cells(deltas: DataFrame, keys: list[str], time: str, mult: str | None = None) -> DataFrame:
    """Sums of ons, delta and cc by key and time, each row counted ``mult`` times; cells where all are 0 are left out."""
    times = F.col(mult) if mult else F.lit(1)
    cells = deltas.groupBy(*keys, time).agg(*(F.sum(F.col(c) * times).cast("long").alias(c) for c in ("ons", "delta", "cc")))
    return cells.where("ons <> 0 or delta <> 0 or cc <> 0")


def last_wins(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the columns of its last row by ``order``."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__v"))
    return last.select(*keys, *(F.col("__v")[c].alias(c) for c in columns))


def series(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Runs of equal cells at equal steps: keys, start, step, count and the columns; a lone cell has step 0.

    Each cell belongs to the run in which it stands with the same values and the same step as the cell before.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = df.withColumn("__step", F.when(same, F.col(time) - F.lag(time).over(order)))
    # a run goes on where the step is the run's own; after a break the next equal cell sets the step
    prior = F.lag("__step").over(order)
    breaks = F.when(F.col("__step").isNull(), 1).when(prior.isNull(), 0).when(F.col("__step") == prior, 0).otherwise(1)
    rows = rows.withColumn("__run", F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "__run", *columns).agg(F.min(time).alias("start"), F.max(time).alias("__end"), F.count("*").alias("count"))
    step = F.when(F.col("count") > 1, (F.col("__end") - F.col("start")) / (F.col("count") - 1)).otherwise(0).cast("long")
    return out.select(*keys, "start", step.alias("step"), "count", *columns)


def expand_series(runs: DataFrame, time: str) -> DataFrame:
    """The cells of series() again."""
    steps = F.when(F.col("count") > 1, F.sequence(F.col("start"), F.col("start") + (F.col("count") - 1) * F.col("step"), F.greatest(F.col("step"), F.lit(1).cast("long")))).otherwise(F.array("start"))
    return runs.withColumn(time, F.explode(steps)).drop("start", "step", "count")


def dup_lengths(df: DataFrame, length: str) -> DataFrame:
    """Lengths that occur at least twice: only those can hold repeated content."""
    return df.groupBy(length).agg(F.count("*").alias("n")).where("n >= 2")


def distinct_content(df: DataFrame, length: str, content: str, keep: list[str]) -> DataFrame:
    """One row for each distinct content (by length and SHA-256) with its multiplicity ``mult`` and the least of ``keep``."""
    hashed = df.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.groupBy(length, "hash").agg(F.count("*").alias("mult"), *(F.min(k).alias(k) for k in keep), F.first(content).alias(content))


def merge_sum(frames: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Sums by key over several inputs."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in columns))


def repeat_effect(total: Column, lowest: Column, highest: Column, times: Column) -> tuple[Column, Column, Column]:
    """Sum, least and greatest prefix of a block that stands ``times`` times in a row, in closed form."""
    more = (times - 1) * total
    return total * times, F.least(lowest, lowest + more), F.greatest(highest, highest + more)


def concat_effect(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """(deficit, net) of one block after another: a deficit is how many offs go beyond what the block holds."""
    return F.greatest(a[0], b[0] - a[1]), a[1] + b[1]
