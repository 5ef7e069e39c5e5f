"""Running aggregates in two levels, so that one long song is not one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def bucketed(column: str, width: float) -> Column:
    """Number of the bucket of ``width`` units that a place falls into."""
    return F.expr(f"cast(floor(`{column}` / {width}) as bigint)")


def carried(local: DataFrame, keys: list[str], bucket: str, totals: dict[str, Column], before: dict[str, tuple[str, str]]) -> DataFrame:
    """Add to rows what holds before their bucket: totals of each bucket, folded over the buckets before it.

    local must be cheap to read twice: a written table. totals are aggregates of a bucket by name; before maps a new name
    to (fold, total). There is one row for each bucket, which AQE broadcasts where they are few.
    """
    sums = local.groupBy(*keys, bucket).agg(*(c.alias(n) for n, c in totals.items()))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    on = [f"__on{k}" for k in range(len(keys) + 1)]
    carry = sums.select(*(F.col(k).alias(o) for k, o in zip([*keys, bucket], on, strict=True)), *(_FOLD[f](t).over(earlier).alias(n) for n, (f, t) in before.items()))
    same = F.lit(True)
    for k, o in zip([*keys, bucket], on, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return local.join(carry, same, "left").drop(*on)


def running(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, str]], width: float) -> DataFrame:
    """Add running aggregates over ``order`` within ``keys``; columns maps a new name to ("sum" | "max" | "min" | "last", column).

    Rows fall into buckets of ``width`` units of the first order column. The running aggregates inside buckets are
    written once; bucket totals get a running aggregate of their own, one row for each bucket, which is added to them.
    Equal to one window over the whole key. ``last`` carries the last value that is not null. order must tell rows apart
    where ties matter. df is read once.
    """
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__bucket", bucketed(order[0], width))
    local = materialize(rows.select("*", *(_FOLD[f](c).over(inside).alias(n) for n, (f, c) in columns.items())))
    # a bucket's last running value is its total
    end = lambda n, f: _FOLD[f](n) if f in ("max", "min") else F.max_by(n, F.struct(*order))
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order)))
    totals = {f"__of_{n}": F.sum(c) if f == "sum" else last(n) if f == "last" else end(n, f) for n, (f, c) in columns.items()}
    both = carried(local, keys, "__bucket", totals, {f"__up_{n}": (f, f"__of_{n}") for n, (f, _) in columns.items()})
    for n, (f, _) in columns.items():
        c = F.col(f"__up_{n}")
        whole = {"sum": F.coalesce(F.col(n), F.lit(0)) + F.coalesce(c, F.lit(0)), "max": F.greatest(n, c), "min": F.least(n, c), "last": F.coalesce(F.col(n), c)}[f]
        both = both.withColumn(n, whole).drop(f"__up_{n}")
    return both.drop("__bucket")


def closed_window(df: DataFrame, keys: list[str], time: str, columns: dict[str, str], width) -> DataFrame:
    """Add exact sums over the closed window [time - width, time]; width is a number or a column that is constant within keys.

    The sums run inside buckets of one width. A row enters its own bucket and the next one, which its window reaches,
    and leaves that just after its time and one width: a running sum of what enters and leaves, whatever a window holds.
    Rows at one time all see each other.
    """
    summed = window_sums(moves(df, time, width), [*keys, "__bucket"], columns)
    return summed.where("__k = 0").drop("__k", "__bucket", "__t", "__sign")


def moves(df: DataFrame, time: str, width) -> DataFrame:
    """Three rows for each: __bucket of one width, __t and __sign; __k is 0 for the row itself, 1 for what it does in the next bucket."""
    size = F.lit(width) if isinstance(width, int) else width
    at = F.col(time)
    bucket = F.floor(at / size).cast("bigint")
    move = lambda k, t, sign: F.struct(F.lit(k).alias("k"), t.cast("bigint").alias("t"), F.lit(sign).alias("sign"))
    put = df.withColumn("__put", F.explode(F.array(move(0, at, 1), move(1, at, 1), move(1, at + size + 1, -1))))
    return put.select(*df.columns, F.col("__put.k").alias("__k"), (bucket + F.col("__put.k")).alias("__bucket"), F.col("__put.t").alias("__t"), F.col("__put.sign").alias("__sign"))


def window_sums(moved: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Sums of what has entered and not left, for rows of moves()."""
    over = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    return moved.select("*", *(F.sum(F.col(c) * F.col("__sign")).over(over).alias(n) for n, c in columns.items()))
