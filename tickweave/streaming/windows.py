"""The closed window over a stream of timed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def closed_window_stream(rows: DataFrame, keys: list[str], time: str, columns: dict[str, str], width: int, late: str) -> DataFrame:
    """Exact sums over the closed window [t - width, t] for each distinct time of a stream: keys, micros, the columns, and the sums.

    rows is a stream with a timestamp column ``time``; width is in microseconds; columns maps a sum's name to its long
    column, whose total at that time is returned beside it. Rows of one time count together and nulls as 0; rows with a
    null time are dropped. Rows may come out of order by ``late`` at most, later ones are dropped.

    Each row is copied into the next bucket of one width, as in the batch form. A bucket's state holds one total for each
    distinct time of two buckets; it is emitted, in append mode, and forgotten when the watermark passes its end.
    """
    sums, inputs = list(columns), list(dict.fromkeys(columns.values()))
    timed = rows.where(F.col(time).isNotNull()).withWatermark(time, late)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    flat = timed.select(*keys, time, micros.alias("micros"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in inputs))
    bucket = F.expr(f"cast(floor(micros / {width}) as bigint)")
    copies = flat.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))

    key_fields = [StructField(k, rows.schema[k].dataType) for k in keys]
    out_schema = StructType([*key_fields, StructField("micros", LongType()), *(StructField(c, LongType()) for c in inputs + sums)])
    state_schema = StructType([StructField(c, ArrayType(LongType())) for c in ["micros", *inputs]])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = int(key[-1]) * width
        if not state.hasTimedOut:
            parts = [b[["micros", *inputs]] for b in batches]
            if state.exists:
                parts.append(pd.DataFrame(dict(zip(["micros", *inputs], map(list, state.get), strict=True))))
            held = pd.concat(parts).groupby("micros", as_index=False).sum()
            state.update(tuple(held[c].astype("int64").tolist() for c in ["micros", *inputs]))
            state.setTimeoutTimestamp(-(-(start + width) // 1000))
            return
        held = dict(zip(["micros", *inputs], (np.array(x, np.int64) for x in state.get), strict=True))
        state.remove()
        at = held["micros"]
        own = at >= start
        if own.any():
            first, last = np.searchsorted(at, at[own] - width, "left"), np.searchsorted(at, at[own], "right")
            out = {k: [v] * int(own.sum()) for k, v in zip(keys, key[:-1], strict=True)}
            out |= {c: held[c][own] for c in ["micros", *inputs]}
            for name, c in columns.items():
                total = np.r_[0, np.cumsum(held[c])]
                out[name] = total[last] - total[first]
            yield pd.DataFrame(out)[[*keys, "micros", *inputs, *sums]]

    return copies.groupBy(*keys, "bucket").applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
