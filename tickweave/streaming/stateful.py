"""Streams with state of their own: saturating counters, and tracks decoded from pieces of bytes as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..sources.layered import segment
from ..sources.midi import KINDS


def held_stream(rows: DataFrame, keys: list[str], order: str, change: str = "x") -> DataFrame:
    """The saturating counter of held() over a stream: keys, the order column, change, held and delta.

    A key's state is one number. Rows of a key must come in order from one micro-batch to the next; within one they are
    sorted. Null changes count as 0.
    """
    fields = [*(StructField(k, rows.schema[k].dataType) for k in keys), StructField(order, LongType()), StructField(change, LongType()), StructField("held", LongType()), StructField("delta", LongType())]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches)).sort_values(order, kind="stable")
        x = table[change].fillna(0).to_numpy(np.int64)
        have = state.get[0] if state.exists else 0
        upto = have + np.cumsum(x)
        held = upto - np.minimum(0, np.minimum.accumulate(upto))
        state.update((int(held[-1]),))
        out = {k: [v] * len(x) for k, v in zip(keys, key, strict=True)}
        yield pd.DataFrame(out | {order: table[order].to_numpy(np.int64), change: x, "held": held, "delta": np.diff(np.r_[have, held])})

    plain = rows.select(*keys, F.col(order).cast("long").alias(order), F.col(change).cast("long").alias(change))
    return plain.groupBy(*keys).applyInPandasWithState(step, StructType(fields), StructType([StructField("held", LongType())]), "append", GroupStateTimeout.NoTimeout)


_EVENT = ("tick", "channel", "key", "value", "us", "num", "dd")


def decode_stream(pieces: DataFrame, vel0_is_off: bool = False) -> DataFrame:
    """Pieces of tracks (song_id, track_idx, piece, last, bytes) to their events, as soon as they are whole.

    A track's state is what the grammar holds between two pieces: bytes of an event that is not whole, the held status,
    bytes to pass over, the tick and the number of events; pieces that come early wait in it. ``last`` marks a track's
    last piece, which gives the event of kind end. A piece that comes again is left aside. Unless vel0_is_off, note-ons
    of velocity 0 stay note-ons.
    """
    out_schema = StructType([StructField("song_id", StringType()), StructField("track_idx", LongType()), StructField("seq", LongType()), StructField("kind", StringType()), *(StructField(c, LongType()) for c in _EVENT)])
    longs = ("next", "status", "skip", "tick", "seq", "ends")
    state_schema = StructType([*(StructField(c, LongType()) for c in longs), StructField("pending", BinaryType()), StructField("early", ArrayType(LongType())), StructField("bytes", ArrayType(BinaryType()))])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, status, skip, tick, seq, ends, pending, early, held = state.get if state.exists else (0, 0, 0, 0, 0, -1, b"", [], [])
        waiting = {int(k): bytes(b) for k, b in zip(early, held, strict=True)}
        for table in batches:
            for piece, last, body in zip(table["piece"], table["last"], table["bytes"], strict=True):
                if piece >= at:
                    waiting[int(piece)] = bytes(body) if body is not None else b""
                if last:
                    ends = int(piece)
        parts = []
        while at in waiting:
            found = segment(bytes(pending) + waiting.pop(at), status, skip, at == ends, vel0_is_off)
            n = len(found.ticks)
            cols = [found.ticks + tick, *found.columns]
            parts.append(pd.DataFrame({"seq": np.arange(seq, seq + n), "kind": [KINDS[k] for k in found.kinds.tolist()]} | {c: pd.Series(v, dtype="Int64").where(pd.Series(v) >= 0) for c, v in zip(_EVENT, cols, strict=True)}))
            (pending, status, skip), tick, seq = found.shape, tick + found.moved, seq + n
            if at == ends:
                parts.append(pd.DataFrame({"seq": [seq], "kind": ["end"], "tick": pd.Series([tick], dtype="Int64")}))
            at += 1
        state.update((at, status, skip, tick, seq, ends, bytes(pending), list(waiting), list(waiting.values())))
        if parts:
            whole = pd.concat(parts, ignore_index=True)
            whole.insert(0, "song_id", key[0])
            whole.insert(1, "track_idx", key[1])
            yield whole.reindex(columns=[f.name for f in out_schema])

    plain = pieces.select("song_id", F.col("track_idx").cast("long").alias("track_idx"), F.col("piece").cast("long").alias("piece"), F.coalesce("last", F.lit(False)).alias("last"), "bytes")
    return plain.groupBy("song_id", "track_idx").applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
