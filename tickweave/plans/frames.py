"""One row of statistics for each frame of a song."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import bucketed, moves, window_sums
from ..store import materialize
from .maps import asof, meter_map, meter_place, tempo_map

#: Seconds in a bucket of the lookups by time, and frames in a block of the grid.
SPAN, BLOCK = 64.0, 4096


def grid(cells: DataFrame, ends: DataFrame, keys: list[str], lag: int, time: str) -> DataFrame:
    """Every frame 0..last_frame of each key with its state at the frame's end.

    cells come from swept(), with a column frame; ends has keys and last_frame. Result: keys, k, cum, cum_cc, nps (over
    ``lag`` frames), cps, peak_nps, peak_cps, poly, peak_poly. A frame that has cells holds until the next one that has:
    it is repeated block by block, so a long silence is not one row's sequence. The value ``lag`` frames ago is found
    within a block and the last frames of the one before, which are copied into it.
    """
    state = ["cum", "cum_cc", "poly", "peak_poly", "peak_nps", "peak_cps"]
    held = cells.groupBy(*keys, F.col("frame").alias("k")).agg(*(F.max_by(c, time).alias(c) if c == "poly" else F.max(c).alias(c) for c in state))
    zero = [F.lit(0).cast("long").alias(c) for c in state]
    held = held.unionByName(ends.select(*keys, F.lit(-1).cast("long").alias("k"), *zero))
    until = F.lead("k").over(Window.partitionBy(*keys).orderBy("k"))
    held = held.withColumn("next", until).join(ends, keys).where("k <= last_frame")
    held = held.withColumn("next", F.least(F.coalesce(F.col("next") - 1, F.col("last_frame")), F.col("last_frame"))).withColumn("k", F.greatest("k", F.lit(0).cast("long"))).where("next >= k")
    block = max(BLOCK, lag)
    held = held.withColumn("b", F.explode(F.expr(f"sequence(k div {block}, next div {block})")))
    every = held.withColumn("k", F.explode(F.expr(f"sequence(greatest(k, b * {block}), least(next, b * {block} + {block - 1}))")))
    copies = every.select(*keys, "k", *state, F.explode(F.expr(f"if(k % {block} >= {block - lag}, array(b, b + 1), array(b))")).alias("block"))
    order = Window.partitionBy(*keys, "block").orderBy("k")
    ago = lambda c: (F.col(c) - F.coalesce(F.lag(c, lag).over(order), F.lit(0))).cast("long")
    both = copies.select(*keys, "k", *state, "block", ago("cum").alias("nps"), ago("cum_cc").alias("cps"))
    return both.where(f"k div {block} = block").select(*keys, "k", "cum", "cum_cc", "nps", "cps", "peak_nps", "peak_cps", "poly", "peak_poly")


def swept(cells: DataFrame, keys: list[str], time: str, second) -> DataFrame:
    """Cells with running sums, the running peaks and the closed window of one ``second``: cum, cum_cc, poly, peak_poly, nps, cps, peak_nps, peak_cps.

    One pass over buckets of a second gives the windows and the running values inside a bucket; they are written once, and
    what the buckets before come to is added. cells have one row for each time; they are read once.
    """
    moved, bucket = moves(cells, time, second), [*keys, "__bucket"]
    own = lambda c: F.when(F.col("__k") == 0, F.col(c)).otherwise(0)
    upto = Window.partitionBy(*bucket).orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    summed = window_sums(moved, bucket, {"nps": "ons", "cps": "cc"})
    local = summed.select("*", *(F.sum(own(c)).over(upto).alias(n) for n, c in (("cum", "ons"), ("cum_cc", "cc"), ("poly", "delta")))).where("__k = 0")
    local = local.select("*", *(F.max(c).over(upto).alias(n) for n, c in (("peak_poly", "poly"), ("peak_nps", "nps"), ("peak_cps", "cps")))).drop("__k", "__t", "__sign")
    # seconds are short: their totals are carried over wider buckets first
    local = materialize(local)
    totals = {"t_ons": F.sum("ons"), "t_cc": F.sum("cc"), "t_delta": F.sum("delta"), "t_poly": F.max("peak_poly"), "t_nps": F.max("peak_nps"), "t_cps": F.max("peak_cps")}
    sums = local.groupBy(*keys, "__bucket").agg(*(c.alias(n) for n, c in totals.items()))
    return _with_carry(local, sums, keys)


def _with_carry(local: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Add the sums and peaks of the buckets before: running over wide buckets of buckets, so that no window holds a whole song."""
    wide = sums.withColumn("wide", bucketed("__bucket", BLOCK))
    inside = Window.partitionBy(*keys, "wide").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    part = wide.select(*keys, "wide", "__bucket", "t_ons", "t_cc", "t_delta", "t_poly", "t_nps", "t_cps", *(zero(F.sum(c).over(inside)).alias(n) for n, c in (("p_ons", "t_ons"), ("p_cc", "t_cc"), ("p_delta", "t_delta"))))
    # a bucket's peak stands on what was held before it
    part = part.withColumn("t_poly", F.col("t_poly") + F.col("p_delta")).select("*", *(F.max(c).over(inside).alias(n) for n, c in (("p_poly", "t_poly"), ("p_nps", "t_nps"), ("p_cps", "t_cps"))))
    totals = {"w_ons": F.sum("t_ons"), "w_cc": F.sum("t_cc"), "w_delta": F.sum("t_delta"), "w_poly": F.max("t_poly"), "w_nps": F.max("t_nps"), "w_cps": F.max("t_cps")}
    tops = part.groupBy(*keys, "wide").agg(*(c.alias(n) for n, c in totals.items()))
    before = Window.partitionBy(*keys).orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("*", *(zero(F.sum(c).over(before)).alias(n) for n, c in (("u_ons", "w_ons"), ("u_cc", "w_cc"), ("u_delta", "w_delta"))))
    tops = tops.withColumn("w_poly", F.col("w_poly") + F.col("u_delta")).select(*(F.col(k).alias(f"__{k}") for k in [*keys, "wide"]), "u_ons", "u_cc", "u_delta", *(F.max(c).over(before).alias(n) for n, c in (("u_poly", "w_poly"), ("u_nps", "w_nps"), ("u_cps", "w_cps"))))
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names]
    joined = part.join(tops, same([*keys, "wide"])).select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__b"),
        *((F.col(f"p_{c}") + F.col(f"u_{c}")).alias(f"b_{c}") for c in ("ons", "cc", "delta")),
        F.greatest(F.col("p_poly") + F.col("u_delta"), "u_poly", F.lit(0)).alias("b_poly"), *(F.greatest(F.lit(0), f"p_{c}", f"u_{c}").alias(f"b_{c}") for c in ("nps", "cps")),
    )
    both = local.join(joined, [*same(keys), F.col("__bucket") == F.col("__b")])
    plus = {"cum": "b_ons", "cum_cc": "b_cc", "poly": "b_delta"}
    return both.select(
        *(F.col(c) for c in local.columns if c not in {"__bucket", "cum", "cum_cc", "poly", "peak_poly", "peak_nps", "peak_cps"}),
        *((F.col(c) + F.col(b)).cast("long").alias(c) for c, b in plus.items()),
        F.greatest(F.col("peak_poly") + F.col("b_delta"), "b_poly").cast("long").alias("peak_poly"), *(F.greatest(f"peak_{c}", f"b_{c}").cast("long").alias(f"peak_{c}") for c in ("nps", "cps")),
    )


#: Ticks that times of at most 28 bits can reach, and bins of a frame where peaks are taken over bins.
SPEC_TICK, BINS = 1 << 28, 8


def guarded(events: DataFrame, spec: str) -> DataFrame:
    """Events, with an error at one beyond SPEC_TICK if spec is fail; proceed and bins let it pass."""
    if spec not in ("proceed", "bins", "fail"):
        raise ValueError("spec must be proceed, bins or fail")
    if spec != "fail":
        return events
    broken = F.raise_error(F.concat(F.lit("a tick beyond the specification: "), F.col("tick").cast("string")))
    return events.withColumn("tick", F.when(F.col("tick") > SPEC_TICK, broken.cast("long")).otherwise(F.col("tick")))


def frames(deltas: DataFrame, tempo_changes: DataFrame, meter_changes: DataFrame, songs: DataFrame, fps: float = 60.0, end_delay: float = 0.0, bins: bool = False) -> DataFrame:
    """Frames of songs: deltas (song_id, tick, ons, delta, cc), songs (song_id, ppqn, max_tick).

    A cell's second is that of its tempo segment plus its ticks there; its frame is the second times fps, cut. A frame
    shows all cells up to its end, the tempo at its end, and the tick at its start. nps counts the last second in
    frames; peak_nps is exact, over closed seconds in integers. Frames of the end delay have no rates and no polyphony.
    With bins, for very long songs, cells are added up in eighths of a frame first and peaks are those of the bins.
    """
    keys = ["song_id"]
    # what several steps read is written once: the songs, then both maps as one table
    songs = materialize(songs.select("song_id", "ppqn", "max_tick"), small=True)
    tempo, meter = tempo_map(tempo_changes, songs), meter_map(meter_changes, songs)
    named = lambda df, name: df.select(F.lit(name).alias("map"), *df.columns)
    maps = materialize(named(tempo, "tempo").unionByName(named(meter, "meter"), allowMissingColumns=True), small=True)
    tempo, meter = (maps.where(F.col("map") == name).select(*df.columns) for name, df in (("tempo", tempo), ("meter", meter)))
    cells = deltas.groupBy("song_id", "tick").agg(*(F.sum(c).cast("long").alias(c) for c in ("ons", "delta", "cc"))).where("ons <> 0 or delta <> 0 or cc <> 0")
    tempo_named = tempo.select("song_id", F.col("tick").alias("seg"), F.struct(F.col("tick").alias("t0"), "us", "time_sec", "exact_t").alias("tempo"))
    at = asof(cells.join(songs.select("song_id", "ppqn"), "song_id"), F.col("tick"), tempo_named, "seg", ["tempo"], keys, "seg")
    inv = F.lit(1.0) / (F.col("ppqn") * F.lit(1e6))
    since = F.col("tick") - F.col("tempo.t0")
    timed = at.withColumn("sec", F.col("tempo.time_sec") + since.cast("double") * F.col("tempo.us").cast("double") * inv)
    timed = timed.withColumn("at_t", F.col("tempo.exact_t") + since * F.col("tempo.us")).withColumn("second", F.lit(1_000_000).cast("long") * F.col("ppqn"))
    timed = timed.withColumn("frame", F.floor(F.col("sec") * fps).cast("long")).drop("tempo")
    lag = max(1, int(fps + 0.5))
    if bins:
        binned = timed.withColumn("at_t", F.floor(F.col("sec") * fps * BINS).cast("long"))
        binned = binned.groupBy("song_id", "at_t").agg(*(F.sum(c).alias(c) for c in ("ons", "delta", "cc"))).withColumn("frame", F.expr(f"at_t div {BINS}"))
        done = swept(binned, keys, "at_t", lag * BINS - 1)
    else:
        done = swept(timed, keys, "at_t", F.col("second"))

    # one row for each song: its last tempo
    reached = songs.select("song_id", "ppqn", F.col("max_tick").alias("tick")).join(tempo_named, "song_id").where("seg <= tick or seg = 0")
    last = reached.groupBy("song_id", "ppqn", "tick").agg(F.max_by("tempo", "seg").alias("tempo"))
    length = F.col("tempo.time_sec") + (F.col("tick") - F.col("tempo.t0")).cast("double") * F.col("tempo.us").cast("double") * inv
    ends = last.select("song_id", "ppqn", F.col("tick").alias("max_tick"), length.alias("max_time"))
    ends = ends.select("*", (F.ceil(F.col("max_time") * fps) + 1).cast("long").alias("song_frames"), F.ceil((F.col("max_time") + end_delay) * fps).cast("long").alias("last_frame"))
    state = grid(done, ends.select("song_id", "last_frame"), keys, lag, "at_t").join(ends, "song_id")
    rate = lambda k: k.cast("double") * F.lit(1.0 / fps)
    by_time = tempo.select("song_id", F.col("time_sec").alias("seg"), F.struct("tick", "us", "time_sec").alias("tempo"))
    start = asof(state, rate(F.col("k")), by_time, "seg", ["tempo"], keys, "seg", SPAN)
    gone = F.greatest(F.lit(0.0), rate(F.col("k")) - F.col("tempo.time_sec"))
    start = start.withColumn("tick", F.col("tempo.tick") + (gone * (F.col("ppqn") * F.lit(1e6)) / F.col("tempo.us")).cast("long")).drop("tempo")
    by_end = by_time.withColumnRenamed("tempo", "tempo_end")
    both = asof(start, rate(F.col("k") + 1), by_end, "seg", ["tempo_end"], keys, "seg", SPAN)
    both = both.withColumn("bpm", F.lit(6e7) / F.col("tempo_end.us")).drop("tempo_end")
    segs = meter.select("song_id", F.col("tick").alias("seg"), F.struct(F.col("tick").alias("seg_tick"), "num", "dd", "beats", "measures").alias("meter"))
    placed = asof(both.withColumn("clamped", F.greatest(F.lit(0).cast("long"), F.least("tick", F.col("max_tick") - 1))), F.col("clamped"), segs, "seg", ["meter"], keys, "seg")
    placed = placed.select("*", "meter.*")
    place = meter_place(F.col("tick"), F.col("max_tick"))
    tail = F.col("k") >= F.col("song_frames")
    shown = lambda c: F.when(tail, 0).otherwise(F.col(c))
    return placed.select(
        "song_id", F.col("k").alias("frame_index"), rate(F.col("k")).alias("timestamp_sec"), F.col("cum").alias("cumulative_notes"), F.col("cum_cc").alias("cumulative_cc"),
        shown("nps").cast("double").alias("notes_per_second"), F.col("peak_nps").cast("double").alias("peak_nps"), F.greatest(F.lit(0), shown("poly")).cast("long").alias("polyphony"), "peak_poly", "bpm", "tick",
        place["beat"].alias("beat"), place["measure"].alias("measure"), place["measure_beat"].cast("int").alias("measure_beat"), F.col("num").cast("smallint").alias("ts_num"), F.col("dd").cast("smallint").alias("ts_dd"),
        shown("cps").cast("double").alias("cc_per_second"), F.col("peak_cps").cast("double").alias("peak_cps"),
    ).withColumnRenamed("peak_poly", "peak_polyphony")


def changed(frames: DataFrame, keys: list[str], index: str, column: str) -> DataFrame:
    """The frames whose column differs from that of the frame before, and each key's first: frames are dense, so the one before is an equi-join."""
    before = frames.select(*keys, (F.col(index) + 1).alias(index), F.col(column).alias("__before"), F.lit(True).alias("__found"))
    both = frames.join(before, [*keys, index], "left")
    return both.where(F.col("__found").isNull() | ~F.col(column).eqNullSafe(F.col("__before"))).drop("__before", "__found")


def summary(frames: DataFrame) -> DataFrame:
    """One row for each song: notes, cc, last tick, frames, and the peaks."""
    return frames.groupBy("song_id").agg(F.max("cumulative_notes").alias("notes"), F.max("cumulative_cc").alias("cc"), F.max("tick").alias("tick"), F.count("*").alias("frames"), F.max("peak_polyphony").alias("peak_poly"), F.max("peak_nps").cast("long").alias("peak_nps"), F.max("peak_cps").cast("long").alias("peak_cps"))


def lead_in(frames: DataFrame, songs: DataFrame, fps: float, start_delay: float) -> DataFrame:
    """Frames before the song: negative times, zero statistics, the first tempo and signature, ticks counted back at that tempo."""
    count = -int(-start_delay * fps // 1)
    first = frames.where("frame_index = 0").join(songs.select("song_id", "ppqn"), "song_id")
    rows = first.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))) if count else first.where("false").withColumn("j", F.lit(0).cast("long"))
    at = F.col("j").cast("double") * F.lit(1.0 / fps) - start_delay
    ticks = F.col("tick") + F.round(at * F.col("ppqn") * 1e6 / (F.lit(6e7) / F.col("bpm"))).cast("long")
    kept = {"song_id", "bpm", "ts_num", "ts_dd"}
    zero = {"timestamp_sec": at, "tick": ticks, "frame_index": F.col("j")}
    return rows.select(*(c if c in kept else zero.get(c, F.lit(0)).cast(t).alias(c) for c, t in frames.dtypes))


def songs_of(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """(song_id, ppqn, max_tick) of decoded songs: every track ends with an event at its last tick."""
    return tracks.groupBy("song_id").agg(F.max("ppqn").alias("ppqn")).join(events.groupBy("song_id").agg(F.max("tick").alias("max_tick")), "song_id")


def from_events(events: DataFrame, tracks: DataFrame, fps: float = 60.0, end_delay: float = 0.0, vel0_is_off: bool = True, close_held: bool = False, spec: str = "proceed") -> DataFrame:
    """Frames of decoded songs. Tracks are decoded once: their events are written, and everything else reads that table.

    spec says what a tick beyond SPEC_TICK does: nothing, since ticks are never an axis here (proceed), peaks over bins
    for all songs (bins), or an error (fail).
    """
    from ..operators.ticks import note_deltas

    if spec == "fail" or not hasattr(events, "_tickweave_path"):  # not written yet
        events = materialize(guarded(events, spec))
    deltas = note_deltas(events, vel0_is_off, close_held)
    tempo = events.where("kind = 'tempo'").select("song_id", "tick", "us", "track_idx", "seq")
    meter = events.where("kind = 'timesig'").select("song_id", "tick", "num", "dd", "track_idx", "seq")
    return frames(deltas.drop("track_idx"), tempo, meter, songs_of(events, tracks.drop("bytes")), fps, end_delay, spec == "bins")


def song_totals(frames: DataFrame, songs: DataFrame, end_delay: float = 0.0) -> DataFrame:
    """What templates show of a whole song: frames' song with total_notes, total_cc, total_ticks, ppqn, duration, total_beats, total_measures, max_num.

    duration is the last frame's time less the end delay, 0 at least.
    """
    ends = frames.groupBy("song_id").agg(
        F.max("cumulative_notes").alias("total_notes"), F.max("cumulative_cc").alias("total_cc"), F.greatest(F.max("timestamp_sec") - end_delay, F.lit(0.0)).alias("duration"),
        F.max("beat").alias("total_beats"), F.max("measure").alias("total_measures"), F.max("ts_num").cast("int").alias("max_num"),
    )
    return ends.join(songs.select("song_id", "ppqn", F.col("max_tick").alias("total_ticks")), "song_id")
