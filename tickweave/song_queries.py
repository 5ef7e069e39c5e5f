"""Queries over real songs: the event table written as MIDI files, decoded again, and turned into frames; with DuckDB SQL.

Four songs of a track for each user. 512 ticks are a quarter and tempos are multiples of 125,000 microseconds, so that
all seconds are exact in doubles and both engines cut them into the same frames.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import layout, template
from .plans import dedup
from .plans import frames as plan
from .queries import _longs_but, _table, query
from .sources import cells, layered, midi, midi_write, settings
from .store import materialize

PPQN, FPS, TAIL = 512, 60.0, 1.5
#: Microseconds of the event table in a tick.
TICK = 100_000_000

_EVENTS = f"""
e0 AS (SELECT user_id % 4 AS song, user_id AS trk, event_id AS seq, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {TICK} AS tick, event_type AS et FROM events),
e AS (SELECT *, CASE WHEN et IN ('view', 'click') THEN 'on' WHEN et IN ('purchase', 'error') THEN 'off' WHEN seq % 3 = 0 THEN 'cc' WHEN seq % 3 = 1 THEN 'tempo' ELSE 'timesig' END AS kind,
  CASE WHEN et IN ('view', 'click') THEN seq % 3 * 40 ELSE 7 END AS val, 125000 * (1 + seq % 8) AS us, 2 + seq % 6 AS num, 2 + seq % 2 AS dd FROM e0 WHERE et IN ('view', 'click', 'purchase', 'error', 'signup'))"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = _table(spark, sf_dir, "events")
    first = events.agg(F.min(micros).alias("t0"))
    seq, kind = F.col("event_id"), F.col("event_type")
    signup = F.element_at(F.array(*map(F.lit, ("cc", "tempo", "timesig"))), (seq % 3 + 1).cast("int"))
    named = F.when(kind.isin("view", "click"), "on").when(kind.isin("purchase", "error"), "off").when(kind == "signup", signup)
    rows = events.withColumn("m", micros).crossJoin(F.broadcast(first))  # one row
    return rows.select(
        (F.col("user_id") % 4).cast("string").alias("song_id"), F.col("user_id").cast("int").alias("track_idx"), seq.cast("long").alias("seq"), F.expr(f"(m - t0) div {TICK}").alias("tick"), named.alias("kind"),
        (F.col("user_id") % 16).cast("int").alias("channel"), (F.col("user_id") % 128).cast("int").alias("key"), F.when(named == "on", seq % 3 * 40).otherwise(7).cast("int").alias("value"),
        (F.lit(125000) * (1 + seq % 8)).cast("int").alias("us"), (2 + seq % 6).cast("int").alias("num"), (2 + seq % 2).cast("int").alias("dd"),
    )


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midi.split_tracks(midi_write.write_songs(_events(spark, sf_dir), PPQN), mode="fail")


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tracks = materialize(_tracks(spark, sf_dir))
    return materialize(midi.read_events(tracks), small=True), tracks


@query(
    f"""WITH {_EVENTS} SELECT CAST(song AS VARCHAR) AS song_id, dense_rank() OVER (PARTITION BY song ORDER BY trk) - 1 AS track_idx, row_number() OVER (PARTITION BY trk ORDER BY tick, seq) - 1 AS seq, tick, kind,
CASE WHEN kind IN ('on', 'off', 'cc') THEN trk % 16 ELSE -1 END AS channel, CASE WHEN kind IN ('on', 'off', 'cc') THEN trk % 128 ELSE -1 END AS key, CASE WHEN kind IN ('on', 'off', 'cc') THEN val ELSE -1 END AS val,
CASE WHEN kind = 'tempo' THEN us ELSE -1 END AS us, CASE WHEN kind = 'timesig' THEN num ELSE -1 END AS num, CASE WHEN kind = 'timesig' THEN dd ELSE -1 END AS dd FROM e""",
    base=False,
)
def p1_decode(spark, sf_dir):
    """Events written as MIDI files and decoded from their bytes."""
    events = midi.read_events(_tracks(spark, sf_dir)).where("kind <> 'end'").withColumnRenamed("value", "val")
    whole = events.select("song_id", "kind", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("track_idx", "seq", "tick", "channel", "key", "val", "us", "num", "dd")))
    return whole


@query(f"WITH {_EVENTS} SELECT CAST(song AS VARCHAR) AS song_id, count(DISTINCT trk) AS tracks, {PPQN} AS ppqn, 0 AS desync, count(*) AS events, CAST(sum(CAST(kind IN ('on', 'off') AS INT)) AS BIGINT) AS notes, max(tick) AS max_tick FROM e GROUP BY song", base=False)
def a19_tracks(spark, sf_dir):
    """Tracks, cut tracks, events and the last tick of each song."""
    events, tracks = _decoded(spark, sf_dir)
    counts = events.groupBy("song_id").agg(F.count(F.when(F.col("kind") != "end", 1)).alias("events"), F.count(F.when(F.col("kind").isin("on", "off"), 1)).alias("notes"), F.max("tick").alias("max_tick"))
    whole = tracks.groupBy("song_id").agg(F.count("*").alias("tracks"), F.max("ppqn").alias("ppqn"), F.sum((F.col("len") < F.col("declared")).cast("long")).alias("desync"))
    return _longs_but(whole.join(counts, "song_id"), "song_id")


_FRAMES = f"""{_EVENTS},
n0 AS (SELECT song, trk, tick, seq, CASE WHEN kind = 'on' AND val > 0 THEN 1 ELSE -1 END AS x FROM e WHERE kind IN ('on', 'off')),
n1 AS (SELECT *, sum(x) OVER (PARTITION BY trk ORDER BY tick, seq) AS s FROM n0),
n2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trk ORDER BY tick, seq)) AS held FROM n1),
n3 AS (SELECT song, tick, CAST(x > 0 AS BIGINT) AS ons, held - coalesce(lag(held) OVER (PARTITION BY trk ORDER BY tick, seq), 0) AS delta, 0 AS cc
  FROM n2 UNION ALL SELECT song, tick, 0, 0, 1 FROM e WHERE kind = 'cc'),
c0 AS (SELECT song, tick, sum(ons) AS ons, sum(delta) AS delta, sum(cc) AS cc FROM n3 GROUP BY ALL HAVING sum(ons) <> 0 OR sum(delta) <> 0 OR sum(cc) <> 0),
so AS (SELECT song, max(tick) AS max_tick FROM e GROUP BY song),
t0 AS (SELECT song, tick, arg_max(us, trk * 1000000000 + seq) AS us FROM e WHERE kind = 'tempo' GROUP BY ALL),
t1 AS (FROM t0 UNION ALL SELECT song, 0, 500000 FROM so WHERE song NOT IN (SELECT song FROM t0 WHERE tick = 0)),
t2 AS (SELECT *, coalesce((tick - lag(tick) OVER w) * lag(us) OVER w, 0) AS d FROM t1 WINDOW w AS (PARTITION BY song ORDER BY tick)),
tm AS (SELECT song, tick, us, CAST(sum(d) OVER (PARTITION BY song ORDER BY tick) AS BIGINT) AS x, CAST(sum(d) OVER (PARTITION BY song ORDER BY tick) AS DOUBLE) / ({PPQN} * 1e6::DOUBLE) AS ts FROM t2),
m0 AS (SELECT song, tick, arg_max({{'num': num, 'dd': dd}}, trk * 1000000000 + seq) AS s FROM e WHERE kind = 'timesig' GROUP BY ALL),
m1 AS (SELECT song, tick, s.num AS num, s.dd AS dd FROM m0 UNION ALL SELECT song, 0, 4, 2 FROM so WHERE song NOT IN (SELECT song FROM m0 WHERE tick = 0)),
m2 AS (SELECT * FROM (SELECT *, lag(num) OVER w AS pn, lag(dd) OVER w AS pd FROM m1 WINDOW w AS (PARTITION BY song ORDER BY tick)) WHERE pn IS NULL OR pn <> num OR pd <> dd),
m3 AS (SELECT *, (tick - lag(tick) OVER w) * (1 << lag(dd) OVER w) AS span, lag(num) OVER w AS ln FROM m2 WINDOW w AS (PARTITION BY song ORDER BY tick)),
ms AS (SELECT song, tick, num, dd, CAST(coalesce(sum((span + 2047) // 2048) OVER w, 0) AS BIGINT) AS beats, CAST(coalesce(sum((span + 2048 * ln - 1) // (2048 * ln)) OVER w, 0) AS BIGINT) AS measures
  FROM m3 WINDOW w AS (PARTITION BY song ORDER BY tick)),
c1 AS (SELECT c.*, t.x + (c.tick - t.tick) * t.us AS x, CAST(floor((t.ts + CAST(c.tick - t.tick AS DOUBLE) * CAST(t.us AS DOUBLE) * (1.0::DOUBLE / ({PPQN} * 1e6::DOUBLE))) * 60.0::DOUBLE) AS BIGINT) AS k
  FROM c0 c ASOF JOIN tm t ON c.song = t.song AND c.tick >= t.tick),
c2 AS (SELECT *, sum(delta) OVER (PARTITION BY song ORDER BY x ROWS UNBOUNDED PRECEDING) AS poly, sum(ons) OVER w AS wn, sum(cc) OVER w AS wc
  FROM c1 WINDOW w AS (PARTITION BY song ORDER BY x RANGE BETWEEN 512000000 PRECEDING AND CURRENT ROW)),
en AS (SELECT s.song, max_tick, arg_max(t.ts + CAST(max_tick - t.tick AS DOUBLE) * CAST(t.us AS DOUBLE) * (1.0::DOUBLE / ({PPQN} * 1e6::DOUBLE)), t.tick) AS mt
  FROM so s JOIN tm t ON t.song = s.song AND t.tick <= max_tick GROUP BY ALL),
gr AS (SELECT song, max_tick, CAST(ceil(mt * 60.0::DOUBLE) AS BIGINT) + 1 AS own, unnest(range(0, CAST(ceil((mt + 1.5::DOUBLE) * 60.0::DOUBLE) AS BIGINT) + 1)) AS k FROM en),
f0 AS (SELECT song, k, sum(ons) AS ons, sum(cc) AS cc, sum(delta) AS delta, max(poly) AS pk, max(wn) AS wn, max(wc) AS wc FROM c2 GROUP BY ALL),
f1 AS (SELECT g.*, coalesce(sum(ons) OVER w, 0) AS cum, coalesce(sum(cc) OVER w, 0) AS cum_cc, coalesce(sum(delta) OVER w, 0) AS poly, greatest(0, coalesce(max(pk) OVER w, 0)) AS peak, coalesce(max(wn) OVER w, 0) AS pn, coalesce(max(wc) OVER w, 0) AS pc
  FROM gr g LEFT JOIN f0 f ON f.song = g.song AND f.k = g.k WINDOW w AS (PARTITION BY g.song ORDER BY g.k ROWS UNBOUNDED PRECEDING)),
f2 AS (SELECT *, cum - coalesce(lag(cum, 60) OVER w, 0) AS nps, cum_cc - coalesce(lag(cum_cc, 60) OVER w, 0) AS cps, CAST(k AS DOUBLE) * (1.0::DOUBLE / 60.0::DOUBLE) AS at, CAST(k + 1 AS DOUBLE) * (1.0::DOUBLE / 60.0::DOUBLE) AS fin
  FROM f1 WINDOW w AS (PARTITION BY song ORDER BY k)),
f3 AS (SELECT f.*, t.tick + CAST(trunc(greatest(0.0::DOUBLE, f.at - t.ts) * ({PPQN} * 1e6::DOUBLE) / t.us) AS BIGINT) AS tick FROM f2 f ASOF JOIN tm t ON f.song = t.song AND f.at >= t.ts),
f4 AS (SELECT f.*, 60000000.0::DOUBLE / t.us AS bpm, greatest(0, least(f.tick, max_tick - 1)) AS cl FROM f3 f ASOF JOIN tm t ON f.song = t.song AND f.fin >= t.ts),
fr AS (SELECT CAST(f.song AS VARCHAR) AS song_id, f.k AS frame_index, f.at AS timestamp_sec, CAST(cum AS BIGINT) AS cumulative_notes, CAST(cum_cc AS BIGINT) AS cumulative_cc, CAST(CASE WHEN f.k >= own THEN 0 ELSE nps END AS DOUBLE) AS notes_per_second, CAST(pn AS DOUBLE) AS peak_nps,
  CAST(CASE WHEN f.k >= own THEN 0 ELSE greatest(0, poly) END AS BIGINT) AS polyphony, CAST(peak AS BIGINT) AS peak_polyphony, bpm, f.tick AS tick, m.beats + (cl - m.tick) * (1 << m.dd) // 2048 + 1 AS beat, m.measures + (cl - m.tick) * (1 << m.dd) // (2048 * m.num) + 1 AS measure,
  CAST((cl - m.tick) * (1 << m.dd) // 2048 - (cl - m.tick) * (1 << m.dd) // (2048 * m.num) * m.num + 1 AS INT) AS measure_beat, CAST(m.num AS SMALLINT) AS ts_num, CAST(m.dd AS SMALLINT) AS ts_dd, CAST(CASE WHEN f.k >= own THEN 0 ELSE cps END AS DOUBLE) AS cc_per_second, CAST(pc AS DOUBLE) AS peak_cps, max_tick
  FROM f4 f ASOF JOIN ms m ON f.song = m.song AND f.cl >= m.tick)"""


def _song_frames(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    events, tracks = _decoded(spark, sf_dir)
    return plan.from_events(events, tracks, FPS, TAIL, **options), plan.songs_of(events, tracks.drop("bytes"))


@query(f"WITH {_FRAMES} SELECT * EXCLUDE (max_tick) FROM fr", base=False)
def song_frames(spark, sf_dir):
    """Frames of the decoded songs: every column of a frame."""
    return _song_frames(spark, sf_dir)[0]


_TOTALS = f"{_FRAMES}, tt AS (SELECT song_id AS sid, max(cumulative_notes) AS tn, max(cumulative_cc) AS tc, greatest(0.0::DOUBLE, max(timestamp_sec) - 1.5::DOUBLE) AS dur, max(beat) AS tb, max(measure) AS tms FROM fr GROUP BY 1), al AS (SELECT * FROM fr JOIN tt ON sid = song_id)"


@query(f"WITH {_TOTALS} SELECT sid AS song_id, tn AS total_notes, tc AS total_cc, dur AS duration, tb AS total_beats, tms AS total_measures, max(max_tick) AS total_ticks FROM al GROUP BY ALL", base=False)
def f30_song_duration(spark, sf_dir):
    """Totals of each song, its duration without the tail among them."""
    frames, songs = _song_frames(spark, sf_dir)
    return plan.song_totals(materialize(frames), songs, TAIL).drop("ppqn", "max_num")


def _sql_clock(v: str, milli: bool) -> str:
    total = f"CAST(round(abs({v}) * 1000) AS BIGINT)" if milli else f"CAST(trunc(abs({v})) AS BIGINT) * 1000"
    s = f"({total} // 1000)"
    shown = f"CASE WHEN {s} >= 3600 THEN CAST({s} // 3600 AS VARCHAR) || ':' ELSE '' END || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"
    return shown + (f" || '.' || lpad(CAST({total} % 1000 AS VARCHAR), 3, '0')" if milli else "")


def _sql_tokens() -> dict[str, str]:
    """Every token as SQL over the frames and totals of a song."""
    plain, comma = (lambda v: f"CAST({v} AS VARCHAR)"), (lambda v: "format('{:,}', CAST(" + v + " AS BIGINT))")
    left = lambda a, b: f"greatest(0, {a} - {b})"
    out = {}
    for name, now, total, show in (("nc", "cumulative_notes", "tn", comma), ("cc", "cumulative_cc", "tc", plain), ("tick", "tick", "max_tick", comma), ("beat", "beat", "tb", comma), ("measure", "measure", "tms", comma)):
        out |= {name: show(now), f"{name}-total": show(total), f"{name}-rem": show(left(total, now))}
    for name, v in (("", "timestamp_sec"), ("-max", "dur"), ("-rem", "greatest(dur - timestamp_sec, 0.0::DOUBLE)")):
        out |= {f"sec{name}": comma(f"trunc({v})"), f"time{name}": _sql_clock(v, False), f"time-milli{name}": _sql_clock(v, True)}
    out |= {"bpm": "format('{:.2f}', bpm)", "ppqn": f"'{PPQN}'", "plph": comma("polyphony"), "plph-max": comma("peak_polyphony"), "nps": comma("notes_per_second"), "nps-max": comma("peak_nps"), "cps": plain("CAST(cc_per_second AS BIGINT)"), "cps-max": plain("CAST(peak_cps AS BIGINT)")}
    return out | {"measure-beat": plain("measure_beat"), "timesig": "CAST(ts_num AS VARCHAR) || '/' || CAST(1 << ts_dd AS VARCHAR)"}


def _all_tokens() -> tuple[str, str]:
    sql = _sql_tokens()
    return " ".join("{" + t + "}" for t in template.TOKENS), " || ' ' || ".join(f"({sql[t]})" for t in template.TOKENS)


@query(f"WITH {_TOTALS} SELECT song_id, frame_index, {_all_tokens()[1]} AS line FROM al", base=False)
def f13_all_tokens(spark, sf_dir):
    """All tokens of a template, at every frame of the decoded songs."""
    frames, songs = _song_frames(spark, sf_dir)
    frames = materialize(frames)
    return frames.join(plan.song_totals(frames, songs, TAIL), "song_id").select("song_id", "frame_index", template.render(_all_tokens()[0]).alias("line"))


@query(
    f"""WITH {_FRAMES}, ff AS (SELECT * FROM fr WHERE frame_index = 0), g AS (SELECT ff.*, j, CAST(j AS DOUBLE) * (1.0::DOUBLE / 60.0::DOUBLE) - 2.5::DOUBLE AS early FROM ff, range(0, 150) r(j))
SELECT song_id, j AS frame_index, early AS timestamp_sec, tick + CAST(round(early * {PPQN} * 1e6::DOUBLE / (60000000.0::DOUBLE / bpm)) AS BIGINT) AS tick, bpm, ts_num, ts_dd, 0 AS cumulative_notes FROM g""",
    base=False,
)
def f29_lead_in(spark, sf_dir):
    """The 2.5 seconds before the songs."""
    frames, songs = _song_frames(spark, sf_dir)
    return plan.lead_in(frames, songs, FPS, 2.5).select("song_id", "frame_index", "timestamp_sec", "tick", "bpm", "ts_num", "ts_dd", "cumulative_notes")


_BINS = f"""{_FRAMES}, b0 AS (SELECT c.song, CAST(floor((t.ts + CAST(c.tick - t.tick AS DOUBLE) * CAST(t.us AS DOUBLE) * (1.0::DOUBLE / ({PPQN} * 1e6::DOUBLE))) * 60.0::DOUBLE * 8) AS BIGINT) AS b, sum(ons) AS ons, sum(cc) AS cc, sum(delta) AS delta
  FROM c0 c ASOF JOIN tm t ON c.song = t.song AND c.tick >= t.tick GROUP BY ALL),
b1 AS (SELECT *, sum(delta) OVER (PARTITION BY song ORDER BY b ROWS UNBOUNDED PRECEDING) AS poly, sum(ons) OVER w AS wn, sum(cc) OVER w AS wc FROM b0 WINDOW w AS (PARTITION BY song ORDER BY b RANGE BETWEEN 479 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_BINS} SELECT CAST(song AS VARCHAR) AS song_id, CAST(sum(ons) AS BIGINT) AS notes, CAST(greatest(0, max(poly)) AS BIGINT) AS peak_poly, CAST(max(wn) AS BIGINT) AS peak_nps, CAST(max(wc) AS BIGINT) AS peak_cps FROM b1 GROUP BY 1", base=False)
def w7_two_pass(spark, sf_dir):
    """Summary of the songs in the mode for very long songs: peaks over bins of an eighth of a frame."""
    frames, _ = _song_frames(spark, sf_dir, spec="bins")
    whole = plan.summary(frames)
    return _longs_but(whole.select("song_id", "notes", "peak_poly", "peak_nps", "peak_cps"), "song_id")


@query(f"WITH {_FRAMES} SELECT song_id, max(cumulative_notes) AS notes, max(peak_polyphony) AS peak_poly, CAST(max(peak_nps) AS BIGINT) AS peak_nps, max(tick) AS tick, count(*) AS frames FROM fr GROUP BY 1", base=False)
def k6_summary(spark, sf_dir):
    """One line for each song."""
    return plan.summary(_song_frames(spark, sf_dir)[0]).select("song_id", "notes", "peak_poly", "peak_nps", "tick", "frames")


@query(
    f"""WITH {_EVENTS} SELECT CAST(song AS VARCHAR) AS song_id, tick, CAST(sum(CAST(kind = 'on' AND val > 0 AS INT)) AS BIGINT) AS ons, CAST(sum(CAST(kind = 'cc' AS INT)) AS BIGINT) AS cc FROM e WHERE kind IN ('on', 'off', 'cc') GROUP BY ALL""",
    base=False,
)
def dd1_tracks(spark, sf_dir):
    """Note-ons and control changes by tick, every distinct track decoded once."""
    cells = dedup.weighted_cells(_tracks(spark, sf_dir))
    wanted = cells.select("song_id", "tick", "ons", "cc")
    every = midi.read_events(_tracks(spark, sf_dir)).where("kind in ('on', 'off', 'cc')").select("song_id", "tick").distinct()
    return every.join(wanted, ["song_id", "tick"], "left").na.fill(0, ["ons", "cc"])


def _layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files cut into pieces of 300 bytes, each an xz stream, and rows of those in streams again."""
    for batch in batches:
        for song, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            inner = [lzma.compress(content[a : a + 300], preset=0) for a in range(0, len(content), 300)]
            outer = b"".join(lzma.compress(b"".join(inner[a : a + 7]), preset=0) for a in range(0, len(inner), 7))
            yield pa.RecordBatch.from_arrays([pa.array([song]), pa.array([outer], pa.binary())], names=["song_id", "content"])


@query(f"WITH {_FRAMES} SELECT CAST(song AS VARCHAR) AS song_id, tick, CAST(ons AS BIGINT) AS ons, CAST(delta AS BIGINT) AS delta, CAST(cc AS BIGINT) AS cc FROM c0", base=False)
def dd4_layered(spark, sf_dir):
    """Tick cells of the songs, read from archives in two layers of xz streams."""
    archives = midi_write.write_songs(_events(spark, sf_dir), PPQN).mapInArrow(_layers, "song_id string, content binary")
    return layered.cells(materialize(layered.read_layered(archives, mode="fail")))


_CELLS = f"""{_EVENTS},
x0 AS (SELECT song, tick, CAST(sum(CAST(kind = 'on' AS INT)) AS BIGINT) AS ons, CAST(sum(CAST(kind = 'off' AS INT)) AS BIGINT) AS offs FROM e WHERE kind IN ('on', 'off') GROUP BY ALL),
x1 AS (SELECT *, sum(ons - offs) OVER (PARTITION BY song ORDER BY tick) AS s FROM x0),
x2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY song ORDER BY tick)) AS held FROM x1)"""


@query(f"WITH {_CELLS} SELECT CAST(song AS VARCHAR) || '.cjcmcg' AS song_id, tick, ons, CAST(held - coalesce(lag(held) OVER (PARTITION BY song ORDER BY tick), 0) AS BIGINT) AS delta FROM x2", base=False)
def s13_cells(spark, sf_dir):
    """Cell files written from the songs' note counts and read again; note-offs saturate over the whole song."""
    counts = _events(spark, sf_dir).where("kind in ('on', 'off')").groupBy("song_id", "tick").agg(F.count(F.when(F.col("kind") == "on", 1)).alias("ons"), F.count(F.when(F.col("kind") == "off", 1)).alias("offs"))
    ends = counts.groupBy("song_id").agg(F.max("tick").alias("last"), F.sum("ons").alias("notes"))
    grid = ends.select("song_id", F.explode(F.expr("sequence(0L, last)")).alias("tick"))
    table = grid.join(counts, ["song_id", "tick"], "left").na.fill(0, ["ons", "offs"])
    body = table.withColumn("hex", F.concat(midi_write.number(F.col("ons")), midi_write.number(F.col("offs"))))
    body = body.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tick", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    head = F.concat(F.lit(f"{PPQN:08X}" + "0" * 16), midi_write.number(F.col("notes")), F.lpad(F.hex(F.col("last") + 1), 8, "0"))
    files = body.join(ends, "song_id").select(F.concat("song_id", F.lit(".cjcmcg")).alias("song_id"), F.unhex(F.concat(head, "hex")).alias("content"))
    rows = materialize(cells.read_cells(files, mode="fail"))
    return cells.cell_deltas(rows).select("song_id", "tick", "ons", "delta")


_SETS = " || ".join(f"CASE WHEN (c_custkey >> {k}) & 1 = 1 THEN ' ss{k + 1:02d}' ELSE '' END" for k in range(20))


@query(
    f"""SELECT c_custkey, ltrim(CASE WHEN c_custkey % 2 = 0 THEN '-kern' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' -liga' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' zero' ELSE '' END
|| CASE c_custkey % 4 WHEN 1 THEN ' lnum' WHEN 2 THEN ' onum' ELSE '' END || CASE c_custkey % 7 WHEN 1 THEN ' pnum' WHEN 2 THEN ' tnum' ELSE '' END || {_SETS} || CASE WHEN c_custkey % 6 = 0 THEN ' salt -dlig' ELSE '' END) AS features FROM customer""",
    base=False,
)
def f18_features(spark, sf_dir):
    """Font features of typography options made from customers' keys."""
    key = F.col("c_custkey")
    extra = F.when(key % 6 == 0, "salt,; -dlig not!one").otherwise("")
    found = layout.features(key % 2 != 0, key % 3 != 0, key % 5 == 0, key % 4, key % 7, key, extra)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, " ").alias("features"))


@query("SELECT o_orderkey, CAST(least(CAST(o_orderkey AS HUGEINT) * 10000000000000000, 9223372036854775807) AS BIGINT) AS held FROM orders", base=False)
def f24_saturate(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", layout.saturated(F.col("o_orderkey").cast("decimal(38,0)") * F.lit(10**16).cast("decimal(20,0)")).alias("held"))


def _sql_place(own: str, at: str, size: str, room: str, far: str, near: str) -> str:
    start, wide = f"(CASE WHEN whole THEN 0.0::DOUBLE ELSE {at} END)", f"(CASE WHEN whole THEN {room}::DOUBLE ELSE {size} END)"
    low, high, middle = f"({start} + margin)", f"({start} + {wide} - margin)", f"({start} + {wide} / 2)"
    low, high = f"(CASE WHEN {high} < {low} THEN {middle} ELSE {low} END)", f"(CASE WHEN {high} < {low} THEN {middle} ELSE {high} END)"
    x = f"(CASE WHEN anchor IN {far} THEN {high} - {own} WHEN anchor IN {near} THEN ({low} + {high}) / 2 - {own} / 2 ELSE {low} END)"
    x = f"(CASE WHEN {own} <= {wide} THEN greatest({start}, least({x}, {start} + {wide} - {own})) ELSE {x} END)"
    return f"CASE WHEN {own} + 4 > {room} THEN 2.0::DOUBLE ELSE greatest(2.0::DOUBLE, least({x}, {room} - {own} - 2)) END"


_BLOCKS = """b AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 97 * 13 + 5 AS DOUBLE) AS w, CAST(l_orderkey % 89 * 7 + 5 AS DOUBLE) AS h, l_orderkey % 9 + 1 AS anchor, CAST(l_linenumber * 40 AS DOUBLE) AS bx, CAST(l_linenumber * 30 AS DOUBLE) AS "by",
  CAST(l_orderkey % 5 * 150 AS DOUBLE) AS bw, CAST(l_orderkey % 7 * 60 AS DOUBLE) AS bh, CAST(l_orderkey % 11 * 8 AS DOUBLE) AS margin, l_orderkey % 5 * (l_orderkey % 7) = 0 AS whole FROM lineitem)"""


@query(f"""WITH {_BLOCKS} SELECT l_orderkey, l_linenumber, {_sql_place("w", "bx", "bw", "800", "(3, 6, 9)", "(2, 5, 8)")} AS x, {_sql_place("h", '"by"', "bh", "600", "(1, 2, 3)", "(4, 5, 6)")} AS y FROM b""", base=False)
def l1_place(spark, sf_dir):
    """Blocks made from line items, placed in their boxes."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    real = lambda c: c.cast("double")
    x, y = layout.place(real(key % 97 * 13 + 5), real(key % 89 * 7 + 5), key % 9 + 1, (real(line * 40), real(line * 30), real(key % 5 * 150), real(key % 7 * 60)), (F.lit(800.0), F.lit(600.0)), real(key % 11 * 8), F.lit(2.0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query(
    f"""WITH {_BLOCKS}, r AS (SELECT *, CASE WHEN 800 - 2 * margin > 0 THEN 800 - 2 * margin ELSE 800 END AS aw, CASE WHEN 600 - 2 * margin > 0 THEN 600 - 2 * margin ELSE 600 END AS ah FROM b),
s AS (SELECT anchor, min(least((aw - 2) / w, (ah - 2) / h)) AS f FROM r GROUP BY 1) SELECT anchor, CASE WHEN f < 1 THEN greatest(0.01::DOUBLE, f * 0.98::DOUBLE) ELSE 1.0::DOUBLE END AS scale FROM s""",
    base=False,
)
def l3_fit_scale(spark, sf_dir):
    """One scale for all blocks of an anchor."""
    key = F.col("l_orderkey")
    real = lambda c: c.cast("double")
    scale = layout.fit_scale(real(key % 97 * 13 + 5), real(key % 89 * 7 + 5), F.lit(800.0), F.lit(600.0), real(key % 11 * 8), F.lit(2.0))
    return _table(spark, sf_dir, "lineitem").groupBy((key % 9 + 1).alias("anchor")).agg(scale.alias("scale"))


@query("SELECT l_orderkey, l_linenumber, CASE (CASE WHEN l_linenumber % 4 BETWEEN 1 AND 3 THEN l_linenumber % 4 + 6 ELSE l_orderkey % 9 + 1 END) % 3 WHEN 0 THEN CAST(500 - l_orderkey % 400 AS DOUBLE) WHEN 2 THEN (500 - l_orderkey % 400) / 2::DOUBLE ELSE 0.0::DOUBLE END AS shift FROM lineitem", base=False)
def l2_line_offset(spark, sf_dir):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.line_offset(F.lit(500.0), (key % 400).cast("double"), key % 9 + 1, line % 4).alias("shift"))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS file, least(CASE WHEN c_acctbal <= 0 THEN 60.0::DOUBLE ELSE c_acctbal END, 1000.0::DOUBLE) AS fps, CASE WHEN c_custkey % 70 > 51 THEN 18 ELSE CAST(c_custkey % 70 AS INT) END AS x264_crf,
CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS dedup_mode, least(greatest(CAST(c_nationkey * 300 - 900 AS DOUBLE), 0.0::DOUBLE), 3600.0::DOUBLE) AS end_delay, 3.0::DOUBLE AS start_delay, c_custkey % 3 = 0 AS log_open, c_name AS midi_dir FROM customer""",
    base=False,
)
def s19_settings(spark, sf_dir):
    """Settings files made from customers, read, typed and clamped."""
    key = F.col("c_custkey")
    show = lambda name, c: F.concat(F.lit(f"{name} = "), c.cast("string"))
    lines = [F.lit("# head"), show("fps", F.col("c_acctbal").cast("decimal(20,2)")), show("x264_crf", key % 70), show("track_dedup", F.when(key % 2 == 0, "yes").otherwise("no")), show("end_delay", F.col("c_nationkey") * 300 - 900), show("log_open", F.when(key % 3 == 0, "true").otherwise("off")), show("midi_dir", F.col("c_name"))]
    files = _table(spark, sf_dir, "customer").select(key.cast("string").alias("file"), F.concat_ws("\n", *lines).alias("text"))
    found = settings.settings(settings.parse_settings(files))
    return found.select("file", "fps", "x264_crf", "dedup_mode", "end_delay", "start_delay", "log_open", "midi_dir")
