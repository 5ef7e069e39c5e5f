"""The query catalog: every operator on the event table and the other tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import template, text
from .operators import ticks
from .operators.prefix import closed_window, running
from .plans import frames as frame_plan
from .plans.maps import asof
from .sources import adapter
from .store import materialize

S, FRAME, LAG = adapter.SECOND, adapter.FRAME, adapter.LAG
#: Width of a bucket of the two-level running aggregates, in microseconds: one day.
BUCKET = 86_400_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapted song, its held notes and its tick cells as SQL.
_BASE = """
ev AS (SELECT event_id AS seq, user_id AS track, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS exact_t, event_type,
  CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END AS x, CAST(event_type = 'signup' AS BIGINT) AS cc FROM events),
sm AS (SELECT *, sum(x) OVER (PARTITION BY track ORDER BY exact_t, seq) AS s FROM ev WHERE x <> 0),
hd AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY track ORDER BY exact_t, seq)) AS BIGINT) AS held FROM sm),
dl AS (SELECT track, seq, exact_t, x, held, held - coalesce(lag(held) OVER (PARTITION BY track ORDER BY exact_t, seq), 0) AS delta FROM hd),
al AS (SELECT exact_t, CAST(x > 0 AS BIGINT) AS ons, delta, 0 AS cc FROM dl UNION ALL SELECT exact_t, 0, 0, 1 FROM ev WHERE cc = 1),
ce AS (SELECT exact_t, CAST(sum(ons) AS BIGINT) AS ons, CAST(sum(delta) AS BIGINT) AS delta, CAST(sum(cc) AS BIGINT) AS cc FROM al GROUP BY exact_t HAVING sum(ons) <> 0 OR sum(delta) <> 0 OR sum(cc) <> 0),
sw AS (SELECT *, sum(ons) OVER o AS cum, sum(cc) OVER o AS cum_cc, sum(delta) OVER o AS poly, sum(ons) OVER w AS nps, sum(cc) OVER w AS cps FROM ce
  WINDOW o AS (ORDER BY exact_t ROWS UNBOUNDED PRECEDING), w AS (ORDER BY exact_t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
fr AS (SELECT k, coalesce(sum(cum_d) OVER o, 0) AS cum, coalesce(sum(cc_d) OVER o, 0) AS cum_cc, coalesce(sum(d) OVER o, 0) AS poly, greatest(0, coalesce(max(pk) OVER o, 0)) AS peak_poly, coalesce(max(pn) OVER o, 0) AS peak_nps FROM
  (SELECT k, sum(ons) AS cum_d, sum(cc) AS cc_d, sum(delta) AS d, max(poly) AS pk, max(nps) AS pn FROM range(0, (SELECT max(exact_t) // 600000000 + 2 FROM ev)) g(k) LEFT JOIN sw ON sw.exact_t // 600000000 = k GROUP BY k)
  WINDOW o AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
ff AS (SELECT *, cum - coalesce(lag(cum, 6) OVER (ORDER BY k), 0) AS nps FROM fr)
"""


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with its SQL on the tables or, if base, on the adapted song."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {_BASE}\n{sql}" if base else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.adapt(_table(spark, sf_dir, "events"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.tick_cells(adapter.deltas(_song(spark, sf_dir)), ["song"], "exact_t")


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in columns))


@query("SELECT * FROM ce")
def a1_tick_cells(spark, sf_dir):
    return _longs(_cells(spark, sf_dir), "exact_t", "ons", "delta", "cc")


@query("SELECT track, seq, held, delta FROM dl")
def a4_saturating_held(spark, sf_dir):
    return _longs(ticks.held(_song(spark, sf_dir).where("x <> 0"), ["track"], ["exact_t", "seq"]), "track", "seq", "held", "delta")


@query("SELECT track, CAST(-sum(delta) AS BIGINT) AS delta, (SELECT max(exact_t) FROM ev e WHERE e.track = dl.track) AS exact_t FROM dl GROUP BY track HAVING sum(delta) <> 0")
def a5_close_held(spark, sf_dir):
    song = _song(spark, sf_dir)
    held = adapter.deltas(song).groupBy("track").agg((-F.sum("delta")).alias("delta")).where("delta <> 0")
    return held.join(song.groupBy("track").agg(F.max("exact_t").alias("exact_t")), "track")


@query("SELECT CAST(sum(CAST(x > 0 AS INT)) AS BIGINT) AS notes, CAST(sum(cc) AS BIGINT) AS cc, max(exact_t) AS last_t, count(DISTINCT track) AS tracks, count(*) AS events FROM ev")
def a6_totals(spark, sf_dir):
    return _song(spark, sf_dir).agg(F.sum((F.col("x") > 0).cast("long")).alias("notes"), F.sum("cc").alias("cc"), F.max("exact_t").alias("last_t"), F.countDistinct("track").alias("tracks"), F.count("*").alias("events"))


@query("SELECT track, exact_t // 86400000000 AS day, arg_max(event_type, seq) AS event_type FROM ev GROUP BY 1, 2")
def a7_last_wins(spark, sf_dir):
    days = _song(spark, sf_dir).withColumn("day", F.expr(f"exact_t div {BUCKET}"))
    return ticks.last_wins(days, ["track", "day"], ["exact_t", "seq"], ["event_type"])


def _swept(spark, sf_dir):
    return frame_plan.swept(_cells(spark, sf_dir), ["song"], "exact_t", S)


def _frames(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    first, last = adapter.span(events)
    swept = frame_plan.swept(ticks.tick_cells(adapter.deltas(adapter.adapt(events, first)), ["song"], "exact_t"), ["song"], "exact_t", S)
    ends = spark.range(1).select(F.lit(0).alias("song"), F.lit((last - first) // FRAME + 1).cast("long").alias("last_frame"))
    return frame_plan.grid(swept.withColumn("frame", F.expr(f"exact_t div {FRAME}")), ends, ["song"], LAG, "exact_t")


@query("SELECT CAST(max(cum) AS BIGINT) AS notes, CAST(max(cum_cc) AS BIGINT) AS cc, count(*) AS frames, CAST(max(peak_poly) AS BIGINT) AS peak_poly, CAST(max(peak_nps) AS BIGINT) AS peak_nps FROM ff")
def a8_song_summary(spark, sf_dir):
    return _frames(spark, sf_dir).agg(F.max("cum").alias("notes"), F.max("cum_cc").alias("cc"), F.count("*").alias("frames"), F.max("peak_poly").cast("long").alias("peak_poly"), F.max("peak_nps").alias("peak_nps"))


@query("SELECT exact_t // 75000000 AS bin, CAST(sum(ons) AS BIGINT) AS ons, CAST(sum(cc) AS BIGINT) AS cc FROM ce GROUP BY 1")
def a9_frame_bins(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy(F.expr(f"exact_t div {FRAME // 8}").alias("bin")).agg(F.sum("ons").alias("ons"), F.sum("cc").alias("cc"))


@query("SELECT event_type, min(seq) AS first_seq FROM ev GROUP BY 1 ORDER BY 2 LIMIT 64")
def a10_first_seen(spark, sf_dir):
    return _song(spark, sf_dir).groupBy("event_type").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(64)


@query("SELECT CAST(max(cum) AS BIGINT) AS cum, CAST(max(poly) AS BIGINT) AS poly, CAST(max(nps) AS BIGINT) AS nps, max(k) AS k FROM ff")
def a11_extremes(spark, sf_dir):
    return _frames(spark, sf_dir).agg(F.max("cum").alias("cum"), F.max("poly").alias("poly"), F.max("nps").alias("nps"), F.max("k").alias("k"))


@query("SELECT n_chars, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2", base=False)
def a12_dup_lengths(spark, sf_dir):
    return ticks.dup_lengths(_table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT doc_id, sha256(text) AS hash FROM documents", base=False)
def a13_content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("SELECT track, CAST(greatest(0, -min(s)) AS BIGINT) AS deficit, CAST(arg_max(s, seq) AS BIGINT) AS net, CAST(3 * arg_max(s, seq) AS BIGINT) AS net3, CAST(greatest(max(s), max(s) + 2 * arg_max(s, seq)) AS BIGINT) AS top3 FROM sm GROUP BY track")
def a14_effects(spark, sf_dir):
    upto = Window.partitionBy("track").orderBy("exact_t", "seq")
    sums = _song(spark, sf_dir).where("x <> 0").withColumn("s", F.sum("x").over(upto))
    one = sums.groupBy("track").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max_by("s", F.struct("exact_t", "seq")).alias("net"))
    net, _, top = ticks.repeat_effect(F.col("net"), F.col("low"), F.col("high"), F.lit(3))
    return one.select("track", F.greatest(F.lit(0).cast("long"), -F.col("low")).alias("deficit"), "net", net.alias("net3"), top.alias("top3"))


@query(
    """SELECT o_orderstatus AS status, start, CASE WHEN count > 1 THEN (finish - start) // (count - 1) ELSE 0 END AS step, count FROM (
SELECT o_orderstatus, run, min(o_orderkey) AS start, max(o_orderkey) AS finish, count(*) AS count FROM (
SELECT *, sum(CASE WHEN step IS NULL THEN 1 WHEN prior IS NULL THEN 0 WHEN step = prior THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS run FROM (
SELECT *, lag(step) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS prior FROM (
SELECT o_orderstatus, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS step FROM orders))) GROUP BY 1, 2)""",
    base=False,
)
def a15_series_rle(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("long").alias("key"))
    return _longs_but(ticks.series(orders, ["status"], "key", []), "status")


def _longs_but(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*(F.col(c) if c in kept else F.col(c).cast("long").alias(c) for c in df.columns))


@query("SELECT n_chars, sha256(text) AS hash, count(*) AS mult, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2", base=False)
def dd1_distinct_content(spark, sf_dir):
    return ticks.distinct_content(_table(spark, sf_dir, "documents"), "n_chars", "text", ["doc_id"]).select("n_chars", "hash", "mult", "doc_id")


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS docs FROM documents GROUP BY 1", base=False)
def dd1_dedup_weighted(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("content", F.concat_ws("\x01", "lang", "text"))
    once = ticks.distinct_content(docs, "n_chars", "content", ["lang"])
    return once.groupBy("lang").agg(F.sum(F.col("n_chars") * F.col("mult")).cast("long").alias("chars"), F.sum("mult").alias("docs"))


@query("SELECT exact_t, CAST(cum AS BIGINT) AS cum, CAST(cum_cc AS BIGINT) AS cum_cc FROM sw")
def w1_cumulative(spark, sf_dir):
    return _longs(running(_cells(spark, sf_dir), ["song"], ["exact_t"], {"cum": ("sum", "ons"), "cum_cc": ("sum", "cc")}, BUCKET), "exact_t", "cum", "cum_cc")


@query("SELECT exact_t, CAST(poly AS BIGINT) AS poly FROM sw")
def w2_running_poly(spark, sf_dir):
    return _longs(running(_cells(spark, sf_dir), ["song"], ["exact_t"], {"poly": ("sum", "delta")}, BUCKET), "exact_t", "poly")


@query("SELECT exact_t, CAST(greatest(0, max(poly) OVER (ORDER BY exact_t)) AS BIGINT) AS peak_poly FROM sw")
def w3_peak_poly(spark, sf_dir):
    return _longs(_swept(spark, sf_dir), "exact_t", "peak_poly")


@query("SELECT exact_t, CAST(nps AS BIGINT) AS nps, CAST(cps AS BIGINT) AS cps FROM sw")
def w4_closed_window(spark, sf_dir):
    return _longs(closed_window(_cells(spark, sf_dir), ["song"], "exact_t", {"nps": "ons", "cps": "cc"}, S), "exact_t", "nps", "cps")


@query("SELECT exact_t, CAST(max(nps) OVER (ORDER BY exact_t) AS BIGINT) AS peak_nps FROM sw")
def w5_peak(spark, sf_dir):
    windowed = closed_window(_cells(spark, sf_dir), ["song"], "exact_t", {"nps": "ons"}, S)
    return _longs(running(windowed, ["song"], ["exact_t"], {"peak_nps": ("max", "nps")}, BUCKET), "exact_t", "peak_nps")


@query("SELECT k, CAST(nps AS BIGINT) AS nps FROM ff")
def w6_lag_rate(spark, sf_dir):
    return _longs(_frames(spark, sf_dir), "k", "nps")


@query(
    """SELECT bin, CAST(sum(ons) OVER (ORDER BY bin ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS BIGINT) AS nps FROM
(SELECT g.bin, coalesce(sum(ons), 0) AS ons FROM range(0, (SELECT max(exact_t) // 75000000 + 1 FROM ce)) g(bin) LEFT JOIN ce ON exact_t // 75000000 = g.bin GROUP BY 1)"""
)
def w7_binned_window(spark, sf_dir):
    bins = a9_frame_bins(spark, sf_dir)
    every = bins.agg(F.max("bin").alias("m")).select(F.lit(0).alias("song"), F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("bin"))
    return _longs(closed_window(every.join(bins, "bin", "left").na.fill(0, ["ons"]), ["song"], "bin", {"nps": "ons"}, LAG * 8 - 1), "bin", "nps")


_TEMPO = "tm AS (SELECT tick, 250000 + (seq % 8) * 125000 AS us FROM (SELECT exact_t // 1000 AS tick, arg_max(seq, seq) AS seq FROM ev WHERE event_type = 'signup' GROUP BY 1))"


def _tempo(spark, sf_dir):
    """Tempo changes: every signup is one."""
    rows = _song(spark, sf_dir).where("event_type = 'signup'")
    changes = rows.select(F.lit("s").alias("song_id"), F.expr("exact_t div 1000").alias("tick"), (F.lit(250000) + F.col("seq") % 8 * 125000).alias("us"), F.lit(0).alias("track_idx"), "seq")
    songs = spark.createDataFrame([("s", 480)], "song_id string, ppqn int")
    from .plans.maps import tempo_map

    return tempo_map(changes, songs)


_ANCHORS = f"""{_TEMPO},
t0 AS (SELECT tick, us FROM tm UNION ALL SELECT 0, 500000 WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tick = 0)),
an AS (SELECT tick, us, CAST(sum(d) OVER (ORDER BY tick) AS BIGINT) AS exact_t FROM (SELECT *, coalesce((tick - lag(tick) OVER (ORDER BY tick)) * lag(us) OVER (ORDER BY tick), 0) AS d FROM t0))"""


@query(f", {_ANCHORS} SELECT tick, us, exact_t FROM an")
def w8_tempo_anchors(spark, sf_dir):
    return _longs(_tempo(spark, sf_dir), "tick", "us", "exact_t")


@query(f", {_ANCHORS} SELECT v.seq, a.us, a.exact_t + (v.tick - a.tick) * a.us AS place FROM (SELECT seq, exact_t // 1000 AS tick FROM ev) v ASOF JOIN an a ON a.tick <= v.tick")
def j1_asof_tick(spark, sf_dir):
    rows = _song(spark, sf_dir).select(F.lit("s").alias("song_id"), "seq", F.expr("exact_t div 1000").alias("tick"))
    dim = _tempo(spark, sf_dir).select("song_id", F.col("tick").alias("seg"), F.struct("tick", "us", "exact_t").alias("tempo"))
    got = asof(rows, F.col("tick"), dim, "seg", ["tempo"], ["song_id"], "seg", BUCKET // 1000)
    return got.select("seq", F.col("tempo.us").alias("us"), (F.col("tempo.exact_t") + (F.col("tick") - F.col("tempo.tick")) * F.col("tempo.us")).alias("place"))


#: Exact time between the places looked up by time: a frame of the song, which ends beyond its last event.
_STEP = 480_000_000_000
_LAST = "(SELECT max(a.exact_t + (v.tick - a.tick) * a.us) FROM (SELECT exact_t // 1000 AS tick FROM ev) v ASOF JOIN an a ON a.tick <= v.tick)"
_PLACES = f"k AS (SELECT unnest(range(0, CAST({_LAST} // {_STEP} + 2 AS BIGINT))) AS k)"


def _places(tempo: DataFrame, spark, sf_dir) -> DataFrame:
    """(song_id, k) for every frame up to the one after the song's last event, in blocks."""
    ticks_ = _song(spark, sf_dir).agg(F.expr("max(exact_t) div 1000").alias("tick"))
    until = tempo.crossJoin(F.broadcast(ticks_.withColumnRenamed("tick", "end"))).where("tick <= end")  # one row
    ends = until.agg(F.max_by(F.col("exact_t") + (F.col("end") - F.col("tick")) * F.col("us"), "tick").alias("x"))
    block = ends.select(F.expr(f"x div {_STEP} + 1").alias("last")).select("last", F.explode(F.expr("sequence(0L, last div 4096)")).alias("b"))
    return block.select(F.lit("s").alias("song_id"), F.explode(F.expr("sequence(b * 4096, least(last, b * 4096 + 4095))")).alias("k"))


@query(f", {_ANCHORS}, {_PLACES} SELECT k.k, a.us, a.tick + (k.k * {_STEP} - a.exact_t) // a.us AS tick FROM k ASOF JOIN an a ON a.exact_t <= k.k * {_STEP}")
def j2_asof_time(spark, sf_dir):
    tempo = materialize(_tempo(spark, sf_dir))
    rows = _places(tempo, spark, sf_dir).withColumn("at", F.col("k") * _STEP)
    dim = tempo.select("song_id", F.col("exact_t").alias("seg"), F.struct("tick", "us", "exact_t").alias("tempo"))
    got = asof(rows, F.col("at"), dim, "seg", ["tempo"], ["song_id"], "seg", 1 << 45)
    return got.select("k", F.col("tempo.us").alias("us"), F.expr("tempo.tick + (at - tempo.exact_t) div tempo.us").alias("tick"))


@query(f", {_ANCHORS}, {_PLACES} SELECT k.k, a.us FROM k ASOF JOIN an a ON a.exact_t <= (k.k + 1) * {_STEP}")
def j3_asof_frame_end(spark, sf_dir):
    tempo = materialize(_tempo(spark, sf_dir))
    rows = _places(tempo, spark, sf_dir).withColumn("at", (F.col("k") + 1) * _STEP)
    dim = tempo.select("song_id", F.col("exact_t").alias("seg"), F.struct("us").alias("tempo"))
    return asof(rows, F.col("at"), dim, "seg", ["tempo"], ["song_id"], "seg", 1 << 45).select("k", F.col("tempo.us").alias("us"))


_METER = """, mt AS (SELECT tick, 2 + seq % 6 AS num FROM (SELECT exact_t // 1000000 AS tick, arg_max(seq, seq) AS seq FROM ev WHERE event_type = 'signup' GROUP BY 1)),
m0 AS (SELECT tick, num FROM mt UNION ALL SELECT 0, 4 WHERE NOT EXISTS (SELECT 1 FROM mt WHERE tick = 0)),
m1 AS (SELECT * FROM (SELECT *, lag(num) OVER (ORDER BY tick) AS prior FROM m0) WHERE prior IS NULL OR prior <> num),
m2 AS (SELECT *, tick - lag(tick) OVER (ORDER BY tick) AS d, lag(num) OVER (ORDER BY tick) AS pn FROM m1),
ms AS (SELECT tick, num, CAST(coalesce(sum((d + 479) // 480) OVER (ORDER BY tick), 0) AS BIGINT) AS beats, CAST(coalesce(sum((d + 480 * pn - 1) // (480 * pn)) OVER (ORDER BY tick), 0) AS BIGINT) AS measures FROM m2)"""


def _meter(spark, sf_dir):
    from .plans.maps import meter_map

    rows = _song(spark, sf_dir).where("event_type = 'signup'")
    changes = rows.select(F.lit("s").alias("song_id"), F.expr("exact_t div 1000000").alias("tick"), (F.lit(2) + F.col("seq") % 6).cast("int").alias("num"), F.lit(2).alias("dd"), F.lit(0).alias("track_idx"), "seq")
    return meter_map(changes, spark.createDataFrame([("s", 480)], "song_id string, ppqn int"))


@query(f"{_METER} SELECT * FROM ms")
def w9_meter_segments(spark, sf_dir):
    return _longs(_meter(spark, sf_dir), "tick", "num", "beats", "measures")


@query(f"{_METER} SELECT v.seq, m.num, m.beats + (v.tick - m.tick) // 480 + 1 AS beat, m.measures + (v.tick - m.tick) // (480 * m.num) + 1 AS measure, (v.tick - m.tick) // 480 - (v.tick - m.tick) // (480 * m.num) * m.num + 1 AS measure_beat FROM (SELECT seq, exact_t // 1000000 AS tick FROM ev) v ASOF JOIN ms m ON m.tick <= v.tick")
def j4_asof_meter(spark, sf_dir):
    from .plans.maps import meter_place

    rows = _song(spark, sf_dir).select(F.lit("s").alias("song_id"), "seq", F.expr("exact_t div 1000000").alias("tick"))
    dim = _meter(spark, sf_dir).select("song_id", F.col("tick").alias("seg"), F.struct(F.col("tick").alias("seg_tick"), "num", "dd", "beats", "measures", "ppqn").alias("meter"))
    got = asof(rows, F.col("tick"), dim, "seg", ["meter"], ["song_id"], "seg").select("seq", "tick", "meter.*")
    place = meter_place(F.col("tick"), F.lit(1 << 60).cast("long"))
    return _longs(got.select("seq", "num", place["beat"].alias("beat"), place["measure"].alias("measure"), place["measure_beat"].alias("measure_beat")), "seq", "num", "beat", "measure", "measure_beat")


@query(f"""{_METER}, en AS (SELECT max(exact_t) // 1000000 AS t FROM ev), la AS (SELECT *, lead(tick) OVER (ORDER BY tick) AS nx FROM ms)
SELECT la.tick, la.num, beats + (coalesce(nx, en.t) - 1 - la.tick) // 480 + 1 AS last_beat, measures + (coalesce(nx, en.t) - 1 - la.tick) // (480 * la.num) + 1 AS last_measure FROM la, en WHERE la.tick < en.t""")
def w12_beat_measure(spark, sf_dir):
    """The last beat and measure of each stretch of one time signature, at the tick before the next or the song's end."""
    from .plans.maps import meter_place

    ends = _song(spark, sf_dir).agg(F.expr("max(exact_t) div 1000000").alias("end"))
    order = Window.partitionBy("song_id").orderBy("tick")
    segs = _meter(spark, sf_dir).withColumn("next", F.lead("tick").over(order)).crossJoin(F.broadcast(ends)).where("tick < end")  # one row
    rows = segs.withColumn("seg_tick", F.col("tick")).withColumn("at", F.coalesce("next", "end") - 1)
    place = meter_place(F.col("at"), F.col("at") + 1)
    return _longs(rows.select("tick", "num", place["beat"].alias("last_beat"), place["measure"].alias("last_measure")), "tick", "num", "last_beat", "last_measure")


@query("SELECT day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, 1 AS n FROM lineitem UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1 FROM orders) GROUP BY 1", base=False)
def j7_merge_sum(spark, sf_dir):
    parts = [_table(spark, sf_dir, t).select(F.col(c).cast("date").cast("string").alias("day"), F.lit(1).alias("n")) for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))]
    return ticks.merge_sum(parts, ["day"], ["n"])


@query("SELECT d.doc_id, h.mult FROM documents d JOIN (SELECT n_chars, text, count(*) AS mult FROM documents GROUP BY 1, 2) h ON d.n_chars = h.n_chars AND d.text = h.text", base=False)
def j5_content_lookup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return docs.join(docs.groupBy("n_chars", "hash").agg(F.count("*").alias("mult")), ["n_chars", "hash"]).select("doc_id", "mult")


@query("SELECT k, CAST(cum AS BIGINT) AS cum, CAST(cum_cc AS BIGINT) AS cum_cc, CAST(poly AS BIGINT) AS poly FROM ff")
def j9_frame_grid(spark, sf_dir):
    return _longs(_frames(spark, sf_dir), "k", "cum", "cum_cc", "poly")


@query("SELECT k, CASE WHEN k >= (SELECT max(k) - 5 FROM ff) THEN 0 ELSE CAST(nps AS BIGINT) END AS nps, CAST(peak_nps AS BIGINT) AS peak_nps FROM ff")
def w11_tail_mask(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    last = rows.agg(F.max("k").alias("m"))
    return rows.crossJoin(F.broadcast(last)).select("k", F.when(F.col("k") >= F.col("m") - 5, 0).otherwise(F.col("nps")).cast("long").alias("nps"), F.col("peak_nps").cast("long").alias("peak_nps"))  # one row


@query("SELECT exact_t, 'n' AS kind FROM ev WHERE x <> 0 UNION ALL SELECT exact_t, 'c' FROM ev WHERE cc = 1")
def u1_union_all(spark, sf_dir):
    song = _song(spark, sf_dir)
    return song.where("x <> 0").select("exact_t", F.lit("n").alias("kind")).unionByName(song.where("cc = 1").select("exact_t", F.lit("c").alias("kind")))


@query("SELECT DISTINCT track, event_type FROM ev")
def u3_distinct(spark, sf_dir):
    return _song(spark, sf_dir).select("track", "event_type").distinct()


@query("SELECT seq, exact_t, row_number() OVER (PARTITION BY track ORDER BY exact_t, seq) AS place FROM ev")
def o1_stable_sort(spark, sf_dir):
    return _song(spark, sf_dir).select("seq", "exact_t", F.row_number().over(Window.partitionBy("track").orderBy("exact_t", "seq")).cast("long").alias("place"))


@query("SELECT count(*) FILTER (exact_t > 268435456) AS beyond FROM ev")
def p12_tick_guard(spark, sf_dir):
    return _song(spark, sf_dir).agg(F.sum((F.col("exact_t") > (1 << 28)).cast("long")).alias("beyond"))


_KIND = "CASE ((l_orderkey * 7 + l_linenumber * 31) % 128 + 128) // 16 WHEN 8 THEN 'off' WHEN 9 THEN 'on' WHEN 10 THEN 'touch' WHEN 11 THEN 'cc' WHEN 12 THEN 'program' WHEN 13 THEN 'pressure' WHEN 14 THEN 'bend' ELSE 'system' END"


@query(f"SELECT {_KIND} AS kind, ((l_orderkey * 7 + l_linenumber * 31) % 128 + 128) % 16 AS channel, count(*) AS n FROM lineitem GROUP BY ALL", base=False)
def p4_classify(spark, sf_dir):
    """Kinds and channels of status bytes."""
    status = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31) % 128 + 128
    kind, channel = ticks.status_kind(status)
    return _table(spark, sf_dir, "lineitem").groupBy(kind.alias("kind"), channel.cast("long").alias("channel")).agg(F.count("*").alias("n"))


@query("SELECT seq, 60000000.0::DOUBLE / (250000 + (seq % 8) * 125000) AS bpm FROM ev")
def p10_bpm(spark, sf_dir):
    return _song(spark, sf_dir).select("seq", (F.lit(6e7) / (F.lit(250000) + F.col("seq") % 8 * 125000)).alias("bpm"))


_COMMAS = "reverse(rtrim(regexp_replace(reverse({}), '([0-9]{{3}})', '\\1,', 'g'), ','))"


@query(f"SELECT o_orderkey, {_COMMAS.format('CAST(o_orderkey * 7919 AS VARCHAR)')} AS shown FROM orders", base=False)
def f1_commas(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.number(F.col("o_orderkey") * 7919, True).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 4 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 4, '0') END AS shown FROM orders", base=False)
def f2_pad(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.pad(F.col("o_orderkey").cast("string"), 4).alias("shown"))


@query("SELECT c_custkey, length(CAST(greatest(CAST(trunc(c_acctbal) AS BIGINT), 0) AS VARCHAR)) AS width, greatest(5000 - CAST(trunc(c_acctbal) AS BIGINT), 0) AS rest, CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS secs FROM customer", base=False)
def f3_widths(spark, sf_dir):
    whole = F.col("c_acctbal").cast("long")
    return _table(spark, sf_dir, "customer").select("c_custkey", text.digits(whole).cast("long").alias("width"), text.remaining(F.lit(5000), whole).cast("long").alias("rest"), text.seconds(F.col("c_acctbal")).alias("secs"))


@query(f"SELECT c_custkey, CASE WHEN trunc(c_acctbal) < 0 THEN '-' ELSE '' END || {_COMMAS.format('CAST(abs(CAST(trunc(c_acctbal) AS BIGINT)) AS VARCHAR)')} AS shown FROM customer", base=False)
def f5_signed(spark, sf_dir):
    """Ticks are whole numbers: what cuts to 0 has no sign."""
    return _table(spark, sf_dir, "customer").select("c_custkey", text.signed(F.col("c_acctbal").cast("long"), True).alias("shown"))


@query("SELECT DISTINCT l_quantity, format('{:.2f}', 60000000.0 / (l_quantity * 10007)) AS bpm FROM lineitem", base=False)
def f7_bpm(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_quantity", text.bpm(F.lit(6e7) / (F.col("l_quantity") * 10007)).alias("bpm")).distinct()


_CLOCK = "CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"


@query(f"SELECT seq, {_CLOCK} AS shown FROM (SELECT seq, exact_t // 1000000 AS s FROM ev)")
def f8_clock(spark, sf_dir):
    return _song(spark, sf_dir).select("seq", text.clock((F.expr("exact_t div 1000000")).cast("double")).alias("shown"))


@query("SELECT DISTINCT l_linenumber, CAST(l_linenumber AS VARCHAR) || '/' || CAST(1 << (l_linenumber % 6) AS VARCHAR) AS shown FROM lineitem", base=False)
def f10_timesig(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_linenumber", text.time_signature(F.col("l_linenumber"), F.col("l_linenumber") % 6).alias("shown")).distinct()


@query(
    """SELECT doc_id, CASE WHEN v < 1024 THEN CAST(v AS VARCHAR) || ' B' ELSE CASE WHEN x >= 100 THEN format('{:.0f}', x) WHEN x >= 10 THEN format('{:.1f}', x) ELSE format('{:.2f}', x) END || u END AS shown FROM (
SELECT doc_id, v, CASE WHEN v < 1048576 THEN v / 1024.0::DOUBLE WHEN v < 1073741824 THEN v / 1048576.0::DOUBLE ELSE v / 1073741824.0::DOUBLE END AS x, CASE WHEN v < 1048576 THEN ' KiB' WHEN v < 1073741824 THEN ' MiB' ELSE ' GiB' END AS u FROM (
SELECT doc_id, n_chars * n_chars AS v FROM documents))""",
    base=False,
)
def f14_file_size(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.file_size(F.col("n_chars") * F.col("n_chars")).alias("shown"))


@query("SELECT page_id, CASE WHEN url LIKE '%/%' THEN regexp_extract(url, '^(.*/)', 1) ELSE './' END AS dir, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM pages", base=False)
def f15_paths(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.directory(F.col("url")).alias("dir"), text.stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ ,;\\t\\n\\r]+'), lambda x: x <> '')) AS BIGINT) AS parts FROM documents", base=False)
def f17_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.split_features(F.col("text"))).cast("long").alias("parts"))


@query("SELECT doc_id, sha256(replace(replace(replace(text, chr(13), ''), '\\', '\\\\'), chr(10), '\\n')) AS hash FROM documents", base=False)
def f19_escape(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.escape_newlines(F.col("text")).cast("binary"), 256).alias("hash"))


@query("SELECT doc_id, CAST(sum(CAST(l <> '' AS INT)) AS BIGINT) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1", base=False)
def f26_layout_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.layout_lines(F.col("text"))).cast("long").alias("lines"))


@query("SELECT k, cum, '[' || CAST(cum AS VARCHAR) || '] ' || CAST(greatest(0, poly) AS VARCHAR) || '/' || CAST(peak_poly AS VARCHAR) || ' {x}' AS line FROM (SELECT k, CAST(cum AS BIGINT) AS cum, CAST(poly AS BIGINT) AS poly, CAST(peak_poly AS BIGINT) AS peak_poly FROM ff)")
def f13_tokens(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("k", "cum", F.col("cum").alias("cumulative_notes"), F.col("cum").alias("total_notes"), F.col("poly").alias("polyphony"), F.col("peak_poly").alias("peak_polyphony"))
    return rows.select("k", "cum", template.render("[{nc}] {plph}/{plph-max} {x}", template.Style(notes=False, polyphony=False)).alias("line"))


#: Magic numbers to try, by turns (fixed values).
_HEADS = ("1F8B0800", "425A6839", "FD377A585A00", "28B52FFD", "04224D18", "526172211A07", "377ABCAF271C", "4D546864")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'gz' WHEN 1 THEN 'bz2' WHEN 2 THEN 'xz' WHEN 3 THEN 'zstd' WHEN 4 THEN 'lz4' WHEN 5 THEN 'rar' WHEN 6 THEN '7z' END AS kind FROM part", base=False)
def s3_magic(spark, sf_dir):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", text.compressed_kind(head).alias("kind"))


@query("SELECT count(*) FILTER (x > 0 AND seq % 3 > 0) AS notes, count(*) FILTER (x > 0) AS notes_all FROM ev")
def p5_velocity_zero(spark, sf_dir):
    kind = F.when(F.col("x") > 0, "on").when(F.col("x") < 0, "off").otherwise("cc")
    events = _song(spark, sf_dir).where("x <> 0 or cc = 1").select(F.lit("s").alias("song_id"), F.col("track").alias("track_idx"), "seq", F.col("exact_t").alias("tick"), kind.alias("kind"), F.lit(0).alias("channel"), F.lit(0).alias("key"), (F.col("seq") % 3).alias("value"))
    one, two = (ticks.note_deltas(events, off).agg(F.sum("ons").alias(n)) for off, n in ((True, "notes"), (False, "notes_all")))
    return one.crossJoin(F.broadcast(two))  # one row each


@query("SELECT count(*) AS cells, CAST(sum(CAST(delta <> 0 AS INT)) AS BIGINT) AS moving FROM ce")
def p8_zero_cells(spark, sf_dir):
    return _cells(spark, sf_dir).agg(F.count("*").alias("cells"), F.sum((F.col("delta") != 0).cast("long")).alias("moving"))


@query("""SELECT exact_t, CAST(sum(ons) AS BIGINT) AS ons, CAST(sum(delta) AS BIGINT) AS delta, CAST(sum(cc) AS BIGINT) AS cc FROM (
SELECT exact_t, ons, delta, cc FROM ce UNION ALL SELECT exact_t, 2 * ons, delta, 0 FROM ce WHERE ons > 1 UNION ALL SELECT unnest(range(0, (SELECT max(exact_t) FROM ce) + 1, 3600000000)), 1, 0, 2) GROUP BY 1""")
def a17_merge_sparse(spark, sf_dir):
    """Dense cells, sparse ones at some of the same places, and a folded run of equal cells, added up."""
    cells = materialize(_cells(spark, sf_dir))
    sparse = cells.where("ons > 1").select("song", "exact_t", (2 * F.col("ons")).alias("ons"), "delta", F.lit(0).cast("long").alias("cc"))
    last = cells.agg(F.max("exact_t").alias("m"))
    runs = last.select(F.lit(0).cast("long").alias("start"), F.lit(S).alias("step"), F.expr(f"m div {S} + 1").alias("count"), F.lit(1).cast("long").alias("ons"), F.lit(0).cast("long").alias("delta"), F.lit(2).cast("long").alias("cc"))
    return ticks.merge_sum([cells.drop("song"), sparse.drop("song"), ticks.expand_series(runs, "exact_t").select("exact_t", "ons", "delta", "cc")], ["exact_t"], ["ons", "delta", "cc"])


@query("SELECT n_name, row_number() OVER (ORDER BY n_nationkey <> 7, n_name) AS place FROM nation", base=False)
def o5_default_first(spark, sf_dir):
    first = Window.orderBy(F.col("n_nationkey") != 7, "n_name")  # names of a settings folder: a handful of rows
    return _table(spark, sf_dir, "nation").select("n_name", F.row_number().over(first).cast("long").alias("place"))


@query("SELECT c_custkey, CAST(CAST(round(greatest(0, c_acctbal)) AS BIGINT) AS VARCHAR) AS shown FROM customer", base=False)
def f9_rate(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text.rate(F.col("c_acctbal")).alias("shown"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'FFFFFFFF' ELSE substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || printf('%02X', CAST(255 - v // 16777216 AS INT)) END AS rgba
FROM (SELECT c_custkey, v, printf('%08X', v) AS h FROM (SELECT c_custkey, c_custkey * 2654435 % 4294967296 AS v FROM customer))""",
    base=False,
)
def f16_colour(spark, sf_dir):
    hexes = F.lpad(F.hex(F.col("c_custkey") * 2654435 % (1 << 32)), 8, "0")
    given = F.when(F.col("c_custkey") % 5 == 0, F.lit("blue")).otherwise(F.concat(F.lit("&H"), hexes))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.colour(given).alias("rgba"))


@query("SELECT page_id, regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g') AS name FROM pages", base=False)
def f20_clean_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.clean_name(F.col("url")).alias("name"))


@query()
def f21_crc32(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT page_id, page_id % 3 = 0 AS is_cells FROM pages", base=False)
def f22_cell_name(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a.CjCmcg.xz").otherwise(".cjcmcg/b.mid"))
    return _table(spark, sf_dir, "pages").select("page_id", text.is_cell_file(path).alias("is_cells"))


@query("SELECT o_orderkey, greatest(1000.0::DOUBLE, least(100000.0::DOUBLE, o_totalprice)) AS held FROM orders", base=False)
def f25_clamp(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.clamp(F.col("o_totalprice"), 1000.0, 100000.0).alias("held"))


@query("SELECT c_custkey, CAST(d AS INT) AS d, regexp_replace(c_name, '[0-9]', CAST(d AS VARCHAR), 'g') AS shown FROM customer, range(0, 10) g(d)", base=False)
def f27_digit_variants(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(text.digit_variants(F.col("c_name"))).alias("d", "shown"))


@query("SELECT DISTINCT l_quantity, greatest(1, CAST(round(l_quantity / 7 * 1000) AS BIGINT)) AS timescale FROM lineitem", base=False)
def f31_timescale(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_quantity", text.timescale(F.col("l_quantity") / 7).alias("timescale")).distinct()


@query("SELECT k, CAST(poly AS BIGINT) AS poly FROM (SELECT k, poly, lag(poly) OVER (ORDER BY k) AS p FROM ff) WHERE p IS NULL OR p <> poly")
def l6_changed_frames(spark, sf_dir):
    return _longs(frame_plan.changed(_frames(spark, sf_dir), ["song"], "k", "poly"), "k", "poly")


@query("SELECT k, CAST(cum AS BIGINT) AS cum FROM ff WHERE k < 600")
def o4_prefix_frames(spark, sf_dir):
    """The first 600 frames: the limit is the operator."""
    return _longs(_frames(spark, sf_dir).where("k < 600"), "k", "cum")


_LINE = "'N:' || " + _COMMAS.format("CAST(cum AS VARCHAR)") + " || ' P:' || CAST(greatest(0, poly) AS VARCHAR) || ' S:' || CAST(peak_nps AS VARCHAR)"


@query(f"SELECT *, {_LINE} AS line FROM (SELECT k, CAST(cum AS BIGINT) AS cum, CAST(cum_cc AS BIGINT) AS cum_cc, CAST(nps AS BIGINT) AS nps, CAST(peak_nps AS BIGINT) AS peak_nps, CAST(poly AS BIGINT) AS poly, CAST(peak_poly AS BIGINT) AS peak_poly FROM ff)")
def frames_full(spark, sf_dir):
    """The flagship: frames of the adapted song with a rendered line."""
    rows = _longs(_frames(spark, sf_dir), "k", "cum", "cum_cc", "nps", "peak_nps", "poly", "peak_poly")
    named = rows.select("*", F.col("cum").alias("cumulative_notes"), F.col("cum").alias("total_notes"), F.col("poly").alias("polyphony"), F.col("peak_poly").alias("peak_polyphony"), F.col("peak_nps").cast("double").alias("peak"))
    line = F.concat(template.render("N:{nc} P:{plph} S:", template.Style(polyphony=False)), text.rate(F.col("peak")))
    return named.select(*rows.columns, line.alias("line"))
