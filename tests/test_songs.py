"""Small songs, end to end: bytes, events, frames."""

import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from tickweave.functions import template, text
from tickweave.operators import ticks
from tickweave.plans import dedup, frames, maps
from tickweave.sources import cells, midi


def vlq(n):
    out = [n & 0x7F]
    while n := n >> 7:
        out.insert(0, n & 0x7F | 0x80)
    return bytes(out)


def track(*events):
    body = b"".join(vlq(d) + e for d, e in events)
    return b"MTrk" + len(body).to_bytes(4, "big") + body


def song(ppqn, *tracks):
    return b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(tracks).to_bytes(2, "big") + ppqn.to_bytes(2, "big") + b"".join(tracks)


def tempo(us):
    return b"\xff\x51\x03" + us.to_bytes(3, "big")


ON, OFF, END = (lambda k: bytes([0x90, k, 100])), (lambda k: bytes([0x80, k, 0])), b"\xff\x2f\x00"

TEMPO2 = song(
    480,
    track((0, tempo(500000)), (960, tempo(1000000)), (1680, END)),
    track((0, ON(60)), (960, OFF(60)), (0, ON(62)), (960, OFF(62)), (720, END)),
    track((0, ON(64)), (1920, OFF(64)), (480, ON(72)), (240, OFF(72)), (0, END)),
)


def decoded(spark, *files):
    given = spark.createDataFrame([(f"s{k}", bytearray(f)) for k, f in enumerate(files)], "song_id string, content binary")
    tracks = midi.split_tracks(given)
    return tracks, midi.read_events(tracks)


def test_two_tempos(spark):
    tracks, events = decoded(spark, TEMPO2)
    got = {r["frame_index"]: r for r in frames.from_events(events, tracks).collect()}
    assert len(got) == 271
    assert [got[k]["cumulative_notes"] for k in (0, 60, 180, 240)] == [2, 3, 3, 4]
    assert [got[k]["polyphony"] for k in (0, 70, 130, 190, 210, 250, 270)] == [2, 2, 2, 0, 0, 1, 0]
    assert [got[k]["bpm"] for k in (50, 150, 250)] == [120, 60, 60]
    assert (got[270]["peak_polyphony"], got[270]["peak_nps"], got[270]["timestamp_sec"]) == (2, 3, 4.5)


def test_control_changes(spark):
    cc = bytes([0xB0, 7, 1])
    tracks, events = decoded(spark, song(480, track((0, tempo(500000)), (0, cc), (240, cc), (240, cc), (240, cc), (240, cc), (0, ON(60)), (240, OFF(60)), (480, END))))
    got = {r["frame_index"]: r for r in frames.from_events(events, tracks).collect()}
    assert [got[k]["cumulative_cc"] for k in (0, 14, 15, 30, 60)] == [1, 1, 2, 3, 5]
    assert [got[k]["cc_per_second"] for k in (60, 120 if 120 in got else max(got))][0] == 4
    assert [got[k]["peak_cps"] for k in (59, 60, max(got))] == [4, 5, 5]


def test_tail(spark):
    tracks, events = decoded(spark, song(480, track((0, tempo(500000)), (0, ON(60)), (1920, OFF(60)), (0, END))))
    got = {r["frame_index"]: r for r in frames.from_events(events, tracks, fps=10.0, end_delay=1.5).collect()}
    assert len(got) == 36
    assert all(got[k]["polyphony"] == 0 and got[k]["notes_per_second"] == 0 for k in range(21, 36))
    assert got[35]["tick"] - got[21]["tick"] == 1344


@pytest.mark.parametrize(("clumps", "peak"), [([(0, 10), (950, 10)], 20), ([(0, 10), (970, 10)], 10), ([(0, 10), (480, 25), (864, 30)], 55)])
def test_closed_second(spark, clumps, peak):
    events = [(d if k == 0 else 0, ON(60)) for d, n in clumps for k in range(n)]
    tracks, decoded_events = decoded(spark, song(480, track((0, tempo(500000)), *events, (10, END))))
    assert frames.summary(frames.from_events(decoded_events, tracks)).first()["peak_nps"] == peak


def test_running_status_and_real_time(spark):
    body = bytes.fromhex("00 90 3C 40 00 F8 00 3D 40 00 FE 00 3E 40 00 F0 01 F7 00 90 3F 40 00 40 40".replace(" ", ""))
    assert [e[1] for e in midi.decode(body)].count("on") == 5


def test_held_notes(spark):
    from tickweave.operators.ticks import note_deltas

    tracks, events = decoded(spark, song(480, track((0, ON(60)), (0, ON(60)), (100, ON(62)), (0, END))))
    assert note_deltas(events).agg(F.sum("delta")).first()[0] == 3
    assert note_deltas(events, close_held=True).agg(F.sum("delta")).first()[0] == 0


def test_saturating_counter_against_a_loop(spark):
    import random

    from tickweave.operators.ticks import held

    rng = random.Random(1)
    rows = [(rng.randrange(4), k, rng.choice((1, -1, -1, 1))) for k in range(2000)]
    want, now = {}, {}
    for key, k, x in rows:
        now[key] = max(0, now.get(key, 0) + x)
        want[k] = now[key]
    got = held(spark.createDataFrame(rows, "key int, seq long, x long"), ["key"], ["seq"]).collect()
    assert {r["seq"]: r["held"] for r in got} == want


def test_layers_and_junk(spark):
    tracks, events = decoded(spark, TEMPO2, gzip.compress(TEMPO2), lzma.compress(gzip.compress(TEMPO2)), b"no music here", b"")
    counts = {r["song_id"]: r["n"] for r in events.where("kind = 'on'").groupBy("song_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"s0": 4, "s1": 4, "s2": 4}


def test_dedup_changes_nothing(spark):
    from tickweave.operators.ticks import note_deltas, tick_cells

    t = track((0, ON(60)), (96, OFF(60)), (0, END))
    tracks, events = decoded(spark, song(96, t, t, track((0, ON(61)), (0, END)), t))
    plain = tick_cells(note_deltas(events), ["song_id"], "tick")
    order = ["song_id", "tick"]
    assert plain.orderBy(*order).collect() == dedup.weighted_cells(tracks).orderBy(*order).collect()
    assert dedup.distinct_tracks(tracks).count() == 2


def plain_decode(body):
    """The event grammar, a byte at a time."""
    at = tick = status = 0
    out = []

    def number():
        nonlocal at
        value = 0
        for _ in range(4):
            if at < len(body):
                value, more = value << 7 | body[at] & 0x7F, body[at] >= 0x80
                at += 1
                if not more:
                    break
        return value

    while at < len(body):
        tick += number()
        if at >= len(body):
            break
        if body[at] < 0x80:
            event = status
            if not event:
                continue
        else:
            event = body[at]
            at += 1
            status = event if event < 0xF0 else status if event not in (*range(0xF0, 0xF8), 0xFF) else 0
        if event < 0xF0:
            need = 1 if event >> 4 in (0xC, 0xD) else 2
            if at + need > len(body):
                break
            if event >> 4 in (8, 9, 0xB):
                out.append((tick, {8: "off", 9: "on", 0xB: "cc"}[event >> 4], event & 15, body[at] & 0x7F, body[at + 1], None, None, None))
            at += need
        elif event == 0xFF:
            if at >= len(body):
                break
            kind = body[at]
            at += 1
            size = number()
            if at + size > len(body):
                break
            if kind == 0x51 and size == 3 and any(body[at : at + 3]):
                out.append((tick, "tempo", None, None, None, int.from_bytes(body[at : at + 3], "big"), None, None))
            if kind == 0x58 and size == 4:
                out.append((tick, "timesig", None, None, None, None, body[at], body[at + 1]))
            at += size
        elif event in (0xF0, 0xF7):
            size = number()
            at += size
        else:
            at += {0xF1: 1, 0xF3: 1, 0xF2: 2}.get(event, 0)
    return [*out, (tick, "end", *[None] * 6)]


def test_decoder_against_a_loop():
    rng = random.Random(1)
    for k in range(600):
        n = rng.randrange(300)
        body = bytes(rng.choice([rng.randrange(256), 0, 0x90, 60, 100, 0xFF, 0x58, 4, 3, 0x51]) for _ in range(n))
        low = lambda m: bytes(rng.randrange(128) for _ in range(m))
        if k % 5 == 1:
            body = b"".join(bytes([rng.randrange(3), rng.choice([0x80, 0x90, 0xB1, 0xE0])]) + low(2) for _ in range(n)) + body
        if k % 5 == 2:
            body = b"\0\x91" + low(2) + low(3 * n) + body
        if k % 5 == 3:
            body = b"".join(bytes(0x80 | rng.randrange(9) for _ in range(k % 4)) + low(1) + b"\x90" + low(2) for _ in range(n)) + body
        if k % 5 == 4:
            body = b"\0\xC0\5" + b"".join(b"\0\x80" + low(2) + bytes([0x81]) + low(3) for _ in range(n)) + body
        assert list(midi.decode(body)) == plain_decode(body)


def test_time_signatures_have_four_bytes():
    body = b"".join(b"\1\xff\x58" + bytes([n, *([3] * n)]) for n in (2, 3, 4, 5))
    assert [(e[0], e[6], e[7]) for e in midi.decode(body) if e[1] == "timesig"] == [(3, 3, 3)]


def test_broken_files(spark, monkeypatch):
    import zstandard

    cut = TEMPO2[:-3]
    files = [TEMPO2, cut, b"junk", gzip.compress(TEMPO2)[:-9], b"MThd", zstandard.compress(TEMPO2), lzma.compress(b"7z\xbc\xaf\x27\x1c" + bytes(20)), gzip.compress(TEMPO2) + b"tail"]
    given = spark.createDataFrame([(f"s{k}", bytearray(f)) for k, f in enumerate(files)], "song_id string, content binary")
    rows = midi.split_tracks(given, "rows").collect()
    errors = {r["song_id"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"s2", "s3", "s4", "s6"} and "7z archive inside" in errors["s6"]
    assert {r["song_id"] for r in midi.split_tracks(given).collect()} == {"s0", "s1", "s5", "s7"}
    assert [(r["declared"] - r["len"]) for r in rows if r["song_id"] == "s1"] == [0, 0, 3]
    with pytest.raises(Exception, match=r"s[2346]: "):
        midi.split_tracks(given, "fail").count()
    monkeypatch.setattr(midi, "MOST_BYTES", 1000)
    for pack in (gzip.compress, lzma.compress, zstandard.compress):
        assert midi.unwrap(pack(b"x" * 1000)) == b"x" * 1000
        with pytest.raises(midi.TooLong):
            midi.unwrap(pack(b"x" * 1001))


def test_tracks_read_by_span(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(TEMPO2)
    (tmp_path / "b.mid").write_bytes(TEMPO2[:-3])
    (tmp_path / "c.txt").write_bytes(b"nothing")
    whole, spans = midi.read_tracks(spark, str(tmp_path)), midi.read_track_spans(spark, str(tmp_path), mode="rows", each=16)
    key = ["song_id", "track_idx"]
    assert spans.where("error is null").orderBy(*key).collect() == whole.orderBy(*key).collect()
    assert spans.where("error is not null").count() == 1
    assert midi.read_events(spans).where("kind = 'on'").count() == 8


def test_meter(spark):
    songs = spark.createDataFrame([("a", 480, 6000)], "song_id string, ppqn int, max_tick long")
    changes = [(100, 0, 2), (3840, 3, 2), (4560, 6, 3), (5000, 6, 3), (5500, 7, 3), (5500, 6, 3)]
    given = spark.createDataFrame([("a", t, n, d, 0, k) for k, (t, n, d) in enumerate(changes)], "song_id string, tick long, num int, dd int, track_idx int, seq long")
    segs = maps.meter_map(given, songs)
    segs = segs.select("song_id", F.col("tick").alias("seg"), F.struct(F.col("tick").alias("seg_tick"), "num", "dd", "beats", "measures").alias("meter"))
    ticks = spark.createDataFrame([("a", 480, t) for t in (-5, 0, 2000, 4000, 4400, 4560, 5999, 7000)], "song_id string, ppqn int, tick long")
    ticks = ticks.withColumn("at", F.greatest(F.lit(0), F.least("tick", F.lit(5999))))
    got = maps.asof(ticks, F.col("at").cast("long"), segs, "seg", ["meter"], ["song_id"], "seg").select("*", "meter.*")
    place = maps.meter_place(F.col("tick"), F.lit(6000))
    rows = got.orderBy("tick").select(place["beat"], place["measure"], place["measure_beat"], "num", text.time_signature(F.col("num"), F.col("dd"))).collect()
    want = [(1, 1, 1, "4/4"), (1, 1, 1, "4/4"), (5, 2, 1, "4/4"), (9, 3, 1, "3/4"), (10, 3, 2, "3/4"), (11, 4, 1, "6/8"), (16, 4, 6, "6/8"), (16, 4, 6, "6/8")]
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == want


def cell_file(tempos, counts, resolution=480):
    number = lambda n: vlq(n)
    head = resolution.to_bytes(4, "big") + len(tempos).to_bytes(4, "big") + b"".join(t.to_bytes(4, "big") + us.to_bytes(3, "big") for t, us in tempos)
    return head + bytes(4) + number(sum(a for a, _ in counts)) + len(counts).to_bytes(4, "big") + b"".join(number(a) + number(b) for a, b in counts)


def test_cell_files(spark):
    big = 93823560428205
    files = [cell_file([(0, 500000)], [(0, 3), (2, 0), (0, 2), (1, 0)]), cell_file([], [(big, 0), (0, big)]), cell_file([], [(1, 0)])[:-1], b"junk"]
    rows = cells.read_cells(spark.createDataFrame([(str(k), bytearray(f)) for k, f in enumerate(files)], "song_id string, content binary"))
    got = cells.cell_deltas(rows).groupBy("song_id").agg(F.sum("ons"), F.max("delta")).orderBy("song_id").collect()
    assert [tuple(r) for r in got] == [("0", 3, 2), ("1", big, big)]


def test_cell_files_with_data_after_the_table(spark):
    good = cell_file([(0, 500000)], [(1, 0), (0, 0), (0, 3)])
    files = [("a/b.CJCMCG", good + b"more"), ("a/b", good + b"more"), ("c.cjcmcg.gz", gzip.compress(good)), ("junk", b"x")]
    given = spark.createDataFrame([(k, bytearray(f)) for k, f in files], "song_id string, content binary")
    rows = cells.read_cells(given, "rows").collect()
    assert {r["song_id"] for r in rows if r["kind"] == "error"} == {"a/b", "junk"}
    assert [r["note"] for r in rows if r["kind"] == "note"] == ["4 bytes after the table are left aside"]
    assert cells.parse(cell_file([], [(128, 300), (0, 1 << 40)])).offs.tolist() == [300, 1 << 40]
    shown = cells.cell_frames(cells.read_cells(given)).groupBy("song_id").agg(F.max("cumulative_notes"), F.max("peak_polyphony")).collect()
    assert sorted(map(tuple, shown)) == [("a/b.CJCMCG", 1, 1), ("c.cjcmcg.gz", 1, 1)]


def test_goldens(spark):
    row = {"cumulative_notes": 34, "total_notes": 678901, "polyphony": 7, "peak_polyphony": 912, "bpm": 123.456789, "timestamp_sec": -2.5, "cc_per_second": 1234.4, "peak_cps": 56789.0, "cumulative_cc": 7, "total_cc": 1205}
    df = spark.createDataFrame([row])
    show = lambda line, **style: df.select(template.render(line, template.Style(**style))).first()[0]
    assert show("N:{nc}/{nc-total} P:{plph}/{plph-max}", padded=True) == "N:000,034/678,901 P:007/912"
    assert show("N:{nc}/{nc-total}", padded=True, notes=False) == "N:000034/678901"
    assert show("{cps}/{cps-max}") == "1234/56789"
    assert show("{cps}/{cps-max}", cc=True) == "1,234/56,789"
    assert show("{cps}/{cps-max}", padded=True) == "01234/56789"
    assert show("C:{cc}/{cc-total}/{cc-rem} {what}") == "C:7/1205/1198 {what}"
    assert [show("B:{bpm}", bpm_decimals=d) for d in (0, 2, 4, 6, 99)] == ["B:123", "B:123.46", "B:123.4568", "B:123.456789", "B:123.456789"]
    assert show("T:{time-milli} S:{sec}") == "T:-00:02.500 S:-2"
    times = spark.createDataFrame([(-0.2,), (0.0,), (3725.25,), (-3600.5,), (0.9996,)], "v double")
    assert [r[0] for r in times.select(text.clock(F.col("v"), True)).collect()] == ["-00:00.200", "00:00.000", "1:02:05.250", "-1:00:00.500", "00:01.000"]
    names = spark.createDataFrame([("a/b\\c.tar.gz",), ("x",), (" co:n\t",), ("con",)], "v string")
    assert [tuple(r) for r in names.select(text.directory(F.col("v")), text.stem(F.col("v")), text.clean_name(F.col("v"))).collect()] == [("a/b\\", "c.tar", "a_b_c.tar.gz"), ("./", "x", "x"), ("./", " co:n\t", "co_n"), ("./", "con", "con_pattern")]
    sizes = spark.createDataFrame([(1023,), (1024,), (10240,), (1 << 30,), (1 << 51,)], "v long")
    assert [r[0] for r in sizes.select(text.file_size(F.col("v"))).collect()] == ["1023 B", "1.00 KiB", "10.0 KiB", "1.00 GiB", "2048 TiB"]
    lines = spark.createDataFrame([("a\n\\n\\x",)], "v string")
    assert lines.select(text.unescape_newlines(text.escape_newlines(F.col("v")))).first()[0] == "a\n\\n\\x"


def test_lead_in(spark):
    tracks, events = decoded(spark, TEMPO2)
    whole = frames.from_events(events, tracks)
    rows = frames.lead_in(whole, tracks.groupBy("song_id").agg(F.max("ppqn").alias("ppqn")), 60.0, 2.0).orderBy("frame_index").collect()
    assert (len(rows), rows[0]["timestamp_sec"], rows[0]["tick"], rows[0]["bpm"], rows[0]["cumulative_notes"]) == (120, -2.0, -1920, 120, 0)


def test_lookups_and_counters_over_many_buckets(spark):
    rng = random.Random(5)
    dim = sorted({(s, rng.randrange(50, 3000)) for s in "ab" for _ in range(12)})
    rows = [(rng.choice("abc"), rng.randrange(4000), k) for k in range(400)] + [("a", dim[0][1], 400)]
    dims = spark.createDataFrame(dim, "s string, seg long").withColumn("v", F.col("seg") * 2)
    got = maps.asof(spark.createDataFrame(rows, "s string, at long, k int"), F.col("at"), dims, "seg", ["v"], ["s"], "seg", 37)
    first = {s: min(x for y, x in dim if y == s) for s in "ab"}
    want = [(s, at, k, 2 * max((x for y, x in dim if y == s and x <= at), default=first[s]) if s in first else None) for s, at, k in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    changes = [(s, t, rng.choice([-3, -1, 1, 2])) for s in "ab" for t in range(300)]
    df = spark.createDataFrame(changes, "s string, t long, x long")
    one, two = (ticks.held(df, ["s"], ["t"], width=w).select("s", "t", "held", "delta") for w in (None, 23))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_data_source_and_table_function(spark, tmp_path):
    from tickweave.sources import datasource

    datasource.register(spark)
    (tmp_path / "a.mid").write_bytes(TEMPO2)
    (tmp_path / "b.mid.gz").write_bytes(gzip.compress(TEMPO2))
    (tmp_path / "c.txt").write_bytes(b"nothing")
    load = lambda **options: spark.read.format("midi").options(**options).load(str(tmp_path))
    got = load(bytesPerPartition=1)
    assert got.rdd.getNumPartitions() == 3 + 1 + 1 and got.count() == 6
    want = midi.read_tracks(spark, str(tmp_path)).select("track_idx", "bytes").collect()
    assert sorted(map(tuple, got.select("track_idx", "bytes").collect())) == sorted(map(tuple, want))
    assert [r["error"] for r in load(mode="rows").where("error is not null").collect()] == ["ValueError: not a MIDI file"]
    assert load().where("track_idx = 1").count() == 2
    with pytest.raises(Exception, match="not a MIDI file"):
        load(mode="fail").count()
    got.createOrReplaceTempView("tracks")
    rows = spark.sql("SELECT song_id, track_idx, d.* FROM tracks, LATERAL decode_track(bytes) d")
    plain = midi.read_events(got)
    columns = ["song_id", "track_idx", "seq", "tick", "kind", "channel", "key", "value", "us", "num", "dd"]
    assert sorted(map(str, rows.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))


def test_frames_written_and_counted(spark, tmp_path):
    from tickweave import sinks

    tracks, events = decoded(spark, TEMPO2, TEMPO2)
    watched, seen = sinks.counted(events)
    assert watched.count() == events.count() and seen.get == {"events": 20, "notes": 8, "cc": 0, "tracks": 6, "last_tick": 2640}
    whole = frames.from_events(events, tracks)
    want = sorted(whole.collect())
    for kind in ("parquet", "csv"):
        sinks.write_frames(whole, str(tmp_path / kind), kind)
        back = sinks.read_frames(spark, str(tmp_path / kind), whole.schema, kind).select(*whole.columns)
        assert sorted(back.collect()) == want and len(list((tmp_path / kind).glob("song_id=*"))) == 2


def test_ticks_beyond_the_specification(spark):
    far = b"".join(vlq((1 << 28) - 1) + ON(60) for _ in range(3))
    tracks, events = decoded(spark, song(480, b"MTrk" + len(far).to_bytes(4, "big") + far))
    small = events.withColumn("tick", F.col("tick") % 5000)
    for spec in ("proceed", "bins"):
        assert frames.guarded(events, spec).count() == 4
        assert frames.summary(frames.from_events(small, tracks, spec=spec)).first()["notes"] == 3
    with pytest.raises(Exception, match="beyond the specification"):
        frames.guarded(events, "fail").select("tick").collect()


def _event(rng):
    time, key, r = vlq(rng.choice([0, 0, 1, 5, 200])), rng.randrange(60, 63), rng.random()
    plain = [
        (0.4, lambda: bytes([0x90, key, rng.choice([0, 100])])), (0.65, lambda: bytes([0x80, key, 0])), (0.72, lambda: bytes([key, 100])), (0.78, lambda: b"\xb0\7\1"),
        (0.84, lambda: tempo(rng.choice([500000, 250000]))), (0.88, lambda: b"\xff\x58\4" + bytes([rng.randrange(1, 7), 2, 24, 8])), (0.92, lambda: b"\xf0\3abc"),
        (0.95, lambda: b"\xff\1\5words"), (0.97, lambda: b"\xc0\5"), (1.0, lambda: bytes([rng.choice([0xF8, 0xFE, 0xF1, 0xF6])])),
    ]
    return time + next(f for limit, f in plain if r <= limit)()


def layered_song(rng):
    """A song's bytes and an archive of its pieces, in one or two layers, with repeats."""
    tiles = [b"".join(_event(rng) for _ in range(rng.randrange(1, 12))) for _ in range(3)]
    order = [k for _ in range(rng.randrange(1, 5)) for k in [rng.randrange(3) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 9)]
    head, chunk = song(480)[:14], lambda body, more=0: b"MTrk" + max(0, len(body) + more).to_bytes(4, "big")
    body, kind = b"".join(tiles[k] for k in order), rng.randrange(3)
    if kind == 0:
        pieces = [head + chunk(body, rng.choice([0, 0, 3, -2])), *(tiles[k] for k in order)]
    elif kind == 1:
        pieces = [head, *(chunk(tiles[k]) + tiles[k] for k in order)]
    else:
        whole = head + chunk(body) + body
        cuts = sorted({0, len(whole), *(rng.randrange(len(whole)) for _ in range(len(whole) // 5))})
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    packed = [lzma.compress(p, preset=0) for p in pieces]
    if rng.random() < 0.5:
        cuts = sorted({0, len(packed), *(rng.randrange(len(packed)) for _ in range(len(packed) // 3))})
        packed = [lzma.compress(b"".join(packed[a:b]), preset=0) for a, b in zip(cuts, cuts[1:], strict=False)]
    return b"".join(pieces), b"".join(packed)


def plain_song(data, vel0_is_off, close_held):
    """Cells, the last change of each kind at a tick, last tick and tracks, by a loop over all bytes."""
    found, changes, last, tracks = {}, {}, 0, midi.tracks(data)[1]
    for _, _, body in tracks:
        held, tick = {}, 0
        for tick, kind, channel, key, value, us, num, dd in plain_decode(body):
            cell = found.setdefault(tick, [0, 0, 0])
            on = kind == "on" and (value > 0 or not vel0_is_off)
            if on:
                held[channel, key] = held.get((channel, key), 0) + 1
                cell[0], cell[1] = cell[0] + 1, cell[1] + 1
            elif kind in ("on", "off") and held.get((channel, key), 0):
                held[channel, key] -= 1
                cell[1] -= 1
            elif kind == "cc":
                cell[2] += 1
            elif kind in ("tempo", "timesig"):
                changes[tick, kind] = (us,) if kind == "tempo" else (num, dd)
        if close_held:
            found.setdefault(tick, [0, 0, 0])[1] -= sum(held.values())
        last = max(last, tick)
    return {t: tuple(c) for t, c in found.items() if any(c)}, changes, last, len(tracks)


def test_layered_archives_against_a_loop():
    from tickweave.sources import layered

    rng, folded = random.Random(8), 0
    for case in range(300):
        data, archive = layered_song(rng)
        options = rng.random() < 0.7, rng.random() < 0.4
        try:
            want = plain_song(data, *options)
        except ValueError:
            want = None
        grammar = layered.Grammar()
        try:
            root = grammar.add(archive)
            got = layered.Walker(grammar, *options).run(root).elements
        except ValueError:
            assert want is None, case
            continue
        assert grammar.size(root) == len(data) and grammar.decoded <= len(layered.cut(archive)) + sum(len(n) for n in grammar.nodes if isinstance(n, list)) * layered.PERIOD
        found, changes, last, ends = {}, {}, 0, 0
        for e in got:
            folded += bool(e.dims) + (e.times > 1)
            places = [(e.tick, e.seq)]
            for step, count, seq_step in e.dims:
                places = [(t + k * step, s + k * seq_step) for t, s in places for k in range(count)]
            for t, s in places:
                if e.kind == "cell":
                    found[t] = tuple(a + b * e.times for a, b in zip(found.get(t, (0, 0, 0)), e.values, strict=True))
                elif e.kind == "end":
                    last, ends = max(last, t), ends + e.times
                else:
                    changes[t, e.kind] = max(changes.get((t, e.kind), (0, ())), (s, e.values))
        assert ({t: c for t, c in found.items() if any(c)}, {k: v for k, (_, v) in changes.items()}, last, ends) == want, case
    assert folded > 500


def test_patterns_in_a_sequence():
    from tickweave.sources.layered import fold

    assert fold([1, 2, 1, 2, 1, 2, 3, 3, 3, 4]) == [((1, 2), 3), ((3,), 3), ((4,), 1)] and fold([]) == []
    rng = random.Random(1)
    for _ in range(300):
        given = [k for _ in range(rng.randrange(5)) for k in [rng.randrange(3) for _ in range(rng.randrange(1, 10))] * rng.randrange(1, 6)]
        assert [k for pattern, times in fold(given) for _ in range(times) for k in pattern] == given


def test_layered_archives_with_very_many_repeats(spark):
    from tickweave.sources import layered

    tile = b"".join(b"\1" + ON(60) + b"\2" + OFF(60) + b"\0" + ON(61) for _ in range(50))
    n = 2000
    member = lzma.compress(tile, preset=0)
    block = lzma.compress(member * n, preset=0)
    head = lzma.compress(song(480)[:14] + b"MTrk" + (len(tile) * n * n).to_bytes(4, "big"), preset=0)
    many = lzma.compress(head, preset=0) + block * n
    rng = random.Random(4)
    pairs = [layered_song(rng) for _ in range(6)]
    pairs = [p for p in pairs if midi.tracks(p[0])]
    given = [("many", many)] + [(f"s{k}", a) for k, (_, a) in enumerate(pairs)] + [("plain", TEMPO2), ("gz", gzip.compress(TEMPO2)), ("junk", b"x"), ("cut", member[:-5])]
    files = spark.createDataFrame([(k, bytearray(f)) for k, f in given], "song_id string, content binary")
    rows = layered.read_layered(files, mode="rows").cache()
    assert {r["song_id"] for r in rows.where("error is not null").collect()} == {"junk", "cut"}
    whole = {r["song_id"]: r for r in layered.totals(rows).collect()}
    assert (whole["many"]["notes"], whole["many"]["max_tick"], whole["many"]["tracks"]) == (100 * n * n, 150 * n * n, 1)
    assert rows.where("song_id = 'many'").count() < 1000
    small = rows.where("song_id like 's%' or song_id in ('plain', 'gz')")
    plain = spark.createDataFrame([(f"s{k}", bytearray(d)) for k, (d, _) in enumerate(pairs)] + [("plain", bytearray(TEMPO2)), ("gz", bytearray(TEMPO2))], "song_id string, content binary")
    tracks = midi.split_tracks(plain, "fail")
    want = ticks.tick_cells(ticks.note_deltas(midi.read_events(tracks)), ["song_id"], "tick").select("song_id", "tick", "ons", "delta", "cc")
    assert sorted(map(tuple, layered.cells(small).collect())) == sorted(map(tuple, want.collect()))
    got = layered.layered_frames(small.where("song_id in ('s0', 'plain')")).orderBy("song_id", "frame_index").collect()
    assert got == frames.from_events(midi.read_events(tracks), tracks).where("song_id in ('s0', 'plain')").orderBy("song_id", "frame_index").collect()


def test_xz_blocks(spark, tmp_path):
    import shutil
    import subprocess

    from tickweave.sources import xz

    rng = random.Random(2)
    data = TEMPO2 + bytes(rng.randrange(4) for _ in range(40_000))
    files = [lzma.compress(data), lzma.compress(data, check=lzma.CHECK_SHA256) + lzma.compress(b"more"), lzma.compress(data, check=lzma.CHECK_NONE) + bytes(8), data, b""]
    want = [data, data + b"more", data, data, b""]
    if shutil.which("xz"):
        many = subprocess.run(["xz", "-c", "--block-size=5000"], input=data, capture_output=True, check=True).stdout
        assert len(xz.blocks(many)) == -(-len(data) // 5000)
        files, want = [*files, many], [*want, data]
    given = spark.createDataFrame([(str(k), bytearray(f)) for k, f in enumerate(files)], "song_id string, content binary")
    got = {int(r["song_id"]): bytes(r["content"]) for r in xz.unpack_blocks(given, 3).collect()}
    assert [got[k] for k in range(len(files))] == want
    with pytest.raises(ValueError, match="other filters"):
        packed = lzma.compress(data, filters=[{"id": lzma.FILTER_DELTA, "dist": 1}, {"id": lzma.FILTER_LZMA2}])
        xz.unpack_block(packed[12 : 12 + xz.blocks(packed)[0][1]], 8)
