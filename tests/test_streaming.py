"""The streamed closed window against a loop."""

import random

from pyspark.sql import functions as F

from tickweave.streaming import closed_window_stream

SECOND = 1_000_000


def test_closed_window_of_a_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), t + rng.randrange(SECOND // 2), rng.choice([1, 2, None])) for t in range(0, 9 * SECOND, SECOND // 8)]
    rows += [("a", 2 * SECOND, 1), ("a", 3 * SECOND, 1), ("a", 3 * SECOND, 2), ("a", None, 5)]
    rows.sort(key=lambda r: (r[1] or 0) + rng.randrange(SECOND // 2))
    end = [("a", 60 * SECOND, 1)]
    schema = "s string, us long, v int"
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] if k < 3 else rows[3 * len(rows) // 4 :] + end
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = closed_window_stream(stream, ["s"], "ts", {"nps": "v"}, SECOND, "2 seconds")
    query = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("closed").collect())
    real = [(s, t, v or 0) for s, t, v in rows if t is not None]
    want = {(s, t, sum(y for a, b, y in real if (a, b) == (s, t)), sum(y for a, b, y in real if a == s and t - SECOND <= b <= t)) for s, t, _ in real}
    assert got == sorted(want)


def _fed(spark, batches, schema, build, name):
    """Run a stream over files, one a micro-batch, into a table of rows."""
    import tempfile

    folder = tempfile.mkdtemp()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_counter_over_a_stream(spark):
    import random

    from tickweave.operators.ticks import held
    from tickweave.streaming.stateful import held_stream

    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([1, -1, -1, 2, None])) for k in range(300)]
    schema = "key string, seq long, x long"
    got = _fed(spark, [rows[:100], rows[100:200], rows[200:]], schema, lambda s: held_stream(s, ["key"], "seq"), "counted")
    want = held(spark.createDataFrame(rows, schema), ["key"], ["seq"]).select("key", "seq", "held", "delta").collect()
    assert sorted((r["key"], r["seq"], r["held"], r["delta"]) for r in got) == sorted(map(tuple, want))


def test_tracks_decoded_from_pieces(spark):
    import random

    from tickweave.sources import midi
    from tickweave.streaming.stateful import decode_stream

    rng = random.Random(5)
    bodies = [bytes(rng.choice([0, 1, 0x90, 60, 100, 0x81, 0xFF, 0x51, 3, 7, 0xF0, 2]) for _ in range(rng.randrange(30, 200))) for _ in range(4)]
    pieces = []
    for t, body in enumerate(bodies):
        cuts = sorted({0, len(body), *(rng.randrange(len(body)) for _ in range(9))})
        pieces += [("s", t, k, b == len(body), bytearray(body[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rng.shuffle(pieces)
    schema = "song_id string, track_idx int, piece long, last boolean, bytes binary"
    got = _fed(spark, [pieces[:15], pieces[15:], pieces[:5]], schema, decode_stream, "decoded")
    want = [(t, seq, e[1], e[0], *e[2:]) for t, body in enumerate(bodies) for seq, e in enumerate(midi.decode(body))]
    columns = ["track_idx", "seq", "kind", "tick", "channel", "key", "value", "us", "num", "dd"]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, want))


def test_progress_and_cancellation(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    from tickweave.streaming import progress

    seen, ended = [], []
    listener = progress.Progress(lambda *batch: seen.append(batch), ended.append)
    spark.streams.addListener(listener)
    _fed(spark, [[(1,), (2,)], [(3,)]], "x long", lambda s: s, "passed")
    assert progress.wait(lambda: ended == [None] and sum(b[1] for b in seen) == 3, 20)
    spark.streams.removeListener(listener)

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    result = []

    def work():
        with progress.cancellable(spark, "slow-work") as cancel:
            result.append(cancel)
            try:
                spark.range(4).select(F.col("id")).mapInArrow(slow, "id long").collect()
            except Exception as error:
                result.append(error)

    thread = threading.Thread(target=work)
    began = time.monotonic()
    thread.start()
    assert progress.wait(lambda: bool(progress.stage_progress(spark)), 20)
    result[0]()
    thread.join(30)
    assert len(result) == 2 and time.monotonic() - began < 40
