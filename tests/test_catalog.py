"""Catalog queries against their SQL in DuckDB, and the two-level forms against single windows."""

import os
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave import queries
from tickweave.operators import ticks
from tickweave.operators.prefix import closed_window, running

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", ["a4_saturating_held", "a14_effects", "a15_series_rle", "dd1_dedup_weighted", "w4_closed_window", "w9_meter_segments", "j1_asof_tick", "j7_merge_sum", "f5_signed", "f14_file_size", "f19_escape"])
def test_against_sql(spark, duck, name):
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_flagship_last_row(spark):
    r = queries.frames_full(spark, SF).orderBy(F.col("k").desc()).first()
    assert tuple(r[c] for c in ("k", "cum", "cum_cc", "nps", "peak_nps", "poly", "peak_poly")) == (4316, 398, 199, 0, 5, 90, 92)


def test_two_level_forms_equal_single_windows(spark):
    rng = random.Random(3)
    rows = [(k % 2, rng.randrange(500), k, rng.choice([-2, 1, 3, None]), 7 + k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "s int, t long, i long, v long, w int")
    one = Window.partitionBy("s").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    both = running(df, ["s"], ["t", "i"], {"a": ("sum", "v"), "b": ("max", "v"), "c": ("last", "v")}, 40)
    want = df.select("*", F.coalesce(F.sum("v").over(one), F.lit(0)).alias("a"), F.max("v").over(one).alias("b"), F.last("v", ignorenulls=True).over(one).alias("c"))
    assert sorted(map(str, both.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    closed = closed_window(df.na.fill(0), ["s"], "t", {"n": "v"}, 25)
    span = Window.partitionBy("s").orderBy("t").rangeBetween(-25, 0)
    want = df.na.fill(0).select("*", F.sum("v").over(span).alias("n"))
    assert sorted(map(str, closed.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    varied = closed_window(df.na.fill(0), ["s"], "t", {"n": "v"}, F.col("w"))
    brute = [(s, t, i, v or 0, w, sum(y or 0 for a, b, _, y, _ in rows if a == s and t - w <= b <= t)) for s, t, i, v, w in rows]
    assert sorted(tuple(r) for r in varied.collect()) == sorted((s, t, i, v, 7 + s, n) for s, t, i, v, w, n in brute)


def test_series_expands_to_its_cells(spark):
    rows = [(1, t, v) for t, v in ((0, 1), (5, 1), (10, 1), (11, 1), (12, 1), (20, 2), (21, 1), (30, 1))]
    df = spark.createDataFrame(rows, "s int, t long, v long")
    runs = ticks.series(df, ["s"], "t", ["v"])
    assert runs.count() < len(rows)
    assert sorted((r["s"], r["t"], r["v"]) for r in ticks.expand_series(runs, "t").collect()) == rows


def test_crc_of_texts(spark):
    import zlib

    got = {r["doc_id"]: r["crc"] for r in queries.f21_crc32(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: zlib.crc32(r["text"].encode()) for r in docs}


def test_effects_of_blocks_in_a_row(spark):
    rng = random.Random(6)
    blocks = [[rng.choice([1, -1]) for _ in range(rng.randrange(1, 9))] for _ in range(40)]

    def effect(xs):
        low = net = 0
        for x in xs:
            net += x
            low = min(low, net)
        return -low, net

    rows = [(*effect(a), *effect(b), *effect(a + b)) for a, b in zip(blocks, blocks[1:], strict=False)]
    df = spark.createDataFrame(rows, "d1 int, n1 int, d2 int, n2 int, d int, n int")
    d, n = ticks.concat_effect((F.col("d1"), F.col("n1")), (F.col("d2"), F.col("n2")))
    assert df.where((d != F.col("d")) | (n != F.col("n"))).count() == 0


def test_plans_read_the_table_once_or_twice(spark):
    plan = queries.frames_full(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan  # the last step reads written tables alone
    assert queries.a1_tick_cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation ") <= 2
