"""Boxes, placement, font features and settings."""

import random

import pytest
from pyspark.sql import functions as F

from tickweave.functions import boxes, layout
from tickweave.functions.boxes import Box
from tickweave.sources import settings


def test_structures_read_back():
    text = "C(0.5:B,0.5:R(0.25:B,0.75:C(0.3:B,0.7:B)))"
    tree = boxes.read(text)
    assert boxes.write(tree) == text and len(boxes.leaves(tree)) == 4
    assert boxes.write(boxes.read(" C(2:B, 2 :B)".replace(" :", ":"))) == "C(0.5:B,0.5:B)"
    assert boxes.write(boxes.read("C(1:C(1:B,3:B),1:B)")) == "C(0.125:B,0.375:B,0.5:B)" and boxes.read("R(3:B)") == Box()
    for bad in ("", "C()", "C(0:B)", "C(1:B", "B)", "BB", "C(1:B,)", "X", "C(1:B)B", "C(nan:B)", "C(-1:B)", "C(1:C(1:B)", "R(1:" * 70 + "B" + ")" * 70):
        with pytest.raises(ValueError):
            boxes.read(bad)


def test_edits_keep_the_frame_covered():
    rng = random.Random(2)
    tree = Box("first")
    for _ in range(400):
        n = len(boxes.leaves(tree))
        k, what = rng.randrange(n), rng.randrange(5)
        if what == 0 and n < 20:
            tree = boxes.split(tree, k, rng.choice("CR"), rng.randrange(2, 5))
        elif what == 1 and n < 20:
            held = boxes.leaves(tree)[k][2]
            tree, new = boxes.insert(tree, k, rng.choice(["left", "above", "right", "below"]))
            assert boxes.leaves(tree)[new][2] == Box() and boxes.leaves(tree)[k + (new == k)][2] == held
        elif what == 2 and n > 1:
            tree, at = boxes.remove(tree, k)
            assert 0 <= at < n - 1 or n - 1 == at == 0 or at < n
        elif what == 3 and n > 1:
            tree = boxes.equalize(tree, k)
        elif boxes.dividers(tree):
            d = rng.choice(boxes.dividers(tree))
            tree = boxes.move(tree, d, rng.random())
        area = sum((r[2] - r[0]) * (r[3] - r[1]) for _, r, _ in boxes.leaves(tree))
        assert area == pytest.approx(1) and boxes.write(boxes.read(boxes.write(tree)))
        for _, r, _ in boxes.leaves(tree):
            assert boxes.box_at(tree, (r[0] + r[2]) / 2, (r[1] + r[3]) / 2) >= 0


def test_edits_by_hand():
    tree = boxes.split(Box("a"), 0, "C", 2)
    tree, new = boxes.insert(tree, 1, "above")
    assert (boxes.write(tree), new) == ("C(0.5:B,0.5:R(0.5:B,0.5:B))", 1)
    undone, at = boxes.remove(tree, 1)
    assert (undone, at) == (boxes.split(Box("a"), 0, "C", 2), 1)
    d = boxes.edge_divider(tree, 0, "right")
    assert (d.place, d.kind, d.range) == (0.5, "C", (boxes.LEAST, 1 - boxes.LEAST)) and boxes.edge_divider(tree, 0, "left") is None
    assert boxes.write(boxes.move(tree, d, 0.9)) == "C(0.9:B,0.1:R(0.5:B,0.5:B))"
    assert boxes.leaves(boxes.move(tree, d, 5.0))[0][1][2] == pytest.approx(1 - boxes.LEAST)
    held = boxes.from_rect((0.25, 0.5, 0.75, 1.0), Box("x"))
    assert [r[1:5] for r in boxes.box_rows(held) if r[7] == "x"] == [(0.25, 0.5, 0.75, 1.0)] and boxes.write(held) == "C(0.25:B,0.5:R(0.5:B,0.5:B),0.25:B)"
    assert boxes.from_rect((0, 0, 1, 1), Box("x")) == Box("x")


def test_places(spark):
    rows = [(100.0, 40.0, a, 0.0, 0.0, 0.0, 0.0, 10.0) for a in range(1, 10)] + [(100.0, 40.0, 5, 500.0, 100.0, 200.0, 100.0, 10.0), (300.0, 40.0, 9, 500.0, 100.0, 200.0, 100.0, 150.0), (2000.0, 40.0, 8, 0.0, 0.0, 0.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "w double, h double, a int, x double, y double, bw double, bh double, m double")
    c = F.col
    x, y = layout.place(c("w"), c("h"), c("a"), (c("x"), c("y"), c("bw"), c("bh")), (F.lit(800.0), F.lit(600.0)), c("m"), F.lit(1.0))
    got = [tuple(r) for r in df.select(x, y).collect()]
    want = [(px, py) for py in (550.0, 280.0, 10.0) for px in (10.0, 350.0, 690.0)]
    assert got == [*want, (550.0, 130.0), (300.0, 150.0), (1.0, 10.0)]
    lines = spark.createDataFrame([(100.0, 60.0, 7, 0), (100.0, 60.0, 9, 0), (100.0, 60.0, 9, 1), (100.0, 60.0, 7, 2)], "b double, w double, a int, l int")
    assert [r[0] for r in lines.select(layout.line_offset(c("b"), c("w"), c("a"), c("l"))).collect()] == [0.0, 40.0, 0.0, 20.0]
    blocks = spark.createDataFrame([(100.0, 50.0), (0.0, 9.0), (400.0, 50.0)], "w double, h double")
    scale = lambda size: blocks.agg(layout.fit_scale(c("w"), c("h"), F.lit(size), F.lit(300.0), F.lit(10.0), F.lit(2.0))).first()[0]
    assert scale(1000.0) == 1 and scale(222.0) == pytest.approx(0.98 * 0.5)


def test_features_and_saturation(spark):
    df = spark.createDataFrame([(False, True, True, 2, 1, 0b101, "salt, -dlig;x!  tnum=1 toolong ss03[1:3]"), (True, False, False, 0, 2, 1 << 19, None)], "k boolean, l boolean, z boolean, n int, w int, s int, e string")
    got = [r[0] for r in df.select(layout.features(*map(F.col, "klznws"), F.coalesce("e", F.lit("")))).collect()]
    assert got == [["-kern", "zero", "onum", "pnum", "ss01", "ss03", "salt", "-dlig", "tnum=1", "ss03[1:3]"], ["-liga", "tnum", "ss20"]]
    big = spark.createDataFrame([("99999999999999999999",), ("12",)], "v string").select(layout.saturated(F.col("v").cast("decimal(38,0)")))
    assert [r[0] for r in big.collect()] == [(1 << 63) - 1, 12]


def test_settings(spark):
    text = "﻿# head\nfps = 2000\r\nwidth=-3\n height = 5\nstart_delay = -1\nend_delay = nan\nx264_crf = 77\nfps = 5\ntrack_dedup = yes\n;no = 1\nnothing\nkeyframe_seconds = 0.5x\nmidi_dir =  a=b \nlog_open = true\nparse_threads=\n"
    rows = settings.parse_settings(spark.createDataFrame([("a", text), ("b", None), ("c", "fps = 0\ndedup_mode = 1")], "file string, text string"))
    got = {r["file"]: r for r in settings.settings(rows).collect()}
    a, c = got["a"], got["c"]
    assert (a["fps"], a["width"], a["height"], a["start_delay"], a["end_delay"], a["x264_crf"], a["dedup_mode"], a["keyframe_seconds"]) == (1000.0, 1920, 1080, 0.0, 0.0, 18, 2, 0.5)
    assert (a["midi_dir"], a["log_open"], a["parse_threads"], a["vel0_note_off"]) == (" a=b ", True, 0, True) and (c["fps"], c["dedup_mode"], "b" in got) == (60.0, 1, False)
    once = settings.settings(rows)
    assert sorted(settings.settings(settings.parse_settings(settings.write_settings(once))).collect()) == sorted(once.collect())
