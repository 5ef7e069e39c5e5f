"""Operators against plain Python on small tables with nulls, blanks, long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.llm import ann, chat, graph, jaccard, kernels, lattice, licenses, lm, mixing, packing, quality, tokens
from tickweave.llm.queries import RANKS

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, key string, n string, h string, copies string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéñ漢") for _ in range(rng.randrange(1, 12)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    texts += [None, "", " \t\n", "one", "one", "ONE  two", "a b c d", "A b\x0bc\td", "x" * 5000, " ".join(word() for _ in range(6000))]
    for base in texts[:6]:
        words = base.split(" ")
        for k in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"edit{k}"
            texts.append(" ".join(copy))
        texts.append(base)
    rows = [(k, t, rng.choice(["a", "b", "é", None]), "s", "k", "n", "h", "c") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, "null id words here now", "a", *"sknhc"), (None, texts[0], None, *"sknhc")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def shingles(text, width=5):
    words = SPACE.findall(lower(text))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for k, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(k)] = min(ident, least.get(root(k), ident))
    return [(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


order = lambda rows: sorted(rows, key=str)


def test_jaccard_against_brute_force(docs):
    rows = [(r[0], r[1]) for r in made()]
    assert order(tuple(r) for r in jaccard.jaccard_classes(docs).collect()) == order(brute_components(rows))


def test_jaccard_blocks_of_a_large_loose_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(words)))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(tuple(r) for r in got) == order(brute_components(rows))


def test_keep_first(docs):
    want = {c if c is not None else None for _, n, c in brute_components([(r[0], r[1]) for r in made()])}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect() if r[0] is not None]
    assert sorted(ids) == sorted(x for x in want if x is not None)


def test_keep_first_decides_by_row(spark):
    long = lambda w: " ".join(f"{w}{k}" for k in range(30))
    rows = [(5, long("a")), (5, long("b")), (5, long("b")), (3, long("a")), (None, long("b")), (None, long("c")), (None, long("c")), (None, long("d") + " x"), (8, long("d")), (9, ""), (9, ""), (None, None)]
    got = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(3, long("a")), (5, long("b")), (None, long("c")), (8, long("d")), (9, ""), (9, ""), (None, None)]
    assert order(tuple(r) for r in got) == order(want)


def test_jaccard_of_long_texts_in_small_pieces(spark, monkeypatch):
    for name, value in (("ROUTE_BYTES", 30_000), ("TOKEN_PART_BYTES", 1), ("COUNT_TOKENS", 500), ("BATCH_TOKENS", 700), ("BLOCK_TOKENS", 9000)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(4000)}" for _ in range(3000)] for _ in range(3)]
    rows = []
    for k in range(36):
        words = list(base[k % 3])
        for _ in range(rng.randrange(140)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(words[: rng.choice([3000, 2900, 1500])])))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert order(tuple(r) for r in got) == order(brute_components(rows))


def test_clashing_names_and_empty_tables_of_stages(spark, docs):
    clash = docs.withColumnsRenamed({"key": "mark", "n": "ID", "h": "_id", "copies": "__id"}).withColumn("copies", F.lit(1)).withColumn("verdict_mark", F.lit("v"))
    for f in (jaccard.keep_first, mixing.mixed):
        got = f(clash)
        assert got.columns == clash.columns and got.count() == f(docs).count()
        assert f(clash.where("false")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (20, 3), (None, 4)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 141)}


def test_mix(spark, docs):
    rows = made()
    got = mixing.mix(docs).collect()
    size = [len(SPACE.findall(r[1] or "")) for r in rows]
    assert order((r["doc_id"], r["size"]) for r in got) == order((r[0], s) for r, s in zip(rows, size, strict=True))
    whole, names = sum(size), sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    each = {n: sum(s for r, s in zip(rows, size, strict=True) if r[2] == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, stopped = {}, set()
    while True:
        rest = whole - sum(3 * each[n] for n in stopped)
        target = {n: 3 * each[n] if n in stopped else rest * weight[n] / sum(weight[m] for m in names if m not in stopped) for n in names}
        more = {n for n in names if n not in stopped and target[n] > 3 * each[n]}
        if not more:
            break
        stopped |= more
    for n in names:
        own = [r for r in got if r["source"] == n]
        assert own[0]["target"] == pytest.approx(target[n]) and own[0]["source_size"] == each[n]
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
    assert order(map(tuple, mixing.mix(docs).collect())) == order(map(tuple, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_mix_copies_against_a_loop(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SALTS", 5)
    rows = mixing.mix(docs).collect()
    hashes = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "doc_id", F.pmod(F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(5)).alias("salt"), F.xxhash64(F.lit(17), F.xxhash64(F.coalesce("text", F.lit(""))), "doc_id").alias("h"), F.array(*(F.xxhash64(F.lit(17), F.lit(k), F.pmod(F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(5)).cast("int")) for k in range(mixing.ORDERS))).alias("o"))
    places = {(r["doc_id"], r["mark"]): (r["o"], r["h"]) for r in hashes.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((*places[r["doc_id"], r["mark"]], r["size"], r["copies"], r["target"], r["source_size"]))
    for own in by.values():
        rate, whole = (own[0][4] / own[0][5] if own[0][5] else 0.0), own[0][4]
        upto, fits, best = np.arange(len(own) + 1) * rate, False, math.inf
        for turn in range(mixing.ORDERS):
            own.sort(key=lambda x, k=turn: (x[0][k], x[1]))
            got, sizes = np.array([x[3] for x in own]), np.array([x[2] for x in own])
            for u in range(mixing.OFFSETS):
                option = np.diff(np.floor(upto + u / mixing.OFFSETS))
                fits |= bool((option == got).all())
                best = min(best, abs((option * sizes).sum() - whole))
        assert fits and abs((got * sizes).sum() - whole) <= max(best, mixing.NEAR * whole) + 1e-6


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 20) % 9000)), "hot" if k % 3 else f"s{k % 7}") for k in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.01 * r["g"] for r in got)


@pytest.mark.parametrize("f", [lambda d: jaccard.jaccard_classes(d), lambda d: mixing.mix(d), lambda d: packing.pack(d), lambda d: licenses.scan_licenses(d), lambda d: tokens.pack_tokens(d, RANKS), lambda d: lm.score(d, F.lit(False))])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_variable_packing(docs):
    bins = packing.pack(docs, capacities=(64, 128, 512), window=50).collect()
    pieces = [(d, s, n) for b in bins for d, s, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True)]
    assert all(b["used"] == sum(b["lengths"]) <= b["capacity"] and b["capacity"] == min(c for c in (64, 128, 512) if c >= b["used"]) for b in bins)
    want = []
    for r in made():
        n = len(SPACE.findall(r[1] or ""))
        want += [(r[0], s, min(512, n - s)) for s in range(0, max(1, n), 512)]
    assert order(pieces) == order(want)


def test_several_capacities_against_all_packings():
    rng = random.Random(11)
    sizes, hits = (4, 8, 16), 0
    cost = {s: 1 + s + s * s / 32 for s in sizes}

    def cheapest(rest, bins):
        if not rest:
            return sum(cost[min(s for s in sizes if s >= b)] for b in bins)
        head, *tail = rest
        options = [cheapest(tail, [*bins[:k], b + head, *bins[k + 1 :]]) for k, b in enumerate(bins) if b + head <= 16]
        return min([*options, cheapest(tail, [*bins, head])])

    for _ in range(60):
        lengths = np.array([rng.choice([1, 2, 3, 4, 5, 7, 8, 11, 16]) for _ in range(rng.randrange(1, 7))])
        bins, caps = packing.best_fit(lengths, sizes, 1, 32)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert caps == [min(s for s in sizes if s >= lengths[b].sum()) for b in bins]
        got, best = sum(cost[c] for c in caps), cheapest(lengths.tolist(), [])
        assert best - 1e-9 <= got <= 1.3 * best
        hits += got <= best + 1e-9
    assert hits >= 45


def test_several_capacities_are_used():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, (rng.lognormal(5.5, 0.9, 4000)).astype(np.int64) + 1)
    bins, caps = packing.best_fit(lengths, (512, 1024, 2048, 4096), 64, 16_384)
    cost = lambda caps: sum(64 + c + c * c / 16_384 for c in caps)
    assert len({c for c in caps if caps.count(c) > 5}) >= 3 and lengths.sum() / sum(caps) > 0.99
    assert cost(caps) < cost(packing.best_fit(lengths, (4096,), 64, 16_384)[1])


def test_room_is_best_fit():
    rng = random.Random(3)
    room, plain = packing.Room(100), []
    for k in range(3000):
        if rng.random() < 0.5:
            free = rng.randrange(101)
            room.add(free, k)
            plain.append(free)
        else:
            need = rng.randrange(101)
            fits = [f for f in plain if f >= need]
            got = room.take(need)
            assert (got and got[0]) == (min(fits) if fits else None) or (got and got[0] == 0 and min(fits) == 0)
            if fits:
                plain.remove(min(fits))


def test_token_rows_read_back(spark, docs):
    more = spark.createDataFrame([(900, "It's a  test,\n\n new\tline ''quoted'' 12ab  \r\n end . ", "a", *"sknhc"), (901, "don't 'tis x y é \U0001f600!?", "a", *"sknhc")], SCHEMA)
    given = docs.unionByName(more)
    rows = tokens.pack_tokens(given, RANKS, length=64, window=40).collect()
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and r["resets"] == r["cu_seqlens"][:-1] and (ids[r["n_tokens"] :] == tokens.END).all()
        pieces += [(d, s, tuple(ids[a:b].tolist())) for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)]
    want = []
    for r in given.collect():
        ids = [*plain.encode_ordinary(r["text"] or ""), tokens.END]
        want += [(r["doc_id"], s, tuple(ids[s : s + 64])) for s in range(0, len(ids), 64)]
    assert order(pieces) == order(want)


def test_token_shards_read_back(spark, docs, tmp_path):
    packed = tokens.pack_tokens(docs, RANKS, length=64, window=40).cache()
    folder = f"file://{tmp_path}/out"
    index = tokens.write_shards(packed, folder, length=64, rows=7)
    assert index.select("shard").distinct().count() > packed.count() // 8
    (tmp_path / "out/shards/00000-left-over.bin").write_bytes(b"x" * 64)
    back = tokens.read_shards(spark, folder)
    assert order(map(str, back.select(*packed.columns).collect())) == order(map(str, packed.collect()))
    raw = {f.name: f.read_bytes() for f in (tmp_path / "out/shards").iterdir()}
    for r in index.join(packed.select("bin_id", "ids"), "bin_id").collect():
        assert raw[r["shard"]][r["first"] * 128 : r["first"] * 128 + 128] == bytes(r["ids"])


def test_licenses_against_regular_expressions(spark):
    rng = random.Random(5)
    words = ["cc", "by", "CC", "By", "general", "public", "license", "all", "rights", "reserved", "x", "é", "cc-by", "GENERAL public"]
    texts = [None, "", "cc by cc by", "cc byé", "ccby"] + [rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(given).collect():
        got = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        places = [(k, p) for p in licenses.BASE for k in range(len(got)) if got[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(got), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({licenses.BASE[p] for _, p in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_expressions(spark):
    value = lambda s: licenses.evaluate(licenses.parse_expression(s)[0])
    t = value("MIT OR (Apache-2.0 AND GPL-2.0+ WITH Classpath-exception-2.0)")
    assert (t.offered, t.required, t.alternatives, t.asks) == (["mit", "apache-2.0", "gpl-2.0+-with-classpath-exception-2.0"], set(), 2, 0)
    t = value("(MIT OR X1) AND (GPL-3.0 OR MPL-2.0) AND zlib")
    assert (t.required, t.alternatives, t.asks) == ({"zlib"}, 4, 1)
    assert (value("gpl-2.0").asks, value("gpl-2.0 with e").asks, value("x1").asks, value("cc-by-sa-4.0").asks, value("").alternatives) == (2, 1, 3, 2, 0)
    assert licenses.parse_expression("mit or bsd and zlib")[0] == ["mit", "bsd", "zlib", "and", "or"]
    assert licenses.parse_expression("mit or") == (["mit"], 1) and licenses.parse_expression(") mit") == ([], 0)
    texts = ["// SPDX-License-Identifier: MIT OR Apache-2.0\nint main;", "spdx license identifier MIT AND Apache-2.0", "SPDX-License-Identifier:\nMIT", "é SPDX-License-Identifier: (GPL-2.0 WITH x) é", "a SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC OR X1", "spdx license", "identifier mit"]
    got = [r[1:] for r in sorted(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "labels", "required", "alternatives", "asks", "n_base").collect())]
    assert got == [("apache-2.0,mit", "", 2, 0, 0), ("apache-2.0,mit", "apache-2.0,mit", 1, 0, 0), ("", "", 0, None, 0), ("gpl-2.0-with-x", "gpl-2.0-with-x", 1, 1, 0), ("isc,mit,x1", "mit", 2, 0, 0), ("", "", 0, None, 0), ("", "", 0, None, 0)]
    scores = [r[0] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")).orderBy("doc_id").select("score").collect()]
    assert scores[0] < scores[1]


def test_license_notices_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(kernels.chunks, "__defaults__", (400,))
    rng = random.Random(7)
    words = sorted({w for p in [*licenses.NOTICES, *licenses.BASE, "tag x é"] for w in p.split()})
    texts = [rng.choice([" ", "-", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)] + [" ".join(rng.choice(words) for _ in range(9000)), "", None]
    texts += [f"x {p} y" for p in licenses.NOTICES]
    every = licenses.BASE | licenses.NOTICES
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        places = sorted((k, p) for p in every for k in range(len(got)) if got[k : k + len(p.split())] == p.split())
        labels = {every[p] for _, p in places}
        assert list(zip(r["places"], r["phrases"], strict=True)) == places and r["labels"] == ",".join(sorted(labels))
        assert r["score"] == pytest.approx(1 - math.exp(-sum(0.5 if x in licenses.WEAK else 1 for x in labels)))


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_ROWS", 5)
    rng = random.Random(6)
    parts = ["\\", "#", "### ", "</turn>", "\n", "<", "/", ":", "é", "漢", "a", "### Assistant:\n", ""]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "sys:\nx\\", None, "assistant"]), text(), "x") for c in (1, 2, 3, None, 4) for t in range(rng.randrange(1, 2000 if c == 4 else 9))]
    rows.append(rows[0])
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string"))).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        mine = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(mine), hashlib.sha256(mine.encode()).hexdigest())


def test_chats_stored_and_dealt_anew(spark, monkeypatch, tmp_path):
    for name, value in (("PART_ROWS", 5), ("PIECE_ROWS", 3)):
        monkeypatch.setattr(chat, name, value)
    turns = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"text {c} {t} #" * 9) for c in range(7) for t in range(20)], "conv_id long, turn long, role string, text string")
    direct = chat.digests(chat.format_chats(turns), in_order=True).collect()
    chat.format_chats(turns).repartition(6).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() >= 7 and order(map(tuple, chat.digests(stored).collect())) == order(map(tuple, direct))
    assert chat.format_chats(turns.where("false")).count() == 0 and chat.digests(stored.where("false")).count() == 0


def test_chat_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 100)
    monkeypatch.setattr(chat, "MOST_BYTES", 300)
    texts = ["a" * n for n in (10, 90, 20, 500, 30, 30, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 7), pa.array(range(7)), pa.array(["assistant"] * 7), pa.array(texts)], names=["conv_id", "turn", "role", "text"])
    out = [r for b in chat._format(iter([batch])) for r in b.to_pylist()]
    assert [r["part"] for r in out] == list(range(len(out))) and len(out) > 2
    assert [t.decode() for r in out for _, t in chat.read_turns(r["formatted"].encode())] == texts


def test_no_control_string_stands_in_a_text():
    hard = pa.array(["\\### Assistant: </turn> ok", "<</turn>", "\\\\#"])
    buffer, offsets, spans = chat.assemble(pa.array(["user", "a", "b"]), hard)
    raw = buffer.to_pybytes()
    for (a, b), text in zip(spans.tolist(), hard.to_pylist(), strict=True):
        assert b"###" not in raw[a:b] and b"</turn>" not in raw[a:b] and chat.unescape(raw[a:b]).decode() == text


def test_lm_counts_against_a_loop(docs):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    rows = made()
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    toks = [[*SPACE.findall(lower(r[1])), None] for r in rows]
    count = {}
    for t, h in zip(toks, held, strict=True):
        for w in [] if h else t:
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    rest = math.log10(total + len(count) + 1)
    want = order((r[0], h, len(t), sum(w in count for w in t), total, round(sum(math.log10(count.get(w, 0) + 1) - rest for w in t), 6)) for r, h, t in zip(rows, held, toks, strict=True))
    got = lm.score(docs, fold).collect()
    assert order((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def plain_lm(toks, held, words):
    """Each text's log10 probability by loops, at the class level's prior and the word level's first weights."""
    h = lambda w: lm._END if w is None else kernels.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]
    texts = [np.array([h(w) for w in t], np.uint64) for t in toks]
    count, pairs, triples = {}, {}, {}
    cls = lambda x: int(words.classes(np.array([x], np.uint64), words.find(np.array([x], np.uint64)))[0])
    events = []
    for t, out in zip(texts, held, strict=True):
        own, one, two = [], lm._BEGIN, lm._BEGIN
        for x in t:
            own.append((cls(x), int(x), int(one), (int(two), int(one))))
            one, two = x, one
        events.append(own)
        for c, x, short, long in [] if out else own:
            count[x] = count.get(x, 0) + 1
            pairs.setdefault((c, short), {}).setdefault(x, [0, {}])[0] += 1
            of = pairs[c, short][x][1]
            of[long] = of.get(long, 0) + 1
            triples[c, short, long] = triples.get((c, short, long), 0) + 1
    start = lm.begin()

    def weight(c, x, short, long):
        base = count.get(x, 0) + 1
        followers = pairs.get((c, short), {})
        if x not in followers:
            return base
        n1, n2 = followers[x][0], followers[x][1].get(long, 0)
        size1, size2 = sum(f[0] for f in followers.values()), triples.get((c, short, long), 0)
        b1 = sum(n1 >= k for k in (2, 3, 5, 9, 33))
        b2 = 0 if not n2 else 1 + sum(n2 >= k for k in (2, 3, 9))
        value = start[b1] * math.log(n1 * words.mass[c] / (size1 * base)) + start[lm.PAIRS + b1 * lm.TRIPLES + b2]
        if n2:
            value += start[lm.PAIRS + lm.PAIRS * lm.TRIPLES + b2] * math.log(n2 * size1 / (size2 * n1))
        return base * math.exp(max(-20, min(20, value)))

    memory = {}

    def log(c, x, short, long):
        if (c, short, long) not in memory:
            memory[c, short, long] = words.mass[c] + sum(weight(c, y, short, long) - count[y] - 1 for y in pairs.get((c, short), {}))
        g = words.group_of[c]
        return math.log10(words.prior[g] * words.mass[c] / words.group_mass[g] * weight(c, x, short, long) / memory[c, short, long])

    return [sum(log(*e) for e in own) for own in events], log


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_lm_score_against_a_loop(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD", shard)
    monkeypatch.setattr(lm, "TOP", 300)
    seen, own = [], lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: seen.append(own(counts)) or seen[-1])
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = lm.score(docs, fold, rounds=0, updates=0).collect()
    rows = made()
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    toks = [[*SPACE.findall(lower(r[1])), None] for r in rows]
    want, log = plain_lm(toks, held, seen[0])
    assert np.allclose(sorted(r["score"] for r in got), sorted(want), rtol=1e-5)
    if shard == 40:
        assert seen[0].shards > lm.CLASSES and seen[0].rests > lm.RESTS
    # all words and an unknown one of each dealt class, after some word that is known
    known = sorted({w for t, out in zip(toks, held, strict=True) for w in t if not out and w is not None})
    ends = np.cumsum([0, *(len(w.encode()) for w in known)])
    hashes = kernels.word_hashes(np.frombuffer("".join(known).encode(), np.uint8), ends[:-1], ends[1:])
    hashes = np.append(hashes, lm._END)
    one = int(hashes[3])
    long = (int(lm._BEGIN), one)
    total = sum(10 ** log(int(c), int(x), one, long) for x, c in zip(hashes, seen[0].classes(hashes, seen[0].find(hashes)), strict=True))
    total += sum(10 ** log(lm.BANDS + r, -1 - r, one, long) for r in range(seen[0].rests))
    assert total == pytest.approx(1)


def test_lm_does_not_depend_on_tasks(docs):
    fold = F.col("doc_id") % 5 == 2
    one, two = (sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(docs.repartition(n), fold).collect()) for n in (1, 5))
    assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two], rtol=1e-4)


def test_lm_learns_and_beats_unigrams(spark):
    rng = random.Random(12)
    follow = {k: [rng.randrange(300) for _ in range(3)] for k in range(300)}

    def text():
        at, out = rng.randrange(300), []
        for _ in range(80):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    given = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    fold = F.col("doc_id") % 7 == 2
    some, whole = (lm.score(given, fold, rounds=r, updates=u).where("held_out").agg(F.sum("score"), F.sum("base_score")).first() for r, u in ((0, 0), (3, 10)))
    assert whole[0] > some[0] and whole[0] > 0.5 * whole[1]


def test_lm_gradients():
    rng = np.random.default_rng(4)
    word, short, long = rng.integers(0, 9, 400), rng.integers(0, 5, 400).astype(np.uint32), rng.integers(0, 4, 400).astype(np.uint16)
    known = rng.random(400) < 0.8
    weight = np.bincount(word[known], minlength=9) + 1
    grams = lm.Grams(word, weight, float(weight.sum() + 1), short, long, known)
    t = lm.begin() + rng.normal(size=lm.SIZE) * 0.1
    _, got, n = grams.loss(t)
    assert n == known.sum()
    for k in range(lm.SIZE):
        e = np.zeros(lm.SIZE)
        e[k] = 1e-5
        assert (grams.loss(t + e)[0] - grams.loss(t - e)[0]) / 2e-5 == pytest.approx(got[k], abs=1e-3)
    assert grams.loss(grams.learn(60))[0] < grams.loss(lm.begin())[0]
    for turns in (1, 3, 9):
        parts = [p.loss(t) for p in grams.turns(turns)]
        assert sum(p[0] for p in parts) == pytest.approx(grams.loss(t)[0]) and sum(p[2] for p in parts) == n
        assert np.allclose(sum(p[1] for p in parts), got)
    prior = np.full(lm.CLASSES, 1 / lm.CLASSES)
    cells = [rng.integers(0, lm.CELLS, 50) for _ in range(lm.FEATURES)]
    group = rng.integers(0, lm.CLASSES, 50)
    w = rng.normal(size=(lm.FEATURES, lm.CELLS, lm.CLASSES)).astype(np.float32)
    grad, seen = lm.gradient(w, prior, cells, group)
    assert seen.sum() == 50 * lm.FEATURES
    loss = lambda w: -np.log(lm.group_probabilities(w, prior, cells)[np.arange(50), group].astype(float)).sum()
    for k, place, c in ((0, 0, 3), (1, 7, 20), (2, 9, int(group[9]))):
        e = np.zeros_like(w)
        e[k, cells[k][place], c] = 1e-2
        assert (loss(w + e) - loss(w - e)) / 2e-2 == pytest.approx(grad[k, cells[k][place], c], abs=2e-3)
    assert loss(lm.step(w, prior, grad, seen, 0.6)) < loss(w)


def test_lm_frequent_words_count_with_the_one_before(monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(lm, "LONG", 2)
    text = "the a the b the c the d"
    h = next(lm.tokens(pa.array([text])))[2]
    values, counts = np.unique(h, return_counts=True)
    words = lm.Words(values, counts, np.zeros(len(values), np.int64), lm.RESTS, np.ones(lm.BANDS + lm.RESTS), len(h), len(values))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([False])], names=["doc_id", "text", "held"])
    out = next(lm._deal(words, np.zeros((lm.FEATURES, lm.CELLS, lm.CLASSES), np.float32))(iter([batch])))
    short = np.concatenate([np.frombuffer(x, np.uint32) for x in out.column(4).to_pylist() if x is not None])
    # "the" stands four times: what follows it has a context of its own each time; the others' contexts are single words
    assert len(short) == len(h) and len(set(short.tolist())) == len(h)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, ident = [], 0
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((ident, (centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.6])).tolist(), c % 4, "x"))
            ident += 1
    bad = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, []]
    rows += [(ident + k, v, 0, "x") for k, v in enumerate(bad)] + [(ident + 20, rows[0][1], None, "x"), (ident + 21, rows[0][1], 0, "x")]
    return [*rows, rows[1]]


def is_good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_lattice_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "SIDE", 3)
    rows = vectors()
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string"), tables=24, scale=0.3, probes=8).collect()
    u = [np.array(r[1]) / np.linalg.norm(r[1]) if is_good(r[1]) and r[2] is not None else None for r in rows]
    near = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93] for i in range(len(rows))]
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(rows))]
    assert order(map(tuple, got)) == order((r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, near, least, strict=True))


def test_lattice_with_repeated_and_null_ids(spark):
    near = [1.0] * 7 + [1.01]
    rows = [(7, [1.0] * 8, 1), (7, [1.0, -1.0] * 4, 1), (10, near, 1), (None, [5.0] + [0.0] * 7, 1), (None, [5.0] + [0.0] * 7, 1), (None, [1.0] * 8, 2), (3, [2.0] * 8, 2), (4, [1.0] * 8, None), (5, [1.0] * 4, 1), (6, [1.0] * 4, 1)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=24, probes=8).collect()
    want = [(7, 1, 7, True), (7, 0, 7, True), (10, 1, 7, False), (None, 1, None, True), (None, 1, None, True), (None, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert order(map(tuple, got)) == order(want)
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_lattice_cells_of_two_lengths_in_one_block():
    x = [np.array([1.0] * n) for n in (4, 8)]
    cell = np.array([5], np.int32)
    rows = [(5 << 32, 0, 0, 0, 0, True, k, 1, x[k % 2].tobytes(), cell) for k in range(4)]
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f"c{k}" for k in range(10)])
    out = [tuple(r.values()) for b in lattice._compare("<f8", 0.93)(iter([batch])) for r in b.to_pylist()]
    assert sorted((a, b) for a, b, w in out if b is not None) == [(0, 2), (1, 3)]


def test_decode_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    x = lattice.decode(y)
    assert len(lattice.NEIGHBOURS) == 240
    steps = ((y[:, None] - (x[:, None] + lattice.NEIGHBOURS)) ** 2).sum(2)
    assert (((y - x) ** 2).sum(1)[:, None] <= steps + 1e-9).all() and (2 * x % 1 == 0).all()


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[700:720] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000 + k, v) for k, v in enumerate([None, [0.0] * 24, [float("nan")] * 24])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        want = [j for j in np.lexsort((np.arange(1500), -np.round(s, 12))) if j != q][:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(c - s[v]) < 1e-12 for _, v, c in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert hits / 150 >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [700, 701, 702, 703, 704]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_nearest_of_several_lengths_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6 if k % 3 else 9).tolist()) for k in range(160)] + [(1000, [1.0, 2.0])]
    rows += [(300 + k, rows[50][1]) for k in range(8)] + [(100, rows[101][1]), (7, rows[100][1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), rerank=200).collect()
    for q in (0, 50, 100, 150, 300):
        score = {}
        for ident, v in rows:
            for mine in (x for i, x in rows if i == q):
                if ident != q and len(v) == len(mine):
                    c = float(np.dot(v, mine) / (np.linalg.norm(v) * np.linalg.norm(mine)))
                    score[ident] = max(score.get(ident, -2.0), c)
        want = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [v for _, v, _ in own] == [v for v, _ in want] and np.allclose([s for _, _, s in own], [s for _, s in want])
    assert {r["query_id"] for r in got} == {0, 50, 100, 150, 300}


def test_nearest_in_many_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2000))
    for q in range(0, 200, 50):
        x[q + 1 : q + 6] = x[q] + 0.2 * rng.normal(size=(5, 2000))
    got = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), rerank=20).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, q + k) for q in range(0, 200, 50) for k in range(1, 6)}


def test_quality(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice(["the", "house", "stands", "by", "a", "river", "and", "many", "people"]) for _ in range(n)]
    rows, marks = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = " ".join(words(rng.randrange(3, 200)))
        if bad:
            text += " " + " ".join(w + rng.choice(["$$$", "%%%", "!!"]) for w in words(150))
        rows.append((k, text, "x"))
        marks.append((k, 0 if bad else 1))
    rows += [(None, None, "x"), (1000, "", "x"), rows[0]]
    given, labels = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*marks, (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(given.where(~quality.held_out()), labels, rounds=6)
    got = quality.score(given, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == marks[r["doc_id"]][1] for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(given, model)
    assert kept.columns == given.columns and kept.count() == sum(r["predicted"] for r in got)
    none = quality.fit(given, labels.where("false"))
    assert all(r["predicted"] == 1 for r in quality.score(given, none).collect())


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, begin = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9])
    p = {"W": rng.normal(size=(quality.FEATURES, 4)) * 0.1, "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.zeros(1)}
    s, a, *_ = quality._forward(p, x, begin)
    assert s.shape == (3,) and np.allclose(np.add.reduceat(a, begin[:-1]), 1)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    got = quality._gradients(p, x, begin, y, weight)

    def loss():
        s = quality._forward(p, x, begin)[0]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for name, value in p.items():
        flat, grad = value.reshape(-1), np.asarray(got[name]).reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 9)):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            down = loss()
            flat[k] = keep
            assert (up - down) / 2e-5 == pytest.approx(grad[k], abs=1e-7), name


def test_quality_scores_against_a_loop():
    rng = np.random.default_rng(1)
    p = {"W": rng.normal(size=(quality.FEATURES, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1)}
    model = quality.Model(rng.normal(size=quality.FEATURES) * 0.1, rng.random(quality.FEATURES) + 0.5, p)
    texts = ["some words, and 12 MORE! " * n for n in (1, 40, 7)] + [None, "", "$$$"]
    _, _, x, begin = next(quality.passages(pa.array(texts)))
    got = model.score(x, begin)[0]
    for k in range(len(texts)):
        bag = [[math.tanh(sum((v[i] - model.centre[i]) * model.scale[i] * p["W"][i, j] for i in range(len(v))) + p["b"][j]) for j in range(4)] for v in x[begin[k] : begin[k + 1]]]
        gate = [sum(math.tanh(sum(h[i] * p["V"][i, j] for i in range(4))) / (1 + math.exp(-sum(h[i] * p["U"][i, j] for i in range(4)))) * p["w"][j] for j in range(3)) for h in bag]
        total = sum(map(math.exp, gate))
        z = sum(math.exp(g) / total * sum(h[j] * p["c"][j] for j in range(4)) for g, h in zip(gate, bag, strict=True)) + p["d"][0]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_quality_bounds_its_passages(spark, monkeypatch):
    seen = learned(monkeypatch)
    given = spark.createDataFrame([(k, ("word " if k % 2 else "$$ ") * 640) for k in range(20)], "doc_id long, text string")
    quality.fit(given, spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"), most=75, rounds=1)
    assert seen == [(70, 7)]
    assert quality.score(given.where("false"), quality.fit(given.where("false"), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_passages_cover_the_whole_text():
    text = " ".join(["plain"] * 300 + ["$$$"] * 50)
    a, b, x, begin = next(quality.passages(pa.array([text, None, "a"])))
    assert begin.tolist() == [0, 6, 7, 8]
    assert x[5, 6 + quality.MARKS.index(b"$")] > 0.5 and not x[6].any()


def learned(monkeypatch):
    """Passages and documents that each call of quality.fit learns from."""
    seen, own = [], quality._learn

    def learn(x, *rest):
        seen.append((len(x), len(rest[-4])))
        return own(x, *rest)

    monkeypatch.setattr(quality, "_learn", learn)
    return seen


def test_quality_learns_from_all_passages(spark, monkeypatch):
    seen = learned(monkeypatch)
    given = spark.createDataFrame([(1, "plain word " * 3200), (2, "$$ %% " * 3200)], "doc_id long, text string")
    quality.fit(given, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), rounds=1)
    assert seen == [(200, 2)]


def test_quality_samples_labels_that_have_documents(spark, monkeypatch):
    seen = learned(monkeypatch)
    given = spark.createDataFrame([(k, "plain word" if k % 2 else "$$ %%") for k in range(10)], "doc_id long, text string")
    quality.fit(given, spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id long, quality int"), sample=10, rounds=1)
    assert seen == [(10, 10)]
