"""The pipeline's stages on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name != "mix":
            assert docs.count() < before
            before = docs.count()
    words = docs.selectExpr("sum(size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')))").first()[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).selectExpr("sum(used)").first()[0] == words


def test_stages_on_hard_tables(spark):
    """Nulls in any column, blank, long and repeated texts, repeated and null ids, clashing extra columns, empty tables."""
    import random

    rng = random.Random(1)
    long = " ".join(f"word{rng.randrange(50)}" for _ in range(9000))
    text = lambda: " ".join(rng.choice(["the", "house", "stands", "by", "a", "river", "and", "people"]) + str(rng.randrange(9)) for _ in range(rng.randrange(8, 60)))
    rows = [(k, text(), rng.choice(["en", None]), rng.choice(["a", "b", None]), rng.choice([5, None])) for k in range(60)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (100, "", "en", "a", 0), (101, " \n", "en", "a", 2), (102, long, "en", "b", 1), (103, long + " tail", "en", "b", 1), rows[0], rows[0], (0, text(), "en", "a", 1), (None, rows[1][1], "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "id", "mark", "__id", "share_turn", "copies", "KEY", "score", "verdict_id"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for k, name in enumerate(clash):
        docs = docs.selectExpr("*", f"'{k}' AS `{name}`")
    columns = docs.columns
    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        assert stage(spark, before.where("false"), SF).count() == 0, name
        have, kept = plain(before), plain(after)
        if name == "near_duplicates":
            from test_operators import brute_components, shingles

            least = {}
            for (ident, words, _), (_, n, _), group in zip(have, brute_components([(i, t) for i, t, _ in have]), _groups(have), strict=True):
                if n:
                    least.setdefault(group, set()).add((ident is None, ident or 0))
            assert sorted((i is None, i or 0) for i, t, _ in kept if shingles(t)) == sorted(min(x) for x in least.values())
            assert sum(not shingles(t) for _, t, _ in kept) == sum(not shingles(t) for _, t, _ in have)
        else:
            assert {x for x in kept} <= set(have), name
        before = after.cache()
    bins = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert sorted(((i is None, i or 0), s, n) for b in bins for i, s, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True)) == sorted(
        ((i is None, i or 0), s, min(4096, n - s)) for i, t, _ in plain(before) for n in [len((t or "").replace("\n", " ").split(" ")) - (t or "").replace("\n", " ").split(" ").count("")] for s in range(0, max(1, n), 4096)
    )


def _groups(rows):
    """Each row's group of near copies, as a number."""
    from test_operators import shingles

    sets, at = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[root(i)] = root(j)
    return [root(k) for k in range(len(rows))]
