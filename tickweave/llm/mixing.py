"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from ..store import materialize, unused

#: Places of the random offset, orders of the groups to try them in, and the share of a target within which draws count as equally near it.
OFFSETS, ORDERS, NEAR = 1024, 8, 0.001
#: Rows that are ranked together at most, on average; a source is dealt to at least SALTS groups.
RANKED, SALTS = 1 << 20, 64


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their numbers of words, about 4 MB of text at a time."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(K.word_counts(batch.column(3)))], names=["doc_id", "mark", "source", "size"])


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), source, size and the group in the sampling order, which is one of hashes."""
    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    sized = materialize(plain.mapInArrow(_sizes, "doc_id long, mark long, source string, size long"))
    salts = max(SALTS, -(-sized.count() // RANKED))
    return sized.select("*", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int").alias("salt"))


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weighted shares of all sizes, none above ``most`` times its source's.

    Sources take the weights in turn, by code point, null last. A source whose share exceeds its limit stops there and the
    excess is reshared by weight until none is above: the common rate is the one at which the sources stopped so far,
    those with the least limit for their weight, leave exactly the rest to the others. One row for each source is sorted
    here, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    least = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = least.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rate = weighted.withColumn("rate", rest / left).withColumn("place", F.row_number().over(least))
    open_ = most * F.col("source_size") > F.col("rate") * F.col("w")
    rate = rate.withColumn("first", F.min(F.when(open_, F.struct("place", "rate"))).over(whole).getField("rate"))
    limit = (most * F.col("source_size")).cast("double")
    return rate.select("source", "source_size", F.when(F.col("first").isNull(), limit).otherwise(F.least(limit, F.col("first") * F.col("w"))).alias("target"))


def _draws(ranked: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """(source, turn, offset): each source's order of groups and random offset, drawn by the seed from those that bring its words nearest to the target.

    A document's copies are one more than the whole part of its rate while the offset lies in one arc of the circle. So
    the words taken at all offsets are the running sums of two steps for each document; a source has at most a row for
    each order and place of the grid, and few where it has few documents.
    """
    share = F.col("rate") - F.floor("rate")
    begin = F.pmod(1 - share - F.pmod((F.col("start") + F.col("rank") - 1) * F.col("rate"), F.lit(1.0)), F.lit(1.0))
    first, last = F.ceil(begin * OFFSETS).cast("int"), F.ceil((begin + share) * OFFSETS).cast("int")
    # an arc beyond the circle's end goes on at its start
    step = lambda at, sign: F.struct(at.alias("at"), (F.lit(sign) * F.col("size")).alias("step"))
    wraps = F.when(last > OFFSETS, F.array(step(F.lit(0), 1), step(last - OFFSETS, -1))).otherwise(F.array().cast("array<struct<at:int,step:bigint>>"))
    tried = ranked.where("size > 0").select("source", "size", "rate", "rank", F.posexplode("starts").alias("turn", "start"))
    steps = tried.select("source", "turn", F.explode(F.concat(F.array(step(first, 1), step(last, -1)), wraps)).alias("s")).select("source", "turn", "s.at", "s.step")
    # between two steps the words stay the same, so the places of steps, and the first one, are all that differ
    begins = goal.select("source", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("turn"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("step"))
    steps = steps.where(F.col("at") < OFFSETS).unionByName(begins).groupBy("source", "turn", "at").agg(F.sum("step").alias("step"))
    met = steps.withColumnRenamed("source", "s").join(goal, F.col("source").eqNullSafe(F.col("s")))
    upto = Window.partitionBy("source", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.floor("rate") * F.col("source_size") + F.sum("step").over(upto)
    miss = F.abs(taken - F.col("target")) / F.greatest("target", F.lit(1.0))
    drawn = F.struct(F.greatest(miss, F.lit(NEAR)).alias("miss"), F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), "turn", "at").alias("draw"), "turn", "at")
    best = met.select("source", drawn.alias("drawn")).groupBy("source").agg(F.min("drawn").alias("drawn"))
    return best.select("source", "drawn.turn", (F.col("drawn.at") / F.lit(float(OFFSETS))).alias("offset"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """How often each document enters the mix: doc_id, mark, source, size, source_size, target, copies, taken.

    Size is the number of words (ASCII white space apart; null: 0). Each document of a source expects the same number of
    copies, target / source_size. They are summed in one order, by size class and hash, so the sample is stratified;
    a document's copies are the integer boundaries that the running sum, started at one random offset of the source,
    crosses at it. The offset is drawn, by the seed and the source's name, from those that bring the words taken nearest
    to the target: reruns agree, and large documents do not carry a source far off.

    The running sum is a document's rank in its (source, size class, salt) group after the count of all groups before
    it; the number of groups grows with the rows, and no group holds a whole hot source. mark is a hash of the text; rows
    that repeat id, text and source are interchangeable. Sources without words have target 0 and give no copies. An empty
    table gives an empty result. Other columns are ignored.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    groups = materialize(sized.groupBy("source", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words")), small=True)
    goal = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = materialize(goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), small=True)
    tried = groups.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    running = Window.partitionBy("source", "turn").orderBy(F.xxhash64(F.lit(seed), "turn", "salt"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    places = tried.select("source", "salt", "turn", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("start"))
    places = places.groupBy("source", "salt").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "start"))), lambda x: x["start"]).alias("starts"))
    plan = places.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("salt").alias("t"), "starts", "source_size", "target", "rate")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("source", "salt").orderBy(F.xxhash64(F.lit(seed), "mark", "doc_id"), "doc_id", "mark")))
    both = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t")))
    ranked = materialize(both.select("doc_id", "mark", "source", "size", "source_size", "target", "rate", "rank", "starts"), small=True)
    draws = _draws(ranked, goal, seed).withColumnRenamed("source", "s")
    placed = ranked.join(draws, F.col("source").eqNullSafe(F.col("s"))).withColumn("place", F.element_at("starts", F.col("turn") + 1) + F.col("rank"))
    upto = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    copies = F.least(F.lit(most), upto(F.col("place")) - upto(F.col("place") - 1)).cast("long")
    sampled = placed.withColumn("copies", copies)
    return sampled.select("doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as mix() says, with all their columns. Options as in mix().

    Rows that repeat id, text and source share the copies that they get together as evenly as whole copies allow.
    Columns may have any names.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    keys = ["doc_id", "mark", "source"]
    share = mix(docs, **options).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("times")).where("copies > 0")
    names = unused(docs.columns, "share_id", "share_mark", "share_source", "share_copies", "share_times", "share_turn", "share_each")
    i, m, s, copies, times, turn, each = names
    share = share.toDF(*names[:5])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (_mark(text_col) == F.col(m)) & F.col(source_col).cast("string").eqNullSafe(F.col(s))
    joined = docs.join(share, same)
    alone = joined.where(F.col(times) == 1).withColumn(each, F.col(copies))
    many = joined.where(F.col(times) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(i, m, s).orderBy(F.lit(0))))
    many = many.withColumn(each, F.expr(f"({copies} * {turn}) div {times} - ({copies} * ({turn} - 1)) div {times}")).drop(turn)
    out = alone.unionByName(many).where(F.col(each) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(each))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
