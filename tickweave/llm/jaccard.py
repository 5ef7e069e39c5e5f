"""N-gram Jaccard join by multiple-global-order prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from ..store import materialize, partitions_for, unused

#: Text that becomes rows for the token partitions at a time, and token bytes, by the size estimate of the input, of a partition and of a part of it.
ROUTE_BYTES, TOKEN_PARTITION_BYTES, TOKEN_PART_BYTES = 2 << 20, 64 << 20, 16 << 20
#: Tokens whose frequencies are counted at a time, and lists of tokens that go into one batch.
COUNT_TOKENS, BATCH_TOKENS = 1 << 21, 1 << 19
#: Members and tokens of a side of a block: two sides of a candidate group meet in one task.
BLOCK, BLOCK_TOKENS = 512, 1 << 19
_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))

_ROUTED = "part int, keys binary, counts binary, tokens binary, docs binary"
_TOKENS = "kind int, key long, n long, doc_id long, tokens binary, dfs binary"


def _binary(values: list) -> pa.Array:
    return pa.array([x if x is None else x.tobytes() for x in values], pa.binary())


def _low(tokens: np.ndarray) -> np.ndarray:
    """The low six bytes of each token, which go over the network; the part says most of the rest."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6]


def _whole(raw: pa.Buffer, part: int) -> np.ndarray:
    """Tokens of a part again: the low six bytes and the part's number."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((part & 0xFFFF) << 48)


def _groups(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes come to about ``limit`` together, at least one item each."""
    return K.chunks(np.r_[0, np.cumsum(size, dtype=np.int64)], limit)


def _route(width: int, parts: int):
    """Texts to a row for each token part: the classes' slices of tokens, and documents dealt by class.

    Holds about ROUTE_BYTES of text, or one longer text, with its tokens and some ten arrays of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = K.utf8(batch.column(1))
            for a, b in K.chunks(offsets, ROUTE_BYTES):
                yield routed(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    def routed(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        present = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        sets = list(K.shingle_sets(texts, width))
        n = np.array([len(s) for s in sets], np.int64)
        keys = np.array([K.set_key(s) for s in sets], np.int64)
        distinct, first = np.unique(keys, return_index=True)
        keep = np.zeros(len(sets), bool)
        keep[first] = True
        own = np.flatnonzero(keep & (n > 0))
        tokens = np.concatenate([sets[i] for i in own]) if len(own) else np.empty(0, np.uint64)
        del sets
        row = np.repeat(own.astype(np.int32), n[own])
        # high bits deal tokens out; a stable sort by part keeps rows and each set's order
        part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        tokens, row, part = tokens[order], row[order], part[order]
        del order
        cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])]) if len(part) else np.empty(0, np.int64)
        size = np.diff(np.r_[cut, len(part)])
        slice_part, slice_row = part[cut], row[cut]
        doc_part = ((K.mix64(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        doc_order = np.argsort(doc_part, kind="stable")
        used = np.unique(np.r_[slice_part, doc_part])
        at_slice = np.searchsorted(slice_part, np.r_[used, parts])
        at_token = np.searchsorted(part, np.r_[used, parts])
        at_doc = np.searchsorted(doc_part[doc_order], np.r_[used, parts])
        out: list[list] = [[], [], [], []]
        short = np.uint16 if not len(size) or size.max() < 1 << 16 else np.uint32
        for k in range(len(used)):
            s, t, d = (slice(x[k], x[k + 1]) for x in (at_slice, at_token, at_doc))
            rows, docs = slice_row[s], doc_order[d]
            out[0].append(keys[rows])
            out[1].append(size[s].astype(short))
            out[2].append(_low(tokens[t]))
            out[3].append(np.stack([keys[docs], n[docs], ids[docs].astype(np.int64), present[docs].astype(np.int64)], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(_binary, out)], names=["part", "keys", "counts", "tokens", "docs"])

    return run


def _frequencies(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that occur twice or more, rising, and how often each occurs; COUNT_TOKENS are sorted at a time."""
    pieces = max(1, -(-len(tokens) // COUNT_TOKENS))
    # the low bits are as good a hash as the high ones, which are alike within a part
    piece = (tokens & np.uint64(0xFFFF)) * np.uint64(pieces) >> np.uint64(16) if pieces > 1 else None
    where, times = [], []
    for k in range(pieces):
        own = np.flatnonzero(piece == k) if pieces > 1 else np.arange(len(tokens))
        order = own[np.argsort(tokens[own])]
        ranked = tokens[order]
        edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        runs = np.diff(np.r_[edge, len(ranked)])
        shared = np.repeat(runs > 1, runs)
        where.append(order[shared])
        times.append(np.repeat(runs[runs > 1], runs[runs > 1]).astype(np.int32))
    where, times = np.concatenate(where), np.concatenate(times)
    order = np.argsort(where)
    return where[order], times[order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token part to documents and, for each class, its shared tokens with document frequencies.

    Holds one part at a time: its slices, and sorted arrays of COUNT_TOKENS of its tokens.
    """
    names = ["kind", "key", "n", "doc_id", "tokens", "dfs"]
    at, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal held
        keys, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        _, first = np.unique(keys, return_index=True)  # a class arrives once from every piece of text that has it
        if len(first) < len(keys):
            kept = np.zeros(len(keys), bool)
            kept[first] = True
            tokens = tokens[np.repeat(kept, counts)]
            keys, counts = keys[kept], counts[kept]
        where, df = _frequencies(tokens)
        owner, tokens = np.searchsorted(np.cumsum(counts, dtype=np.int64), where, side="right"), tokens[where]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        stop = np.r_[cut[1:], len(owner)] if len(owner) else cut
        for a, b in _groups(stop - cut + 8, BATCH_TOKENS):
            own, spans = owner[cut[a:b]], list(zip(cut[a:b], stop[a:b], strict=True))
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(keys[own]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), _binary([tokens[x:y] for x, y in spans]), _binary([df[x:y] for x, y in spans])], names=names)

    for batch in batches:
        parts, *rest = (batch.column(k) for k in range(5))
        for k, p in enumerate(parts.to_pylist()):
            if p != at and held:
                yield from done()
            at = p
            keys, counts, tokens, docs = (c[k].as_buffer() for c in rest)
            keys, docs = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64).reshape(-1, 4)
            if len(keys):
                held.append([keys.copy(), np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(keys) else np.uint32).astype(np.int32), _whole(tokens, p)])
            if len(docs):
                m = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array(docs[:, 2], mask=docs[:, 3] == 0), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
    if held:
        yield from done()


def prefix_length(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that any set at the threshold must meet at least once, under any global order."""
    return n - -(-n * percent // 100) + 1


def _assemble(percent: int):
    """Classes' slices to sorted shared tokens and the shared part of the prefix under each of three global orders.

    All three orders put tokens of one class first (they can meet nothing), so only the rest of the prefix is kept:
    by rising document frequency, and by two independent hashes.
    """

    names = ["key", "n", "tokens", "p1", "p2", "p3"]
    longs = pa.list_(pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, longs) for c in cols[2:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            key, n, slices = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for k in range(len(key)):
                own = slices[k].values
                tokens = np.frombuffer(b"".join(own.field("tokens").to_pylist()), np.uint64)
                df = np.frombuffer(b"".join(own.field("dfs").to_pylist()), np.int32)
                room = int(prefix_length(int(n[k]), percent) - (n[k] - len(tokens)))
                if room <= 0:
                    continue
                order = np.argsort(tokens)
                tokens, df = tokens[order], df[order]
                sets = [tokens[np.lexsort((tokens, df))[:room]]] + [tokens[np.argsort(K.mix64(tokens ^ s), kind="stable")[:room]] for s in _SEEDS]
                rows.append((int(key[k]), int(n[k]), tokens.view(np.int64), *(x.view(np.int64) for x in sets)))
                size += len(tokens)
                if size >= BATCH_TOKENS:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def _blocks(percent: int):
    """Rows sorted by (pivot, bi, bj): compare a block's left rows with its right rows; emit a spanning set of its links.

    Holds the token lists of one block, whose sides are bounded by members and by tokens, and some eight arrays of their number.
    """

    def links(left: list, right: list) -> tuple[list, list]:
        a_out, b_out = [], []
        if not left or not right:
            return a_out, b_out
        key_r = np.array([r[0] for r in right])
        n_r = np.array([r[1] for r in right], np.int64)
        sides = []
        for field in (3, 4, 5, 2):
            flat = np.concatenate([r[field] for r in right])
            universe, flat = np.unique(flat, return_inverse=True)
            sides.append((universe, flat, np.r_[0, np.cumsum([len(r[field]) for r in right])]))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def hits(field: int, side: tuple, mine: np.ndarray) -> np.ndarray:
            universe, flat, offsets = side
            flag = np.zeros(len(universe), np.int64)
            at = np.searchsorted(universe, mine)
            at = at[at < len(universe)]
            flag[at[np.isin(universe[at], mine)]] = 1
            total = np.r_[0, np.cumsum(flag[flat])]
            return total[offsets[1:]] - total[offsets[:-1]]

        for row in left:
            n = row[1]
            near = (100 * np.minimum(n, n_r) >= percent * np.maximum(n, n_r)) & (key_r != row[0])
            for side, field in zip(sides[:3], (3, 4, 5), strict=True):
                if near.any():
                    near &= hits(field, side, row[field]) > 0
            if not near.any():
                continue
            both = hits(2, sides[3], row[2])
            for k in np.flatnonzero(near & (100 * both >= percent * (n + n_r - both))):
                x, y = root(row[0]), root(int(key_r[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a_out.append(row[0])
                    b_out.append(int(key_r[k]))
        return a_out, b_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            a, b = links(left, right)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            pivot, bi, bj, is_left, key, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            lists = [batch.column(k) for k in range(6, 10)]
            for k in range(batch.num_rows):
                here = (pivot[k], bi[k], bj[k])
                if here != at:
                    yield from done()
                    at, left, right = here, [], []
                row = (int(key[k]), int(n[k]), *(c[k].values.to_numpy().copy() for c in lists))
                (left if is_left[k] else right).append(row)
        yield from done()

    return run


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents by Jaccard similarity of word shingles: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs outside ASCII white space; a document's set is its distinct shingles of ``width``
    words, or the whole sequence if it is shorter. Two documents link when ``100 * |A & B| >= percent * |A | B|``;
    component_id is the smallest id reachable by links. Sets are compared as 64-bit hashes.

    Documents with equal sets form a class. Every token meets all classes that have it in one token partition, which
    gives exact document frequencies; only classes whose shared tokens reach into their prefix go on. Candidate groups
    hold all classes that share a prefix token, under the least class of that token's list; each group is compared with
    that pivot first, and only members that the pivot does not link meet the others, in blocks of bounded size. A pair
    is verified when it shares prefix tokens under all three global orders. No list or group is capped, and only
    spanning links are emitted, never all pairs of a group.

    Null and blank texts have an empty set: n_shingles 0, component_id their own id. Repeated ids keep their rows; null
    ids take part by text and never name a component unless all its ids are null. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = partitions_for(texts, TOKEN_PARTITION_BYTES)
    routed = texts.mapInArrow(_route(width, tasks * -(-partitions_for(texts, TOKEN_PART_BYTES) // tasks)), _ROUTED)
    table = materialize(routed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_count, _TOKENS))
    members = table.where("kind = 0").select("doc_id", "key", "n")
    classes = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))

    slices = table.where("kind = 1").select("key", F.struct("tokens", "dfs").alias("s"), (F.length("tokens") / 8).cast("long").alias("m"))
    whole = slices.groupBy("key").agg(F.collect_list("s").alias("s"), F.sum("m").alias("m")).join(classes.select("key", "n"), "key")
    # ceil(n * percent / 100) tokens or more must be shared for the prefix to hold a shared token
    whole = whole.where(F.expr(f"n - m < n - (n * {percent} + 99) div 100 + 1")).select("key", "n", "s")
    lists = "tokens array<long>, p1 array<long>, p2 array<long>, p3 array<long>"
    able = materialize(whole.mapInArrow(_assemble(percent), f"key long, n long, {lists}"), small=True)

    posts = able.select("key", "n", F.explode("p1").alias("token"))
    least = F.min(F.struct(F.col("key").alias("pivot"), F.col("n").alias("n0")))
    first = posts.groupBy("token").agg(least.alias("least"), F.count("*").alias("c")).where("c > 1").select("token", "least.*")
    # sizes are known before anything else is sent; then the other prefixes of a pair meet, and whole lists only go to
    # pairs that share tokens under all orders
    group = posts.join(first, "token").where("key <> pivot").select("pivot", "key", "n", "n0").distinct()
    sized = group.withColumn("sized", F.expr(f"100 * least(n, n0) >= {percent} * greatest(n, n0)"))
    # both sides of a pair are the same projection of the table but for names, so that one exchange serves both; lists
    # and pairs are not broadcast while they are few: the plan is one at every size
    side = lambda *names: able.select(*(F.col(c).alias(n) for c, n in names)).hint("merge")
    near = F.expr("arrays_overlap(p2, q2) and arrays_overlap(p3, q3)")
    met = sized.where("sized").join(side(("key", "own"), ("p2", "p2"), ("p3", "p3")), F.col("key") == F.col("own")).join(side(("key", "head"), ("p2", "q2"), ("p3", "q3")), F.col("pivot") == F.col("head"))
    met = met.select("pivot", "key", "n", "n0", near.alias("near"))
    pairs = materialize(met.unionByName(sized.where("not sized").select("pivot", "key", "n", "n0", F.lit(False).alias("near"))), small=True)
    whole = pairs.where("near").join(side(("key", "own"), ("tokens", "tokens")), F.col("key") == F.col("own")).join(side(("key", "head"), ("tokens", "t0")), F.col("pivot") == F.col("head"))
    both = F.size(F.array_intersect("tokens", "t0")).cast("long")
    linked = whole.select("pivot", "key", "n", (F.lit(100) * both >= percent * (F.col("n") + F.col("n0") - both)).alias("linked"))
    star = linked.unionByName(pairs.where("not near").select("pivot", "key", "n", F.lit(False).alias("linked")))
    star = materialize(star, pairs, small=True)
    open_ = F.when(F.col("linked"), 0).otherwise(1)
    sizes = star.groupBy("pivot").agg(F.count("*").alias("g"), F.sum(open_).alias("r"), F.sum("n").alias("tg"), F.sum(F.col("n") * open_).alias("tr")).where("g > 1 and r > 0")
    blocks_of = lambda rows, size: F.expr(f"greatest(({rows} + {BLOCK} - 1) div {BLOCK}, ({size} + {BLOCK_TOKENS} - 1) div {BLOCK_TOKENS})")
    sizes = sizes.select("pivot", blocks_of("g", "tg").alias("bg"), blocks_of("r", "tr").alias("br"))
    open_rows = star.join(sizes, "pivot").select("pivot", "key", "linked", "bg", "br", F.pmod(F.xxhash64("key"), F.col("bg")).alias("own_g"), F.pmod(F.xxhash64("key"), F.col("br")).alias("own_r"))
    right = open_rows.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("br") - 1)).alias("bi"), F.col("own_g").alias("bj"), F.lit(False).alias("left"), "key")
    left = open_rows.where("not linked").select("pivot", F.col("own_r").alias("bi"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bg") - 1)).alias("bj"), F.lit(True).alias("left"), "key")
    blocks = left.unionByName(right).join(able, "key").select("pivot", "bi", "bj", "left", "key", "n", "tokens", "p1", "p2", "p3")
    blocks = blocks.repartition(partitions_for(blocks, TOKEN_PARTITION_BYTES), "pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj", "left")
    found = blocks.mapInArrow(_blocks(percent), "a long, b long")
    edges = star.where("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b")).unionByName(found)

    linked = components(edges)
    named = linked.join(classes.drop("n"), F.col("node") == F.col("key")).select("key", "component", "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = named.join(least, "component").select("key", "component_id")
    # written, so that both sides of the last join are plain exchanges, which AQE splits where one class has very many members
    label = materialize(classes.join(joined, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")), small=True)
    return members.join(label, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The first row, by id, of each component of docs, with all its columns.

    Rows are told apart by id and text, texts by 64-bit hashes. A component's first row has its least id, null ids last,
    and of several texts with that id the one with the least hash; all other rows of the component go, whatever their id.
    Of rows that repeat both id and text one stays; texts without words all stay. Columns may have any names; an empty
    table stays empty.
    """
    own_id, own_mark = unused(docs.columns, "id", "mark")
    marked = docs.select("*", F.col(id_col).cast("long").alias(own_id), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(own_mark))
    rows = materialize(marked.select(F.col(own_id).alias("id"), F.col(own_mark).alias("mark")).groupBy("id", "mark").agg(F.count("*").alias("times")), small=True)
    texts = marked.select(F.col(own_mark).alias("mark"), F.col(text_col).alias("text"))
    classes = jaccard_classes(texts, id_col="mark", text_col="text", width=width, percent=percent).where("n_shingles > 0")
    component = materialize(classes.groupBy("doc_id").agg(F.min("component_id").alias("component")).withColumnRenamed("doc_id", "mark"), small=True)
    # written, so that both sides are plain exchanges, which AQE splits where one text has very many ids
    placed = materialize(rows.join(component, "mark"), rows, component, small=True)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    first = placed.groupBy("component").agg(F.min(order).alias("f")).select(F.col("f.id").alias("first_id"), F.col("f.mark").alias("first_mark"))
    met = placed.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")), "left")
    verdict = materialize(met.select("id", "mark", "times", F.col("first_mark").isNull().alias("gone")), placed, small=True)
    names = unused(marked.columns, "verdict_id", "verdict_mark")
    renamed = lambda which: verdict.where(which).select(F.col("id").alias(names[0]), F.col("mark").alias(names[1]))
    same = F.col(own_id).eqNullSafe(F.col(names[0])) & (F.col(own_mark) == F.col(names[1]))
    left = marked.join(renamed("gone"), same, "left_anti").join(renamed("not gone and times > 1"), same, "left")
    once = left.where(F.col(names[1]).isNotNull()).dropDuplicates([own_id, own_mark])
    return left.where(F.col(names[1]).isNull()).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
