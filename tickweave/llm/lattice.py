"""Embedding near-dedup: random projections decoded to E8 lattice points in several tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from ..store import materialize, partitions_for
from .vectors import packed as _packed
from .vectors import unit

#: Tables, E8 blocks of a table's cell, neighbouring cells probed, and lattice units per unit of distance.
TABLES, BLOCKS, PROBES, SCALE = 10, 2, 4, 0.45
#: Vectors of a bucket that meet in one task: the two sides of a block.
SIDE = 1024
#: Bytes of visits, by the size of the tables read, whose vectors meet in one task.
PARTITION_BYTES = 16 << 20


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all halves with an even number of minus signs."""
    pairs = []
    for (i, j), (a, b) in itertools.product(itertools.combinations(range(8), 2), itertools.product((1, -1), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = a, b
        pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


NEIGHBOURS = _minimal()


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and where the sum is odd move the coordinate that was rounded farthest."""
    x = np.rint(y)
    odd = (x.sum(1) % 2).astype(bool)
    gap = y - x
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(odd)
    x[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
    return x


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer one of D8 and of D8 shifted by halves."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - b) ** 2).sum(1) < ((y - a) ** 2).sum(1)
    a[nearer] = b[nearer]
    return a


def cells(unit: np.ndarray, salt: np.ndarray, tables: int, blocks: int, probes: int, scale: float) -> np.ndarray:
    """Cell keys (rows x tables x (1 + probes)): the home cell of each table first, then the cells that cost least to step to.

    A cell is the lattice points of all its blocks; a step changes the point of one block to a neighbouring one, and
    steps are ranked over all blocks by how little farther the new point is. salt tells apart rows that never link.
    """
    n, d = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([7, d, t])
        y = unit @ rng.normal(size=(d, 8 * blocks)) * scale + rng.uniform(0, 2, 8 * blocks)
        points, gains = [], []
        for b in range(blocks):
            part = y[:, 8 * b : 8 * b + 8]
            points.append(decode(part))
            gains.append((part - points[-1]) @ NEIGHBOURS.T)
        gain = np.concatenate(gains, axis=1)
        steps = np.argpartition(-gain, probes, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
        for p in range(1 + probes):
            h = K.mix64(salt ^ np.uint64(t + 1))
            for b in range(blocks):
                point = points[b]
                if p:
                    step = steps[:, p - 1]
                    own = step // len(NEIGHBOURS) == b
                    point = point + np.where(own[:, None], NEIGHBOURS[step % len(NEIGHBOURS)], 0)
                for c in range(8):
                    h = K.mix64(h * np.uint64(31) + (2 * point[:, c]).astype(np.int64).view(np.uint64))
            out[:, t, p] = h
    return out


def _with_cells(kind: str, tables: int, blocks: int, probes: int, scale: float):
    """Vectors to their cells. Holds one Arrow batch with its cells, and for one table the gains of stepping to 240 neighbours of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, label = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list = [None] * len(vec)
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vec):
                by_size.setdefault(len(v), []).append(k)
            for size, rows in by_size.items():
                x = unit(np.frombuffer(b"".join(vec[k] for k in rows), kind).reshape(len(rows), -1))
                names = pa.array([label[k] for k in rows], pa.string())
                data, offsets = K.utf8(names)
                salt = K.word_hashes(data, offsets[:-1], offsets[1:]) ^ K.mix64(np.array([size], np.uint64))
                for k, c in zip(rows, cells(x, salt, tables, blocks, probes, scale).view(np.int64).reshape(len(rows), -1), strict=True):
                    out[k] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "m", "vec", "cells"])

    return run


def _compare(kind: str, threshold: float):
    """Rows sorted by (cell, bi, bj) to link counts (a = vector, w = links, b null) and spanning edges (a, b, w null).

    Holds one block: at most SIDE vectors, on average, of each side with their cells.
    """

    def by_length(rows: list) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in rows:
            out.setdefault(len(r[3]), []).append(r)
        return out

    def links(cell: int, t: int, same: bool, left: list, right: list) -> tuple[dict[int, int], list[tuple[int, int]]]:
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        # a cell's hash may be that of vectors of two lengths, which never link
        ours, theirs = by_length(left), by_length(right)
        for size in ours.keys() & theirs.keys():
            c, e = links_of(cell, t, same, ours[size], theirs[size])
            for k, w in c.items():
                counts[k] = counts.get(k, 0) + w
            edges += e
        return counts, edges

    def links_of(cell: int, t: int, same: bool, left: list, right: list) -> tuple[dict[int, int], list[tuple[int, int]]]:
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        if not left or not right:
            return counts, edges
        stack = lambda rows, k, type_: np.frombuffer(b"".join(r[k] for r in rows), type_).reshape(len(rows), -1)
        xl, xr = unit(stack(left, 3, kind)), unit(stack(right, 3, kind))
        cl, cr = (np.stack([r[4] for r in rows]).reshape(len(rows), t + 1, -1) for rows in (left, right))
        half = np.int32(cell >> 32)
        ids, m, home = (np.array([r[k] for r in right]) for k in (1, 2, 0))
        got = np.zeros(len(right), np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, row in enumerate(left):
            near = xr @ xl[i] >= threshold
            if not row[0]:
                near &= home
            if same:
                near[: i + 1] = False
            at = np.flatnonzero(near)
            if not len(at):
                continue
            mine, theirs = cl[i][None, :, :1], cr[at][:, :, :1]
            there = (cl[i][None] == theirs).any(2)  # their home is among my cells
            here = (cr[at] == mine).any(2)
            met = there | here
            first = met.argmax(1)
            rows = np.arange(len(at))
            hm, ht = cl[i][first, 0], theirs[rows, first, 0]
            where = np.where(there[rows, first] & here[rows, first], np.minimum(hm, ht), np.where(there[rows, first], ht, hm))
            at = at[(first == t) & (where == half)]  # each pair counts once: in the first table that finds it, in one cell
            if not len(at):
                continue
            counts[row[1]] = counts.get(row[1], 0) + int(m[at].sum())
            got[at] += row[2]
            for other in ids[at].tolist():
                x, y = root(row[1]), root(other)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((row[1], other))
        for k in np.flatnonzero(got):
            counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(got[k])
        return counts, edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            counts, edges = links(at[0], at[3], at[1] == at[2], left, left if at[1] == at[2] else right)
            n = len(counts) + len(edges)
            if n:
                cols = ([*counts, *(a for a, _ in edges)], [None] * len(counts) + [b for _, b in edges], [*counts.values()] + [None] * len(edges))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "w"])

        for batch in batches:
            cell, bi, bj, t, own, home, ident, m, vec = (batch.column(k).to_pylist() for k in range(9))
            lists = batch.column(9)
            for k in range(batch.num_rows):
                here = (cell[k], bi[k], bj[k], t[k])
                if here != at:
                    yield from done()
                    at, left, right = here, [], []
                row = (home[k], ident[k], m[k], vec[k], lists[k].values.to_numpy().copy())
                (left if own[k] == bi[k] else right).append(row)
        yield from done()

    return run


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Near-duplicate vectors of one label by cosine: vec_id, n_links, component_id, kept.

    Vectors of equal label and bytes form a class, which is compared once and counts as often as it has members. Classes
    have numbers of their own; ids only come in when components are named.
    Projections of the unit vector, shifted, are decoded to E8 lattice points; a table's cell is the points of several
    blocks. A vector lives in its home cell and visits the neighbouring cells that are nearest, in each table. Two that
    meet at the home of one of them are compared by exact cosine in double precision, in blocks of bounded size; a pair
    counts in the first table that finds it. Tasks emit link counts and spanning edges, never pairs. At the given
    parameters about one and a half in a thousand pairs at the threshold are missed, closer pairs far less often.

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing and are
    their own component. Vectors of different lengths never link. Null ids take part but name no component: one of null ids
    alone has a null component_id and keeps all its rows. Repeated ids give a row each and may have different vectors. An
    empty table gives no rows. Other columns are ignored.
    """
    plain, kind = _packed(df, id_col, vec_col, label_col)
    rows = materialize(plain)
    fit = rows.where("vec is not null and label is not null")
    classes = fit.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # the numbers are fixed once the table is written
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), small=True)
    table = materialize(classes.select("id", "vec", "label", "m").mapInArrow(_with_cells(kind, tables, blocks, probes, scale), "id long, m long, vec binary, cells array<long>"))
    each = 1 + probes
    visits = table.select("id", F.posexplode("cells").alias("pos", "cell")).select("id", "cell", F.expr(f"pos div {each}").cast("int").alias("t"), (F.col("pos") % each == 0).alias("home"))
    alive = visits.groupBy("cell", "t").agg(F.count("*").alias("c"), F.max("home").alias("h")).where("c > 1 and h").select("cell", "t", F.expr(f"(c + {SIDE} - 1) div {SIDE}").alias("nb"))
    dealt = visits.join(alive, ["cell", "t"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("cell", F.least("own", "x").alias("bi"), F.greatest("own", "x").alias("bj"), "t", "own", "home", "id")
    # whether a pair was found before is told by half of each hash, of the tables up to this one
    told = F.transform(F.slice("cells", F.lit(1), (F.col("t") + 1) * each), lambda c: F.shiftright(c, 32).cast("int"))
    full = dealt.join(table, "id").select("cell", "bi", "bj", "t", "own", "home", "id", "m", "vec", told.alias("cells"))
    full = full.repartition(partitions_for(dealt, PARTITION_BYTES), "cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "t", "id")
    found = materialize(full.mapInArrow(_compare(kind, threshold), "a long, b long, w long"), table)
    linked = components(found.where("b is not null").select("a", "b"))
    count = found.where("w is not null").groupBy("a").agg(F.sum("w").alias("w"))
    named = classes.select("id", "least", "m").join(linked, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    whole = named.join(least, "c").join(count, F.col("id") == F.col("a"), "left").select("id", (F.coalesce("w", F.lit(0)) + F.col("m") - 1).alias("n"), "component_id")
    whole = whole.join(classes.select("id", F.col("label").alias("l"), F.col("vec").alias("v")), "id").select("l", "v", "n", "component_id", F.lit(True).alias("fit"))
    out = rows.join(whole, (rows["vec"] == whole["v"]) & (rows["label"] == whole["l"]), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
