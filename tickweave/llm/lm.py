"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax over exact counts of the corpus.

The probability of a word is that of its class in its context times that of the word in its class and context. The first
is a softmax over 32 classes with hashed n-gram and skip features, whose weights every task gets. The second is a softmax
over the words of the class: a word weighs its count in the corpus, raised by features of how often it followed this very
context. Those features rest on exact counts of word pairs and triples, which grow with the corpus and stay distributed:
all events of a class, or of a class and a part of the contexts, meet in one shard, which learns its weights and scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from ..store import discard, materialize

#: Frequent words that every task is told, and the classes: bands of their ranks, and groups that the other words are dealt to.
TOP, BANDS, RESTS = 65_535, 16, 16
CLASSES = BANDS + RESTS
#: Hashed cells of a class-level feature, training rounds, tokens of a step, bytes and rows of text in a block.
CELLS, ROUNDS, STEP, BLOCK_BYTES, BLOCK_ROWS = 4096, 3, 32_768, 4 << 20, 1 << 15
#: Features of a class: previous word, previous two words, the word before the previous.
FEATURES = 3
#: Events of a shard, on average at most, and the count from which a previous word only counts with the word before it.
SHARD, LONG = 1 << 19, 1 << 22
#: Gradient updates of a shard's weights, parts of its contexts that take turns in them, and shards that one task has, on average.
UPDATES, TURNS, SHARDS_A_TASK = 16, 8, 16
_END = np.uint64(0x2545F4914F6CDD1D)
_BEGIN = np.uint64(0x9FB21C651E98DF25)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, end row, token hashes with an end after each row's words, where each row's tokens begin."""
    data, offsets = K.utf8(column)
    for first_row, end_row in K.chunks(offsets, BLOCK_BYTES):
        for a in range(first_row, end_row, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, end_row)
            words, at = [], []
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            for x, y in K.chunks(off):
                piece = K.LOWER[part[off[x] : off[y]]]
                starts, ends, first = K.word_spans(piece, off[x : y + 1] - off[x])
                words.append(K.word_hashes(piece, starts, ends))
                at.append(np.diff(first))
            size = np.concatenate(at)
            stop = np.cumsum(size + 1)
            out = np.empty(int(stop[-1]), np.uint64)
            is_end = np.zeros(len(out), bool)
            is_end[stop - 1] = True
            out[~is_end], out[is_end] = np.concatenate(words), _END
            yield a, b, out, np.r_[0, stop]


def _shifted(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each one, a fixed hash before a text's first."""
    out = np.empty_like(h)
    out[0], out[1:] = _BEGIN, h[:-1]
    out[first[:-1]] = _BEGIN
    return out


@dataclass
class Words:
    """What every task knows of the vocabulary: the frequent words, sorted by hash, with count and band; the classes' masses.

    A class's mass is the sum of its words' counts, each with one more; dealt classes have one unknown word besides.
    Dealt class r belongs to group BANDS + r * RESTS // rests. Shards: each band has some, by context; each dealt class one.
    """

    hashes: np.ndarray
    counts: np.ndarray
    bands: np.ndarray
    rests: int
    mass: np.ndarray  # bands, then dealt classes
    total: int
    distinct: int

    def __post_init__(self) -> None:
        tokens = np.bincount(self.bands, weights=self.counts, minlength=BANDS)
        self.splits = np.maximum(1, -(-tokens // SHARD)).astype(np.int64)
        self.base = np.r_[0, np.cumsum(self.splits)]
        self.group_of = np.r_[np.arange(BANDS), BANDS + np.arange(self.rests) * RESTS // self.rests]
        self.group_mass = np.bincount(self.group_of, weights=self.mass, minlength=CLASSES)
        self.prior = np.maximum(self.group_mass, 1e-9) / max(1e-9, self.group_mass.sum())

    @property
    def shards(self) -> int:
        return int(self.base[-1]) + self.rests

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of tokens among the frequent words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def classes(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class of each token: its band, or BANDS and the dealt class."""
        dealt = ((h >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % self.rests
        return np.where(at >= 0, self.bands[at] if len(self.bands) else 0, BANDS + dealt)


def vocabulary(counts: DataFrame) -> Words:
    """Words of the corpus from its counts (h, c).

    Frequent words are those of the highest counts, in steps of a sixteenth of an octave, that are TOP together at most.
    The driver gets them, one row for each step, and one for each dealt class: their number is that of the remaining
    tokens divided by SHARD.
    """
    step = F.floor(F.log2("c") * 16)
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).collect(), reverse=True)
    total, distinct = sum(r["t"] for r in steps), sum(r["n"] for r in steps)
    room, least = TOP, math.inf
    for r in steps:
        room -= r["n"]
        if room < 0:
            break
        least = r["s"]
    top = sorted(counts.where(step >= F.lit(least)).collect(), key=lambda r: (-r["c"], r["h"]))
    hashes, c = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    bands = np.floor(np.log2(np.arange(len(top)) + 1.0)).astype(np.int64)
    order = np.argsort(hashes)
    hashes, c, bands = hashes[order], c[order], bands[order]
    rests = RESTS * max(1, -(-(total - int(c.sum())) // (RESTS * SHARD)))
    dealt = F.expr(f"(shiftrightunsigned(h, 20) & 2147483647) % {rests}")
    mass = np.ones(BANDS + rests)
    mass[:BANDS] = np.bincount(bands, weights=c + 1, minlength=BANDS)
    for r in counts.groupBy(dealt.alias("r")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[BANDS + r["r"]] += r["m"]
    taken = ((hashes >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % rests
    mass[BANDS:] -= np.bincount(taken, weights=c + 1, minlength=rests)
    return Words(hashes, c, bands, rests, mass, int(total), int(distinct))


# Class level: hashed features, a softmax over the groups of classes.


def contexts(h: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cells of the class-level features; the previous word and a hash of the previous two."""
    one = _shifted(h, first)
    two = _shifted(one, first)
    both = K.mix64(one * _SALT ^ two)
    cell = lambda x: (x >> np.uint64(40)).astype(np.int64) % CELLS
    return [cell(one), cell(both), cell(K.mix64(two + _SALT))], one, both


def group_probabilities(w: np.ndarray, prior: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    """Softmax over the groups for each token: w is features x cells x groups."""
    z = np.log(prior).astype(np.float32) + sum(w[k][c] for k, c in enumerate(cells))
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def gradient(w: np.ndarray, prior: np.ndarray, cells: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log loss by the weights, and how often each cell occurs."""
    grad, seen = np.zeros((FEATURES, CELLS, CLASSES)), np.zeros((FEATURES, CELLS))
    for a in range(0, len(group), STEP):
        own = [c[a : a + STEP] for c in cells]
        p = group_probabilities(w, prior, own)
        p[np.arange(len(p)), group[a : a + STEP]] -= 1
        for k, c in enumerate(own):
            grad[k] += np.bincount((c[:, None] * CLASSES + np.arange(CLASSES)).ravel(), weights=p.ravel(), minlength=CELLS * CLASSES).reshape(CELLS, CLASSES)
            seen[k] += np.bincount(c, minlength=CELLS)
    return grad, seen


def step(w: np.ndarray, prior: np.ndarray, grad: np.ndarray, seen: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one update: each gradient by how often its cell and group would meet if they were independent."""
    return (w - np.clip(rate * grad / (seen[:, :, None] * prior + 5), -1.5, 1.5)).astype(np.float32)


PIECES, DEAL = 48, 32


def _gradients(w: np.ndarray, words: Words):
    """One task's gradient over its own documents, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grad = np.zeros((FEATURES, CELLS, CLASSES + 1))
        used = False
        for batch in batches:
            for _, _, h, first in tokens(batch.column(0)):
                g, n = gradient(w, words.prior, contexts(h, first)[0], words.group_of[words.classes(h, words.find(h))])
                grad[..., :CLASSES] += g
                grad[..., CLASSES] += n
                used = True
        if used:
            part = TaskContext.get().partitionId()
            pieces = [p.astype(np.float32).tobytes() for p in np.array_split(grad.ravel(), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "part", "sums"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by piece and part to one row for each piece."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, sums in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            d = np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
            total[piece] = total[piece] + d if piece in total else d
    for piece, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([0], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["piece", "part", "sums"])


def train(texts: DataFrame, words: Words, rounds: int = ROUNDS, rate: float = 0.6) -> np.ndarray:
    """Class-level weights learned from all rows of texts (text, deal): each round takes one update by the whole gradient of the rows dealt to it.

    Tasks' gradients are summed on executors, piece by piece, first in DEAL parts, then whole; the driver gets one
    gradient a round. The result does not depend on how rows are dealt to tasks, but for the rounding of sums.
    """
    w = np.zeros((FEATURES, CELLS, CLASSES), np.float32)
    schema = "piece int, part int, sums binary"
    for turn in range(rounds):
        own = texts.where(F.pmod(F.col("deal"), F.lit(rounds)) == turn).select("text")
        sums = own.mapInArrow(_gradients(w, words), schema).withColumn("deal", F.pmod("part", F.lit(DEAL)))
        sums = sums.repartition(PIECES, "piece", "deal").sortWithinPartitions("piece", "part").mapInArrow(_sum, schema)
        whole = sums.repartition(PIECES, "piece").sortWithinPartitions("piece", "part").mapInArrow(_sum, schema).collect()
        if whole:
            flat = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(whole, key=lambda r: r["piece"])]).reshape(FEATURES, CELLS, CLASSES + 1)
            w = step(w, words.prior, flat[..., :CLASSES].astype(np.float64), flat[..., CLASSES].astype(np.float64), rate / (1 + 0.2 * turn))
    return w


# Word level: a softmax over the words of a class, by counts of pairs and triples.

#: Kinds of a pair's count (1, 2, up to 4, 8, 32, more) and of a triple's (none, 1, 2, up to 8, more), and the weights they have.
PAIRS, TRIPLES = 6, 5
SIZE = PAIRS + PAIRS * TRIPLES + TRIPLES


def _pair_kind(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([2, 3, 5, 9, 33], n, side="right")


def _triple_kind(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 0, 0, 1 + np.searchsorted([2, 3, 9], n, side="right"))


def begin() -> np.ndarray:
    """Weights to start from: a pair's lift counts for most, and the more the pair occurred the more it is trusted."""
    out = np.zeros(SIZE)
    out[:PAIRS] = 0.9
    out[PAIRS:-TRIPLES] = np.repeat(np.linspace(-1.5, 0.5, PAIRS), TRIPLES)
    out[1 - TRIPLES :] = 0.8
    return out


Features = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _weight(t: np.ndarray, f: Features) -> np.ndarray:
    """What the features (pair kind, pair lift, triple kind, triple lift) add to a word's log weight."""
    b1, x1, b2, x2 = f
    return np.clip(t[b1] * x1 + t[PAIRS + b1 * TRIPLES + b2] + t[PAIRS + PAIRS * TRIPLES + b2] * x2, -20, 20)


def _fold(out: np.ndarray, times: np.ndarray, f: Features) -> None:
    """Add the features, each so many times, to a gradient."""
    b1, x1, b2, x2 = f
    out[:PAIRS] += np.bincount(b1, weights=times * x1, minlength=PAIRS)
    out[PAIRS:-TRIPLES] += np.bincount(b1 * TRIPLES + b2, weights=times, minlength=PAIRS * TRIPLES)
    out[-TRIPLES:] += np.bincount(b2, weights=times * x2, minlength=TRIPLES)


class Grams:
    """Events of one class by pairs (context, word) and triples (context, longer context, word), with what they weigh.

    word numbers the words, weight is each word's count and one, mass their sum over the class; short and long are hashes
    of the contexts; known marks events that count. A word's weight in a context is its own, raised by the features of a
    pair and a triple that occurred; the sum over the class is its mass and what the context's followers add.
    """

    def __init__(self, word: np.ndarray, weight: np.ndarray, mass: float, short: np.ndarray, long: np.ndarray, known: np.ndarray) -> None:
        pairs, pair = np.unique(short.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
        self.n1 = np.bincount(pair[known], minlength=len(pairs))
        self.weight = weight[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)].astype(np.float64)
        self.g1 = np.unique(pairs >> np.uint64(32), return_inverse=True)[1]
        triples, self.event = np.unique(pair.astype(np.uint64) << np.uint64(16) | long.astype(np.uint64), return_inverse=True)
        self.n2 = np.bincount(self.event[known], minlength=len(triples))
        self.pair = (triples >> np.uint64(16)).astype(np.int64)
        groups, self.g2 = np.unique(self.g1[self.pair].astype(np.uint64) << np.uint64(16) | triples & np.uint64(0xFFFF), return_inverse=True)
        self.up = (groups >> np.uint64(16)).astype(np.int64)
        self.size1, self.size2 = (np.bincount(g, weights=n, minlength=m) for g, n, m in ((self.g1, self.n1, self.up[-1] + 1 if len(self.up) else 0), (self.g2, self.n2, len(groups))))
        self.mass = mass
        self.follows, self.seen = self.n1 > 0, self.n2 > 0
        self.place = np.cumsum(self.follows) - 1
        f, t = self.follows, self.seen
        p, g = self.pair[t], self.g2[t]
        self.of_pairs = self._features(self.n1[f], self.size1[self.g1[f]], np.zeros(int(f.sum()), np.int64), 1.0, self.weight[f])
        self.of_triples = self._features(self.n1[p], self.size1[self.g1[p]], self.n2[t], self.size2[g], self.weight[p])
        # as an event sees its triple when it is left out itself
        self.left_out = self._features(self.n1[p] - 1, self.size1[self.g1[p]] - 1, self.n2[t] - 1, self.size2[g] - 1, self.weight[p])
        self.still = self.n1[p] > 1

    def _features(self, n1, size1, n2, size2, weight) -> Features:
        n, s = np.maximum(n1, 1), np.maximum(size1, 1)
        lift = np.log(n * self.mass / (s * weight))
        more = np.where(n2 > 0, np.log(np.maximum(n2, 1) * s / (np.maximum(size2, 1) * n)), 0.0)
        return _pair_kind(n), lift, _triple_kind(n2), more

    def _sums(self, t: np.ndarray) -> tuple:
        """Weights of followers by pair and by triple, the triples' weights by their pair alone, and each longer context's sum."""
        alone = self.weight[self.follows] * np.exp(_weight(t, self.of_pairs))
        whole = self.mass + np.bincount(self.g1[self.follows], weights=alone - self.weight[self.follows], minlength=len(self.size1))
        p = self.pair[self.seen]
        raised = self.weight[p] * np.exp(_weight(t, self.of_triples))
        before = alone[self.place[p]]
        return alone, raised, before, whole[self.up] + np.bincount(self.g2[self.seen], weights=raised - before, minlength=len(self.up))

    def loss(self, t: np.ndarray) -> tuple[float, np.ndarray, int]:
        """Log loss of the known events, each left out of the counts that predict it; its gradient; their number."""
        alone, raised, before, z = self._sums(t)
        g, p, n = self.g2[self.seen], self.pair[self.seen], self.n2[self.seen].astype(np.float64)
        own = np.where(self.still, _weight(t, self.left_out), 0.0)
        weight = self.weight[p] * np.exp(own)
        rest = np.maximum(z[g] - raised + weight, 1e-9)
        out = np.zeros(SIZE)
        _fold(out, n * self.still * (weight / rest - 1), self.left_out)
        _fold(out, -n * raised / rest, self.of_triples)
        share = np.bincount(g, weights=n / rest, minlength=len(self.up))
        _fold(out, np.bincount(self.up, weights=share, minlength=len(self.size1))[self.g1[self.follows]] * alone, self.of_pairs)
        _fold(out, share[g] * raised, self.of_triples)
        q = self.place[p]
        _fold(out, -share[g] * before, tuple(x[q] for x in self.of_pairs))
        return float((n * (np.log(rest) - np.log(weight))).sum()), out, int(n.sum())

    def turns(self, parts: int) -> list[Grams]:
        """The events in so many parts, of whole contexts: everything is sorted by context, so a part is a slice."""
        ends = np.searchsorted(self.g1[self.pair], np.arange(len(self.size1) + 1))
        cut = np.searchsorted(ends, np.linspace(0, len(self.pair), parts + 1)[1:-1])
        out = []
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(self.size1)], strict=True):
            part = object.__new__(Grams)
            p0, p1 = np.searchsorted(self.g1, (a, b))
            t0, t1 = ends[a], ends[b]
            u0, u1 = np.searchsorted(self.up, (a, b))
            part.n1, part.weight, part.g1, part.follows = self.n1[p0:p1], self.weight[p0:p1], self.g1[p0:p1] - a, self.follows[p0:p1]
            part.n2, part.pair, part.g2, part.seen = self.n2[t0:t1], self.pair[t0:t1] - p0, self.g2[t0:t1] - u0, self.seen[t0:t1]
            part.up, part.size1, part.size2, part.mass = self.up[u0:u1] - a, self.size1[a:b], self.size2[u0:u1], self.mass
            part.place = np.cumsum(part.follows) - 1
            f0, s0 = int(self.follows[:p0].sum()), int(self.seen[:t0].sum())
            f1, s1 = f0 + int(part.follows.sum()), s0 + int(part.seen.sum())
            part.of_pairs = tuple(x[f0:f1] for x in self.of_pairs)
            part.of_triples, part.left_out = (tuple(x[s0:s1] for x in f) for f in (self.of_triples, self.left_out))
            part.still = self.still[s0:s1]
            out.append(part)
        return out

    def learn(self, updates: int = UPDATES, rate: float = 0.15, turns: int = TURNS) -> np.ndarray:
        """Weights after so many updates, each by the gradient over one part of the contexts, and each weight at its own pace (Adam)."""
        t, first, second = begin(), np.zeros(SIZE), np.zeros(SIZE)
        parts = self.turns(turns) if updates else []
        for k in range(1, updates + 1):
            _, g, n = parts[k % turns].loss(t)
            g /= max(1, n)
            first, second = 0.8 * first + 0.2 * g, 0.9 * second + 0.1 * g * g
            t = t - rate * (first / (1 - 0.8**k)) / (np.sqrt(second / (1 - 0.9**k)) + 1e-6)
        return t

    def log10(self, t: np.ndarray) -> np.ndarray:
        """log10 probability of each event's word in its class and context."""
        *_, z = self._sums(t)
        more = np.zeros(len(self.pair))
        followed = self.follows[self.pair]
        more[followed] = _weight(t, self.of_pairs)[self.place[self.pair[followed]]]
        more[self.seen] = _weight(t, self.of_triples)
        return ((np.log(self.weight[self.pair]) + more - np.log(z[self.g2])) / math.log(10))[self.event]


# The plan: count words, learn class weights, deal events to shards, score them there, add up by document.


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, h, _ in tokens(batch.column(0)):
            values, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


_EVENTS = "shard int, block long, words binary, times binary, short binary, long binary, docs binary, rows binary"
_NAMES = [x.split()[0] for x in _EVENTS.split(", ")]


def _deal(words: Words, w: np.ndarray):
    """Blocks of documents to their events for each shard, by word, and one row of the documents with what the class level says.

    An event is its word (once for all of a word's events), the contexts' hashes and its row, with a high bit if held out.
    Holds the tokens of one block, BLOCK_BYTES of text or one longer text, and some fifteen arrays of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            present, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, h, first in tokens(batch.column(1)):
                yield dealt(block, ids[a:b], present[a:b], held[a:b], h, first)
                block += 1

    def dealt(block: int, ids: np.ndarray, present: np.ndarray, held: np.ndarray, h: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        cells, one, both = contexts(h, first)
        at = words.find(h)
        which = words.classes(h, at)
        group = words.group_of[which]
        log = np.empty(len(h))
        for x in range(0, len(h), STEP):
            p = group_probabilities(w, words.prior, [c[x : x + STEP] for c in cells])
            log[x : x + STEP] = np.log10(np.maximum(p[np.arange(len(p)), group[x : x + STEP]], 1e-30))
        del cells
        size = np.diff(first)
        rows = np.stack([ids, present.astype(np.int64), held.astype(np.int64), size, np.add.reduceat(log, first[:-1]).view(np.int64)], axis=1)
        # a very frequent previous word only counts with the one before it, and so on for the longer context
        frequent = np.zeros(len(h), bool)
        if len(words.hashes):
            before = np.r_[-1, at[:-1]]
            before[first[:-1]] = -1
            frequent = (before >= 0) & (words.counts[before] > LONG)
        three = K.mix64(both * _SALT ^ _shifted(_shifted(one, first), first))
        short = (K.mix64(np.where(frequent, both, one)) >> np.uint64(32)).astype(np.uint32)
        long = (np.where(frequent, three, both) >> np.uint64(48)).astype(np.uint16)
        band = np.minimum(which, BANDS - 1)
        shard = np.where(which < BANDS, words.base[band] + short % words.splits[band], words.base[-1] + which - BANDS)
        row = np.repeat(np.arange(len(size), dtype=np.uint16) | (held.astype(np.uint16) << np.uint16(15)), size)
        order = np.lexsort((h, shard))
        h, shard, short, long, row = h[order], shard[order], short[order], long[order], row[order]
        fresh = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])])
        times = np.diff(np.r_[fresh, len(h)]).astype(np.uint32)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        ends = np.r_[cut[1:], len(h)]
        of_word, word = np.searchsorted(fresh, np.r_[cut, len(h)]), h[fresh]
        own = shard[cut]
        spans = list(zip(cut, ends, strict=True))
        pieces = lambda x, s: pa.array([x[i:j].tobytes() for i, j in s] + [None], pa.binary())
        by_word = list(zip(of_word[:-1], of_word[1:], strict=True))
        cols = [pieces(word, by_word), pieces(times, by_word), pieces(short, spans), pieces(long, spans), pieces(row, spans)]
        docs = pa.array([None] * len(own) + [rows.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.r_[own, block % words.shards], pa.int32()), pa.array(np.full(len(own) + 1, block)), *cols, docs], names=_NAMES)

    return run


_SUMS = "block long, docs binary, known binary, base binary, model binary, rows binary"


def _score_shards(words: Words, updates: int):
    """Rows sorted by shard to sums for each block's documents: tokens with a count, log10 of count and one, log10 by the model.

    Holds the events of one shard, of which there are SHARD on average, with some thirty arrays of their number, and
    sums of up to a million documents.
    """
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def scored(shard: int, held: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        parts = [[np.frombuffer(x, t) for x, t in zip(r[1:], (np.uint64, np.uint32, np.uint32, np.uint16, np.uint16), strict=True)] for r in held]
        distinct, word = np.unique(np.concatenate([np.repeat(p[0], p[1]) for p in parts]), return_inverse=True)
        short, long, row = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        known = row < 1 << 15
        which = int(np.searchsorted(words.base, shard, side="right")) - 1 if shard < words.base[-1] else BANDS + shard - int(words.base[-1])
        # a dealt class has all its events here, a band only some; the counts of its words are known everywhere
        count = words.counts[words.find(distinct)] if which < BANDS else np.bincount(word[known], minlength=len(distinct))
        grams = Grams(word, count + 1, words.mass[which], short, long, known)
        model = grams.log10(grams.learn(updates)) + math.log10(words.mass[which] / words.group_mass[words.group_of[which]])
        base, seen = np.log10(count + 1.0)[word], (count > 0)[word]
        row = row & np.uint16((1 << 15) - 1)
        stop = np.cumsum([len(p[2]) for p in parts])
        for r, z, n in zip(held, stop, (len(p[2]) for p in parts), strict=True):
            a = z - n
            docs, at = np.unique(row[a:z], return_inverse=True)
            yield r[0], docs, *(np.bincount(at, weights=x[a:z], minlength=len(docs)) for x in (seen, base, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        sums: dict[int, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sums, size
            out = []
            for block, parts in sums.items():
                docs, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                known, base, model = (np.bincount(where, weights=np.concatenate([p[k] for p in parts]), minlength=len(docs)) for k in (1, 2, 3))
                out.append((block, docs.astype(np.uint16).tobytes(), known.astype(np.uint32).tobytes(), base.tobytes(), model.astype(np.float32).tobytes(), None))
            sums, size = {}, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] + [pa.binary()] * 5, strict=True)], names=names)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for block, *values in scored(at, held) if held else ():
                sums.setdefault(block, []).append(values)
                size += len(values[0])
            held = []
            if size > 1 << 20:
                yield from flush()

        for batch in batches:
            shard, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(batch.num_rows):
                if shard[k] != at:
                    yield from done()
                    at = int(shard[k])
                if batch.column(7)[k].is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([block[k]]), *(pa.nulls(1, pa.binary()) for _ in range(4)), batch.column(7).slice(k, 1)], names=names)
                else:
                    held.append((int(block[k]), *(batch.column(c)[k].as_py() for c in range(2, 7))))
        yield from done()
        yield from flush()

    return run


def _finish(log_rest: float, total: int):
    """Rows sorted by block, its documents first, to one row for each document."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = known = base = model = None

        def done() -> pa.RecordBatch:
            n = rows[:, 3]
            score = model + np.ascontiguousarray(rows[:, 4]).view(np.float64)
            cols = [pa.array(rows[:, 0], mask=rows[:, 1] == 0), pa.array(rows[:, 2] == 1), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base - n * log_rest), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(5)[k].is_valid:
                    if rows is not None:
                        yield done()
                    rows = np.frombuffer(batch.column(5)[k].as_py(), np.int64).reshape(-1, 5)
                    known, base, model = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows))
                else:
                    at, *values = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, np.uint16), (2, np.uint32), (3, np.float64), (4, np.float32)))
                    known[at], base[at], model[at] = known[at] + values[0], base[at] + values[1], model[at] + values[2]
        if rows is not None:
            yield done()

    return run


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, updates: int = UPDATES) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased, ASCII white space apart) and one end. Counts c, their sum N and the number V of
    distinct tokens come from all rows that held_out (a boolean column of docs) leaves. base_score sums
    log10((c + 1) / (N + V + 1)); n_known counts tokens with c > 0. score sums log10 of the model's probability of each
    token given those before it. The probabilities of all known tokens, and of one unknown token in each dealt class,
    sum to 1 in every context.

    Words and pairs are told apart by 64-bit and 32-bit hashes, triples by 16 more bits. No vocabulary is broadcast but
    TOP words. Weights are the same however rows are dealt to tasks, but for the rounding of sums. Null texts are empty:
    one token, the end. Null held_out counts as held out, null and repeated ids keep their rows, a very long text is a
    block of its own, other columns are ignored. Without training rows every count is 0; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    learn = texts.where("not held")
    # dealing by id and length keeps the rounds alike when ids repeat or are null
    deal = F.xxhash64("doc_id", F.length("text")).alias("deal")
    counts = materialize(learn.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    words = vocabulary(counts)
    discard(counts)
    w = train(learn.select("text", deal), words, rounds)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = texts.mapInArrow(_deal(words, w), _EVENTS).repartition(max(parts, -(-words.shards // SHARDS_A_TASK)), "shard").sortWithinPartitions("shard", "block")
    sums = events.mapInArrow(_score_shards(words, updates), _SUMS)
    dealt = sums.repartition(max(parts, -(-words.shards // SHARDS_A_TASK)), "block").sortWithinPartitions(F.col("block"), F.col("rows").isNull())
    return dealt.mapInArrow(_finish(math.log10(words.total + words.distinct + 1), words.total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
