"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from ..store import discard, materialize

#: Words of a passage.
PASSAGE = 64
#: Byte pairs are counted in so many hashed cells.
PAIRS = 64
#: Kinds of bytes: space, newline and other controls, digit, upper, lower, beyond ASCII, and each mark of its own below.
MARKS = b".,;:!?'\"()[]{}<>|#$%&*@/\\_=+-~^`"
KINDS = 6 + len(MARKS)
#: Word lengths 1 to 15 and more, then repeats: share of words equal to the one before, and of distinct words.
FEATURES = KINDS + PAIRS + 16 + 2
#: Labelled documents to learn from at most, those first by a hash of their id, and passages that they may have together.
SAMPLE, SAMPLE_PASSAGES = 6_000, 1 << 18

_KIND = np.full(256, 1, np.uint8)
_KIND[0x20] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = 3
_KIND[0x61:0x7B] = 4
_KIND[0x80:] = 5
for _k, _b in enumerate(MARKS):
    _KIND[_b] = 6 + _k


def passages(column: pa.Array, size: int = PASSAGE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: first row, end row, passage features (passages x FEATURES), where each row's passages begin.

    A text's passages are its words in runs of ``size``, to its end; a text without words has one passage of zeros.
    """
    data, offsets = K.utf8(column)
    for a, b in K.chunks(offsets, 2 << 20):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = K.word_spans(part, offsets[a : b + 1] - offsets[a])
        words = np.diff(first)
        count = np.maximum(1, -(-words // size))
        begin = np.r_[0, np.cumsum(count)]
        total = int(begin[-1])
        x = np.zeros((total, FEATURES), np.float32)
        if len(starts):
            row = np.repeat(np.arange(b - a), words)
            of_word = begin[row] + (np.arange(len(starts)) - first[row]) // size
            fresh = np.r_[True, of_word[1:] != of_word[:-1]]
            # a passage runs from its first word's start to the next passage's, or to its row's end
            head = starts[fresh]
            which = of_word[fresh]
            tail = np.r_[head[1:], len(part)]
            row_end = (offsets[a : b + 1] - offsets[a])[1:][row[fresh]]
            tail = np.minimum(tail, row_end)
            size_of = tail - head
            at = np.repeat(which, size_of)
            shift = np.repeat(head - np.r_[0, np.cumsum(size_of)[:-1]], size_of)
            raw = part[np.arange(len(at)) + shift]
            kind = _KIND[raw]
            x[:, :KINDS] = np.bincount(at * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS)
            low = K.LOWER[raw].astype(np.int64)
            pair = ((low[:-1] * 31 + low[1:]) * 2654435761 >> 7) % PAIRS
            same = at[:-1] == at[1:]
            x[:, KINDS : KINDS + PAIRS] = np.bincount((at[:-1] * PAIRS + pair)[same], minlength=total * PAIRS).reshape(total, PAIRS)
            bytes_in = np.maximum(1, x[:, :KINDS].sum(1, keepdims=True))
            x[:, : KINDS + PAIRS] = np.sqrt(x[:, : KINDS + PAIRS] / bytes_in)
            length = np.minimum(ends - starts, 16) - 1
            in_passage = np.maximum(1, np.bincount(of_word, minlength=total)).astype(np.float32)
            at_length = KINDS + PAIRS
            x[:, at_length : at_length + 16] = np.sqrt(np.bincount(of_word * 16 + length, minlength=total * 16).reshape(total, 16) / in_passage[:, None])
            h = K.word_hashes(part, starts, ends)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
            x[:, -2] = np.bincount(of_word, weights=again, minlength=total) / in_passage
            both = np.unique(K.mix64(of_word.astype(np.uint64)) ^ h, return_index=True)[1]
            x[:, -1] = np.bincount(of_word[both], minlength=total) / in_passage
        yield a, b, x, begin


@dataclass
class Model:
    """Passage encoder, gated attention and the head over the weighted passage."""

    centre: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def score(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents and attention of passages."""
        return _forward(self.params, (x - self.centre) * self.scale, begin)[:2]


def _sums(v: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, begin[:-1], axis=0)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> tuple:
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (v * u) @ p["w"]
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    top = np.maximum.reduceat(e, begin[:-1])
    e = np.exp(e - top[of])
    a = e / _sums(e, begin)[of]
    z = _sums(a[:, None] * h, begin)
    s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return s, a, z, h, v, u, of


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the documents' weighted log loss by the parameters."""
    s, a, z, h, v, u, of = _forward(p, x, begin)
    ds = ((s - y) * weight).astype(x.dtype)
    dz = ds[:, None] * p["c"]
    da = (h * dz[of]).sum(1)
    de = a * (da - _sums(a * da, begin)[of])
    dvu = de[:, None] * p["w"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = (a[:, None] * dz[of] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


def _learn(x: np.ndarray, first_of: np.ndarray, size_of: np.ndarray, y: np.ndarray, hidden: int, rounds: int, seed: int) -> Model:
    """Adam on the documents' log loss, the rarer label weighted up to balance; document k has rows first_of[k] and on of x."""
    rng = np.random.default_rng(seed)
    centre = x.mean(0, dtype=np.float64)
    scale = 1 / (np.sqrt(np.maximum(0, np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - centre**2)) + 1e-2)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, 16), "U": draw(hidden, 16), "w": draw(16), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            own = order[at : at + 128]
            size = size_of[own]
            starts = np.r_[0, np.cumsum(size)]
            xs = ((x[np.repeat(first_of[own] - starts[:-1], size) + np.arange(starts[-1])] - centre) * scale).astype(np.float32)
            g = _gradients(p, xs, starts, y[own], weight[own] / len(own))
            step += 1
            for k in p:
                grad = g[k] + (1e-4 * p[k] if p[k].ndim == 2 else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = (p[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(centre.astype(np.float32), scale.astype(np.float32), p)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x, begin in passages(batch.column(2)):
            bags = [x[begin[k] : begin[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(2)), pa.array(np.diff(begin)), pa.array(bags, pa.binary())], names=["id", "y", "n", "bag"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_PASSAGES, hidden: int = 32, rounds: int = 12, seed: int = 5) -> Model:
    """Learn from at most ``sample`` labelled documents, those of docs first by a hash of their id, of all their passages.

    Of these, in the same order, a document is left out whose passages would make more than ``most`` of all taken: the
    driver holds that many at most. Labels that are null, contradict each other for one id or belong to no row of docs are
    left out; rows that repeat an id are one document each. With labels of one kind only, or none, the scores are that
    label, or 1.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    present = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    chosen = known.where("y = z").join(present, "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col("y").cast("double").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")  # sample bounds the broadcast
    table = materialize(joined.mapInArrow(_features, "id long, y double, n long, bag binary").withColumn("mark", F.xxhash64("bag")))
    taken, total = {}, 0
    for r in table.select("id", "mark", "y", "n").orderBy(F.xxhash64("id"), "id", "mark").limit(sample).collect():
        if total + r["n"] <= most:
            taken.setdefault((r["id"], r["mark"]), []).append((total, r["n"], r["y"]))
            total += r["n"]
    y = [place[2] for places in taken.values() for place in places]
    if len(set(y)) < 2:
        zero = {"W": np.zeros((FEATURES, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.array([30.0 if not y or y[0] else -30.0])}
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), zero)
    x = np.empty((total, FEATURES), np.float32)
    for r in table.select("id", "mark", "bag").toLocalIterator():
        for first, n, _ in taken.get((r["id"], r["mark"]), ()):
            x[first : first + n] = np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES)
    discard(table)
    first, size = (np.array([place[k] for places in taken.values() for place in places]) for k in (0, 1))
    return _learn(x, first, size, np.array(y), hidden, rounds, seed)


def _score(model: Model, threshold: float):
    """Texts to scores. Holds the passage features of about 2 MB of text, or of one longer text: some 5 MB for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(batch.num_rows)
            for a, b, x, begin in passages(batch.column(batch.num_columns - 1)):
                score[a:b] = model.score(x, begin)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row: the whole text is encoded and the attention runs over all its passages.

    Null and blank texts are scored as one passage of zeros; every row gives one row; an empty table gives none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(model, threshold), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns; no join and no shuffle."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.empty(batch.num_rows, bool)
            for a, b, x, begin in passages(batch.column(place)):
                good[a:b] = model.score(x, begin)[0] >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls into the fold; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))
