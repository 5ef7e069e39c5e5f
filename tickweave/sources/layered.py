"""Layered xz archives: files of xz streams whose contents are streams again, with very many repeats.

A file becomes a grammar: each distinct stream is decoded once, and a sequence of streams is a list of runs. The songs'
bytes are never laid out: the track grammar walks the runs, and where an iteration leaves it in the state that it began
in, the others are folded into a step and a count. The rows are cells, tempo changes and time signatures with a list of
steps and counts, which Spark expands where single cells are wanted; totals need no expansion.
"""

from __future__ import annotations

import hashlib
import io
import lzma
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .midi import _BROKEN, KINDS, _bounded, _checked, _run, division, unwrap

#: First and last bytes of an xz stream (fixed values); the longest pattern that is looked for in a sequence.
HEAD, FOOT = b"\xfd7zXZ\0", b"YZ"
PERIOD, DEPTH = 8, 16

LAYERED = "song_id string, ppqn int, kind string, tick long, seq long, steps array<long>, counts array<long>, seq_steps array<long>, ons long, delta long, cc long, us int, num int, dd int, times long, error string"


class NotLayered(ValueError):
    pass


def cut(data: bytes) -> list[tuple[int, int]]:
    """Places of the xz streams that data consists of, from its end by footers and indexes, nothing decoded; [] if it is no row of them."""
    out: list[tuple[int, int]] = []
    end = len(data)
    while end:
        while end >= 4 and data[end - 4 : end] == bytes(4):  # padding between streams
            end -= 4
        if end < 32 or data[end - 2 : end] != FOOT:
            return []
        index = (int.from_bytes(data[end - 8 : end - 4], "little") + 1) * 4
        at = end - 12 - index
        if at < 12 or data[at] != 0:
            return []
        try:
            count, place = _number(data, at + 1, end - 12)
            size = 0
            for _ in range(count):
                unpadded, place = _number(data, place, end - 12)
                _, place = _number(data, place, end - 12)
                size += -(-unpadded // 4) * 4
        except IndexError:
            return []
        start = at - size - 12
        if start < 0 or data[start : start + 6] != HEAD:
            return []
        out.append((start, end))
        end = start
    return out[::-1]


def _number(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= end or shift > 62:
            raise IndexError
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


def fold(sequence: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """A sequence as patterns of at most PERIOD items with how often each stands in a row."""
    out: list[tuple[tuple[int, ...], int]] = []
    at = 0
    while at < len(sequence):
        best = (1, 1)
        for period in range(1, PERIOD + 1):
            pattern = sequence[at : at + period]
            times = 1
            while sequence[at + times * period : at + (times + 1) * period] == pattern:
                times += 1
            if times > 1 and times * period > best[0] * best[1]:
                best = (period, times)
        out.append((tuple(sequence[at : at + best[0]]), best[1]))
        at += best[0] * best[1]
    return out


@dataclass
class Grammar:
    """Nodes by number: bytes, or runs of (children, times). Streams and contents that are equal are one node."""

    nodes: list[bytes | list[tuple[tuple[int, ...], int]]] = field(default_factory=list)
    known: dict[bytes, int] = field(default_factory=dict)
    decoded: int = 0

    def add(self, data: bytes, depth: int = 0) -> int:
        """The node of a payload: a row of xz streams, or bytes."""
        key = hashlib.sha256(data).digest()
        if key in self.known:
            return self.known[key]
        places = cut(data) if data[:6] == HEAD else []
        if data[:6] == HEAD and not places:
            raise NotLayered("a stream that is not whole")
        if depth > DEPTH:
            raise NotLayered("too many layers")
        if places:
            found = [self._stream(data[a:b], depth) for a, b in places]
            node: bytes | list = fold(found)
        else:
            node = data
        self.nodes.append(node)
        self.known[key] = len(self.nodes) - 1
        return self.known[key]

    def _stream(self, stream: bytes, depth: int) -> int:
        key = b"s" + hashlib.sha256(stream).digest()
        if key not in self.known:
            self.decoded += 1
            self.known[key] = self.add(_bounded(lzma.LZMAFile(io.BytesIO(stream))), depth + 1)
        return self.known[key]

    def size(self, node: int, memo: dict[int, int] | None = None) -> int:
        """Bytes that a node comes to."""
        memo = {} if memo is None else memo
        if node not in memo:
            own = self.nodes[node]
            memo[node] = len(own) if isinstance(own, bytes) else sum(times * sum(self.size(c, memo) for c in children) for children, times in own)
        return memo[node]


Key = tuple[int, int]
Dims = tuple[tuple[int, int, int], ...]


@dataclass
class Element:
    """A cell, change or track's end at tick + i * step for each step and i below its count; times: how often it stands there."""

    kind: str
    tick: int
    seq: int
    values: tuple
    dims: Dims = ()
    times: int = 1

    def repeated(self, step: int, count: int, seq_step: int) -> Element:
        if step:
            return Element(self.kind, self.tick, self.seq, self.values, (*self.dims, (step, count, seq_step)), self.times)
        return Element(self.kind, self.tick, self.seq, self.values, self.dims, self.times * count)


@dataclass
class State:
    """Where the track grammar stands between two pieces of bytes."""

    stage: str = "head"  # head, chunk, skip, track
    pending: bytes = b""
    left: int = 0  # bytes of the chunk still to come
    status: int = 0
    skip: int = 0  # bytes of a message to pass over
    tick: int = 0
    seq: int = 0
    tracks: int = 0
    held: dict[Key, int] = field(default_factory=dict)
    ppqn: int = 480

    def shape(self) -> tuple:
        return self.stage, self.pending, self.status, self.skip

    def copy(self) -> State:
        return State(self.stage, self.pending, self.left, self.status, self.skip, self.tick, self.seq, self.tracks, dict(self.held), self.ppqn)


@dataclass
class Effect:
    """What a stretch of bytes did: its elements, what it takes and leaves of each key's counter before any track's end in it, and whether there was one."""

    elements: list[Element] = field(default_factory=list)
    keys: dict[Key, tuple[int, int]] = field(default_factory=dict)
    reset: bool = False

    def then(self, other: Effect) -> None:
        self.elements += other.elements
        if not self.reset:
            for k, (d, n) in other.keys.items():
                d0, n0 = self.keys.get(k, (0, 0))
                self.keys[k] = (max(d0, d - n0), n0 + n)
        self.reset |= other.reset


def _again(d: int, n: int, times: int) -> tuple[int, int]:
    """(deficit, net) of so many blocks in a row: what each takes below what the ones before left."""
    return (d if n >= 0 else d - (times - 1) * n), n * times


@dataclass
class Segment:
    """Events of bytes within a track, independent of tick and counters: relative ticks and columns, and how it ends."""

    ticks: np.ndarray
    kinds: np.ndarray
    columns: np.ndarray  # channel, key, value, us, num, dd
    moved: int
    shape: tuple[bytes, int, int]
    keys: dict[Key, tuple[int, int]]


class Walker:
    """The track grammar over a file's nodes."""

    def __init__(self, grammar: Grammar, vel0_is_off: bool, close_held: bool) -> None:
        self.grammar, self.vel0_is_off, self.close_held = grammar, vel0_is_off, close_held
        self.state = State()
        self.memo: dict[tuple, Segment] = {}

    def run(self, node: int) -> Effect:
        out = self._node(node)
        self._finish(out)
        return out

    def _finish(self, out: Effect) -> None:
        s = self.state
        if s.stage == "head":
            raise NotLayered("not a MIDI file")
        if s.stage == "chunk" and len(s.pending) >= 4:
            raise ValueError("a chunk's length is cut")
        if s.stage == "track":  # the file ends within the track
            self._track(b"", out, None, True)

    def _node(self, node: int) -> Effect:
        own, out = self.grammar.nodes[node], Effect()
        if isinstance(own, bytes):
            self._feed(own, out, node)
        else:
            for children, times in own:
                out.then(self._repeat(children, times))
        return out

    def _repeat(self, children: tuple[int, ...], times: int) -> Effect:
        """So many iterations: one is walked, those that must do the same are folded onto it."""
        out = Effect()
        while times:
            before, one = self.state.copy(), Effect()
            for child in children:
                one.then(self._node(child))
            times -= 1
            more = self._alike(before, one, times) if times else 0
            if more:
                s = self.state
                step, seq_step, used = s.tick - before.tick, s.seq - before.seq, before.left - s.left
                if one.reset:
                    step = used = 0
                one.elements = [e.repeated(step, more + 1, seq_step) for e in one.elements]
                for k, (d, n) in one.keys.items():
                    if not one.reset and s.held.get(k, 0) >= d:
                        s.held[k] = s.held.get(k, 0) + more * n
                    one.keys[k] = _again(d, n, more + 1)
                s.tick, s.seq, s.left, s.tracks = s.tick + more * step, s.seq + more * seq_step, s.left - more * used, s.tracks + more * (s.tracks - before.tracks)
                times -= more
            out.then(one)
        return out

    def _alike(self, before: State, one: Effect, times: int) -> int:
        """How many of the next iterations do exactly what the last one did, at a later place."""
        s = self.state
        if s.shape() != before.shape():
            return 0
        same = {k: c for k, c in s.held.items() if c} == {k: c for k, c in before.held.items() if c}
        if one.reset:
            return times if same and (s.tick, s.left) == (before.tick, before.left) else 0
        used = before.left - s.left
        if used <= 0:
            return 0
        times = min(times, (s.left - 1) // used)
        for k, (d, n) in one.keys.items():
            was, now = before.held.get(k, 0), s.held.get(k, 0)
            if (was >= d) != (now >= d) or now < d and now != was:
                return 0
            if now >= d and n < 0:
                times = min(times, (now - d) // -n + 1)
        return times

    def _feed(self, data: bytes, out: Effect, node: int) -> None:
        s, at = self.state, 0
        if s.stage == "track" and s.left > len(data):
            s.left -= len(data)
            self._track(data, out, node, False)
            return
        while at < len(data):
            if s.stage in ("head", "chunk"):
                need = 14 if s.stage == "head" else 8
                take = data[at : at + need - len(s.pending)]
                s.pending += take
                at += len(take)
                if len(s.pending) == need:
                    self._header(out) if s.stage == "head" else self._chunk(out)
                continue
            take = min(s.left, len(data) - at)
            s.left -= take
            if s.stage == "skip":
                if not s.left:
                    s.stage = "chunk"
            else:
                self._track(data[at : at + take], out, None, not s.left)
            at += take

    def _header(self, out: Effect) -> None:
        s, head = self.state, self.state.pending
        if head[:4] != b"MThd":
            raise NotLayered("not a MIDI file")
        raw, s.pending = int.from_bytes(head[12:14], "big"), b""
        s.stage = "chunk"
        if raw == 0x4D54:
            s.ppqn, s.pending = 480, head[12:14]
        else:
            s.ppqn, s.left = division(raw), max(6, int.from_bytes(head[4:8], "big")) - 6
            if s.left:
                s.stage = "skip"

    def _chunk(self, out: Effect) -> None:
        s = self.state
        tag, s.left, s.pending = s.pending[:4], int.from_bytes(s.pending[4:], "big"), b""
        if tag == b"MTrk":
            s.stage, s.tick, s.status, s.skip, s.held = "track", 0, 0, 0, {}
            out.reset = True
            if not s.left:
                self._track(b"", out, None, True)
        elif s.left:
            s.stage = "skip"

    def _track(self, data: bytes, out: Effect, node: int | None, last: bool) -> None:
        """Bytes of a track, the last ones or not; node if they are a whole node, whose events are remembered."""
        s = self.state
        key = (node, s.pending, s.status, s.skip)
        if node is None or key not in self.memo:
            found = segment(s.pending + data, s.status, s.skip, last, self.vel0_is_off)
            if node is not None:
                self.memo[key] = found
        else:
            found = self.memo[key]
        effect = Effect(self._elements(found), dict(found.keys))
        s.pending, s.status, s.skip = found.shape
        s.tick += found.moved
        if last:
            held = sum(s.held.values())
            if self.close_held and held:
                effect.elements.append(Element("cell", s.tick, s.seq, (0, -held, 0)))
            effect.elements.append(Element("end", s.tick, s.seq, ()))
            s.stage, s.pending, s.held, s.skip, s.status, s.left = "chunk", b"", {}, 0, 0, 0
            s.tracks += 1
            effect.reset = True
        out.then(effect)

    def _elements(self, found: Segment) -> list[Element]:
        """Cells and changes at their ticks; note-offs beyond what a key holds do nothing."""
        s = self.state
        delta = np.where(found.kinds == 0, 1, np.where(found.kinds == 1, -1, 0)).astype(np.int64)
        for k, (d, n) in found.keys.items():
            have = s.held.get(k, 0)
            if have < d:  # some of this key's note-offs find nothing
                own = np.flatnonzero((found.kinds <= 1) & (found.columns[0] == k[0]) & (found.columns[1] == k[1]))
                upto = have + np.cumsum(delta[own])
                low = np.minimum(0, np.minimum.accumulate(upto))
                real = upto - low
                delta[own] = np.diff(np.r_[have, real])
                s.held[k] = int(real[-1])
            else:
                s.held[k] = have + n
        out = []
        counted = found.kinds <= 2
        if counted.any():
            ticks, where = np.unique(found.ticks[counted], return_inverse=True)
            sums = [np.bincount(where, weights=w, minlength=len(ticks)).astype(np.int64) for w in ((found.kinds == 0)[counted], delta[counted], (found.kinds == 2)[counted])]
            moving = (sums[0] != 0) | (sums[1] != 0) | (sums[2] != 0)
            out += [Element("cell", s.tick + t, s.seq, v) for t, *v in zip(ticks[moving].tolist(), *(x[moving].tolist() for x in sums), strict=True)]
        for k in np.flatnonzero(found.kinds > 2).tolist():
            kind = KINDS[found.kinds[k]]
            s.seq += 1
            out.append(Element(kind, s.tick + int(found.ticks[k]), s.seq, (int(found.columns[3, k]),) if kind == "tempo" else (int(found.columns[4, k]), int(found.columns[5, k]))))
        return out


def segment(body: bytes, status: int, skip: int, last: bool, vel0_is_off: bool) -> Segment:
    """Whole events of a track's bytes; what is left of one waits for more, or, at the track's end, only moves its time."""
    data, events = np.frombuffer(body, np.uint8), []
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, tick, looked = min(skip, len(body)), 0, 0
    skip -= at

    def flush() -> None:
        if events:
            table = np.array(events, np.int64).T
            parts.append((table[0], table[1], table[2:]))
            events.clear()

    while at < len(body):
        if at >= looked:
            size, times, statuses, keys, values = _run(data, at, status)
            if size:
                flush()
                ticks = tick + np.cumsum(times, dtype=np.int64)
                high = statuses >> 4
                kind = np.select([high == 9, high == 8, high == 11], [0, 1, 2], -1)
                own = kind >= 0
                none = np.full(int(own.sum()), -1)
                parts.append((ticks[own], kind[own], np.stack([(statuses & 15)[own], keys[own], values[own], none, none, none]).astype(np.int64)))
                at, tick, status = at + size, int(ticks[-1]), int(statuses[-1])
                continue
            looked = at + 64
        got = _event(body, at, status)
        if got is None:
            break
        at, step, status, event, skip = got
        tick += step
        if event:
            events.append((tick, *event))
        over = min(skip, len(body) - at)
        at, skip = at + over, skip - over
    rest = body[at:]
    if last and rest:  # a cut event still moves time
        step = 0
        for b in rest[:4]:
            step = step << 7 | b & 0x7F
            if b < 0x80:
                break
        tick += step
    flush()
    if parts:
        ticks, kinds, columns = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
    else:
        ticks, kinds, columns = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((6, 0), np.int64)
    if vel0_is_off:
        kinds = np.where((kinds == 0) & (columns[2] == 0), 1, kinds)
    keys: dict[Key, tuple[int, int]] = {}
    notes = np.flatnonzero(kinds <= 1)
    if len(notes):
        name = columns[0, notes] * 128 + columns[1, notes]
        order = np.argsort(name, kind="stable")
        name, x = name[order], np.where(kinds[notes][order] == 0, 1, -1)
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(name)], strict=True):
            upto = np.cumsum(x[a:b])
            keys[int(name[a]) // 128, int(name[a]) % 128] = (max(0, -int(upto.min())), int(upto[-1]))
    return Segment(ticks, kinds, columns, tick, (b"" if last else rest, status, 0 if last else skip), keys)


def _event(body: bytes, at: int, status: int) -> tuple | None:
    """The event at a place: the place after it, its time, the held status, its columns if it counts, and bytes to pass over; None if it is not whole."""
    n = len(body)

    def number(at: int) -> tuple[int, int] | None:
        value = 0
        for k in range(4):
            if at >= n:
                return None
            b = body[at]
            at += 1
            value = value << 7 | b & 0x7F
            if b < 0x80 or k == 3:
                return value, at
        return None

    got = number(at)
    if got is None or got[1] >= n:
        return None
    step, at = got
    b = body[at]
    if b < 0x80:
        event = status
        if not event:
            return at, step, status, None, 0  # a data byte without a status consumes nothing
    else:
        at, event = at + 1, b
        status = b if b < 0xF0 else status if b >= 0xF8 and b != 0xFF else 0
    if event < 0xF0:
        high = event >> 4
        need = 1 if high in (0xC, 0xD) else 2
        if at + need > n:
            return None
        kind = {9: 0, 8: 1, 11: 2}.get(high)
        return at + need, step, status, None if kind is None else (kind, event & 15, body[at] & 0x7F, body[at + 1], -1, -1, -1), 0
    if event == 0xFF:
        got = number(at + 1)
        if got is None:
            return None
        kind, (size, at) = body[at], got
        if (kind, size) in ((0x51, 3), (0x58, 4)):
            if at + size > n:
                return None
            if kind == 0x51:
                us = int.from_bytes(body[at : at + 3], "big")
                return at + 3, step, status, (3, -1, -1, -1, us, -1, -1) if us else None, 0
            return at + 4, step, status, (4, -1, -1, -1, -1, body[at], body[at + 1]), 0
        return at, step, status, None, size
    if event in (0xF0, 0xF7):
        got = number(at)
        return None if got is None else (got[1], step, status, None, got[0])
    return at, step, status, None, {0xF1: 1, 0xF3: 1, 0xF2: 2}.get(event, 0)


def _read(vel0_is_off: bool, close_held: bool, mode: str):
    names = [x.split()[0] for x in LAYERED.split(", ")]
    longs = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), longs, longs, longs, *[pa.int64()] * 3, *[pa.int32()] * 3, pa.int64(), pa.string()]

    def rows(song: str, ppqn: int, elements: list[Element]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(elements), 50_000):
            table = []
            for e in elements[a : a + 50_000]:
                cell = e.values if e.kind == "cell" else (0, 0, 0)
                us = e.values[0] if e.kind == "tempo" else None
                num, dd = e.values if e.kind == "timesig" else (None, None)
                table.append((song, ppqn, e.kind, e.tick, e.seq, *([d[k] for d in e.dims] for k in range(3)), *cell, us, num, dd, e.times, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    data = content.as_py() or b""
                    grammar = Grammar()
                    try:
                        root = grammar.add(data if data[:6] == HEAD else unwrap(data))
                    except NotLayered:  # streams that are not whole by themselves: the standard way
                        grammar = Grammar()
                        root = grammar.add(unwrap(data))
                    walker = Walker(grammar, vel0_is_off, close_held)
                    found = walker.run(root)
                    yield from rows(song, walker.state.ppqn, found.elements)
                except _BROKEN as error:
                    if mode == "fail":
                        raise ValueError(f"{song}: {error}") from error
                    if mode == "rows":
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([song, *[None] * 14, str(error)], kinds, strict=True)], names=names)

    return run


def read_layered(files: DataFrame, vel0_is_off: bool = True, close_held: bool = False, mode: str = "drop") -> DataFrame:
    """(song_id, content) to folded rows: cells, tempo changes, time signatures and tracks' ends.

    A row stands at tick + i * step for every i below the count, for each of its steps, and counts ``times`` there. One
    task walks one file; each distinct stream is decoded once and its events are remembered for each state that it is
    entered in. Files of other kinds are unwrapped and walked whole. mode as for tracks.
    """
    return files.select("song_id", "content").mapInArrow(_read(vel0_is_off, close_held, _checked(mode)), LAYERED)


def totals(rows: DataFrame) -> DataFrame:
    """(song_id, ppqn, notes, cc, tracks, max_tick) without expansion; counts are decimals, as they may be of any size."""
    whole = F.aggregate("counts", F.col("times").cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    last = F.aggregate(F.arrays_zip("steps", "counts"), F.col("tick"), lambda a, x: a + x["steps"] * (x["counts"] - 1))
    count = lambda c: F.sum((F.col(c) * F.col("whole")).cast("decimal(38,0)"))
    sums = rows.where("error is null").withColumn("whole", whole).withColumn("last", last).groupBy("song_id")
    return sums.agg(F.max("ppqn").alias("ppqn"), count("ons").alias("notes"), count("cc").alias("cc"), F.sum(F.when(F.col("kind") == "end", F.col("whole"))).alias("tracks"), F.max("last").alias("max_tick"))


def expanded(rows: DataFrame) -> DataFrame:
    """Rows without steps: one for each place that a row stands at. Done on executors, one step at a time."""
    most = rows.agg(F.coalesce(F.max(F.size("steps")), F.lit(0))).first()[0]
    for _ in range(most):
        n = F.expr("if(size(counts) > 0, element_at(counts, 1), 1L)")
        blocks = rows.withColumn("__n", n).withColumn("__b", F.explode(F.expr("sequence(0L, (__n - 1) div 65536)")))
        places = blocks.withColumn("__i", F.explode(F.expr("sequence(__b * 65536, least(__n - 1, __b * 65536 + 65535))")))
        moved = lambda c, s: F.when(F.size(s) > 0, F.col(c) + F.col("__i") * F.expr(f"try_element_at({s}, 1)")).otherwise(F.col(c))
        rest = lambda c: F.when(F.size(c) > 1, F.expr(f"slice({c}, 2, size({c}) - 1)")).otherwise(F.expr("cast(array() as array<bigint>)"))
        rows = places.withColumn("tick", moved("tick", "steps")).withColumn("seq", moved("seq", "seq_steps"))
        rows = rows.withColumns({c: rest(c) for c in ("steps", "counts", "seq_steps")}).drop("__n", "__b", "__i")
    return rows


def cells(rows: DataFrame) -> DataFrame:
    """Tick cells of the songs: (song_id, tick, ons, delta, cc)."""
    every = expanded(rows.where("kind = 'cell'"))
    sums = every.groupBy("song_id", "tick").agg(*(F.sum(F.col(c) * F.col("times")).cast("long").alias(c) for c in ("ons", "delta", "cc")))
    return sums.where("ons <> 0 or delta <> 0 or cc <> 0")


def layered_frames(rows: DataFrame, fps: float = 60.0, end_delay: float = 0.0, bins: bool = False) -> DataFrame:
    """Frames of the songs that read_layered() gave."""
    from ..plans.frames import frames
    from ..store import materialize

    rows = materialize(rows)
    whole = totals(rows).select("song_id", "ppqn", "max_tick")
    changes = expanded(rows.where("kind in ('tempo', 'timesig')")).withColumn("track_idx", F.lit(0))
    tempo = changes.where("kind = 'tempo'").select("song_id", "tick", "us", "track_idx", "seq")
    meter = changes.where("kind = 'timesig'").select("song_id", "tick", "num", "dd", "track_idx", "seq")
    return frames(cells(rows), tempo, meter, whole, fps, end_delay, bins)
