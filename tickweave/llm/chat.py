"""Chat formatting by columnar byte assembly, and the reader of what it writes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from ..store import partitions_for

#: The template: header, role, newline, text, footer. Texts and roles hold neither control string once escaped.
HEAD, MIDDLE, FOOT = b"### ", b":\n", b"\n</turn>\n"
#: Rows or bytes after which a long conversation goes on in a further part; rows taken at a time; bytes written together at most, but for one longer text.
PART_ROWS, PART_BYTES, PIECE_ROWS, MOST_BYTES = 4096, 16 << 20, 512, 1 << 29
#: Bytes of turns, by the size of the tables read, that one task formats.
PARTITION_BYTES = 64 << 20


def _escaped(data: np.ndarray, offsets: np.ndarray, role: bool) -> np.ndarray:
    """Where a backslash goes in front: backslashes, number signs and slashes after '<'; in roles newlines and colons too."""
    mask = (data == 0x5C) | (data == 0x23)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0x3C
    after[offsets[(offsets > 0) & (offsets < len(data))]] = False
    mask |= (data == 0x2F) & after
    if role:
        mask |= (data == 0x0A) | (data == 0x3A)
    return mask


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """All turns in one preallocated buffer: the buffer, turns' offsets, and the (start, end) of each turn's text in it.

    Lengths of the five segments of a turn give cumulative offsets; bytes are scattered to their places segment by segment.
    """
    n = len(texts)
    out_at = np.zeros(5 * n + 1, np.int64)
    pieces = []
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = len(HEAD), len(MIDDLE), len(FOOT)
    for place, column in ((1, roles), (3, texts)):
        data, offsets = K.utf8(column)
        mask = _escaped(data, offsets, place == 1)
        extra = np.r_[0, np.cumsum(mask)]
        size[:, place] = np.diff(offsets) + extra[offsets[1:]] - extra[offsets[:-1]]
        pieces.append((place, data, offsets, mask, extra))
    np.cumsum(size.ravel(), out=out_at[1:])
    buffer = pa.allocate_buffer(int(out_at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    starts = out_at[:-1].reshape(n, 5)
    for place, literal in ((0, HEAD), (2, MIDDLE), (4, FOOT)):
        out[(starts[:, place][:, None] + np.arange(len(literal))).ravel()] = np.tile(np.frombuffer(literal, np.uint8), n)
    for place, data, offsets, mask, extra in pieces:
        shift = np.repeat(starts[:, place] - offsets[:-1] - extra[offsets[:-1]], np.diff(offsets))
        to = np.arange(len(data)) + shift + extra[1:]
        out[to] = data
        out[to[mask] - 1] = 0x5C
    spans = np.stack([starts[:, 3], starts[:, 3] + size[:, 3]], axis=1)
    return buffer, np.r_[starts[:, 0], out_at[-1]], spans


def unescape(data: bytes) -> bytes:
    """Drop the backslashes that _escaped put in: in each run of backslashes those at even places."""
    raw = np.frombuffer(data, np.uint8)
    slash = raw == 0x5C
    if not slash.any():
        return data
    at = np.arange(len(raw))
    begin = np.maximum.accumulate(np.where(slash & ~np.r_[False, slash[:-1]], at, -1))
    return raw[~(slash & ((at - begin) % 2 == 0))].tobytes()


def read_turns(data: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted conversation, or of a part of one."""
    turns = []
    for turn in data.split(FOOT)[:-1]:
        if not turn.startswith(HEAD):
            raise ValueError("no turn header")
        end = turn.index(MIDDLE)  # an escaped role holds neither a bare colon nor a bare newline
        while end and (end - len(turn[:end].rstrip(b"\\"))) % 2:
            end = turn.index(MIDDLE, end + 1)
        turns.append((unescape(turn[len(HEAD) : end]), unescape(turn[end + len(MIDDLE) :])))
    return turns


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most PIECE_ROWS rows and about PART_BYTES of text."""
    _, offsets = K.utf8(batch.column(3))
    for a, b in K.chunks(offsets, PART_BYTES):
        for at in range(a, b, PIECE_ROWS):
            yield batch.slice(at, min(PIECE_ROWS, b - at))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to rows of whole conversations, long ones in parts.

    Holds about PART_BYTES of turns, or one longer text, and some six arrays of their bytes.
    """
    names = ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"]
    held: list[pa.RecordBatch] = []
    rows = size = 0
    key, part = object(), 0

    def write(table: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        nonlocal key, part
        table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
        conv, role, text = (table.column(k).combine_chunks() for k in (0, 2, 3))
        buffer, offsets, spans = assemble(role, text)
        keys = conv.to_pylist()
        first = [0] + [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        stops = [*first[1:], len(keys)]
        parts = []
        for a in first:
            key, part = (keys[a], part + 1) if keys[a] == key else (keys[a], 0)
            parts.append(part)
        if offsets[-1] > 2**31 - 1:
            raise ValueError("one turn's text exceeds what a row can hold")
        whole = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets[[*first, len(keys)]].astype(np.int32)), buffer)
        loss = np.array([r == "assistant" for r in role.to_pylist()], bool)
        # places in code points, counted from the conversation's start: bytes that do not continue a character
        lead = np.r_[0, np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)]
        origin = lead[offsets[np.repeat(first, np.diff([*first, len(keys)]))]]
        spans = np.stack([lead[spans[:, 0]] - origin, lead[spans[:, 1]] - origin], axis=1)[loss]
        ends = np.r_[0, np.cumsum(loss)][[*first, len(keys)]].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(spans[:, k])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(parts, pa.int32()), pa.array(np.subtract(stops, first), pa.int64()), whole, *lists], names=names)

    for batch in batches:
        for piece in _pieces(batch):
            if held and size + piece.nbytes > MOST_BYTES:
                # the conversation at its end may go on in a further part
                yield write(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
            held.append(piece)
            rows += piece.num_rows
            size += piece.nbytes
            if rows < PART_ROWS and size < PART_BYTES:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_pylist()
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            # the last conversation may go on; alone, it is written as a part
            cut = last or len(keys)
            yield write(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows, size = len(keys) - cut, sum(b.nbytes for b in held)
    if rows:
        yield write(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """Conversations as formatted text: conv_id, part, n_turns, formatted, loss_starts, loss_ends (code points of part).

    Turns go by turn, null first, ties by role and text; null roles and texts are empty; a null conv_id is one
    conversation. A backslash goes before each backslash and number sign, and before a slash after '<', so that no
    control string stands in a text; read_turns() undoes it. The loss mask covers the texts of role ``assistant``. A very
    long conversation is written in consecutive parts of bounded size; a single text must fit, escaped, in 2 GiB. An empty
    table gives no rows. Other columns are ignored.
    """
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = plain.repartition(partitions_for(plain, PARTITION_BYTES), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, "conv_id long, part int, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, in order, to one row of digests for each conversation; nothing but hash states is held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None

    def row(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            conv, part, n_turns, text, starts, ends = (batch.column(c)[k].as_py() for c in range(6))
            if part == 0:
                if state:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = read_turns(text.encode())
            if len(turns) != n_turns:
                raise ValueError("the formatted text does not read back")
            state[1] += n_turns
            state[5] += len(text)
            for role, body in turns:
                state[2].update(role + b"\n" + body + b"\n")
            for a, b in zip(starts, ends, strict=True):
                masked = unescape(text[a:b].encode())
                state[3] += len(masked.decode())
                state[4].update(masked)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(state), kinds, strict=True)], names=names)


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Read format_chats() output back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's parts must follow each other. They do where format_chats() has just written them (in_order); a table
    that was stored or dealt anew is brought into that order first.
    """
    if not in_order:
        formatted = formatted.repartition(partitions_for(formatted, PARTITION_BYTES), "conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
