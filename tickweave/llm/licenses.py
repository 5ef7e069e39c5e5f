"""License scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for license expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method itself and their labels (fixed values).
NOTICES = {
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "creative commons": "cc",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "licensed under": "notice",
    "copyright": "copyright",
}
TAG = "spdx license identifier"
#: Weight of a label as evidence that the text states its license: an expression or a full notice counts more than a word.
WEAK = {"copyright", "notice", "reserved"}

#: How much a license asks, by the start of its identifier; the longest start holds, others ask most (fixed values).
ASKS = {"mit": 0, "bsd": 0, "apache": 0, "isc": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "cc-by": 0, "public-domain": 0, "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1, "gpl": 2, "agpl": 2, "cc-by-sa": 2}
UNKNOWN = 3

#: Bytes between words once A-Z are lower-cased: all of ASCII but digits and a-z.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = False
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> tuple[list[str], int]:
    """The longest well-formed license expression at the start of text, in reverse Polish order, and its number of tokens.

    ``with`` binds before ``and`` before ``or``; operators match in any case. Without a well-formed start the result is
    ([], 0).
    """
    tokens = _TOKEN.findall(text)
    best: tuple[list[str], int] = ([], 0)
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what must come next
    for k, token in enumerate(tokens):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append("(")
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
            continue
        else:
            if not operand:
                break
            out.append(low)
        operand = token == "("
        if not operand and "(" not in stack:
            best = (out + stack[::-1], k + 1)
    return best


@dataclass
class Terms:
    """What an expression comes to: identifiers it names, those that hold whichever alternative is taken, the number of
    alternatives, and how much the one that asks least asks."""

    offered: list[str]
    required: set[str]
    alternatives: int
    asks: int


def _asks(ident: str) -> int:
    return ASKS[max(starts, key=len)] if (starts := [p for p in ASKS if ident.startswith(p)]) else UNKNOWN


def evaluate(rpn: list[str]) -> Terms:
    """Terms of an expression in reverse Polish order: ``or`` leaves a choice, ``and`` binds to both sides, ``with`` joins
    an exception to its license and makes a license that asks much ask less. An empty expression has no alternative."""
    stack: list[Terms] = []
    for token in rpn:
        if token not in _RANK:
            stack.append(Terms([token], {token}, 1, _asks(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            named = lambda x, e=right.offered[0]: f"{x}-with-{e}"
            stack.append(Terms([named(x) for x in left.offered], {named(x) for x in left.required}, left.alternatives, 1 if left.asks == 2 else left.asks))
        elif token == "and":
            stack.append(Terms(left.offered + right.offered, left.required | right.required, left.alternatives * right.alternatives, max(left.asks, right.asks)))
        else:
            stack.append(Terms(left.offered + right.offered, left.required & right.required, left.alternatives + right.alternatives, min(left.asks, right.asks)))
    return stack[0] if stack else Terms([], set(), 0, 0)


def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces, so that they match whole words of a text whose words are joined by single spaces."""
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", (phrase, len(phrase) + 1))
    out.make_automaton()
    return out


def scan(data: np.ndarray, offsets: np.ndarray, found_by: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """Texts' numbers of words; the row, word index and phrase of every place, in order; what follows a tag in its line, else "".

    All texts are one line for the automaton: their words after single spaces, a newline between texts.
    """
    low = K.LOWER[data]
    starts, ends, first = K.word_spans(low, offsets, _BETWEEN)
    size = ends - starts
    before = np.cumsum(size + 1) - (size + 1)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = before + 2 * (row_of + 1)  # a newline and a space before each text
    line = np.full(int((size + 1).sum()) + 2 * (len(offsets) - 1), 0x20, np.uint8)
    line[np.arange(int(size.sum())) + np.repeat(place - (np.cumsum(size) - size), size)] = low[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]
    line[np.r_[0, np.cumsum(size + 1)][first[:-1]] + 2 * np.arange(len(offsets) - 1)] = 0x0A
    hits = sorted((end - length + 1, phrase) for end, (phrase, length) in found_by.iter(line.tobytes().decode("latin-1")))
    word = np.searchsorted(place, np.array([h[0] for h in hits], np.int64))
    row = row_of[word] if len(word) else np.empty(0, np.int64)
    after = []
    for w, r, (_, phrase) in zip(word.tolist(), row.tolist(), hits, strict=True):
        text = ""
        if phrase == TAG:
            rest = data[ends[w + 2] : offsets[r + 1]]
            stop = np.flatnonzero((rest == 0x0A) | (rest == 0x0D))
            text = rest[: stop[0] if len(stop) else None].tobytes().decode(errors="replace")
        after.append(text)
    return np.diff(first), row, word - first[row], [p for _, p in hits], after


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, phrases array<string>, places array<long>, expressions array<string>, required string, alternatives long, asks int"


def _evidence(phrases: list[str], after: list[str]) -> tuple:
    """base_labels, labels, score, expressions, required, alternatives and asks of one text's places."""
    terms = [evaluate(parse_expression(x.lstrip(": \t"))[0]) for p, x in zip(phrases, after, strict=True) if p == TAG]
    terms = [t for t in terms if t.offered]
    base = {BASE[p] for p in phrases if p in BASE}
    more = {NOTICES[p] for p in phrases if p in NOTICES}
    offered, required = {i for t in terms for i in t.offered}, {i for t in terms for i in t.required}
    strength = len(offered) + len(required) + sum(0.5 if x in WEAK else 1.0 for x in base | more)
    alternatives, asks = 1, 0
    for t in terms:  # a text's expressions hold together
        alternatives, asks = min(alternatives * t.alternatives, 1 << 62), max(asks, t.asks)
    join = lambda x: ",".join(sorted(x))
    return join(base), join(base | more | offered), 1 - float(np.exp(-strength)), [i for t in terms for i in t.offered], join(required), alternatives if terms else 0, asks if terms else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds about 4 MB of text, or one longer text, and some ten arrays of its bytes and words."""
    found_by = automaton()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    kinds = [pa.string(), pa.string(), pa.float64(), strings, pa.string(), pa.int64(), pa.int32()]
    nothing = _evidence([], [])
    for batch in batches:
        data, offsets = K.utf8(batch.column(1))
        for a, b in K.chunks(offsets):
            m = b - a
            words, row, place, phrases, after = scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], found_by)
            is_base = np.array([p in BASE for p in phrases], bool)
            n_base = np.bincount(row[is_base], minlength=m)
            first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
            np.minimum.at(first, row[is_base], place[is_base])
            np.maximum.at(last, row[is_base], place[is_base])
            cut = np.searchsorted(row, np.arange(m + 1))
            found = [_evidence(phrases[x:y], after[x:y]) if y > x else nothing for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            ends = pa.array(cut, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(phrases, pa.string())).cast(strings), pa.ListArray.from_arrays(ends, pa.array(place, pa.int64())).cast(longs)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), *cols[:3], *lists, *cols[3:]], names=names)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License evidence of every whole text, one row for each: the columns of the schema above.

    A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII. n_base counts all places of the base
    phrases, first_word and last_word are their least and greatest start; base_labels and labels are distinct, sorted,
    joined by commas, and empty without any. labels adds notices and the identifiers of license expressions, which
    follow an identifier tag in its line. required are the identifiers that hold whichever alternative of the expressions
    is taken, alternatives their number (0 without an expression), asks how much the one that asks least asks (0 to 3;
    null without). score grows with the number of distinct labels, required identifiers counting twice, 0 without any.
    Null texts are empty, very long ones a piece of their own; null and repeated ids give a row each; an empty table
    gives none; no shuffle. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_rows, _SCHEMA)
