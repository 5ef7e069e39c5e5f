"""The frame divided into boxes: an immutable tree of columns and rows, its text form, and edits that give a new tree.

A box is known by its number in reading order. A layout is a handful of boxes, so it lives on the driver; box_rows() gives
it as rows for a DataFrame.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from itertools import accumulate

#: Least share of the frame that a divider leaves to a part, parts of a split and depth of its text form at most.
LEAST, PARTS, DEPTH = 0.02, 256, 64
_EPS = 1e-9
_WORD = re.compile(r"[CR]\(|[B,)]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?:")


@dataclass(frozen=True)
class Box:
    text: str = ""
    anchor: int = 7
    line_align: int = 0


@dataclass(frozen=True)
class Split:
    """kind is C (columns, side by side) or R (rows); weights are the parts' shares and sum to 1."""

    kind: str
    weights: tuple[float, ...]
    parts: tuple[Node, ...]


Node = Box | Split
Rect = tuple[float, float, float, float]
WHOLE: Rect = (0.0, 0.0, 1.0, 1.0)


def split_of(kind: str, weighted: list[tuple[float, Node]]) -> Node:
    """A split in normal form: parts of the same direction join it, one part alone is itself, weights sum to 1."""
    flat: list[tuple[float, Node]] = []
    for weight, part in weighted:
        weight = weight if weight > 0 and math.isfinite(weight) else 1e-6
        flat += [(weight * w, p) for w, p in zip(part.weights, part.parts, strict=True)] if isinstance(part, Split) and part.kind == kind else [(weight, part)]
    if not flat:
        return Box()
    if len(flat) == 1:
        return flat[0][1]
    whole = sum(w for w, _ in flat)
    scale = 1.0 if abs(whole - 1) <= 1e-12 else whole  # so that an edit undone gives the same tree
    return Split(kind, tuple(w / scale for w, _ in flat), tuple(p for _, p in flat))


def _spans(node: Split, rect: Rect) -> list[Rect]:
    axis = 0 if node.kind == "C" else 1
    start, end = rect[axis], rect[axis + 2]
    edges = [start, *accumulate(node.weights[:-1], lambda at, w: at + w * (end - start), initial=start)][1:] + [end]
    return [(a, rect[1], b, rect[3]) if axis == 0 else (rect[0], a, rect[2], b) for a, b in zip(edges, edges[1:], strict=False)]


def walk(node: Node, rect: Rect = WHOLE, path: tuple[int, ...] = ()):
    """(path, rectangle, node) of the tree, parents first, in reading order."""
    yield path, rect, node
    if isinstance(node, Split):
        for k, (part, own) in enumerate(zip(node.parts, _spans(node, rect), strict=True)):
            yield from walk(part, own, (*path, k))


def leaves(node: Node) -> list[tuple[tuple[int, ...], Rect, Box]]:
    return [x for x in walk(node) if isinstance(x[2], Box)]


def box_rows(node: Node) -> list[tuple]:
    """(index, x0, y0, x1, y1, anchor, line_align, text) of the boxes."""
    return [(k, *rect, box.anchor, box.line_align, box.text) for k, (_, rect, box) in enumerate(leaves(node))]


def box_at(node: Node, x: float, y: float) -> int:
    """Number of the first box that holds a point, -1 outside."""
    return next((k for k, (_, r, _) in enumerate(leaves(node)) if r[0] <= x <= r[2] and r[1] <= y <= r[3]), -1)


def _get(node: Node, path: tuple[int, ...]) -> Node:
    for k in path:
        node = node.parts[k]
    return node


def _put(node: Node, path: tuple[int, ...], new: Node) -> Node:
    """The tree with another node at a path, in normal form."""
    if not path:
        return new
    parts = [_put(p, path[1:], new) if k == path[0] else p for k, p in enumerate(node.parts)]
    return split_of(node.kind, list(zip(node.weights, parts, strict=True)))


def _path(node: Node, number: int) -> tuple[int, ...]:
    found = leaves(node)
    if not 0 <= number < len(found):
        raise IndexError(f"no box {number}")
    return found[number][0]


def split(node: Node, number: int, kind: str, n: int) -> Node:
    """Divide a box into n equal parts; the first keeps its content."""
    if kind not in ("C", "R") or not 2 <= n <= 16:
        raise ValueError("2 to 16 columns or rows")
    path = _path(node, number)
    return _put(node, path, split_of(kind, [(1 / n, _get(node, path)), *((1 / n, Box()) for _ in range(n - 1))]))


def insert(node: Node, number: int, side: str) -> tuple[Node, int]:
    """An empty box beside a box (left, above, right, below), on half its room: the tree and the new box's number."""
    kind, first = {"left": ("C", True), "above": ("R", True), "right": ("C", False), "below": ("R", False)}[side]
    path = _path(node, number)
    pair = [(0.5, Box()), (0.5, _get(node, path))]
    return _put(node, path, split_of(kind, pair if first else pair[::-1])), number if first else number + 1


def remove(node: Node, number: int, prefer: int = -1) -> tuple[Node, int]:
    """Give a box's room to the part before it, or after it if it is the first, or to the box ``prefer`` if that is beside it: the tree and the number of a box beside the gap."""
    path = _path(node, number)
    if not path:
        raise ValueError("the only box stays")
    parent, k = _get(node, path[:-1]), path[-1]
    heir = k - 1 if k else 1
    if 0 <= prefer < len(leaves(node)) and prefer != number:
        other = _path(node, prefer)
        if other[:-1] == path[:-1] and abs(other[-1] - k) == 1:
            heir = other[-1]
    weights = list(parent.weights)
    weights[heir] += weights[k]
    left = [(w, p) for j, (w, p) in enumerate(zip(weights, parent.parts, strict=True)) if j != k]
    return _put(node, path[:-1], split_of(parent.kind, left)), number - 1 if heir < k else number


def equalize(node: Node, number: int) -> Node:
    """The parts of the split that a box stands in at equal shares."""
    path = _path(node, number)
    if not path:
        raise ValueError("the only box has no split")
    parent = _get(node, path[:-1])
    return _put(node, path[:-1], replace(parent, weights=(1 / len(parent.parts),) * len(parent.parts)))


@dataclass(frozen=True)
class Divider:
    """The line between parts k and k + 1 of the split at a path: its place, its ends across, and where it may go."""

    path: tuple[int, ...]
    k: int
    kind: str
    place: float
    low: float
    high: float
    range: tuple[float, float] = field(default=(0.0, 1.0))


def dividers(node: Node) -> list[Divider]:
    out = []
    for path, rect, own in walk(node):
        if isinstance(own, Split):
            axis = 0 if own.kind == "C" else 1
            spans = _spans(own, rect)
            for k, (a, b) in enumerate(zip(spans, spans[1:], strict=False)):
                at = a[axis + 2]
                out.append(Divider(path, k, own.kind, at, rect[1 - axis], rect[3 - axis], (min(at, a[axis] + LEAST), max(at, b[axis + 2] - LEAST))))
    return out


def edge_divider(node: Node, number: int, side: str) -> Divider | None:
    """The divider along the whole of one edge of a box."""
    rect = leaves(node)[number][1]
    kind, at = {"left": ("C", 0), "above": ("R", 1), "right": ("C", 2), "below": ("R", 3)}[side]
    low, high = (rect[1], rect[3]) if kind == "C" else (rect[0], rect[2])
    fits = lambda d: d.kind == kind and abs(d.place - rect[at]) < _EPS and d.low <= low + _EPS and d.high >= high - _EPS
    return next(filter(fits, dividers(node)), None)


def move(node: Node, divider: Divider, place: float) -> Node:
    """The divider at another place, between the ends of its two parts less the least share, or their middle."""
    rect, own = next((r, n) for p, r, n in walk(node) if p == divider.path)
    axis = 0 if own.kind == "C" else 1
    spans, length = _spans(own, rect), rect[axis + 2] - rect[axis]
    start, end = spans[divider.k][axis], spans[divider.k + 1][axis + 2]
    middle = (start + end) / 2
    place = max(min(start + LEAST, middle), min(max(end - LEAST, middle), place))
    weights = list(own.weights)
    pair = weights[divider.k] + weights[divider.k + 1]
    weights[divider.k] = (place - start) / length
    weights[divider.k + 1] = pair - weights[divider.k]
    return _put(node, divider.path, replace(own, weights=tuple(weights)))


def from_rect(rect: Rect, box: Box) -> Node:
    """A tree in which one box has this rectangle of the frame and empty boxes have the rest."""
    x0, y0, x1, y1 = (min(1.0, max(0.0, v)) for v in (rect[0], rect[1], max(rect[0], rect[2]), max(rect[1], rect[3])))
    node: Node = box
    for kind, a, b in (("R", y0, y1), ("C", x0, x1)):
        if b - a > _EPS:
            node = split_of(kind, [(w, p) for w, p in ((a, Box()), (b - a, node), (1 - b, Box())) if w > _EPS])
    return node


def write(node: Node) -> str:
    """The structure as text: B for a box, C(...) and R(...) for splits, with a weight before each part."""
    if isinstance(node, Box):
        return "B"
    return f"{node.kind}({','.join(f'{w:.9g}:{write(p)}' for w, p in zip(node.weights, node.parts, strict=True))})"


def read(text: str) -> Node:
    """The tree of a structure's text, white space aside, with empty boxes; ValueError where it is none."""
    text = re.sub(r"[ \t\r\n]", "", text)
    words = _WORD.findall(text)
    if "".join(words) != text:
        raise ValueError("not a structure")
    stack: list[tuple[str, list[tuple[float, Node]]]] = [("", [])]
    weight: float | None = None
    state = "part"  # what must come: a part, a weight, or a comma or the end
    for word in words:
        if state == "weight" and word.endswith(":"):
            weight, state = float(word[:-1]), "part"
            if not (weight > 0 and math.isfinite(weight)):
                raise ValueError("a weight must be above 0")
            stack[-1][1].append((weight, Box()))
        elif state == "part" and word == "B":
            state = "next"
            if len(stack) == 1:
                stack[0][1].append((1.0, Box()))
        elif state == "part" and word.endswith("("):
            stack.append((word[0], []))
            state = "weight"
            if len(stack) > DEPTH + 1:
                raise ValueError("too deep")
        elif state == "next" and word == "," and len(stack) > 1:
            state = "weight"
        elif state == "next" and word == ")" and len(stack) > 1:
            kind, parts = stack.pop()
            if len(parts) > PARTS:
                raise ValueError("too many parts")
            done = split_of(kind, parts)
            if len(stack) == 1:
                stack[0][1].append((1.0, done))
            else:
                stack[-1][1][-1] = (stack[-1][1][-1][0], done)
        else:
            raise ValueError(f"unexpected {word!r}")
    if len(stack) != 1 or len(stack[0][1]) != 1 or state != "next":
        raise ValueError("not a structure")
    return stack[0][1][0][1]
