"""Placing blocks of text, as Column expressions, and the font features of typography options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_features

#: Anchors as on a number pad: 1 to 3 stand at the bottom, 3, 6 and 9 at the right (fixed values).
RIGHT, CENTRE, BOTTOM, MIDDLE = (3, 6, 9), (2, 5, 8), (1, 2, 3), (4, 5, 6)
#: Features by option (fixed values): off kerning and ligatures, slashed zero, kinds and widths of numerals.
NUMERALS, NUMERAL_WIDTHS, STYLISTIC_SETS = ("lnum", "onum"), ("pnum", "tnum"), 20


def place(width: Column, height: Column, anchor: Column, box: tuple[Column, Column, Column, Column], frame: tuple[Column, Column], margin: Column, pad: Column) -> tuple[Column, Column]:
    """Left and top of a block in its box (x, y, width, height; the frame if it has no size).

    The box is inset by the margin, or its centre line where that is too large; the block is then moved into the box if
    it fits there, and into the frame less the pad if it fits that, else to the frame's first corner.
    """
    whole = (box[2] <= 0) | (box[3] <= 0)
    out = []
    for own, at, size, room, far, near in ((width, box[0], box[2], frame[0], RIGHT, CENTRE), (height, box[1], box[3], frame[1], BOTTOM, MIDDLE)):
        start, size = F.when(whole, 0.0).otherwise(at), F.when(whole, room).otherwise(size)
        low, high = start + margin, start + size - margin
        middle = start + size / 2
        low, high = F.when(high < low, middle).otherwise(low), F.when(high < low, middle).otherwise(high)
        x = F.when(anchor.isin(*far), high - own).when(anchor.isin(*near), (low + high) / 2 - own / 2).otherwise(low)
        x = F.when(own <= size, F.greatest(start, F.least(x, start + size - own))).otherwise(x)
        x = F.greatest(pad, F.least(x, room - own - pad))
        out.append(F.when(own + 2 * pad > room, pad).otherwise(x))
    return out[0], out[1]


def line_offset(block_width: Column, line_width: Column, anchor: Column, line_align: Column) -> Column:
    """How far a line begins right of its block: by its own alignment (1 to 3) or its block's anchor."""
    side = F.when(line_align.between(1, 3), line_align + 6).otherwise(anchor)
    slack = block_width - line_width
    return F.when(side.isin(*RIGHT), slack).when(side.isin(*CENTRE), slack / 2).otherwise(0.0)


def fit_scale(width: Column, height: Column, box_width: Column, box_height: Column, margin: Column, pad: Column) -> Column:
    """The one scale at which every block fits its box less the margin, as an aggregate over blocks: at most 1, with 2 %
    headroom below that, at least 0.01. Blocks without a size do not count."""
    room = lambda size: F.when(size - 2 * margin > 0, size - 2 * margin).otherwise(size)
    own = F.when((width > 0) & (height > 0), F.least((room(box_width) - pad) / width, (room(box_height) - pad) / height))
    least = F.min(own)
    return F.when(least < 1, F.greatest(F.lit(0.01), least * 0.98)).otherwise(1.0)


def features(kerning: Column, ligatures: Column, slashed_zero: Column, numerals: Column, numeral_width: Column, stylistic_sets: Column, extra: Column) -> Column:
    """Font features of the options, in order, then those of the user's list that have the form of one.

    stylistic_sets has a bit for each set; a feature is a tag of up to four characters, with a sign, range or value.
    """
    chosen = [F.when(~kerning, "-kern"), F.when(~ligatures, "-liga"), F.when(slashed_zero, "zero")]
    chosen += [F.when(numerals == k + 1, F.lit(name)) for k, name in enumerate(NUMERALS)]
    chosen += [F.when(numeral_width == k + 1, F.lit(name)) for k, name in enumerate(NUMERAL_WIDTHS)]
    chosen += [F.when(F.shiftright(stylistic_sets, k).bitwiseAND(F.lit(1)) == 1, F.lit(f"ss{k + 1:02d}")) for k in range(STYLISTIC_SETS)]
    form = r"^[+-]?[A-Za-z0-9]{1,4}(\[\d*(:\d*)?\])?(=(\d+|on|off))?$"
    return F.concat(F.array_compact(F.array(*chosen)), F.filter(split_features(extra), lambda f: f.rlike(form)))


def saturated(value: Column, most: int = (1 << 63) - 1) -> Column:
    """A whole number of any size as a long, at most ``most``."""
    return F.least(value.cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)")).cast("long")
