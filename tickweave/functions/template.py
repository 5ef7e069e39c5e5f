"""Text templates over frames, compiled to Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Names of tokens (fixed values).
TOKENS = (
    "nc nc-total nc-rem cc cc-total cc-rem tick tick-total tick-rem sec sec-max sec-rem time time-max time-rem time-milli time-milli-max time-milli-rem "
    "bpm ppqn plph plph-max nps nps-max cps cps-max beat beat-total beat-rem measure measure-total measure-rem measure-beat timesig"
).split()


@dataclass(frozen=True)
class Style:
    """Grouping of each kind of number, zero padding, and decimals of the tempo."""

    notes: bool = True
    cc: bool = False
    ticks: bool = True
    polyphony: bool = True
    nps: bool = True
    beats: bool = True
    seconds: bool = True
    padded: bool = False
    bpm_decimals: int = 2


def parse(line: str) -> list[tuple[str, bool]]:
    """Literals and token names in order; a name that is no token stays literal."""
    out: list[tuple[str, bool]] = []
    for part in re.split(r"(\{(?:%s)\})" % "|".join(map(re.escape, TOKENS)), line):
        if part:
            is_token = part[0] == "{" and part[1:-1] in TOKENS
            out.append((part[1:-1], True) if is_token else (part, False))
    return out


def token(name: str, style: Style = Style()) -> Column:
    """One token as text, from a frame's columns and its song's: total_notes, total_cc, total_ticks, ppqn, duration, total_beats, total_measures, max_num."""
    c = F.col
    width = lambda v: T.digits(v.cast("long")) if style.padded else 0
    plain = {"nc": ("cumulative_notes", "total_notes", style.notes), "cc": ("cumulative_cc", "total_cc", style.cc), "beat": ("beat", "total_beats", style.beats), "measure": ("measure", "total_measures", style.beats)}
    base, _, kind = name.partition("-")
    if base in plain and name != "measure-beat":
        now, total, group = plain[base]
        value = {"": c(now), "total": c(total), "rem": T.remaining(c(total), c(now))}[kind]
        return T.number(value, group, width(c(total)))
    rest = F.greatest(c("duration") - c("timestamp_sec"), F.lit(0.0))
    when = {"": c("timestamp_sec"), "max": c("duration"), "rem": rest}
    if base == "sec":
        return T.seconds(when[kind], style.seconds)
    if base == "time":
        return T.clock(when[kind.removeprefix("milli").removeprefix("-")], kind.startswith("milli"))
    if base == "tick":
        total = width(c("total_ticks"))
        return T.signed(c("tick"), style.ticks, total) if not kind else T.number(c("total_ticks") if kind == "total" else T.remaining(c("total_ticks"), c("tick")), style.ticks, total)
    return {
        "bpm": lambda: T.bpm(c("bpm"), style.bpm_decimals),
        "ppqn": lambda: c("ppqn").cast("string"),
        "plph": lambda: T.number(F.greatest(c("polyphony"), F.lit(0)), style.polyphony, width(c("peak_polyphony"))),
        "plph-max": lambda: T.number(F.greatest(c("peak_polyphony"), F.lit(0)), style.polyphony, width(c("peak_polyphony"))),
        "nps": lambda: T.rate(c("notes_per_second"), style.nps, width(F.round(c("peak_nps")))),
        "nps-max": lambda: T.rate(c("peak_nps"), style.nps, width(F.round(c("peak_nps")))),
        "cps": lambda: T.rate(c("cc_per_second"), style.cc, width(F.round(c("peak_cps")))),
        "cps-max": lambda: T.rate(c("peak_cps"), style.cc, width(F.round(c("peak_cps")))),
        "measure-beat": lambda: T.number(c("measure_beat"), False, width(c("max_num"))),
        "timesig": lambda: T.time_signature(c("ts_num"), c("ts_dd")),
    }[name]()


def render(line: str, style: Style = Style()) -> Column:
    """A template line as one Column."""
    parts = [token(t, style) if is_token else F.lit(t) for t, is_token in parse(line)]
    return F.concat(*parts) if parts else F.lit("")
