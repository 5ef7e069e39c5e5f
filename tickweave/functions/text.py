"""Formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def commas(s: Column) -> Column:
    """Group the digits of a number's text by threes, leading zeros too."""
    return F.regexp_replace(s, r"(?<=\d)(?=(\d{3})+$)", ",")


def pad(s: Column, width) -> Column:
    """Zeros in front up to width; never shorter than the text."""
    return F.lpad(s, F.greatest(F.length(s), width if isinstance(width, Column) else F.lit(width)), F.lit("0"))


def digits(v: Column) -> Column:
    """Digits of a number, negative ones as 0."""
    return F.length(F.greatest(v, F.lit(0)).cast("string"))


def number(v: Column, group: bool = False, width=0) -> Column:
    """A whole number: padded, then grouped."""
    s = pad(v.cast("long").cast("string"), width)
    return commas(s) if group else s


def remaining(total: Column, current: Column) -> Column:
    return F.greatest(total - current, F.lit(0))


def signed(v: Column, group: bool = False, width=0) -> Column:
    """A minus before the formatted size of the number."""
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), number(F.abs(v), group, width))


def seconds(v: Column, group: bool = False) -> Column:
    """Whole seconds, cut toward zero; what cuts to 0 has no sign."""
    whole = v.cast("long")
    return signed(whole, group)


def bpm(v: Column, decimals: int = 2) -> Column:
    """Fixed decimals, 0 to 6, halves to even on the binary value."""
    places = max(0, min(6, decimals))
    return F.call_function("format_number", v, F.lit("0" + ("." + "0" * places if places else "")))


def clock(v: Column, milli: bool = False) -> Column:
    """mm:ss, from an hour on h:mm:ss, with milliseconds if asked for; the sign in front."""
    size = F.abs(v)
    total = F.round(size * 1000).cast("long") if milli else size.cast("long") * 1000
    s = (total / 1000).cast("long")
    h, m, r = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit(":"))).otherwise(F.lit("")), two(m), F.lit(":"), two(r))
    if milli:
        text = F.concat(text, F.lit("."), F.lpad((total % 1000).cast("string"), 3, "0"))
    return F.concat(F.when((v < 0) & (total > 0), F.lit("-")).otherwise(F.lit("")), text)


def rate(v: Column, group: bool = False, width=0) -> Column:
    """A rate to the nearest whole number, not below 0."""
    return number(F.round(F.greatest(v, F.lit(0.0))), group, width)


def time_signature(num: Column, dd: Column) -> Column:
    return F.concat_ws("/", num.cast("string"), F.pow(F.lit(2.0), F.least(dd, F.lit(62))).cast("long").cast("string"))


def file_size(v: Column) -> Column:
    """Bytes, or the greatest of KiB to TiB with three significant digits."""
    out = F.concat(v.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        x = v / F.lit(float(1024**k))
        shown = F.when(x >= 100, F.call_function("format_number", x, F.lit("0"))).when(x >= 10, F.call_function("format_number", x, F.lit("0.0"))).otherwise(F.call_function("format_number", x, F.lit("0.00")))
        out = F.when(x >= 1, F.concat(shown, F.lit(" " + unit))).otherwise(out)
    return out


def size_rate(v: Column, secs: Column) -> Column:
    return F.when(secs <= 0, F.lit("0 B/s")).otherwise(F.concat(file_size((v / secs).cast("long")), F.lit("/s")))


def directory(path: Column) -> Column:
    """A path up to its last slash or backslash, which stays; without one, ./"""
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"^(?s)(.*[/\\])", 1)).otherwise(F.lit("./"))


def stem(path: Column) -> Column:
    """The last part of a path without what follows its last dot."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def split_features(s: Column) -> Column:
    return F.filter(F.split(s, r"[ ,;\t\n\r]+"), lambda x: x != "")


def colour(s: Column) -> Column:
    """&HAABBGGRR text to RRGGBBAA hex, where AA 00 is opaque; anything else is white."""
    hexes = F.upper(F.lpad(F.regexp_extract(s, r"^&[Hh]([0-9A-Fa-f]{6,8})&?$", 1), 8, "0"))
    part = lambda k: F.substring(hexes, k, 2)
    alpha = F.lpad(F.hex(F.lit(255) - F.conv(part(1), 16, 10).cast("int")), 2, "0")
    return F.when(s.rlike(r"^&[Hh][0-9A-Fa-f]{6,8}&?$"), F.concat(part(7), part(5), part(3), alpha)).otherwise(F.lit("FFFFFFFF"))


def escape_newlines(s: Column) -> Column:
    """Backslashes doubled, newlines as backslash n, carriage returns dropped."""
    return F.replace(F.replace(F.replace(s, F.lit("\r"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_newlines(s: Column) -> Column:
    """escape_newlines() undone; other backslashes stay."""
    held = F.lit("\x00")
    return F.replace(F.replace(F.replace(s, F.lit("\\\\"), held), F.lit("\\n"), F.lit("\n")), held, F.lit("\\"))


#: Device names that cannot be file names (fixed values).
DEVICES = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "LPT1", "LPT2", "LPT3")


def clean_name(s: Column) -> Column:
    """A name fit for a file: reserved characters become underscores, controls go, ends are trimmed, device names get _pattern."""
    got = F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|]', "_"), r"[\x00-\x1f]", "")
    got = F.regexp_replace(got, r"^[ \t]+|[ \t]+$", "")
    return F.when(F.upper(got).isin(*DEVICES), F.concat(got, F.lit("_pattern"))).otherwise(got)


def compressed_kind(head: Column) -> Column:
    """The compression that a file's first bytes name, or null."""
    out = F.lit(None).cast("string")
    # fixed values: magic numbers
    for kind, magic in (("lz4", "04224D18"), ("zstd", "28B52FFD"), ("bz2", "425A68"), ("gz", "1F8B"), ("rar", "526172211A07"), ("xz", "FD377A585A00"), ("7z", "377ABCAF271C")):
        out = F.when(F.hex(F.substring(head, 1, len(magic) // 2)) == magic, F.lit(kind)).otherwise(out)
    return out


def is_cell_file(path: Column) -> Column:
    """Whether the last part of a path holds .cjcmcg, in any case."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)).contains(".cjcmcg")


def layout_lines(text: Column) -> Column:
    """(pos, line) of the lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"] != "")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def timescale(fps: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.round(fps * 1000).cast("long"))


def digit_variants(s: Column) -> Column:
    """The text with all its digits replaced by 0, by 1, ... by 9."""
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.regexp_replace(s, F.lit("[0-9]"), d.cast("string")))
