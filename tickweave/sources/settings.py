"""Settings files: ``key = value`` lines to rows, rows to typed and clamped columns, and back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers by key: type, default, least, most, and whether a value outside is moved to the bound or replaced (fixed values).
NUMBERS = {
    "width": ("int", 1920, 1, None, "default"), "height": ("int", 1080, 1, None, "default"), "fps": ("double", 60.0, None, 1000.0, "clamp"),
    "start_delay": ("double", 3.0, 0.0, 3600.0, "clamp"), "end_delay": ("double", 0.0, 0.0, 3600.0, "clamp"),
    "ffmpeg_threads": ("int", 0, 0, None, "clamp"), "parse_threads": ("int", 0, 0, None, "clamp"),
    "dedup_mode": ("int", 0, 0, 2, "default"), "output_format": ("int", 0, 0, 1, "default"), "x264_crf": ("int", 18, 0, 51, "default"),
    "keyframe_seconds": ("double", 2.0, 0.1, 60.0, "default"), "log_height": ("double", 150.0, 60.0, 10000.0, "default"),
}
#: Switches and texts with their defaults (fixed values).
SWITCHES = {"vel0_note_off": True, "close_held_notes": False, "transparent_bg": False, "log_open": False}
TEXTS = {"midi_dir": "", "output_dir": ""}


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, key, value) of the settings files at path."""
    return parse_settings(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def parse_settings(files: DataFrame) -> DataFrame:
    """(file, text) to (file, line, key, value): lines that begin with a number sign or semicolon, or have no equals sign, are left out.

    A key loses the blanks after it, a value one space before it; a byte order mark and carriage returns at line ends go.
    """
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    lines = files.select("file", F.posexplode(F.split(clean, "\n")).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", r"\r+$", ""))
    kept = lines.where("raw <> '' and instr('#;', substr(raw, 1, 1)) = 0 and instr(raw, '=') > 0")
    return kept.select("file", "line", F.regexp_replace(F.regexp_extract("raw", r"(?s)^([^=]*)=", 1), r"[ \t]+$", "").alias("key"), F.regexp_replace(F.regexp_extract("raw", r"(?s)^[^=]*=(.*)$", 1), "^ ", "").alias("value"))


def _number(value: Column, kind: str) -> Column:
    """The number at the start of a text, null without one or if it is not finite."""
    form = r"^[ \t]*([+-]?\d+)" if kind == "int" else r"^[ \t]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    found = F.regexp_extract(value, form, 1)
    number = F.when(found != "", F.expr(f"try_cast(regexp_extract(value, r'{form}', 1) as {kind})"))
    return number if kind == "int" else F.when(F.abs(number) < float("inf"), number)


def settings(rows: DataFrame) -> DataFrame:
    """Rows of parse_settings() to one row for each file, with every setting typed, defaulted and in its range.

    The first of repeated keys holds. A file with the old switch track_dedup and no dedup_mode has mode 2 if it is on.
    """
    first = rows.groupBy("file", "key").agg(F.min_by("value", "line").alias("value"))
    typed = first.select("file", "key", "value", _number(F.col("value"), "int").alias("whole"), _number(F.col("value"), "double").alias("real"), F.col("value").isin("1", "true", "yes").alias("on"))
    of = lambda column, key: F.max(F.when((F.col("key") == key) & (F.col("value") != ""), F.col(column)))
    keys = {k: of("whole" if t[0] == "int" else "real", k) for k, t in NUMBERS.items()} | {k: of("on", k) for k in (*SWITCHES, "track_dedup")} | {k: of("value", k) for k in TEXTS}
    found = typed.groupBy("file").agg(*(c.alias(k) for k, c in keys.items()))
    mode = F.when(F.col("track_dedup"), 2).otherwise(0)

    def ranged(key: str) -> Column:
        kind, default, least, most, outside = NUMBERS[key]
        default = mode if key == "dedup_mode" else F.lit(default)
        c = F.coalesce(F.col(key), default)
        if key == "fps":
            return F.least(F.when(c <= 0, 60.0).otherwise(c), F.lit(1000.0))
        if outside == "clamp":
            c = F.greatest(c, F.lit(least)) if least is not None else c
            return (F.least(c, F.lit(most)) if most is not None else c).cast(kind)
        bad = (c < F.lit(least)) if most is None else ~c.between(least, most)
        return F.when(bad, F.lit(NUMBERS[key][1])).otherwise(c).cast(kind)

    return found.select("file", *(ranged(k).alias(k) for k in NUMBERS), *(F.coalesce(k, F.lit(d)).alias(k) for k, d in SWITCHES.items()), *(F.coalesce(k, F.lit(d)).alias(k) for k, d in TEXTS.items()))


def write_settings(df: DataFrame) -> DataFrame:
    """Rows of settings() to (file, text), which parse_settings() reads back."""

    def shown(key: str) -> Column:
        value = F.col(key)
        if key in SWITCHES:
            value = F.when(value, "1").otherwise("0")
        elif key in NUMBERS and NUMBERS[key][0] == "double":
            value = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
        return F.concat(F.lit(f"{key} = "), value.cast("string"))

    return df.select("file", F.concat_ws("\n", F.lit("# settings"), *map(shown, (*NUMBERS, *SWITCHES, *TEXTS)), F.lit("")).alias("text"))
