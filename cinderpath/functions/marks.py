"""The mark type: times, distances and status codes as typed values with one sort key (MRK-1 to MRK-4).

All of it is native column expressions, evaluated once into the columns ``m`` and ``k`` and ordered by them everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mark that begins with one of these has no value.
STATUS = ("DNF", "DNS", "DQ", "NH", "ND", "SCR", "FOUL", "X")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, as lenient parsers read it; null if none. Plain numbers are cast, only others are searched."""
    plain = F.when(without(text, "0123456789.") == "", text.try_cast("double"))
    return F.coalesce(plain, F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))


def parse_mark(mark: Column, zero: bool = False) -> Column:
    """MRK-1: struct(value, is_time, valid). Distances in inches, times in seconds; whatever has no value is an invalid time of 0.

    Plain texts (7.40, 1:02.87, 5-08.00) are split and cast; patterns are for the others. ``zero``: whether a time that is written out as
    nought (0.00) is a value, as in tables of measurements; in printed results it stands for none.
    """
    text = F.upper(F.trim(F.coalesce(mark, F.lit(""))))
    status = text == ""
    for code in STATUS:
        status = status | text.startswith(code)
    distance = (without(text, "'\"-") != text) & (without(text, "0123456789") != text)
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    feet = F.coalesce(part(r"^(\d+)['-]"), part(r"(\d+)'")).try_cast("double")
    inches = F.coalesce(part(r"['\-\s](\d+(?:\.\d+)?)"), part(r"(\d+(?:\.\d+)?)\"")).try_cast("double")
    before, after = F.substring_index(text, "-", 1), F.substring_index(text, "-", -1)
    two = (F.length(without(text, "0123456789.")) == 1) & (before != "") & (without(before, "0123456789") == "") & ~after.startswith(".")
    plain = F.when(two & text.contains("-"), before.try_cast("double") * 12 + after.try_cast("double"))
    length = F.coalesce(plain, F.coalesce(feet * 12, F.lit(0.0)) + F.coalesce(inches, F.lit(0.0)))
    clock = F.reverse(F.split(text, ":"))
    unit = lambda i, factor: F.when(F.size(clock) > i, number_prefix(F.get(clock, F.lit(i))) * factor).otherwise(F.lit(0.0))
    seconds = F.when(text.contains(":"), unit(0, 1) + unit(1, 60) + unit(2, 3600)).otherwise(number_prefix(text))
    value = F.when(status, 0.0).when(distance, length).otherwise(F.coalesce(seconds, F.lit(0.0)))
    return F.struct(value.alias("value"), (status | ~distance).alias("is_time"), (~status & (distance | (seconds.isNotNull() if zero else value != 0))).alias("valid"))


def mark_key(m: Column) -> Column:
    """MRK-2: struct(invalid, directed); a is better than b exactly if key(a) < key(b)."""
    directed = F.when(~m["valid"], F.lit(0.0)).when(m["is_time"], m["value"]).otherwise(-m["value"])
    return F.struct((~m["valid"]).alias("invalid"), directed.alias("directed"))


def with_marks(df: DataFrame, mark: str = "mark", zero: bool = False) -> DataFrame:
    """Adds ``m`` (parsed) and ``k`` (sort key); rows that have both keep them."""
    if {"m", "k"} <= set(df.columns):
        return df
    return df.withColumn("m", parse_mark(F.col(mark), zero)).withColumn("k", mark_key(F.col("m")))


def format_time(seconds: Column) -> Column:
    """MRK-3: s.ff below a minute, else m:ss.ff."""
    rest = F.format_string("%.2f", seconds % 60)
    return F.when(seconds < 60, F.format_string("%.2f", seconds)).otherwise(F.concat_ws(":", F.floor(seconds / 60).cast("string"), F.lpad(rest, 5, "0")))


def format_distance(inches: Column) -> Column:
    return F.concat(F.floor(inches / 12).cast("string"), F.lit("' "), F.format_string("%.2f", inches % 12), F.lit('"'))


def format_improvement(new: Column, old: Column) -> Column:
    """MRK-4: -0.45s for times, +6.00" for distances; both arguments are parsed marks."""
    time = F.format_string("-%.2fs", F.round(old["value"] - new["value"], 2))
    return F.when(new["is_time"], time).otherwise(F.format_string('+%.2f"', F.round(new["value"] - old["value"], 2)))
