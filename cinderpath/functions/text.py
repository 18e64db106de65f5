"""Text helpers shared by the parsers and the cleansing rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The line ends that the parsers split at.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Standard event names, in order.
STANDARD_EVENTS = (
    "55 Meter Dash", "200 Meter Dash", "400 Meter Dash", "800 Meter Run", "1 Mile Run", "2 Mile Run", "55 Meter Hurdles",
    "55 Yard Hurdles", "High Jump", "Long Jump", "Triple Jump", "Pole Vault", "Shot Put", "600 Meter Run", "1000 Meter Run",
    "1600 Meter Run", "3200 Meter Run", "4x200 Meter Relay", "4x400 Meter Relay", "4x800 Meter Relay", "Indoor Pentathlon",
    "Racewalk", "100 Meter Dash", "110 Meter Hurdles", "100 Meter Hurdles", "300 Meter Hurdles", "400 Meter Hurdles",
    "Javelin Throw", "Discus Throw",
)
#: What is cut off an event name, in order.
EVENT_SUFFIXES = (
    r"\s+Meet\s+[A-Z].*", r"\s+Small\s+School.*", r"\s+Large\s+School.*", r"\s+Open\s+Division.*", r"\s+Division\s+[1-4].*",
    r"\s+CLASS\s+[A-C].*", r"\s+JR\s+DIV.*", r"\s+INT\s+DIV.*", r"\s+SR\s+DIV.*", r"\s+Jr\.\s+Division.*", r"\s+Sr\.\s+Division.*",
    r"\s+Junior\s+Div.*", r"\s+Senior\s+Div.*", r"\s+Team\s+Scores.*", r"\s+OPEN\s+DIV.*", r"\s+sionon.*", r"\s+idual.*",
    r"\s+chool.*", r"\s+hool.*", r"\s+-\s*IN$", r"\s+IN$", r"\s+Relay\s+Relay",
)


def lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row per line: the kept columns, pos (from 0) and line."""
    return df.select(*keep, F.posexplode(F.split(text, LINE_END)).alias("pos", "line"))


def carried(value: Column, keys: list[str], order: str) -> Column:
    """WIN-8: the last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def block_number(header: Column, keys: list[str], order: str) -> Column:
    """WIN-9: the number of headers up to the row; rows above the first one have 0. A null or false is no header."""
    return F.count(F.when(header, 1)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def first_match(value: Column, entries: list[tuple[str, str]], how: str = "prefix") -> Column:
    """JOIN-6/7: the value of the first entry whose key is a case-insensitive prefix of, or contained in, ``value``; null if none.

    The list is configuration, so it is a literal array inside the row and no join at all; its order decides.
    """
    if not entries:
        return F.lit(None).cast("string")
    table = F.array(*[F.struct(F.lit(key.lower()).alias("key"), F.lit(full).alias("full")) for key, full in entries])
    test = (lambda e: F.startswith(F.lower(value), e["key"])) if how == "prefix" else (lambda e: F.contains(F.lower(value), e["key"]))
    return F.get(F.filter(table, test), F.lit(0))["full"]


def normalise_event(name: Column, standard: tuple[str, ...] = STANDARD_EVENTS) -> Column:
    """PAR-1: the longest standard name that the name contains, the first of equal ones; else the name."""
    ranked = sorted(standard, key=lambda s: -len(s))  # stable
    return F.coalesce(first_match(name, [(s, s) for s in ranked], "contains"), name)


def clean_event(name: Column) -> Column:
    """PAR-19e: an event name without number, division and other endings."""
    name = F.regexp_replace(name, r"(?i)^Event\s+\d+\s+", "")
    name = reduce(lambda c, s: F.trim(F.regexp_replace(c, f"(?i){s}", "")), EVENT_SUFFIXES, name)
    return F.trim(F.regexp_replace(name, r"\s+[A-Z]School$", ""))


def display_date(date: Column) -> Column:
    """PRJ-13: an ISO date and time without its time."""
    return F.substring_index(date, "T", 1)


def date_from_text(text: Column) -> Column:
    """A date from ``December 27, 2025``, ``Dec 20-22, 2025`` (its first day), ``1/10/2025`` or ISO text; null if none."""
    text = F.regexp_replace(F.trim(text), r"(\d{1,2})-\d{1,2},", "$1,")
    return F.coalesce(*[F.try_to_date(text, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")])
