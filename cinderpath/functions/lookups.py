"""Lookup lists of any length by equi-joins: equality, prefix and containment, the first entry that fits (JOIN-4, 6, 7, PRJ-3, 4).

Short lists are literal arrays in the row (``text.first_match``). Here a value is cut into every text that could be a key - itself, its
prefixes or its parts, of the lengths that keys have - and these meet the keys by equality. Each different value is cut once, so a value
of a third of all rows costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import indexed, looked_up
from ..tables import narrow


def looked_up_first(rows: DataFrame, value: str, entries: DataFrame, name: str, how: str = "equal") -> DataFrame:
    """``rows`` with ``name``: what the first entry says whose key fits ``value`` without regard to case; null if none does.

    entries: ord, key, full; of equal ord the lesser ``full``. ``how``: equal, prefix (an empty key fits everything) or contains. Only
    the different lengths of keys come to the driver, so one number for each length up to the longest key's.

    Keys are numbered in the order of their entries. The least number of a value is kept by hash, so the many keys that fit it are never
    sorted; the text of an entry is looked up once for each value.
    """
    keys = entries.where("key IS NOT NULL").groupBy(F.lower("key").alias("_key")).agg(F.min(F.struct("ord", "full")).alias("_entry")).select("_key", "_entry.ord", "_entry.full")
    keys = indexed(keys, [], ["ord", "full"], "_n", "lookup-keys")
    values = rows.select(F.col(value).alias("_value")).where("_value IS NOT NULL").distinct()
    low = F.lower("_value")
    if how == "equal":
        met = values.withColumn("_key", low)
    else:
        lengths = sorted(r[0] for r in keys.select(F.length("_key")).distinct().collect())
        fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(low))
        prefixes = F.transform(fitting, lambda n: F.substring(low, F.lit(1), n))
        parts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))))
        met = values.select("_value", F.explode(prefixes if how == "prefix" else F.array_distinct(parts)).alias("_key"))
    first = met.join(narrow(keys.select("_key", "_n")), "_key").groupBy("_value").agg(F.min("_n").alias("_n"))
    first = first.join(keys.select("_n", "full"), "_n").select(F.col("_value").alias(value), F.col("full").alias(name))
    return looked_up(rows, first, [value])


def fitting_entry(rows: DataFrame, value: str, entries: DataFrame, name: str, how: str, otherwise: Column) -> DataFrame:
    """``looked_up_first`` with a value for rows without an entry."""
    return looked_up_first(rows, value, entries, "_found", how).withColumn(name, F.coalesce("_found", otherwise)).drop("_found")
