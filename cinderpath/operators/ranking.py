"""Places in ordered groups of any size, without a task that holds a whole group.

A window over a group sorts it in one task, which a group with a third of all rows doesn't allow. Here rows are range-partitioned by
group and order, so a large group lies in many partitions one after another. Each partition numbers its rows, the counts of the
partitions before it (a row for each partition and group in it) give the offset.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import narrow, stored


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table`` by equal keys, nulls equal; ``table`` has each key once and no other column of ``rows``."""
    table = table.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    return rows.join(table, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]), how).drop(*[f"_key_{c}" for c in keys])


def indexed(df: DataFrame, group: list[str], order: list[str], name: str = "index", label: str = "indexed") -> DataFrame:
    """Adds ``name``: the place of a row in its group from 0, in ascending ``order`` (null first). The order is over plain columns.

    Rows that are equal in group and order stay together in one partition; among themselves their order is arbitrary. Without a group,
    all rows are one. One shuffle and a written table; the offsets are broadcast if their number is small, else joined.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), label)
    heads = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = narrow(heads.select(*group, "_part", (F.col("_from") - F.coalesce(before, F.lit(0))).alias("_base")))
    return looked_up(rows, heads, [*group, "_part"], "inner").select(*df.columns, (F.col("_at") - F.col("_base")).alias(name))


def running(df: DataFrame, group: str, at: str, values: dict[str, tuple[str, str]], block: int = 1024, backwards: bool = False) -> DataFrame:
    """Adds running values over each group by ``at`` (a distinct number from 0 up in its group): new column -> (``sum`` or ``bit_xor``, column).

    Blocks of ``block`` rows run by themselves; what the blocks before hand on is a row for each block of the groups that go beyond the first. ``df`` is read
    three times, so it should be a written table.
    Backwards, a row's value takes in what comes after it.
    """
    kinds = {"sum": F.sum, "bit_xor": F.bit_xor}
    put = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    rows = df.withColumn("_block", F.floor(F.col(at) / block).cast("long"))
    order = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    inside = Window.partitionBy(group, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[kinds[k](c).over(inside).alias(f"_in_{name}") for name, (k, c) in values.items()])
    beyond = narrow(rows.where(F.col(at) >= block).select(group).distinct())
    totals = rows.join(beyond, group, "left_semi").groupBy(group, "_block").agg(*[kinds[k](c).alias(f"_all_{name}") for name, (k, c) in values.items()])
    earlier = Window.partitionBy(group).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(group, "_block", *[kinds[k](f"_all_{name}").over(earlier).alias(f"_on_{name}") for name, (k, _) in values.items()])
    out = looked_up(within, narrow(carried), [group, "_block"])
    return out.select(*df.columns, *[put[k](F.col(f"_in_{name}"), F.coalesce(F.col(f"_on_{name}"), F.lit(0).cast("long"))).alias(name) for name, (k, _) in values.items()])
