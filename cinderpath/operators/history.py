"""Athletes' histories: first appearance, personal and season best, facets, sorting, statistics (WIN-1 to 3, AGG-7, 8, 14, FIL-8, SRT-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import with_marks


def season_parts(year: Column, season: Column) -> tuple[Column, Column]:
    """PRJ-7: year and season, also where the season is written ``2026 Indoor``; Unknown if missing."""
    combined = season.rlike(r"^\d{4}\s+.*$")
    return (
        F.coalesce(F.when(combined, F.regexp_extract(season, r"^(\d{4})\s+(.*)$", 1)).otherwise(year), F.lit("Unknown")),
        F.coalesce(F.when(combined, F.regexp_extract(season, r"^(\d{4})\s+(.*)$", 2)).otherwise(season), F.lit("Unknown")),
    )


def milestones(perf: DataFrame) -> DataFrame:
    """``perf`` with m, k, is_first, is_pr, is_sb. One shuffle: the season-best window's keys extend the others'.

    The flags are computed over all rows given; filter afterwards.
    """
    keys = ["athlete_id", "event", "season"]
    by_date = Window.partitionBy(*keys).orderBy(F.col("date").asc_nulls_last(), "id")
    best = [F.col("k.invalid"), F.col("k.directed"), F.col("date").asc_nulls_last(), F.col("id")]
    first = lambda w: F.row_number().over(w) == 1
    flagged = with_marks(perf).withColumn("is_first", first(by_date)).withColumn("is_pr", first(Window.partitionBy(*keys).orderBy(*best)))
    return flagged.withColumn("is_sb", first(Window.partitionBy(*keys, "year").orderBy(*best)))


def matching(filters: dict[str, str | None]) -> Column:
    """FIL-1, FIL-8: equality with every filter that isn't absent or ``All``."""
    used = [F.col(c) == v for c, v in filters.items() if v not in (None, "All")]
    return reduce(lambda a, b: a & b, used, F.lit(True))


def facets(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """AGG-14: facet, option - the options of each facet under all the *other* filters, in one pass over the rows."""
    offers = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option"), F.coalesce(matching({k: v for k, v in filters.items() if k != c}), F.lit(False)).alias("ok")) for c in filters]
    return df.select(F.explode(F.array(*offers)).alias("o")).where("o.ok AND o.option IS NOT NULL").select("o.facet", "o.option").distinct()


def history(df: DataFrame, by: str = "date", descending: bool = True, prs_only: bool = False) -> DataFrame:
    """SRT-2, FIL-9: milestones in the user's order - newest or best first if descending, invalid marks then last."""
    rows = df.where("is_pr") if prs_only else df
    order = [F.col("date").desc_nulls_last() if descending else F.col("date").asc_nulls_last()] if by == "date" else [c.asc() if descending else c.desc() for c in (F.col("k.invalid"), F.col("k.directed"))]
    return rows.orderBy(*order, "id")


def profile(perf: DataFrame) -> DataFrame:
    """AGG-7: per athlete and event over valid marks - best_mark, best, upper_median, sigma (population), n.

    Rows are counted by value first, without lists: a value's rows become one before the shuffle, and all the rest works on the different
    values. The median is the least value at which the running count passes half, the deviation is over values with their counts.
    """
    rows = with_marks(perf).select("athlete_id", "event", "mark", "date", "id", "m.valid", "m.value", "k.directed")
    # validity is asked after the aggregation: a filter before it would make Spark read each mark twice, in more code than it compiles
    values = rows.groupBy("athlete_id", "event", "valid", "directed", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("date", "id", "mark")).alias("first"), F.max("valid").alias("_valid"))
    values = values.where("_valid").drop("valid", "_valid")
    whole = Window.partitionBy("athlete_id", "event")
    total, passed = F.sum("n").over(whole), F.sum("n").over(whole.orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    told = values.withColumns({"total": total, "passed": passed, "mean": F.sum(F.col("value") * F.col("n")).over(whole) / total})
    best = F.min(F.struct("directed", F.col("first.date").alias("date"), F.col("first.id").alias("id"), F.col("first.mark").alias("mark"), "value")).alias("b")
    found = told.groupBy("athlete_id", "event").agg(
        best, F.min(F.when(F.col("passed") > F.floor(F.col("total") / 2), F.col("value"))).alias("upper_median"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2))) / F.max("total")).alias("sigma"), F.max("total").alias("n"),
    )
    return found.select("athlete_id", "event", F.col("b.mark").alias("best_mark"), F.col("b.value").alias("best"), "upper_median", "sigma", "n")


def series(perf: DataFrame) -> DataFrame:
    """AGG-8: per athlete, event and year the dated values in order. A line of a chart is a list in the end: an athlete's marks of one event and year."""
    rows = with_marks(perf).select("athlete_id", "event", "year", "date", "id", "m.value", "m.valid")
    points = F.sort_array(F.collect_list(F.when(F.col("valid"), F.struct("date", "id", "value"))))
    return rows.groupBy("athlete_id", "event", "year").agg(points.alias("points")).where(F.size("points") > 0)
