"""Improvements on the previous best (WIN-4, JOIN-8, JOIN-9, AGG-12, AGG-15, LIM-3): windows over days, no self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import format_improvement, with_marks
from .scoring import best_per_group


def _seen(perf: DataFrame) -> DataFrame:
    """Every row with the best of its athlete and event on earlier days (``prev_best_day``) and before the row (``old_pr``)."""
    keys = Window.partitionBy("athlete_id", "event")
    rows = with_marks(perf).withColumn("_day", F.datediff("day", F.lit("1970-01-01")))
    packed = F.struct("k.invalid", "k.directed", "date", "id", "m", "mark")
    return rows.withColumns(
        {"prev_best_day": F.min(packed).over(keys.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)), "old_pr": F.min(packed).over(keys.orderBy("date", "id").rowsBetween(Window.unboundedPreceding, -1))}
    )


def _improved(best: DataFrame) -> DataFrame:
    better = F.struct("k.invalid", "k.directed") < F.struct("prev_best_day.invalid", "prev_best_day.directed")
    improvement = F.when(F.col("old_pr.m.valid"), format_improvement(F.col("m"), F.col("old_pr.m"))).otherwise("")
    return best.where(F.col("prev_best_day").isNotNull() & better).withColumn("improvement", improvement)


def pr_pops(perf: DataFrame) -> DataFrame:
    """The best row of each athlete, event and day that beats all earlier days, with ``prev_best_day`` and ``old_pr``.

    ``prev_best_day`` is the best of earlier days, ``old_pr`` the best of all earlier performances, the same day's included.
    """
    return _improved(best_per_group(_seen(perf), "athlete_id", "event", "day"))


def meet_pops(perf: DataFrame, meets: DataFrame) -> DataFrame:
    """FIL-12: ``pr_pops`` of the rows of chosen meets (team, meet_name, day) only, against whatever was done anywhere before."""
    chosen = _seen(perf).join(meets.select("team", "meet_name", "day").distinct(), ["team", "meet_name", "day"], "left_semi")
    return _improved(best_per_group(chosen, "athlete_id", "event", "team", "meet_name", "day"))


def latest_meets(perf: DataFrame) -> DataFrame:
    """LIM-3: team, meet_name, day: the latest meet of each team."""
    return perf.where("date IS NOT NULL").groupBy("team").agg(F.max_by("meet_name", F.struct("date", "id")).alias("meet_name"), F.max("day").alias("day"))


def pop_summary(pops: DataFrame) -> DataFrame:
    """AGG-12: per athlete the improvements in order, and their number."""
    listed = F.sort_array(F.collect_list(F.struct("day", "event", "mark", "improvement")))
    return pops.groupBy("athlete_id", "athlete_name").agg(F.count(F.lit(1)).alias("n"), listed.alias("pops"))


def by_name(summary: DataFrame) -> DataFrame:
    """SRT-8: the summary in the order of athletes' names in a dictionary."""
    return summary.orderBy(F.collate("athlete_name", "UNICODE"), "athlete_id")


def team_meets(perf: DataFrame, team: str) -> DataFrame:
    """AGG-15: the distinct meets and days of a team, newest first."""
    return perf.where(F.col("team") == team).select("meet_name", "day").distinct().orderBy(F.desc("day"), "meet_name")
