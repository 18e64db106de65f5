"""Audits of data quality (AGG-1, 10, 11, 17, SNK-5, LIM-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleanse import date_in_season

#: The status marks that are counted.
STATUS_MARKS = ("DNF", "DNS", "DQ", "NH", "NM", "FOUL", "SCR", "ND")


def status_counts(perf: DataFrame) -> DataFrame:
    return perf.where(F.col("mark").isin(*STATUS_MARKS)).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def record_counts(perf: DataFrame, *by: str) -> DataFrame:
    """AGG-17: the number of records, and of those with splits; a missing or empty list of splits counts as none."""
    splits = F.coalesce(F.from_json("splits", "array<string>"), F.array().cast("array<string>"))
    return perf.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(splits) > 0, 1)).alias("with_splits"))


def date_quality(perf: DataFrame, season: str, year: str, placeholder: str = "2026-01-01") -> DataFrame:
    """AGG-11: class, n: missing, placeholder, wrong season or valid."""
    day = F.col("day")
    kind = F.when(day.isNull(), "missing").when(day == F.to_date(F.lit(placeholder)), "placeholder").when(date_in_season(day, F.lit(season), F.lit(year)), "valid").otherwise("wrong season")
    return perf.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def digit_audit(meets: DataFrame) -> DataFrame:
    """AGG-10: one row - files, events, entries, athlete and school names with digits - of parsed meets (file, events)."""
    named = lambda c: F.expr(f"aggregate(events, 0L, (n, e) -> n + size(filter(coalesce(e.results, array()), r -> r.{c} RLIKE '[0-9]')))")
    entries = F.expr("aggregate(events, 0L, (n, e) -> n + size(coalesce(e.results, array())))")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return meets.agg(F.count_distinct("file").alias("files"), total(F.size("events"), "events"), total(entries, "entries"), total(named("athlete"), "athlete_warnings"), total(named("school"), "school_warnings"))


def warnings_report(meets: DataFrame, n: int = 20) -> DataFrame:
    """SNK-5, LIM-2: the first n warnings by file."""
    found = meets.select("file", F.posexplode("events").alias("event_ord", "e")).select("file", "event_ord", "e.event", F.posexplode("e.results").alias("result_ord", "r"))
    return found.select("file", "event_ord", "result_ord", "event", F.explode("r.warnings").alias("warning")).orderBy("file", "event_ord", "result_ord", "warning").limit(n)


def first_warnings(results: DataFrame, n: int = 20) -> DataFrame:
    """SNK-5, LIM-2: ``warnings_report`` of the results as rows (``report_parser.results``), without a document that holds all of a file.

    Events count from 0 in the order of the blocks that have results.
    """
    found = results.select("file", "block", (F.col("result_ord") - 1).cast("int").alias("result_ord"), "event", "warnings")
    found = found.withColumn("event_ord", F.dense_rank().over(Window.partitionBy("file").orderBy("block")) - 1)
    return found.select("file", "event_ord", "result_ord", "event", F.explode("warnings").alias("warning")).orderBy("file", "event_ord", "result_ord", "warning").limit(n)


def first_results(meets: DataFrame, n: int = 3) -> DataFrame:
    """LIM-2: the first n results of each event, as a preview of a parsed meet; cut in the row."""
    events = meets.select("file", F.posexplode("events").alias("event_ord", "e"))
    return events.select("file", "event_ord", "e.event", "e.gender", F.posexplode(F.slice("e.results", 1, n)).alias("result_ord", "r")).select("file", "event_ord", "event", "gender", "result_ord", "r.athlete", "r.school", "r.result")
