"""The service's questions as functions of the tables (API-1 to 4, JOIN-1, 2, 12, FIL-1 to 4, AGG-2 to 4, 16, SRT-1, SNK-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import matching

#: First names that a broken column once put among the teams.
TEAM_BLACKLIST = ("Sam", "Sarah", "Thomas", "John", "David", "Emma", "Madison")


def season_like(perf: DataFrame, year: str | None = None, season: str | None = None) -> DataFrame:
    """FIL-2: season LIKE 'year%' and LIKE '%season', letter case ignored."""
    rows = perf.where(F.col("season").ilike(f"{year}%")) if year else perf
    return rows.where(F.col("season").ilike(f"%{season}")) if season else rows


def athletes(dim: DataFrame, perf: DataFrame, **filters: str | None) -> DataFrame:
    """JOIN-2: athletes with at least one performance under the filters; a semi-join, so nobody is repeated."""
    return dim.join(perf.where(matching(filters)).select("athlete_id"), "athlete_id", "left_semi")


def teams(perf: DataFrame, blacklist: tuple[str, ...] = TEAM_BLACKLIST) -> DataFrame:
    """FIL-3, FIL-4, AGG-2: the distinct real teams, in order."""
    team = F.col("team")
    short = (F.length(team) < 4) & ~(team.rlike("[A-Z]") & (team == F.upper(team)))
    named = perf.where("team IS NOT NULL AND team <> 'Unknown' AND team <> ''").where(~short)
    return (named.where(~team.isin(*blacklist)) if blacklist else named).select("team").distinct().orderBy("team")


def athlete_performances(perf: DataFrame, athlete_id: int, team: str | None = None) -> DataFrame:
    return perf.where((F.col("athlete_id") == athlete_id) & matching({"team": team})).orderBy(F.desc_nulls_last("date"), F.desc("id"))


def performances(perf: DataFrame, dim: DataFrame, team: str | None = None) -> DataFrame:
    """JOIN-1: performances with their athletes' names, newest first. Spark broadcasts the dimension while it is small."""
    return perf.where(matching({"team": team})).join(dim, "athlete_id").orderBy(F.desc_nulls_last("date"), F.desc("id"))


def roster(perf: DataFrame, team: str | None = None) -> DataFrame:
    """AGG-4: the athletes of a team, each with the first name seen, in the order of names in a dictionary."""
    named = perf.where(matching({"team": team})).groupBy("athlete_id").agg(F.min_by("athlete_name", "id").alias("athlete_name"))
    return named.orderBy(F.collate("athlete_name", "UNICODE"), "athlete_id")


def filter_options(perf: DataFrame, *columns: str) -> DataFrame:
    """AGG-16, SRT-3: facet, option, place: the distinct values of each column, one pass, in the order of a menu: years from the latest, others by their characters."""
    pairs = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option")) for c in columns]
    found = perf.select(F.explode(F.array(*pairs)).alias("o")).select("o.*").where("option IS NOT NULL").distinct()
    year = F.when(F.col("facet") == "year", F.col("option").try_cast("int"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(year.desc_nulls_last(), "option"))).orderBy("facet", "place")


def export(perf: DataFrame, dim: DataFrame) -> DataFrame:
    """SNK-4: performances with names and splits decoded; an empty list where there are none or the text is no list."""
    splits = F.coalesce(F.from_json("splits", "array<string>"), F.array().cast("array<string>"))
    return perf.join(dim, "athlete_id").withColumn("splits", splits)


def combined(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """SET-1, SET-2: the rows of several tables by the names of their columns, each as often as it comes or once."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.distinct() if distinct else rows
