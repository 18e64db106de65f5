"""The registered queries: each operator applied to the tables of a scale-factor folder (names as in the survey's operator table)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.marks import format_distance, format_improvement, format_time
from ..functions import text
from ..functions.text import first_match, normalise_event
from ..operators import api, audit, cleanse, conference, entry_sheet, history, pops, scoring
from ..sources import pages
from ..sources.bindings import marked_events, perf_events, perf_orders, table
from . import loading_queries, page_queries, report_queries

TEAM_MAP = [("nation_12", "Twelve Union"), ("NATION_1", "Group One"), ("NATION_2", "Group Two"), ("NATION_20", "Never reached")]
SCHOOLS = [("_12", "Twelve School"), ("_1", "One School"), ("N_2", "Two School")]
PART_NAMES = ("red", "bolt", "small", "small ring", "gear", "hot gear", "blue", "gizmo")
ALIASES = {"Clicks": ["click", "tap"], "Views": ["view"], "Sales": ["purchase", "sale"], "Throws": ["throw", "hurl"], "Faults": ["fault", "err"]}
FACETS = {"year": "2024", "season": "Indoor", "event": "All", "team": "Team 3"}
SLOTS = ["Girls 4X800m Relay", "Boys 4X800m Relay", "Girls 55 M. Hurdles Prelim", "Boys 55 M. Dash Final", "Girls One Mile", "Boys 400 M. Run", "Girls Long Jump", "Boys Triple Jump"]
SHEET_HEAD = ("4x8", "55H", "55", "1mi", "400", "LJ")


TEAMS = ("Maine Central Institute", "Central Aroostook", "piscataquis Valley", "Piscataquis", "PCHS", "ORONO HIGH SCHOOL", "Sumner/Narragaugus", "Lee Academy", "Elsewhere")


def _value(m: str = "m") -> F.Column:
    return F.round(F.col(f"{m}.value"), 2)


def milestones(spark: SparkSession, d: str) -> DataFrame:
    """WIN-1 to 3, MRK-1, 2, PRJ-7."""
    return history.milestones(marked_events(spark, d)).select("id", "athlete_id", "event", "season", "year", "mark", "is_first", "is_pr", "is_sb")


def mark_parse(spark: SparkSession, d: str) -> DataFrame:
    return marked_events(spark, d).select("id", "mark", _value().alias("value"), "m.is_time", "m.valid")


def mark_format(spark: SparkSession, d: str) -> DataFrame:
    """MRK-3."""
    rows = marked_events(spark, d).where("m.valid")
    return rows.select("id", F.when(F.col("m.is_time"), format_time(_value())).otherwise(format_distance(_value())).alias("shown"))


def mark_improvement(spark: SparkSession, d: str) -> DataFrame:
    """MRK-4: from one valid mark to the next of an athlete and event."""
    rows = marked_events(spark, d).where("m.valid").withColumn("old", F.lag("m").over(Window.partitionBy("athlete_id", "event").orderBy("date", "id"))).where("old IS NOT NULL")
    return rows.where((F.col("m.is_time") & (F.col("m.value") < F.col("old.value"))) | (~F.col("m.is_time") & (F.col("m.value") > F.col("old.value")))).select("id", format_improvement(F.col("m"), F.col("old")).alias("improvement"))


def _athletes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("athlete_id"), F.col("c_name").alias("athlete_name"))


def api_athletes(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-2, FIL-1."""
    return api.athletes(_athletes(spark, d), perf_orders(spark, d), team="NATION_7", year="1998", season="Indoor")


def api_teams(spark: SparkSession, d: str) -> DataFrame:
    """FIL-3, 4, AGG-2."""
    return api.teams(perf_orders(spark, d), ("NATION_7", "NATION_9"))


def api_athlete_performances(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-12, SRT-1."""
    return api.athlete_performances(perf_orders(spark, d), 7).select("id", "event", "team", "date")


def api_performances(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-1, SRT-1."""
    return api.performances(perf_orders(spark, d).drop("athlete_name"), _athletes(spark, d), "NATION_3").select("id", "athlete_id", "athlete_name", "event", "date")


def season_like(spark: SparkSession, d: str) -> DataFrame:
    """FIL-2 on combined seasons."""
    rows = perf_events(spark, d).withColumn("season", F.concat_ws(" ", "year", "season"))
    return api.season_like(rows, "2024", "indoor").select("id", "season")


def season_parts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-7, PRJ-8 on combined and separate seasons."""
    rows = perf_events(spark, d).withColumn("season", F.when(F.col("id") % 2 == 0, F.concat_ws(" ", "year", "season")).otherwise(F.col("season")))
    year, season = history.season_parts(F.when(F.col("id") % 2 == 1, F.col("year")), F.col("season"))
    return rows.select("id", year.alias("year"), season.alias("season"), F.format_string("%s (%s)", F.col("meet_name"), year).alias("meet_with_year"))


def facets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, FIL-8."""
    return history.facets(perf_events(spark, d), FACETS)


def history_sorted(spark: SparkSession, d: str) -> DataFrame:
    """SRT-2, FIL-9: an athlete's personal records, best first."""
    rows = history.history(history.milestones(marked_events(spark, d)), "mark", True, True)
    place = F.row_number().over(Window.partitionBy("athlete_id").orderBy("k.invalid", "k.directed", "id"))
    return rows.select("id", "athlete_id", "mark", place.alias("place"))


def date_in_season(spark: SparkSession, d: str) -> DataFrame:
    """FIL-6."""
    day = F.col("o_orderdate").cast("date")
    ok = lambda season: cleanse.date_in_season(day, F.lit(season), F.lit("1998"))
    return table(spark, d, "orders").select("o_orderkey", ok("Indoor").alias("indoor"), ok("Outdoor").alias("outdoor"))


def team_prefix_map(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-6, PRJ-3."""
    return table(spark, d, "nation").select("n_nationkey", cleanse.normalise_team(F.col("n_name"), TEAM_MAP).alias("team"))


def conference_tag(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-7."""
    return perf_orders(spark, d).withColumn("conference", first_match(F.col("team"), SCHOOLS, "contains")).where("conference IS NOT NULL").groupBy("team", "conference").agg(F.count(F.lit(1)).alias("n"))


def conference_schools(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10, PRJ-11: customers as athletes of nine teams in two years and seasons."""
    team, year = F.get(F.array(*map(F.lit, TEAMS)), (F.col("c_custkey") % len(TEAMS)).cast("int")), F.when(F.col("c_nationkey") % 2 == 0, "2026").otherwise("2025")
    rows = table(spark, d, "customer").select("c_custkey", team.alias("team"), year.alias("year"), F.when(F.col("c_custkey") % 2 == 0, "Indoor").otherwise("Outdoor").alias("season"))
    return rows.withColumn("school", conference.school_in(F.col("team"), F.col("year"), F.col("season")))


def display_date(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-13."""
    return perf_events(spark, d).select("id", text.display_date(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).alias("shown"))


def event_normalise(spark: SparkSession, d: str) -> DataFrame:
    """PAR-1."""
    return table(spark, d, "part").select("p_partkey", normalise_event(F.col("p_name"), PART_NAMES).alias("event"))


def athlete_flags(spark: SparkSession, d: str) -> DataFrame:
    """FIL-7, PRJ-9, PRJ-12."""
    rows = table(spark, d, "part").withColumn("event", F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "Girls").otherwise("Boys"), F.when(F.col("p_size") % 3 == 0, "4x200 Meter Relay").otherwise("High Jump")))
    return rows.select("p_partkey", cleanse.likely_athlete(F.col("p_name")).alias("likely"), cleanse.is_relay(F.col("event")).alias("relay"), cleanse.event_gender(F.col("event")).alias("gender"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """DDP-1."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    return cleanse.first_arrivals(rows.where("l_orderkey % 4 <> 0"), rows.where("l_orderkey % 4 = 0"), ["l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber"])


def last_values(spark: SparkSession, d: str) -> DataFrame:
    """DDP-2."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return cleanse.last_values(rows, "o_custkey", "o_orderstatus", "o_orderkey")


def athlete_ids(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-5."""
    names = perf_orders(spark, d).select("athlete_name", F.col("id").alias("first_seen"))
    return cleanse.assign_ids(names, _athletes(spark, d).where("athlete_id % 3 = 0"))


def synced_anti(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-3."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    return cleanse.unsynced(orders, table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("key")), ["key"])


def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5, AGG-6."""
    return scoring.best_per_group(marked_events(spark, d), "event", "season", "year", "athlete_id").select("event", "season", "year", "athlete_id", "id", "mark")


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    mark = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", mark.alias("mark"), (-mark).alias("directed"))


def comp_rank(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5, 6."""
    ranked = scoring.with_rank(_quantities(spark, d), ["l_suppkey"], ["directed"])
    return ranked.select("l_suppkey", "l_orderkey", "l_linenumber", "rank", scoring.place_points(F.col("rank")).alias("potential"))


def tie_points(spark: SparkSession, d: str) -> DataFrame:
    """WIN-7."""
    scored = scoring.scorers(_quantities(spark, d), ["l_suppkey"], ["directed"])
    return scored.select("l_suppkey", "l_orderkey", "l_linenumber", F.round("points", 6).alias("points"))


def championship(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5, WIN-6, 7: ranks and points of a championship pool."""
    scored = scoring.championship_points(marked_events(spark, d))
    return scored.select("event", "season", "year", "athlete_id", "mark", "rank", F.round("points", 6).alias("points"))


def team_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9, SRT-5: the standings in order."""
    totals = scoring.team_scores(scoring.championship_scorers(marked_events(spark, d)), "season", "year")
    return totals.select("season", "year", "team", F.round("total", 6).alias("total"), "n", F.transform("breakdown", lambda p: p["event"]).alias("events"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_per_group(marked_events(spark, d), "event", "season", "year", "athlete_id").withColumn("is_relay", F.lit(False))


def _relay_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool with relays: in two events an entry is one of four athletes, mostly of the athlete's team; one in eight has no names."""
    u = F.col("athlete_id")
    member = lambda k: F.concat(F.lit("Athlete "), (u + k).cast("string"))
    names = F.when(u % 8 == 0, F.concat("team", F.lit(" Relay"))).otherwise(F.concat_ws(", ", member(0), member(12), member(24), F.when(u % 5 == 0, member(1)).otherwise(member(36))))
    relay = F.col("event").isin("view", "signup")
    return _pool(spark, d).withColumn("is_relay", relay).withColumn("athlete_name", F.when(relay, names).otherwise(F.col("athlete_name")))


def result_table(spark: SparkSession, d: str) -> DataFrame:
    """SRT-4, AGG-5."""
    return scoring.result_table(marked_events(spark, d), "event", "season", "year").select("event", "season", "year", "athlete_id", "mark", "place")


def greedy_scores(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-1, 2."""
    return scoring.greedy_scores(_pool(spark, d)).select("year", "season", "event", "id", "athlete_name", "rank", F.round("points", 6).alias("points"))


def relay_scores(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-1, 2 with relays."""
    return scoring.greedy_scores(_relay_pool(spark, d)).select("year", "season", "event", "id", "athlete_name", "rank", F.round("points", 6).alias("points"))


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """FIL-10: performances of scored events without pentathlons."""
    event = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Indoor Pentathlon "), "event")).otherwise(F.col("event"))
    rows = perf_events(spark, d).withColumn("event", event)
    return rows.where(scoring.scored_event(F.col("event"), {"Clicks": ["click", "tap"], "Sales": ["Purchase"]})).select("id", "event")


def missing_events(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11, FIL-10."""
    return scoring.missing_events(perf_events(spark, d).where("event <> 'view' OR season = 'Indoor'"), ALIASES, "year", "season")


def pr_pops(spark: SparkSession, d: str) -> DataFrame:
    """WIN-4, JOIN-8, 9, AGG-6, FIL-12."""
    rows = pops.pr_pops(marked_events(spark, d))
    return rows.select("id", "athlete_id", "event", "day", "mark", F.col("prev_best_day.mark").alias("prev_mark"), F.col("old_pr.mark").alias("old_pr"))


def pop_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12, SRT-8."""
    return pops.by_name(pops.pop_summary(pops.pr_pops(marked_events(spark, d)))).select("athlete_id", "athlete_name", "n", F.array_join(F.transform("pops", lambda p: F.concat_ws(" ", p["day"].cast("string"), p["event"], p["mark"])), "; ").alias("pops"))


def team_meets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15."""
    return pops.team_meets(perf_events(spark, d), "Team 3")


def latest_meet(spark: SparkSession, d: str) -> DataFrame:
    """LIM-3: the latest meet of each team."""
    return pops.latest_meets(perf_events(spark, d))


def meet_pops(spark: SparkSession, d: str) -> DataFrame:
    """FIL-12, LIM-3: improvements at the latest meet of each team."""
    rows = marked_events(spark, d)
    return pops.meet_pops(rows, pops.latest_meets(rows)).select("team", "meet_name", "athlete_id", "event", "mark", F.col("prev_best_day.mark").alias("prev_mark"), F.col("old_pr.mark").alias("old_pr"))


def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7, FIL-11."""
    return history.profile(marked_events(spark, d)).select("athlete_id", "event", "best_mark", F.round("upper_median", 2).alias("upper_median"), F.round("sigma", 4).alias("sigma"), "n")


def profile_series(spark: SparkSession, d: str) -> DataFrame:
    """AGG-8."""
    shown = F.array_join(F.transform("points", lambda p: F.concat_ws("=", F.date_format(p["date"], "yyyy-MM-dd HH:mm"), F.round(p["value"] * 100).cast("long").cast("string"))), ",")
    return history.series(marked_events(spark, d)).select("athlete_id", "event", "year", shown.alias("series"))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """An entry sheet made of nations: girls' table of regions 0 to 2, boys' of the others."""
    n = F.col("n_nationkey")
    role = lambda i: F.get(F.array(*map(F.lit, ("x", "y", "", "(x)", "?", ""))), ((n + i * n + i) % 6).cast("int"))
    girls = F.when(F.col("n_regionkey") <= 2, 0).otherwise(1)
    rows = table(spark, d, "nation").select((girls * 1000 + 1 + n).alias("pos"), F.concat_ws(",", "n_name", *[role(i) for i in range(len(SHEET_HEAD))]).alias("line"))
    heads = table(spark, d, "region").where("r_regionkey <= 1").select((F.col("r_regionkey") * 1000).alias("pos"), F.concat(F.when(F.col("r_regionkey") == 0, "Girls,").otherwise("Boys,"), F.lit(",".join(SHEET_HEAD))).alias("line"))
    return rows.unionByName(heads).withColumn("sheet", F.lit(1))


def unpivot_sheet(spark: SparkSession, d: str) -> DataFrame:
    """PIV-1, 2, SRC-13."""
    return entry_sheet.unpivot_sheet(_sheet(spark, d)).select("gender", "name", "event", "role")


def _slots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(SLOTS)], "ord int, slot string")


def sheet_match(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10."""
    return entry_sheet.sheet_match(_slots(spark), entry_sheet.unpivot_sheet(_sheet(spark, d))).select("ord", "slot", "name", "role")


def meet_sheet(spark: SparkSession, d: str) -> DataFrame:
    """GEN-2, SRT-7, WIN-10."""
    return entry_sheet.meet_sheet(_slots(spark), entry_sheet.unpivot_sheet(_sheet(spark, d))).withColumn("entries", F.array_join("entries", "; "))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """PAR-4: the lines of texts."""
    return text.lines(table(spark, d, "documents"), "text", "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.char_length("line").cast("long").alias("n"))


def block_segment(spark: SparkSession, d: str) -> DataFrame:
    """PAR-6, WIN-9: a line is a header if the next one is longer."""
    lines = text.lines(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "pos", F.char_length("line").alias("n"))
    header = F.lead("n").over(Window.partitionBy("doc_id").orderBy("pos")) > F.col("n")
    blocks = lines.withColumn("header", header).withColumn("block", text.block_number(F.col("header"), ["doc_id"], "pos"))
    return blocks.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").cast("long").alias("chars"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """WIN-8: the last user turn at or before each turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.carried(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn").alias("asked"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, FIL-13."""
    return audit.status_counts(perf_events(spark, d))


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: an athlete's records under two filters."""
    rows = perf_events(spark, d).withColumn("splits", F.when(F.col("id") % 2 == 0, F.to_json(F.array("event", "season"))))
    return audit.record_counts(rows.where(history.matching({"year": "2024", "season": "Indoor"})), "athlete_id")


def date_quality(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11."""
    return audit.date_quality(perf_orders(spark, d), "Indoor", "1998", "1997-06-01")


def digit_audit(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: the texts of documents as meets, their lines as entries."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("athlete"), F.col("source").alias("school")))
    meets = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.array(F.struct(F.lit("text").alias("event"), lines.alias("results"))).alias("events"))
    return audit.digit_audit(meets)


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2."""
    return pages.links(table(spark, d, "pages"), "html", "page_id")


def year_from_url(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6."""
    return table(spark, d, "pages").select("page_id", pages.year_from_url(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit("/20"), F.col("url"))).alias("a"), pages.year_from_url(F.col("url"), F.col("html")).alias("b"))


def splits_json(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-6."""
    parsed = F.from_json("props", "struct<k:int>")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.array(parsed["k"].cast("string"))).alias("splits"))


def export(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4, JOIN-1, PRJ-6."""
    rows = perf_events(spark, d).withColumn("splits", F.when(F.col("id") % 2 == 0, F.to_json(F.array("event", "season"))))
    dim = rows.select("athlete_id", "athlete_name").distinct()
    return api.export(rows.drop("athlete_name"), dim).select("id", "athlete_name", F.size("splits").cast("long").alias("n_splits"))


def roster(spark: SparkSession, d: str) -> DataFrame:
    """AGG-4, SRT-3."""
    return api.roster(perf_orders(spark, d), "NATION_12")


def filter_options(spark: SparkSession, d: str) -> DataFrame:
    """AGG-3, 16, SRT-3."""
    return api.filter_options(perf_orders(spark, d), "year", "season", "event", "meet_name")


def union_pages(spark: SparkSession, d: str) -> DataFrame:
    """SET-1."""
    rows = perf_events(spark, d)
    return api.combined(rows.where("season = 'Indoor'").select("id", "season"), rows.where("season = 'Outdoor'").select("season", "id"))


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SET-2."""
    rows = perf_events(spark, d)
    return api.combined(rows.where("season = 'Indoor'").select("team", "event"), rows.where("season = 'Outdoor'").select("team", "event"), distinct=True)


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    milestones, mark_parse, mark_format, mark_improvement, api_athletes, api_teams, api_athlete_performances, api_performances, season_like, season_parts, facets, history_sorted,
    date_in_season, team_prefix_map, conference_tag, event_normalise, athlete_flags, dedup_first, last_values, athlete_ids, synced_anti, best_per_group, comp_rank, tie_points,
    championship, team_scores, greedy_scores, relay_scores, scored_events, missing_events, pr_pops, pop_summary, team_meets, latest_meet, meet_pops, profile_stats, profile_series, unpivot_sheet, sheet_match, meet_sheet,
    text_lines, block_segment, carry_forward, status_counts, date_quality, digit_audit, html_links, year_from_url, splits_json, export, roster, filter_options,
    union_pages, union_distinct, conference_schools, display_date, result_table, record_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*ALL, *page_queries.QUERIES, *report_queries.QUERIES, *loading_queries.QUERIES)}
