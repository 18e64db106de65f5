"""Registered queries over loading, the manifest, lookup lists, performance lists and athletes' pages, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import looked_up_first
from ..operators import list_parser
from ..sources import batches, pages
from ..sources.bindings import perf_events, table
from ..sources.warehouse import ATHLETES
from ..streaming.incremental import PERFORMANCES, Rules, load_meets
from ..tables import shared_dir, stored

RULES = Rules(
    "Indoor", "2024", teams=[("Team 1", "One United"), ("Team 11", "Never reached")], names=[("athlete 7", "Seven, Al"), ("ATHLETE 7", "Never reached"), ("Athlete 9", "")],
    dates=[("-28", "2024-02-28"), ("meet-2024-01-2", "2024-02-20")], web_dates={"meet-2024-01-05.htm": "January 6-7, 2024", "meet-2024-01-06.htm": "July 1, 2024"},
)
SCHOOLS = [("team 1", "First School"), ("team 3", "Third School"), ("team 10", "Never reached")]


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cinderpath/{name}-{uuid.uuid4().hex}"


def _meets(spark: SparkSession, d: str) -> DataFrame:
    """stem, date, events: each day of ``events`` as a parsed meet, an event a block; every fourth entry is a preliminary, errors are relays, some have no date."""
    rows = perf_events(spark, d).where("athlete_id IS NOT NULL")
    kind = F.when(F.col("id") % 4 == 0, "Prelims").when(F.col("id") % 4 == 1, "Finals")
    mark = F.when(F.col("id") % 23 == 0, "DNS").otherwise(F.col("mark"))
    members = F.when((F.col("event") == "error") & (F.col("id") % 2 == 0), F.array("athlete_name", F.lit("Bea Poe")))
    none = F.lit(None).cast("array<string>")
    result = F.struct(F.col("athlete_name").alias("athlete"), F.col("team").alias("school"), mark.alias("result"), kind.alias("type"), members.alias("athletes"), F.when(F.col("id") % 5 == 0, F.array(F.lit("1.0"))).otherwise(none).alias("splits"), none.alias("warnings"))
    blocks = rows.groupBy("day", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", result.alias("r")))), lambda s: s["r"]).alias("results"))
    block = F.struct(F.col("event"), F.lit("Girls").alias("gender"), (F.col("event") == "error").alias("is_relay"), "results")
    date = F.when(F.dayofmonth("day") % 9 == 0, F.lit("Unknown")).otherwise(F.col("day").cast("string"))
    return blocks.groupBy("day").agg(F.array_sort(F.collect_list(block)).alias("events")).select(F.concat(F.lit("meet-"), F.col("day").cast("string")).alias("stem"), date.alias("date"), "events", "day")


def load(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3, JOIN-3, 4, 5, PRJ-1 to 6, FIL-5, DDP-1, GEN-1: meets loaded in two batches that share days, the second one twice."""
    root, meets = _root(spark, "loaded"), stored(_meets(spark, d), "meets")
    load_meets(spark, root, meets.where("dayofmonth(day) <= 15"), 0, RULES)
    for _ in range(2):
        load_meets(spark, root, meets.where("dayofmonth(day) > 10"), 1, RULES)
    athletes = batches.read_batches(spark, root, "athletes", ATHLETES).drop("batch")
    return batches.read_batches(spark, root, "performances", PERFORMANCES).join(athletes, "athlete_id").select("id", "athlete_id", "athlete_name", "event", "mark", "team", "date", "season", "meet_name", "splits", "batch")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3, 5: the manifest after three crawls: all pages, every third one under another year, and a whole one with nothing new."""
    root, seen = _root(spark, "manifest"), lambda n: F.lit(f"2025-01-0{n} 00:00:00").cast("timestamp")
    found = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), (F.col("page_id") % 3 + 2023).cast("string").alias("year"))
    batches.file_under(spark, root, found.select("url", "year", seen(1).alias("seen")), 0)
    batches.file_under(spark, root, found.where("page_id % 3 = 0").select("url", F.lit("2026").alias("year"), seen(2).alias("seen")), 1)
    batches.file_under(spark, root, found.where("page_id % 3 = 0").select("url", F.lit("2026").alias("year"), seen(3).alias("seen")), 2, whole=True)
    return batches.manifest(spark, root).select("url", "year", "path", F.date_format("seen", "yyyy-MM-dd").alias("seen"))


def _url_entries(spark: SparkSession, d: str, start: int, length: Column) -> DataFrame:
    rows = table(spark, d, "pages")
    return rows.select((-F.col("page_id")).alias("ord"), F.upper(F.substring(F.col("url"), F.lit(start), length.cast("int"))).alias("key"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("full"))


def lookup_prefix(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-6, PRJ-3: the first of as many prefixes as there are pages."""
    return looked_up_first(table(spark, d, "pages").select("page_id", "url"), "url", _url_entries(spark, d, 1, F.col("page_id") % 30 + 12), "found", "prefix").select("page_id", "found")


def lookup_contains(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-4, 7: the first of as many parts as there are pages."""
    return looked_up_first(table(spark, d, "pages").select("page_id", "url"), "url", _url_entries(spark, d, 13, F.col("page_id") % 11 + 4), "found", "contains").select("page_id", "found")


def lookup_equal(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-4: corrected names of customers, half of them listed twice."""
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    old = names.select("c_custkey", F.upper("c_name").alias("key"))
    entries = old.select(F.col("c_custkey").alias("ord"), "key", F.concat(F.lit("late "), "key").alias("full")).unionByName(old.where("c_custkey % 2 = 0").select((F.col("c_custkey") - 5000).alias("ord"), "key", F.concat(F.lit("early "), "key").alias("full")))
    return looked_up_first(names.where("c_custkey % 3 > 0"), "c_name", entries.where("ord % 5 <> 0"), "found").select("c_custkey", "found")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """file, text: events as performance lists, one a day; errors as relays."""
    rows = perf_events(spark, d)
    date = F.date_format("day", "MM/dd/yyyy")
    own = F.format_string("%d %s %s Runner %s %d  %s %s", F.col("id") % 9 + 1, F.translate("mark", "ADFHN", ""), F.when(F.col("id") % 2 == 0, "F").otherwise("P"), F.translate(F.col("athlete_id").cast("string"), "0123456789", "abcdefghij"), F.col("id") % 6 + 7, F.col("team"), date)
    relay = F.format_string("%d %s F A '%s' %s", F.col("id") % 9 + 1, "mark", "team", date)
    line = F.when(F.col("event") == "error", relay).otherwise(own)
    title = F.when(F.col("event") == "error", "Girls 4x200 Relay ===").otherwise(F.concat(F.lit("Boys "), "event", F.lit(" Dash")))
    blocks = rows.groupBy("day", title.alias("title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "\n").alias("rows"))
    return blocks.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "title", F.lit("=====\nRank Mark"), "rows"))), "\n\n").alias("text")).select(F.col("day").cast("string").alias("file"), "text", F.lit("Indoor").alias("season"))


def performance_lists(spark: SparkSession, d: str) -> DataFrame:
    """PAR-20 to 22: the rows of two schools of the lists."""
    return list_parser.performance_list(_lists(spark, d), SCHOOLS).select("file", "event", "rank", "mark", "name", "grade", "team", "date", "year")


def latest_lists(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11, 12: the lists that an index page links to, read from stored pages."""
    lists = _lists(spark, d).withColumn("name", F.concat(F.lit("emitlgirls"), F.regexp_extract("file", r"(\d+)$", 1), F.lit(".htm")))
    site = "http://lists.example/2024/"
    index = lists.groupBy().agg(F.concat_ws("<br>", F.sort_array(F.collect_list(F.format_string('<a href="../2024/%s">x</a> <a href="other.htm">y</a>', "name")))).alias("html"))
    pages_ = lists.select(F.concat(F.lit(site), "name").alias("url"), F.concat(F.lit("<html><pre>"), F.replace("text", F.lit("'"), F.lit("&#39;")), F.lit("</pre></html>")).alias("html"))
    found = list_parser.latest_lists(index.select(F.lit(f"{site}index.htm").alias("url"), "html", F.lit("Indoor").alias("season")), pages_, SCHOOLS)
    return found.select(F.substring_index("file", "/", -1).alias("file"), "event", "rank", "mark", "name", "team", "date")


def _delimited(spark: SparkSession, d: str) -> DataFrame:
    """file, text, url, season: each day as a page of rows that two spaces cut; odd days print no grades."""
    rows = perf_events(spark, d).where("event <> 'error'")
    letters = F.translate(F.col("athlete_id").cast("string"), "0123456789", "abcdefghij")
    mark, standard = F.concat("mark", F.when((F.col("id") % 5 == 0), "q").otherwise("")), F.dayofmonth("day") % 2 == 0
    line = F.when(standard, F.format_string("%d  Roe, %s  %d  Union %s  %s", F.col("id") % 9 + 1, letters, F.col("id") % 6 + 7, F.translate(F.regexp_replace("team", "Team ", ""), "0123456789", "abcdefghij"), mark)).otherwise(
        F.format_string("%d  Roe, %s  Union %s  %s  2", F.col("id") % 9 + 1, letters, F.translate(F.regexp_replace("team", "Team ", ""), "0123456789", "abcdefghij"), mark))
    blocks = rows.groupBy("day", "event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "\n").alias("rows"))
    body = blocks.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Girls "), F.initcap("event"), F.lit(" Dash\n"), "rows"))), "\n\n").alias("body"))
    text = F.concat(F.lit("Licensed to nobody\nWinter Festival Meet 4 - "), F.date_format("day", "M/d/yyyy"), F.lit("\n\n"), F.col("body"))
    return body.select(F.col("day").cast("string").alias("file"), text.alias("text"), F.lit("http://x.example/indoor/2024").alias("url"), F.lit("Indoor").alias("season"))


def delimited_pages(spark: SparkSession, d: str) -> DataFrame:
    """PAR-18, 19: the rows of delimited pages of both layouts."""
    return list_parser.delimited(_delimited(spark, d)).select("file", "athlete_name", "grade", "school", "event", "mark", "rank", "season", "date", "meet_name")


def page_layouts(spark: SparkSession, d: str) -> DataFrame:
    """PAR-18: the layout that each page shows."""
    return list_parser.layouts(_delimited(spark, d))


def _bio_pages(spark: SparkSession, d: str) -> DataFrame:
    """file, html: an athlete's page with a card for each season and the results of each event."""
    rows = perf_events(spark, d)
    flag = F.when(F.col("id") % 10 == 0, " PR").when(F.col("id") % 10 == 1, " SR").otherwise("")
    line = F.format_string('<tr result-id="%d"><td>%d</td><td>-</td><td>%s%s</td><td>%s</td><td><a href="/m">%s</a></td></tr>', "id", F.col("id") % 9 + 1, "mark", flag, F.date_format("day", "MMM d"), "meet_name")
    listed = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("t")))), lambda s: s["t"]), "")
    events = rows.groupBy("athlete_id", "athlete_name", "year", "season", "event").agg(listed("id", line).alias("rows"))
    table_ = F.concat(F.lit("<tr><td><h5>"), "event", F.lit("</h5></td></tr>"), "rows")
    cards = events.groupBy("athlete_id", "athlete_name", "year", "season").agg(listed("event", table_).alias("tables"))
    card = F.concat(F.lit('<div class="card"><div class="card-header"><h5>'), "year", F.lit(" "), "season", F.lit(' North</h5></div><div class="card-block"><table>'), "tables", F.lit("</table></div></div>"))
    named = cards.groupBy("athlete_id", "athlete_name").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    head = F.when(F.col("athlete_id") % 2 == 0, F.concat(F.lit('<meta name="favTitle" content="TF - '), "athlete_name", F.lit('">'))).otherwise(F.concat(F.lit("<title>"), "athlete_name", F.lit(" - Results</title>")))
    return named.select(F.col("athlete_id").cast("string").alias("file"), F.concat(head, "cards").alias("html"))


def bio_results(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9, PAR-23: the results on athletes' pages."""
    return pages.bio_results(_bio_pages(spark, d)).select("file", "athlete_name", "season", "event", "mark", "place", "date", "meet_name", "is_pr", "is_sb")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    load, manifest, lookup_prefix, lookup_contains, lookup_equal, performance_lists, latest_lists, delimited_pages, page_layouts, bio_results,
)


def sql(pe: str) -> dict[str, str]:
    letters = lambda c: f"translate(CAST({c} AS VARCHAR), '0123456789', 'abcdefghij')"
    urls = lambda start, length, test: f"SELECT p.page_id, (SELECT arg_min('page ' || e.page_id, -e.page_id) FROM pages e WHERE {test.format(v='lower(p.url)', k=f'lower(substring(e.url, {start}, CAST({length} AS INTEGER)))')}) AS found FROM pages p"
    lists = f"""{pe}, l AS (SELECT *, CAST(day AS VARCHAR) AS file, CASE event WHEN 'error' THEN 'Girls 4x200 Relay' ELSE 'Boys ' || event || ' Dash' END AS title, id % 9 + 1 AS rank,
  CASE WHEN contains(team, 'Team 1') THEN 'First School' WHEN contains(team, 'Team 3') THEN 'Third School' END AS school, strftime(day, '%m/%d/%Y') AS shown FROM pe WHERE NOT invalid)"""
    return {
        "load": f"""{pe}, r AS (
  SELECT *, row_number() OVER (PARTITION BY day, event ORDER BY id) AS result_ord, CASE WHEN id % 23 = 0 THEN 'DNS' ELSE mark END AS m,
    CASE WHEN event = 'error' AND id % 2 = 0 THEN athlete_name || ', Bea Poe' WHEN event = 'error' THEN team || ' Relay' ELSE athlete_name END AS n,
    CASE WHEN contains(meet_name, '-28') THEN '2024-02-28' WHEN contains(meet_name, 'meet-2024-01-2') THEN '2024-02-20' WHEN meet_name = 'meet-2024-01-05' THEN '2024-01-06' WHEN day(day) % 9 = 0 THEN NULL ELSE CAST(day AS VARCHAR) END AS dd,
    CASE WHEN day(day) <= 15 THEN 0 ELSE 1 END AS batch, CASE WHEN id % 4 = 0 THEN 'T09:00:00' WHEN id % 4 = 1 THEN 'T15:00:00' ELSE 'T12:00:00' END AS hour FROM pe
), named AS (
  SELECT * EXCLUDE (athlete_name, mark, event, team, date, splits, season), CASE WHEN lower(n) = 'athlete 7' THEN 'Seven, Al' WHEN lower(n) = 'athlete 9' THEN '' ELSE n END AS athlete_name, m AS mark, 'Girls ' || event AS event, event AS block,
    CASE WHEN starts_with(team, 'Team 1') THEN 'One United' ELSE team END AS team, coalesce(dd || hour, 'Unknown') AS date, CASE WHEN id % 5 = 0 THEN '["1.0"]' END AS splits FROM r
), kept AS (SELECT * FROM named WHERE athlete_name <> '' AND mark <> 'DNS'),
ids AS (SELECT athlete_name, row_number() OVER (ORDER BY min((batch, meet_name, block, result_ord))) AS athlete_id FROM kept GROUP BY 1),
first AS (SELECT *, row_number() OVER (PARTITION BY athlete_name, event, mark, date ORDER BY batch, meet_name, block, result_ord) AS copy FROM kept)
SELECT row_number() OVER (ORDER BY batch, meet_name, block, result_ord) AS id, ids.athlete_id, first.athlete_name, event, mark, team, date, 'Indoor' AS season, meet_name, splits, batch::BIGINT AS batch
FROM first JOIN ids ON ids.athlete_name = first.athlete_name WHERE copy = 1""",
        "manifest": """WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, max(page_id % 3 + 2023) AS year, bool_or(page_id % 3 = 0) AS again FROM pages GROUP BY 1),
t AS (SELECT url, CASE WHEN again THEN '2026' ELSE CAST(year AS VARCHAR) END AS year, CASE WHEN again THEN '2025-01-02' ELSE '2025-01-01' END AS seen FROM p)
SELECT url, year, year || '/' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/(?:[^?#]*/)?([^/?#]+)$', 1), ''), 'index.html') AS path, seen FROM t""",
        "lookup_prefix": urls(1, "e.page_id % 30 + 12", "starts_with({v}, {k})"),
        "lookup_contains": urls(13, "e.page_id % 11 + 4", "contains({v}, {k})"),
        "lookup_equal": """WITH e AS (SELECT c_custkey AS ord, c_name, 'late ' || upper(c_name) AS entry FROM customer UNION ALL SELECT c_custkey - 5000, c_name, 'early ' || upper(c_name) FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_name, arg_min(entry, ord) AS found FROM e WHERE ord % 5 <> 0 GROUP BY 1) SELECT c_custkey, found FROM customer LEFT JOIN b ON b.c_name = customer.c_name WHERE c_custkey % 3 > 0""",
        "performance_lists": f"""{lists} SELECT file, title AS event, CAST(rank AS VARCHAR) AS rank, mark, CASE WHEN event = 'error' THEN school || ' Relay' ELSE 'Runner ' || {letters("athlete_id")} END AS name,
  CASE WHEN event = 'error' THEN '--' ELSE CAST(id % 6 + 7 AS VARCHAR) END AS grade, school AS team, shown AS date, '2024' AS year FROM l WHERE school IS NOT NULL""",
        "latest_lists": f"""{lists} SELECT 'emitlgirls' || strftime(day, '%d') || '.htm' AS file, title AS event, CAST(rank AS VARCHAR) AS rank, mark, CASE WHEN event = 'error' THEN school || ' Relay' ELSE 'Runner ' || {letters("athlete_id")} END AS name,
  school AS team, shown AS date FROM l WHERE school IS NOT NULL""",
        "delimited_pages": f"""{pe} SELECT CAST(day AS VARCHAR) AS file, 'Roe, ' || {letters("athlete_id")} AS athlete_name, CASE WHEN day(day) % 2 = 0 THEN CAST(id % 6 + 7 AS VARCHAR) ELSE '--' END AS grade, 'Union ' || {letters("athlete_id % 12")} AS school,
  'Girls ' || upper(event[1:1]) || event[2:] || ' Dash' AS event, mark, CAST(id % 9 + 1 AS VARCHAR) AS rank, '2024 Indoor' AS season, strftime(day, '%-m/%-d/%Y') AS date, 'Winter Festival Meet 4' AS meet_name FROM pe WHERE event <> 'error' AND NOT invalid""",
        "page_layouts": f"{pe} SELECT DISTINCT CAST(day AS VARCHAR) AS file, CASE WHEN day(day) % 2 = 0 THEN 'STANDARD' ELSE 'SMAA' END AS layout FROM pe WHERE event <> 'error'",
        "bio_results": f"""{pe} SELECT CAST(athlete_id AS VARCHAR) AS file, athlete_name, year || ' ' || season AS season, event, mark, CAST(id % 9 + 1 AS VARCHAR) AS place, strftime(day, '%b %-d') AS date, meet_name, id % 10 = 0 AS is_pr, id % 10 = 1 AS is_sb FROM pe""",
    }
