"""Delimited result pages and performance lists to rows (PAR-18 to 22, SRC-11, 12): regular expressions and carry-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import carried, clean_event, first_match
from ..sources.page_tree import page_text
from ..sources.pages import absolute, links

#: The addresses of performance lists.
LIST_LINK = r"(emitl|pvc)(girls|boys)(relays)?\d+.*\.htm"
#: Terms that no name or school has, and the rows of performance lists.
JUNK = "license|contractor|timing|results|page|hy-tek|meet manager|points|finals|prelims|rank|name|year|school|team|seed"
INDIVIDUAL = r"^\s*(\d+)\s+([\d:.'-]+)\s+([FP])\s+(.+?)\s+(\d+|--)\s+(.+?)\s+(\d{1,2}/\d{1,2}/(\d{4}))"
RELAY = r"^\s*(\d+)\s+([\d:.'-]+)\s+([FP])\s+([A-D])\s+'(.+?)'\s+(\d{1,2}/\d{1,2}/(\d{4}))"


def _lines(files: DataFrame, *keep: str) -> DataFrame:
    return files.select("file", *keep, F.posexplode(F.split(F.replace("text", F.lit(chr(160)), F.lit(" ")), "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "^\\s+|\\s+$", "")))


def _parts(line: str = "line") -> Column:
    return F.array_remove(F.transform(F.split(line, r"\s{2,}|\t"), lambda p: F.trim(p)), "")


def layouts(files: DataFrame) -> DataFrame:
    """PAR-18: file, layout: STANDARD (with grades), SMAA (without) or UNKNOWN, by the first telling row of the first 50 lines."""
    rows = _lines(files).where("pos < 50").withColumn("p", _parts()).where((F.size("p") >= 4) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    third = F.get("p", F.lit(2))
    grade = third.isin("--", *map(str, range(7, 13)))
    kind = F.when(grade, "STANDARD").when(~third.rlike(r"^\d+$"), "SMAA")
    told = rows.withColumn("layout", kind).where("layout IS NOT NULL").groupBy("file").agg(F.min_by("layout", "pos").alias("layout"))
    return files.select("file").join(told, "file", "left").select("file", F.coalesce("layout", F.lit("UNKNOWN")).alias("layout"))


def season_year(date: Column, url: Column, season: Column) -> Column:
    """PAR-19g: the year of the date, the next one for an indoor date from November; else the year in the address; else 2026."""
    year = F.regexp_extract(date, r"(\d{2,4})$", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).try_cast("int")
    late = F.regexp_extract(date, r"^(\d{1,2})/", 1).try_cast("int") >= 11
    named = F.nullif(F.regexp_extract(url, r"(20\d{2})", 1), F.lit("")).try_cast("int")
    winter = F.lower(url).rlike("indoor") & F.lower(url).rlike("dec|nov")
    return F.coalesce(F.when((season == "Indoor") & late, full + 1).otherwise(full), F.when(winter, named + 1).otherwise(named), F.lit(2026)).cast("string")


def meet_details(files: DataFrame) -> DataFrame:
    """PAR-19f: file, meet_name, date: the first plain header of the first ten lines with text, and the first date anywhere."""
    text = F.regexp_replace("text", "(?s)<!--.*?-->", "")
    filled = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = files.select("file", F.posexplode(F.slice(filled, 1, 10)).alias("pos", "line")).where(~F.col("line").rlike("[<>]") & ~F.lower("line").rlike("license|contractor|timing|hy-tek|page") & (F.length("line") > 3))
    named = rows.groupBy("file").agg(F.trim(F.regexp_replace(F.min_by("line", "pos"), r"-\s*\d{1,2}/\d{1,2}/\d{2,4}.*", "")).alias("base"), F.min_by(F.regexp_extract("line", r"(?i)(Meet\s+\d+[A-Z]?)", 1), F.when(F.col("line").rlike(r"(?i)Meet\s+\d+"), F.col("pos"))).alias("detail"))
    name = F.when(F.col("base").isNull(), "Unknown Meet").when((F.coalesce("detail", F.lit("")) != "") & ~F.contains("base", F.col("detail")), F.concat_ws(" ", "base", "detail")).otherwise(F.col("base"))
    date = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{2,4})", 1), F.lit("")), F.lit("Unknown"))
    return files.select("file", date.alias("date")).join(named, "file", "left").select("file", name.alias("meet_name"), "date")


def delimited(files: DataFrame) -> DataFrame:
    """PAR-19a to e: flat results of delimited pages (file, text, url, season), each in the layout that it shows."""
    head = r"(?i)(Girls|Boys|Women|Men)\s+([\d\w\s]+)"
    rows = _lines(files, "url", "season").where("line <> ''")
    header = (F.length("line") < 80) & F.col("line").rlike("Girls|Boys|Women|Men") & F.col("line").rlike(head)
    rows = rows.withColumn("_h", header)
    for name, i in (("gender", 1), ("event", 2)):
        rows = rows.withColumn(name, carried(F.when(F.col("_h"), F.trim(F.regexp_extract("line", head, i))), ["file"], "pos"))
    rows = rows.where("event IS NOT NULL AND NOT _h").withColumn("p", _parts()).where(F.size("p") >= 3)
    rows = rows.withColumn("rank", F.regexp_replace(F.get("p", F.lit(0)), r"^\.+|\.+$", "")).where(F.col("rank").rlike(r"^\d+$")).join(layouts(files), "file")
    relay = F.contains("event", F.lit("Relay")) | F.contains("line", F.lit("Relay"))
    rows = rows.withColumn("_kind", F.when(relay, "RELAY").when(F.col("layout") == "SMAA", "SMAA").otherwise("STANDARD"))
    index = F.sequence(F.lit(0), F.size("p") - 1)
    grade = F.array_min(F.filter(index, lambda i: (i >= 1) & F.get("p", i).isin("--", *map(str, range(7, 13)))))
    rows = rows.withColumn("_g", F.when(F.col("_kind") == "STANDARD", grade)).where("_kind <> 'STANDARD' OR _g IS NOT NULL")
    least = F.when(F.col("_kind") == "RELAY", 0).when(F.col("_kind") == "SMAA", 3).otherwise(2)
    after = F.when(F.col("_kind") == "RELAY", 0).when(F.col("_kind") == "SMAA", 1).otherwise(F.col("_g"))
    rows = rows.withColumn("_least", least).withColumn("_after", after)
    mark = F.array_max(F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i > F.col("_after")) & F.get("p", i).rlike(r"\d") & F.get("p", i).rlike("[:.]") & (F.length(F.get("p", i)) > F.col("_least"))))
    rows = rows.withColumn("_m", mark).where("_m IS NOT NULL")
    joined = lambda a, b: F.array_join(F.slice("p", a + 1, F.greatest(b - a, F.lit(0))), " ")
    rows = rows.withColumn("school", F.when(F.col("_kind") == "STANDARD", joined(F.col("_g") + 1, F.col("_m"))).when(F.col("_kind") == "SMAA", joined(F.lit(2), F.col("_m"))).otherwise(joined(F.lit(1), F.col("_m"))))
    name = F.when(F.col("_kind") == "RELAY", F.concat("school", F.lit(" Relay"))).when(F.col("_kind") == "SMAA", F.get("p", F.lit(1))).otherwise(joined(F.lit(1), F.col("_g")))
    rows = rows.withColumn("athlete_name", name).where("_kind = 'RELAY' OR NOT (lower(athlete_name) RLIKE '" + JUNK + "' OR lower(school) RLIKE '" + JUNK + "')")
    rows = rows.join(meet_details(files), "file")
    return rows.select(
        "file", "pos", "athlete_name", F.when(F.col("_kind") == "STANDARD", F.get("p", F.col("_g"))).otherwise("--").alias("grade"), "school", clean_event(F.concat_ws(" ", "gender", "event")).alias("event"),
        F.btrim(F.get("p", F.col("_m")), F.lit("qQ*RxXJj")).alias("mark"), "rank", F.lit("0").alias("points"), "gender",
        F.concat_ws(" ", season_year(F.col("date"), F.col("url"), F.col("season")), "season").alias("season"), "date", "meet_name", F.col("url").alias("meet_url"),
    )


def performance_list(files: DataFrame, schools: list[tuple[str, str]]) -> DataFrame:
    """PAR-20 to 22: rows of performance lists (file, text, season) of the given schools; a December indoor date counts for the next year."""
    rows = _lines(files, "season").where("line <> ''")
    header = F.col("line").rlike("Girls|Boys") & F.col("line").rlike("Dash|Run|Hurdles|Jump|Shot|Vault|Relay")
    rows = rows.withColumn("_h", header).withColumn("event", carried(F.when(header, F.nullif(F.trim(F.regexp_extract("line", r"^((?:Girls|Boys)\s+[^=]+)", 1)), F.lit(""))), ["file", "season"], "pos")).where("event IS NOT NULL AND NOT _h")
    own, relay = F.col("line").rlike(INDIVIDUAL), F.col("line").rlike(RELAY)
    pick = lambda i, r: F.when(own, F.regexp_extract("line", INDIVIDUAL, i)).otherwise(F.regexp_extract("line", RELAY, r))
    rows = rows.where(own | relay).withColumn("team", first_match(F.trim(pick(6, 5)), schools, "contains")).where("team IS NOT NULL").withColumn("date", pick(7, 6))
    year = F.regexp_extract("date", r"/(\d{4})$", 1).cast("int") + F.when((F.col("season") == "Indoor") & (F.regexp_extract("date", r"^(\d+)/", 1) == "12"), 1).otherwise(0)
    return rows.select(
        "file", "pos", "event", pick(1, 1).alias("rank"), pick(2, 2).alias("mark"), F.when(own, F.trim(F.regexp_extract("line", INDIVIDUAL, 4))).otherwise(F.concat("team", F.lit(" Relay"))).alias("name"),
        F.when(own, F.regexp_extract("line", INDIVIDUAL, 5)).otherwise("--").alias("grade"), "team", "date", "season", year.cast("string").alias("year"),
    )


def latest_lists(indexes: DataFrame, stored: DataFrame, schools: list[tuple[str, str]]) -> DataFrame:
    """SRC-12: the rows of all performance lists that index pages (url, html, season) link to, of those that are stored (url, html); file is a list's address."""
    found = links(indexes, "html", "url", "season").where(F.col("href").rlike(LIST_LINK)).select("season", absolute(F.col("url"), F.col("href")).alias("file")).distinct()
    return performance_list(page_text(found.join(stored.select(F.col("url").alias("file"), "html"), "file"), "html", "file", "season"), schools)
