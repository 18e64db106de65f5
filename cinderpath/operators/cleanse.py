"""Cleansing and loading of performances (PRJ-1 to 6, 9, 12, FIL-5 to 7, JOIN-3 to 7, DDP-1, 2, GEN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_from_text, first_match, normalise_event


def normalise_team(team: Column, prefixes: list[tuple[str, str]]) -> Column:
    """PRJ-3: blank is Unknown; a merged mark is cut off; then the first prefix of the map that fits."""
    cut = F.trim(F.regexp_replace(F.trim(team), r"\s+J?\d+[-:.]\d.*$", ""))
    return F.when(F.coalesce(F.trim(team), F.lit("")) == "", "Unknown").otherwise(F.coalesce(first_match(cut, prefixes), cut))


def correct_athlete(name: Column, corrections: list[tuple[str, str]]) -> Column:
    """PRJ-4: exact match without regard to case, the first entry wins."""
    chain = name
    for old, new in reversed(corrections):
        chain = F.when(F.lower(name) == old.lower(), F.lit(new)).otherwise(chain)
    return chain


def is_relay(event: Column) -> Column:
    return F.lower(event).rlike("relay|4x")


def event_gender(event: Column) -> Column:
    return F.when(F.contains(F.lower(event), F.lit("girls")), "girls").otherwise("boys")


def date_in_season(day: Column, season: Column, year: Column) -> Column:
    """FIL-6: Indoor Y is 1 November Y-1 to 31 March Y, Outdoor Y is 1 March to 30 June; other seasons hold any day; no date is false."""
    y = year.try_cast("int")
    span = lambda a, b: day.between(F.make_date(*a), F.make_date(*b))
    indoor = span((y - 1, F.lit(11), F.lit(1)), (y, F.lit(3), F.lit(31)))
    outdoor = span((y, F.lit(3), F.lit(1)), (y, F.lit(6), F.lit(30)))
    return F.coalesce(F.when(day.isNull(), False).when(season == "Indoor", indoor).when(season == "Outdoor", outdoor).otherwise(True), F.lit(False))


def likely_athlete(name: Column) -> Column:
    """FIL-7: whether a text looks like an athlete's name; a flag of data quality, nothing is dropped by it."""
    n = F.trim(name)
    # fixed values: words of school names
    school = "High|School|Academy|Acad|Institute|MCI|GSA|MDI|EMITL|PVC|Relay|Track|Field|Team|Club|Middle|University|College"
    return (
        F.when(F.coalesce(name, F.lit("")) == "", True)
        .when(n.rlike(r"\d") & n.rlike("[.:-]") & ~F.contains(n, F.lit("U-32")), True)
        .when(F.contains(n, F.lit("   ")), True)
        .when(n.rlike(f"(?i){school}"), False)
        .when(n.rlike(r"(?i)\b(EL|HS|MS|U VT)\b"), False)
        .when(F.contains(n, F.lit(",")), True)
        .when(n.rlike(r"^[A-Z][a-z.']+\s+([A-Z][a-z.']+\s*){1,2}$"), True)
        .otherwise(F.length(n) < 3)
    )


def date_in_name(name: Column) -> Column:
    """JOIN-4: the date in a file's name, as ISO text: ``7feb2025`` or ``2-7-2025`` (month first); null if none."""
    low = F.lower(name)
    worded, plain = r"(\d{1,2})([a-z]{3})(\d{4})", r"(\d{1,2})[-_](\d{1,2})[-_](\d{4})"
    part = lambda p, i: F.regexp_extract(low, p, i)
    months = F.array(*map(F.lit, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")))
    month = F.array_position(months, part(worded, 2))
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(low.rlike(worded), F.when(month > 0, iso(part(worded, 3), month.cast("string"), part(worded, 1)))).when(low.rlike(plain), iso(part(plain, 3), part(plain, 1), part(plain, 2)))


def resolve_date(web: Column, content: Column, file_name: Column, fix: Column, season: Column, year: Column) -> Column:
    """JOIN-4: the first of web map, content and file name that lies in the season; a manual fix goes before all; texts in, ISO text or Unknown out."""
    days = [date_from_text(c) for c in (web, content, file_name)]
    found = [F.when(date_in_season(d, season, year), d) for d in days]
    return F.coalesce(F.coalesce(date_from_text(fix), *found).cast("string"), F.lit("Unknown"))


def flatten_meets(meets: DataFrame, keep: tuple[str, ...] = ("stem", "season", "year")) -> DataFrame:
    """GEN-1, PRJ-1, 2, 5, 6, FIL-5: parsed meets as flat performances with their ordinals; two explodes, no shuffle.

    An event's fields become columns before its results become rows, so a row of a result doesn't hold all the results of its event.
    """
    keep = tuple(c for c in keep if c in meets.columns)
    numbered = F.transform("events", lambda e, i: F.struct(i.alias("event_ord"), *[e[c].alias(c) for c in ("event", "gender", "is_relay", "results")]))
    events = meets.select(*keep, "meet_name", "date", F.inline(numbered))
    return flatten_results(events.select(*keep, "meet_name", "date", "event_ord", "event", "gender", "is_relay", F.posexplode("results").alias("result_ord", "r")), keep)


def flatten_results(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``flatten_meets`` of results that are rows already: meet_name, date, event_ord, event, gender, is_relay, result_ord, r."""
    rows = results.withColumn("is_relay", F.coalesce("is_relay", F.lit(False)))
    name = F.when(F.col("is_relay") & (F.size(F.coalesce("r.athletes", F.array())) > 0), F.array_join("r.athletes", ", ")).when(F.col("is_relay"), F.concat("r.school", F.lit(" Relay"))).otherwise(F.col("r.athlete"))
    kind = F.lower(F.coalesce("r.type", F.lit("")))
    hour = F.when(F.contains(kind, F.lit("prelim")), "T09:00:00").when(F.contains(kind, F.lit("final")), "T15:00:00").otherwise("T12:00:00")
    flat = rows.select(
        *keep, "meet_name", "event_ord", "result_ord", F.trim(F.concat_ws(" ", "gender", normalise_event(F.col("event")))).alias("event"), "is_relay", F.trim(name).alias("athlete_name"),
        F.col("r.school").alias("team"), F.trim("r.result").alias("mark"), F.when(F.col("date") == "Unknown", F.col("date")).otherwise(F.concat("date", hour)).alias("date"), F.to_json("r.splits").alias("splits"),
    )
    return flat.where("athlete_name <> '' AND mark <> '' AND upper(mark) NOT IN ('DNS', 'SCR')")


def first_arrivals(incoming: DataFrame, target: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """DDP-1: of equal keys the first in order, unless the target has the key already. The first is found by a partial aggregation."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(incoming.columns)
    return first if target is None else first.join(target.select(keys), keys, "left_anti")


def last_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """DDP-2: later values overwrite earlier ones."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def assign_ids(names: DataFrame, dim: DataFrame, width: int = 1_000_000) -> DataFrame:
    """JOIN-5: athlete_name, athlete_id: known names keep their id, new ones follow the largest id in the order of first_seen.

    names: athlete_name, first_seen (an ordinal). New names are numbered within ranges of ``width`` ordinals, and each range begins where
    the ranges before it end, so that only the small table of range sizes is ordered as a whole.
    """
    seen = names.groupBy("athlete_name").agg(F.min("first_seen").alias("first_seen"))
    known = seen.join(dim, "athlete_name", "left").withColumn("range", F.floor(F.col("first_seen") / width))
    fresh = known.where("athlete_id IS NULL")
    sizes = fresh.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    largest = dim.agg(F.max("athlete_id")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("range").orderBy("first_seen", "athlete_name"))
    numbered = fresh.withColumn("place", place).join(before, "range").select("athlete_name", (F.lit(largest) + F.col("before") + F.col("place")).alias("athlete_id"))
    return known.where("athlete_id IS NOT NULL").select("athlete_name", "athlete_id").unionByName(numbered)


def unsynced(candidates: DataFrame, synced: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-3: what the target doesn't have yet."""
    return candidates.join(synced.select(keys), keys, "left_anti")
