"""Incremental load of parsed meets into athletes and performances: a file stream that processes what is there and ends (SNK-3, JOIN-3, 5, DDP-1).

Each micro-batch leaves out meets that are loaded, cleans the rest, numbers new athletes and performances after those that are there, and
commits both tables at once (``sources.batches``); a lost batch runs again with the same result. Derived flags are windows over the
tables, never state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import first_match
from ..operators.cleanse import correct_athlete, date_in_name, first_arrivals, flatten_meets, normalise_team, resolve_date, unsynced
from ..operators.ranking import indexed
from ..sources.batches import commit, read_batches
from ..sources.warehouse import ATHLETES, parsed_meets
from ..tables import stored

PERFORMANCES = "id long, athlete_id long, event string, mark string, team string, date string, season string, year string, meet_name string, splits string"
KEYS = ["athlete_name", "event", "mark", "date"]
ORDER = ["stem", "event_ord", "result_ord"]


@dataclass(frozen=True)
class Rules:
    """What cleansing needs: the season, team prefixes, corrected names, corrected dates by a part of the meet's name, dates from an index page."""

    season: str
    year: str
    teams: list[tuple[str, str]] = field(default_factory=list)
    names: list[tuple[str, str]] = field(default_factory=list)
    dates: list[tuple[str, str]] = field(default_factory=list)
    web_dates: dict[str, str] = field(default_factory=dict)


def cleaned(meets: DataFrame, rules: Rules) -> DataFrame:
    """Flat performances of parsed meets (stem, date, events), with resolved dates and corrected names and teams; a meet is named by its file."""
    season, year = F.lit(rules.season), F.lit(rules.year)
    web = F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.web_dates.items() for x in pair]), F.concat("stem", F.lit(".htm"))) if rules.web_dates else F.lit(None).cast("string")
    date = resolve_date(web, F.col("date"), date_in_name(F.col("stem")), first_match(F.col("stem"), rules.dates, "contains"), season, year)
    flat = flatten_meets(meets.withColumn("date", date).withColumn("meet_name", F.col("stem")), ("stem",))
    named = flat.withColumns({"athlete_name": correct_athlete(F.col("athlete_name"), rules.names), "team": normalise_team(F.col("team"), rules.teams)})
    return named.where("athlete_name <> ''").withColumns({"season": season, "year": year})


def load_meets(spark: SparkSession, root: str, meets: DataFrame, number: int, rules: Rules) -> None:
    """Loads parsed meets (stem, date, events) as batch ``number`` of the tables athletes and performances under ``root``."""
    athletes, have = read_batches(spark, root, "athletes", ATHLETES, number), read_batches(spark, root, "performances", PERFORMANCES, number)
    loaded = have.select(F.col("meet_name").alias("stem")).distinct()
    rows = stored(cleaned(unsynced(meets, loaded, ["stem"]), rules), "cleaned")
    # an athlete is new by name; numbers follow the largest one in the order of appearance
    names = rows.groupBy("athlete_name").agg(F.min(F.struct(*ORDER)).alias("seen")).select("athlete_name", "seen.*")
    fresh = indexed(names.join(athletes.select("athlete_name"), "athlete_name", "left_anti"), [], [*ORDER, "athlete_name"], "place", "new-athletes")
    largest = lambda df, c: df.agg(F.max(c)).first()[0] or 0
    fresh = stored(fresh.select((F.col("place") + 1 + largest(athletes, "athlete_id")).alias("athlete_id"), "athlete_name"), "new-athletes")
    ids = athletes.select("athlete_id", "athlete_name").unionByName(fresh)
    known = have.join(athletes.select("athlete_id", "athlete_name"), "athlete_id").select(KEYS)
    first = indexed(first_arrivals(rows, known, KEYS, ORDER), [], [*ORDER, "athlete_name"], "place", "new-performances")
    placed = first.join(ids, "athlete_name").withColumn("id", F.col("place") + 1 + largest(have, "id"))
    commit(spark, root, number, {"athletes": fresh, "performances": placed.select(*[c.split()[0] for c in PERFORMANCES.split(", ")])})


def load_new_meets(spark: SparkSession, inbox: str, root: str, checkpoint: str, rules: Rules) -> StreamingQuery:
    """``load_meets`` of the files that have come to ``inbox`` since the last call, of both forms."""
    stream = parsed_meets(spark.readStream.text(inbox, wholetext=True))

    def load(batch: DataFrame, number: int) -> None:
        load_meets(batch.sparkSession, root, batch, number, rules)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
