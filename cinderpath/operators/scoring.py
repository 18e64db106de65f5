"""Championship scoring: best per group, ranks, tie-split points, selection under entry limits, team totals (AGG-5, 9, WIN-5 to 7, SRT-4, 5, SEQ-1, 2)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import with_marks
from ..functions.text import first_match
from ..tables import narrow, stored
from .components import NODES, components
from .ranking import indexed, looked_up

#: Points for places 1 to 6.
POINTS = (10, 8, 6, 4, 2, 1)
LIMIT = 3
CHAMPIONSHIP = ["event", "season", "year"]


def best_per_group(perf: DataFrame, *keys: str) -> DataFrame:
    """AGG-5, AGG-6: the row with the best mark of each group, earliest on ties.

    Each task keeps one row of a group before the shuffle, so a hot group is no hot task. The row is carried whole, so both steps sort
    by the group's keys instead of hashing.
    """
    rows = with_marks(perf)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("k.invalid", "k.directed", "date", "id")).alias("row"))
    return best.select(*keys, "row.*")


def mark_ranks(rows: DataFrame, group: list[str], order: list[str], mark: str = "mark") -> DataFrame:
    """WIN-5: group…, mark, ``rank`` and ``tied`` of each different mark of a group: one more than the rows before it, and the rows that have it.

    Rows are counted by mark before the shuffle, so a task gets the different marks of a group - hundredths of a second within an
    event's range, thousands, whatever the number of rows. ``order``: columns that a mark determines; marks of equal order come by their text.
    """
    counted = rows.groupBy(*group, *order, mark).agg(F.count(F.lit(1)).alias("tied"))
    before = F.sum("tied").over(Window.partitionBy(*group).orderBy(*order, mark).rowsBetween(Window.unboundedPreceding, -1))
    return counted.select(*group, mark, (F.coalesce(before, F.lit(0).cast("long")) + 1).alias("rank"), "tied")


def with_rank(rows: DataFrame, group: list[str], order: list[str], mark: str = "mark") -> DataFrame:
    """WIN-5: adds ``rank``, in which rows of equal mark *text* share the first place that it has in the group's order, and ``tied``."""
    return looked_up(rows, mark_ranks(rows, group, order, mark), [*group, mark])


def place_points(rank: Column) -> Column:
    """WIN-6: points of a place, 0 beyond the sixth; ties are not split."""
    return F.coalesce(F.get(F.array(*[F.lit(float(p)) for p in POINTS]), (rank - 1).cast("int")), F.lit(0.0))


def tie_points(rank: Column, tied: Column) -> Column:
    """WIN-7: the sum of the points of places rank to rank + tied - 1, divided among the tied."""
    rules = F.array(*[F.lit(float(p)) for p in POINTS])
    share = F.aggregate(F.slice(rules, F.least(rank, F.lit(len(POINTS))).cast("int"), tied.cast("int")), F.lit(0.0), lambda a, p: a + p) / tied
    return F.when(rank > len(POINTS), F.lit(0.0)).otherwise(share)


def with_tie_points(rows: DataFrame, group: list[str], order: list[str], mark: str = "mark") -> DataFrame:
    """Adds rank, tied and points to rows of valid marks."""
    return with_rank(rows, group, order, mark).withColumn("points", tie_points(F.col("rank"), F.col("tied")))


def scorers(rows: DataFrame, group: list[str], order: list[str], mark: str = "mark") -> DataFrame:
    """``with_tie_points``, only the rows that score: the few marks of the first six places meet the rows."""
    ranks = mark_ranks(rows, group, order, mark).where(F.col("rank") <= len(POINTS))
    return looked_up(rows, ranks, [*group, mark], "inner").withColumn("points", tie_points(F.col("rank"), F.col("tied")))


def result_table(perf: DataFrame, *group: str) -> DataFrame:
    """SRT-4: each athlete's best row of a group with its ``place`` in the group's table: valid marks first, best first, then the earlier."""
    best = best_per_group(perf, *group, "athlete_id").withColumns({"_invalid": F.col("k.invalid"), "_directed": F.col("k.directed")})
    placed = indexed(best, list(group), ["_invalid", "_directed", "date", "id"], "place", "result-table")
    return placed.withColumn("place", (F.col("place") + 1).cast("int")).drop("_invalid", "_directed")


def _pool(perf: DataFrame, where: str = "m.valid") -> DataFrame:
    return best_per_group(perf, "event", "season", "year", "athlete_id").where(where).withColumn("directed", F.col("k.directed"))


def championship_points(perf: DataFrame) -> DataFrame:
    """The pool of a championship: best mark of each athlete, event, season and year, ranked and with tie-split points."""
    return with_tie_points(_pool(perf), CHAMPIONSHIP, ["directed"])


def championship_scorers(perf: DataFrame) -> DataFrame:
    """``championship_points``, only the rows with points."""
    return scorers(_pool(perf), CHAMPIONSHIP, ["directed"])


def team_scores(scored: DataFrame, *by: str) -> DataFrame:
    """AGG-9, SRT-5: total per team with its breakdown, in the order of the standings: best total first in each of ``by``, then by name."""
    parts = F.sort_array(F.collect_list(F.struct("points", "event", "athlete_id")), False)
    totals = scored.where("points > 0").groupBy(*by, "team").agg(F.sum("points").alias("total"), F.count(F.lit(1)).alias("n"), parts.alias("breakdown"))
    return totals.orderBy(*by, F.desc("total"), F.asc_nulls_last("team"))


#: Entries whose names are Python numbers at once.
TURNS = 100_000
ORDER = [("potential", "descending"), ("rank", "ascending"), ("is_relay", "ascending"), ("event", "ascending"), ("id", "ascending")]


def _select(entries: pa.Table, limit: int) -> pa.Table:
    """_row of the entries of a component that fit, taken one by one. Names are numbers in a list of distinct ones, so that a component may hold millions."""
    order = pc.sort_indices(entries.select([c for c, _ in ORDER]), ORDER).to_numpy()
    names = entries["names"].combine_chunks()
    sizes = pc.list_value_length(names).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    known = names.flatten().dictionary_encode()
    number = known.indices.to_numpy()
    used, taken = [0] * len(known.dictionary), np.zeros(len(order), bool)
    for at in range(0, len(order), TURNS):
        some = order[at : at + TURNS]
        size = sizes[some]
        ends = np.cumsum(size)
        mine = number[np.repeat(starts[some] - ends + size, size) + np.arange(size.sum())].tolist()
        start = 0
        for k, end in zip(some.tolist(), ends.tolist(), strict=True):
            who, start = mine[start:end], end
            if all(used[n] < limit for n in who):
                for n in who:
                    used[n] += 1
                taken[k] = True
    return pa.table({"_row": entries["_row"].filter(pa.array(taken))})


def _entered() -> Column:
    """The athletes whom an entry counts for: of a relay its named members, else the athlete; a missing name is an empty one."""
    members = F.transform(F.split(F.coalesce("athlete_name", F.lit("")), ","), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
    named = F.filter(members, lambda n: (n != "") & ~F.lower(n).contains("school") & ~F.lower(n).contains("relay"))
    return F.when(F.col("is_relay"), named).otherwise(F.array(F.coalesce("athlete_name", F.lit(""))))


def greedy_selection(pool: DataFrame, limit: int = LIMIT) -> DataFrame:
    """SEQ-1: the entries that fit under a limit of events per athlete, taken by potential points, rank, input order.

    An athlete who is in no relay of the championship (year, season) gets the first ``limit`` entries in that order, found by a window over
    each athlete. A relay without named members always fits. Relays with members, and the entries of these members, depend on each other
    only within a component of athletes whom relays join; each component is chosen by itself, entry by entry, in a group of its own.
    The ranking is made once and written. Needs is_relay (null: no relay); relay rows list their members by name.
    """
    valid = pool.where("m.valid").withColumn("directed", F.col("k.directed"))
    ranked = with_rank(valid, CHAMPIONSHIP, ["directed"])
    actions = ranked.select(
        "year", "season", "id", "event", "team", "athlete_id", "athlete_name", "mark", "directed", F.coalesce(F.col("is_relay"), F.lit(False)).alias("is_relay"),
        place_points(F.col("rank")).alias("potential"), "rank",
    )
    named = stored(actions.withColumns({"names": _entered(), "_row": F.monotonically_increasing_id()}), "entries")
    members = named.where("is_relay").select("year", "season", "id", "names", F.explode("names").alias("name"))
    if members.isEmpty():
        return _own_turns(named, limit).select(actions.columns)
    person = lambda name: F.struct("year", "season", name.alias("name"))
    joined = components(members.select(person(F.get("names", F.lit(0))).alias("a"), person(F.col("name")).alias("b")))
    joined = narrow(joined.select("node.year", "node.season", "node.name", F.col("component.name").alias("component")), NODES)
    # a relay has the component of its first member, an athlete the one of the name
    told = stored(looked_up(named.withColumn("name", F.get("names", F.lit(0))), joined, ["year", "season", "name"]), "entries-by-component")
    coupled = told.where("component IS NOT NULL").select("year", "season", "component", "_row", "names", *[c for c, _ in ORDER])
    # Python gets what the choice needs; the rows themselves don't go there
    taken = stored(coupled.groupBy("year", "season", "component").applyInArrow(lambda group: _select(group, limit), "_row long"), "taken")
    apart = told.where("component IS NULL")
    return _own_turns(apart, limit).select(actions.columns).unionByName(told.join(narrow(taken), "_row", "left_semi").select(actions.columns))


def _own_turns(entries: DataFrame, limit: int) -> DataFrame:
    """The first entries of each athlete, and all relays without names, which come in no athlete's turn."""
    name = F.get("names", F.lit(0))
    athlete = Window.partitionBy("year", "season", name, F.when(name.isNull(), F.col("id")))
    turn = F.row_number().over(athlete.orderBy(F.desc("potential"), "rank", F.asc_nulls_last("event"), F.asc_nulls_last("id")))
    return entries.withColumn("_turn", turn).where(F.col("_turn") <= limit)


def greedy_scores(pool: DataFrame, limit: int = LIMIT) -> DataFrame:
    """SEQ-2: the selected entries ranked again and scored with ties split."""
    return with_tie_points(greedy_selection(pool, limit).drop("rank", "potential"), CHAMPIONSHIP, ["directed"])


def scored_event(event: Column, aliases: dict[str, list[str]], excluded: tuple[str, ...] = ("pentathlon",)) -> Column:
    """FIL-10: whether an event counts: an alias of a scored one is contained in it, and no excluded word is."""
    low = F.lower(event)
    none_of = reduce(lambda a, word: a & ~F.contains(low, F.lit(word.lower())), excluded, F.lit(True))
    return F.coalesce(first_match(event, [(a, name) for name, names in aliases.items() for a in names], "contains").isNotNull() & none_of, F.lit(False))


def missing_events(found: DataFrame, aliases: dict[str, list[str]], *by: str) -> DataFrame:
    """JOIN-11: for each group the expected events of which no alias is contained in a found event."""
    present = found.select(*by, F.explode(F.array(*[F.when(first_match(F.col("event"), [(a, name) for a in names], "contains").isNotNull(), F.lit(name)) for name, names in aliases.items()])).alias("name"))
    seen = present.groupBy(*by).agg(F.collect_set("name").alias("seen"))
    return seen.select(*by, F.explode(F.array_except(F.array(*map(F.lit, aliases)), "seen")).alias("missing"))
