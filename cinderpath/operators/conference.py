"""Schools of a conference (JOIN-7, PRJ-10, PRJ-11): lists by year and season, literals in the plan, no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of a team's name, or part of one, and the school's full name, in order.
SCHOOLS = (
    ("Orono", "Orono High School"), ("George Steve", "George Stevens Academy"), ("Bucksport", "Bucksport High School"), ("Sumner", "Sumner/Narragaugus"),
    ("Central", "Central High School"), ("Foxcroft", "Foxcroft Academy"), ("Dexter", "Dexter Regional High School"), ("Piscataquis", "Piscataquis Community High School"),
    ("Penquis", "Penquis Valley High School"), ("Searsport", "Searsport District High School"), ("Mattanawcook", "Mattanawcook Academy"), ("Lee Academy", "Lee Academy"),
    ("Deer Isle", "Deer Isle-Stonington High School"), ("Bangor Chris", "Bangor Christian Schools"), ("Greenville", "Greenville High School"), ("Narraguagus", "Sumner/Narragaugus"),
    ("Washington Acad", "Washington Academy"), ("Calais", "Calais High School"), ("Shead", "Shead High School"), ("Fort Kent", "Fort Kent Community High School"),
    ("Caribou Hig", "Caribou High School"), ("Presque Isle", "Presque Isle High School"), ("Houlton", "Houlton High School"),
)
#: The lists of single seasons.
SCHOOLS_OF = {
    ("2026", "Indoor"): (
        ("Bangor Chris", "Bangor Christian Schools"), ("Bucksport", "Bucksport High School"), ("Central", "Central High School"), ("Dexter", "Dexter Regional High School"),
        ("Foxcroft", "Foxcroft Academy"), ("George Stevens", "George Stevens Academy"), ("Mattanawcook", "Mattanawcook Academy"), ("Orono", "Orono High School"),
        ("PCHS", "Piscataquis Community High School"), ("Penquis", "Penquis Valley High School"), ("Searsport", "Searsport District High School"), ("Sumner", "Sumner/Narragaugus"),
    ),
}
#: Keys that don't hold for teams with a word in their name, and a second word for a key (letter case counts).
UNLESS = {"Central": "maine"}
ALSO = {"PCHS": "Piscataquis"}


def school(team: Column, schools: tuple[tuple[str, str], ...], unless: dict[str, str] = UNLESS, also: dict[str, str] = ALSO) -> Column:
    """PRJ-10: the full name of the first school whose key the team's name contains or whose full name it is, letter case ignored; else by a second word; null if none."""
    if not schools:
        return F.lit(None).cast("string")
    lower = F.lower(team)
    rows = F.array(*[F.struct(F.lit(k.lower()).alias("key"), F.lit(full).alias("full"), F.lit(unless.get(k)).cast("string").alias("unless")) for k, full in schools])
    first = F.get(F.filter(rows, lambda s: (F.contains(lower, s["key"]) | (lower == F.lower(s["full"]))) & ~F.coalesce(F.contains(lower, s["unless"]), F.lit(False))), F.lit(0))["full"]
    second = [F.when(F.contains(team, F.lit(also[k])), full) for k, full in schools if k in also]
    return F.coalesce(first, *second)


def school_in(team: Column, year: Column, season: Column, lists: dict[tuple[str, str], tuple[tuple[str, str], ...]] = SCHOOLS_OF, default: tuple[tuple[str, str], ...] = SCHOOLS) -> Column:
    """PRJ-11: ``school`` by the list of the year and season, else by the default one."""
    own = reduce(lambda c, item: c.when((year == item[0][0]) & (season == item[0][1]), school(team, item[1])), lists.items(), F.when(F.lit(False), F.lit("")))
    return own.otherwise(school(team, default))
