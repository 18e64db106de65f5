"""Entry sheets and the meet sheet (SRC-13, PIV-1, 2, JOIN-10, GEN-2, SRT-7, WIN-10). Cells are split at commas, quoting is not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sheet abbreviations and their events.
EVENTS = {
    "4x8": "4X800m Relay", "55H": "55 M. Hurdles", "55": "55 M. Dash", "1mi": "One Mile", "400": "400 M. Run", "800": "800 M. Run", "200": "200 M. Dash",
    "2mi": "Two Mile Run", "4x2": "4X200m Relay", "LJ": "Long Jump", "TJ": "Triple Jump", "HJ": "High Jump", "PV": "Pole Vault", "SP": "Shot Put",
}
ROLES = ("x", "y", "?", "(y)", "(x)")


def unpivot_sheet(lines: DataFrame, sheet: str = "sheet", events: dict[str, str] = EVENTS) -> DataFrame:
    """PIV-1, 2: sheet, gender, pos, name, event, role, col of every marked cell; the first table is girls', later ones boys'."""
    order = Window.partitionBy(sheet).orderBy("pos")
    is_header = F.contains("line", F.lit("4x8")) & F.contains("line", F.lit("55H"))
    rows = lines.withColumn("_table", F.count(F.when(is_header, 1)).over(order)).withColumn("_h", is_header)
    rows = rows.withColumn("_head", F.first(F.when(F.col("_h"), F.split("line", ",")), True).over(Window.partitionBy(sheet, "_table")))
    cells = rows.where("_table > 0 AND NOT _h").withColumn("_cells", F.split("line", ",")).withColumn("name", F.trim(F.get("_cells", F.lit(0)))).where("name NOT IN ('', 'Total')")
    long = cells.select(sheet, "pos", "_table", "name", F.posexplode("_cells").alias("col", "cell"), "_head").withColumn("role", F.lower(F.trim("cell"))).where((F.col("col") > 0) & F.col("role").isin(*ROLES))
    table = F.create_map(*[F.lit(x) for pair in events.items() for x in pair])
    named = long.withColumn("event", F.try_element_at(table, F.trim(F.get("_head", F.col("col"))))).where("event IS NOT NULL")
    return named.select(sheet, F.when(F.col("_table") == 1, "girls").otherwise("boys").alias("gender"), "pos", "name", "event", "role", "col")


def base_event(slot: Column) -> Column:
    return F.trim(F.regexp_replace(slot, "Girls|Boys|Prelim|Final", ""))


def sheet_match(slots: DataFrame, entries: DataFrame, events: tuple[str, ...] = tuple(EVENTS.values())) -> DataFrame:
    """JOIN-10: ord, slot, name, role: for each programme slot the athletes of its gender with an event that contains it or is contained.

    The substring test runs between slots and the fixed list of events; athletes then come by an equi-join.
    """
    base = base_event(F.col("slot"))
    fits = F.filter(F.array(*map(F.lit, events)), lambda e: F.contains(base, e) | F.contains(e, base))
    gender = F.when(F.contains(F.lower("slot"), F.lit("girls")), "girls").when(F.contains(F.lower("slot"), F.lit("boys")), "boys")
    wanted = slots.select("ord", "slot", gender.alias("gender"), F.explode(fits).alias("event"))
    met = entries.join(wanted, ["gender", "event"])
    return met.groupBy("ord", "slot", "pos", "name").agg(F.min_by("role", "col").alias("role"))


def meet_sheet(slots: DataFrame, entries: DataFrame) -> DataFrame:
    """GEN-2, SRT-7, WIN-10: the programme with its entries in order, relay roles labelled, in two columns; finals of the 55 are tentative."""
    met = sheet_match(slots, entries)
    relay = F.contains(F.lower("slot"), F.lit("relay"))
    rank = F.when(~relay, 0).when(F.col("role") == "x", 1).when(F.col("role") == "y", 2).when(F.col("role").isin("(x)", "(y)"), 3).otherwise(9)
    label = F.when(~relay, "").when(F.col("role") == "x", " (A)").when(F.col("role") == "y", " (B)").otherwise(" (Alt)")
    people = met.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "pos", F.concat("name", label).alias("label")))).alias("people"))
    n = slots.count()
    half = -(-n // 2)
    placed = slots.join(people, "ord", "left").withColumn("number", F.row_number().over(Window.orderBy("ord")))
    return placed.select("ord", "slot", "number", F.when(F.col("number") <= half, 1).otherwise(2).alias("column"), F.transform(F.coalesce("people", F.array()), lambda p: p["label"]).alias("entries"), (F.contains("slot", F.lit("55")) & F.contains("slot", F.lit("Final"))).alias("tentative"))
