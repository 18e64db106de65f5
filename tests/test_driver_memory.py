"""What may not be broadcast by Spark's guess from a file's size, and what no task may hold as a whole."""

from pyspark.sql import functions as F

from cinderpath.operators import components as rounds
from cinderpath.operators import scoring
from cinderpath.tables import narrow


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    """Structs of texts take a few bytes in Parquet and some 100 in memory, so their number decides."""
    plans, stored = [], rounds.stored
    monkeypatch.setattr(rounds, "stored", lambda df, label: (plans.append(plan(df)), stored(df, label))[1])
    monkeypatch.setattr(rounds, "NODES", 2, raising=False)
    node = lambda c: F.struct(F.lit("2024").alias("year"), F.col(c).cast("string").alias("name"))
    edges = spark.range(6).select(node("id").alias("a"), F.struct(F.lit("2024").alias("year"), (F.col("id") + 1 - F.col("id") % 2).cast("string").alias("name")).alias("b"))
    found = {r["node"]["name"]: r["component"]["name"] for r in rounds.components(edges).collect()}
    assert found == {"0": "0", "1": "0", "2": "2", "3": "2", "4": "4", "5": "4"}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_wide_tables_are_merged(spark):
    rows = spark.range(100)
    assert "SortMergeJoin" in plan(rows.join(narrow(spark.range(10), 5), "id")) and "Broadcast" in plan(rows.join(narrow(spark.range(10), 50), "id"))


def test_relay_selection_gets_narrow_rows(spark, monkeypatch):
    """Groups of a component hold what the choice needs, and not the entries."""
    plans, stored = {}, scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df, label: (plans.update({label: plan(df)}), stored(df, label))[1])
    rows = [(i, "2024", "Indoor", e, f"A{i % 5}", f"A{i % 5}" if e == "x" else f"A{i % 5}, A{(i + 1) % 5}", e == "y") for i, e in ((i, "xy"[i % 2]) for i in range(12))]
    pool = spark.createDataFrame(rows, "id long, year string, season string, event string, team string, athlete_name string, is_relay boolean")
    pool = pool.withColumns({"athlete_id": F.col("id"), "mark": F.col("id").cast("string"), "m": F.struct(F.lit(True).alias("valid")), "k": F.struct(F.col("id").cast("double").alias("directed"))})
    used, taken = {}, set()
    for i, *_, name, relay in sorted(rows, key=lambda r: (max(0, [10, 8, 6, 4, 2, 1, 0][min(r[0] // 2, 6)]) * -1, r[0] // 2 + 1, r[6], r[3], r[0])):
        who = name.split(", ")
        if all(used.get(n, 0) < 3 for n in who):
            taken.add(i)
            used.update({n: used.get(n, 0) + 1 for n in who})
    assert {r["id"] for r in scoring.greedy_selection(pool).collect()} == taken
    assert "taken" in plans and "FlatMapGroupsInArrow" in plans["taken"] and "athlete_name" not in plans["taken"]
