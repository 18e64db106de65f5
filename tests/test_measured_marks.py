"""Tables of measurements: what is written out as nought there is a value, as the queries' SQL says."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cinderpath.functions.marks import parse_mark, with_marks

QUERIES = (
    "milestones", "mark_parse", "mark_format", "mark_improvement", "history_sorted", "best_per_group", "championship", "team_scores", "result_table", "greedy_scores", "relay_scores", "pr_pops", "pop_summary", "meet_pops", "profile_stats",
    "profile_series",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of which one in nine is 0.00, the latest day's among them."""
    path = tmp_path_factory.mktemp("measured")
    start, kinds = dt.datetime(2024, 1, 1), ("view", "click", "error", "purchase", "signup")
    rows = [(i, start + dt.timedelta(hours=2 * i, minutes=i % 60), i * 7 % 4, kinds[i // 4 % 5], 0.0 if i % 9 == 1 or i >= 356 else (i * 7919 % 9973) / 100, '{"k": 1}') for i in range(360)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_times_are_values(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, folder), db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_zero_is_a_choice(spark):
    marks = spark.createDataFrame([(i, m) for i, m in enumerate(["0.00", "0:00.00", "--", "NM", "DNF", "", "7.40"])], "i int, mark string")
    rows = marks.select("i", parse_mark(F.col("mark")).alias("m"), parse_mark(F.col("mark"), zero=True).alias("z")).orderBy("i").collect()
    assert [r.m.valid for r in rows] == [False] * 6 + [True] and [r.z.valid for r in rows] == [True, True, False, False, False, False, True]
    assert [r.i for r in with_marks(with_marks(marks, zero=True)).where("m.valid").orderBy("i").collect()] == [0, 1, 6]


def test_zero_is_the_best_before_a_latest_meet(spark, tmp_path):
    """A view of 4.00 at the latest meet doesn't improve on 0.00, and a view of 0.00 improves on 3.00."""
    rows = [(1, 1, 1, 5.0), (2, 2, 1, 0.0), (3, 3, 1, 4.0), (4, 1, 13, 3.0), (5, 3, 13, 0.0)]
    spark.createDataFrame([(i, dt.datetime(2024, 1, day, 12, i), user, "view", value, "{}") for i, day, user, value in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = entry.queries()["meet_pops"](spark, str(tmp_path)), db.sql(entry.oracle_sql()["meet_pops"])
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*columns).fetchall())
    assert [(r.athlete_id, r.mark) for r in got.collect()] == [(13, "0.00")]
