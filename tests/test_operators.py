import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cinderpath.functions.marks import with_marks
from cinderpath.operators import api, audit, cleanse, conference, history, pops, scoring
from cinderpath.sources.bindings import perf_events

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
DAYS = ["2024-12-20", "2025-01-10", "2025-01-25", "2025-02-08", "2025-12-06", "2025-12-20", "2025-12-27"]
INCHES = [158.25, 166.75, 179.75, 177.75, 160.75, 167.50, 176.50]


def long_jumps(spark):
    rows = [(i, 1, "Long Jump", f"{int(x // 12)}-{x % 12:05.2f}", dt.datetime.fromisoformat(d), "2025" if i < 4 else "2026", "Indoor") for i, (d, x) in enumerate(zip(DAYS, INCHES, strict=True))]
    return spark.createDataFrame(rows, "id long, athlete_id long, event string, mark string, date timestamp_ntz, year string, season string")


def test_series_of_jumps(spark):
    perf = long_jumps(spark)
    rows = {r.id: r for r in history.milestones(perf).collect()}
    assert [i for i, r in rows.items() if r.is_first] == [0] and [i for i, r in rows.items() if r.is_pr] == [2]
    assert sorted(i for i, r in rows.items() if r.is_sb) == [2, 6]
    stats = history.profile(perf).first()
    assert (stats.best_mark, stats.upper_median, stats.n) == ("14-11.75", 167.5, 7) and stats.sigma == pytest.approx(7.8988, abs=1e-4)


@pytest.mark.parametrize(
    ("marks", "ranks", "points"),
    [(["7.1", "7.2", "7.2", "7.3", "7.4"], [1, 2, 2, 4, 5], [10, 7, 7, 4, 2]), (["7.0", "7.1", "7.2", "7.3", *["7.5"] * 4], [1, 2, 3, 4, 5, 5, 5, 5], [10, 8, 6, 4, *[0.75] * 4]), (["7"] * 3 + ["8"], [1, 1, 1, 4], [8, 8, 8, 4])],
)
def test_tie_points(spark, marks, ranks, points):
    df = with_marks(spark.createDataFrame([(i, "e", m) for i, m in enumerate(marks)], "id long, event string, mark string"))
    rows = scoring.with_tie_points(df.withColumn("directed", F.col("k.directed")), ["event"], ["directed"]).orderBy("id").collect()
    assert [r["rank"] for r in rows] == ranks and [r.points for r in rows] == pytest.approx(points)


def test_greedy_never_exceeds_its_limit_and_relays_need_room(spark):
    ind = [(i, f"e{i}", "A", 1, "Al", f"{7 + i / 10}", False) for i in range(5)]
    relay = [(9, "4x2", "A", 2, "Al, Bo, Cy, Di", "99.0", True), (10, "4x4", "B", 3, "B Relay", "99.0", True)]
    pool = with_marks(spark.createDataFrame([(*r, "2025", "Indoor") for r in ind + relay], "id long, event string, team string, athlete_id long, athlete_name string, mark string, is_relay boolean, year string, season string"))
    chosen = {r.id for r in scoring.greedy_selection(pool).collect()}
    assert 10 in chosen and len(chosen & {0, 1, 2, 3, 4}) == 3 and 9 not in chosen


def test_greedy_equals_one_by_one(spark):
    names = ["Al", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "", None]
    rows = [(i, f"e{i % 7}", names[i * 5 % 9], f"{8 + i * 37 % 101 / 10}", False, str(2024 + i % 2)) for i in range(150)]
    rows += [(200 + i, f"r{i % 3}", who, f"{90 + i}.0", True, str(2024 + i % 2)) for i, who in enumerate(["Al, Bo", " Cy ,Di, Al", "B Relay", "North School", None, "Al, Al", "Ed,Bo,", "Di"])]
    rows.append((300, None, "Al", "7.1", None, "2024"))
    pool = spark.createDataFrame(rows, "id long, event string, athlete_name string, mark string, is_relay boolean, year string").selectExpr("*", "'A' AS team", "id AS athlete_id", "'Indoor' AS season")
    pool = with_marks(pool).cache()
    ranked = scoring.with_rank(pool.where("m.valid").withColumn("directed", F.col("k.directed")), ["event", "season", "year"], ["directed"]).collect()
    points = lambda r: scoring.POINTS[r.rank - 1] if r.rank <= 6 else 0
    used, want = {}, set()
    for r in sorted(ranked, key=lambda r: (-points(r), r.rank, bool(r.is_relay), r.event is None, r.event or "", r.id)):
        who = [r.athlete_name or ""]
        if r.is_relay:
            who = [n for n in (x.strip() for x in who[0].split(",")) if n and "school" not in n.lower() and "relay" not in n.lower()]
        if all(used.get((r.year, n), 0) < 3 for n in who):
            want.add(r.id)
            for n in who:
                used[r.year, n] = used.get((r.year, n), 0) + 1
    found = [r.id for r in scoring.greedy_selection(pool).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert scoring.greedy_selection(pool.where("false")).count() == 0


def test_components(spark):
    """Against a search: a long way, a star, a ring, rings joined by one edge, loops."""
    from cinderpath.operators.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300 + i, 300 + (i + 1) % 5) for i in range(5)] + [(208, 304), (500, 500), (501, 502), (502, 501)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = start
                todo += near[node]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)


def test_places_over_partitions(spark):
    """Numbers and running values of groups that lie in many partitions, null and hot groups among them."""
    from pyspark.sql import Window

    from cinderpath.operators import ranking

    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('g', id % 10) END AS g", "id * 7919 % 1009 AS v", "id")
    found = ranking.indexed(rows.repartition(5), ["g"], ["v", "id"])
    want = rows.withColumn("index", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))
    named = found.where("g IS NOT NULL").cache()
    for back in (False, True):
        order = F.desc("index") if back else F.asc("index")
        over = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        got = ranking.running(named, "g", "index", {"s": ("sum", "v"), "x": ("bit_xor", "v")}, block=16, backwards=back)
        assert sorted(map(str, got.collect())) == sorted(map(str, named.withColumns({"s": F.sum("v").over(over), "x": F.bit_xor("v").over(over)}).collect()))
    assert ranking.indexed(rows, [], ["id"]).where("index <> id").isEmpty() and ranking.indexed(rows.limit(0), ["g"], ["v"]).isEmpty()


def test_points_conserved(spark):
    scored = scoring.championship_points(perf_events(spark, SF))
    for row in scored.groupBy("event", "season", "year").agg(F.sum("points").alias("s"), F.count("*").alias("n")).collect():
        assert row.s == pytest.approx(sum(scoring.POINTS[: min(6, row.n)]))


def test_teams_seasons_and_names(spark):
    teams = spark.createDataFrame([("North Chris",), ("northfield",), ("",), (None,), ("Elsewhere",)], "t string").select(cleanse.normalise_team(F.col("t"), [("North Ch", "North Christian"), ("North", "North High")]).alias("t"))
    assert [r.t for r in teams.collect()] == ["North Christian", "North High", "Unknown", "Unknown", "Elsewhere"]
    names = spark.createDataFrame([("Al Example",), ("North High",), ("12.34",), ("Roe, Ann",)], "n string").select(cleanse.likely_athlete(F.col("n")).alias("x"))
    assert [r.x for r in names.collect()] == [True, False, True, True]
    day = lambda d: cleanse.date_in_season(F.lit(d).try_cast("date"), F.lit("Indoor"), F.lit("2026"))
    assert tuple(spark.range(1).select(day("2025-11-01"), day("2026-03-31"), day("2026-04-01"), day("x")).first()) == (True, True, False, False)
    when = cleanse.resolve_date(F.lit("December 20-22, 2025"), F.lit(None).cast("string"), F.lit("2025-01-01"), F.lit(None).cast("string"), F.lit("Indoor"), F.lit("2026"))
    assert spark.range(1).select(when).first()[0] == "2025-12-20"


def test_loading_twice_is_loading_once(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3)], "k long, v string, o long")
    once = cleanse.first_arrivals(rows, None, ["k"], ["o"])
    assert sorted((r.k, r.o) for r in once.collect()) == [(1, 1), (2, 3)]
    assert cleanse.first_arrivals(rows, once, ["k"], ["o"]).count() == 0


@pytest.mark.parametrize(
    "name",
    [
        "milestones", "facets", "pr_pops", "meet_pops", "team_scores", "sheet_match", "meet_sheet", "report_round_trip", "report_meets", "report_flat", "report_preview", "report_warnings", "conference_schools", "display_date",
        "result_table", "record_counts", "pop_summary", "profile_stats", "profile_series", "comp_rank", "tie_points", "relay_scores", "scored_events", "filter_options", "crawl", "crawl_files", "meet_links", "html_paragraphs", "page_links", "load",
        "manifest", "lookup_prefix", "lookup_contains", "lookup_equal", "performance_lists", "latest_lists", "delimited_pages", "page_layouts", "bio_results", "latest_meet", "block_segment", "carry_forward",
    ],
)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_conference_lists(spark):
    cases = [
        ("Maine Central Institute", "2025", "Indoor", None), ("Central Aroostook", "2025", "Indoor", "Central High School"), ("ORONO HIGH SCHOOL", "2026", "Indoor", "Orono High School"),
        ("Houlton", "2025", "Outdoor", "Houlton High School"), ("Houlton", "2026", "Indoor", None), ("Piscataquis", "2026", "Indoor", "Piscataquis Community High School"),
        ("piscataquis", "2026", "Indoor", None), ("piscataquis", "2026", "Outdoor", "Piscataquis Community High School"), ("pchs", "2026", "Indoor", "Piscataquis Community High School"),
        (None, "2026", "Indoor", None), ("Calais", None, None, "Calais High School"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, team string, year string, season string, want string")
    got = rows.select("i", "want", conference.school_in(F.col("team"), F.col("year"), F.col("season")).alias("got")).collect()
    assert [(r.i, r.got) for r in got if r.got != r.want] == []
    assert spark.range(1).select(conference.school(F.lit("x"), ())).first()[0] is None


def test_lists_and_counts_of_the_pages(spark):
    summary = spark.createDataFrame([(1, "Zed"), (2, "\u00c9mile"), (3, "adam"), (4, "Fay")], "athlete_id long, athlete_name string")
    assert [r.athlete_id for r in pops.by_name(summary).collect()] == [3, 2, 4, 1]
    perf = spark.createDataFrame([("a", None), ("a", '["30.1"]'), ("a", "no list"), ("b", "[]")], "team string, splits string")
    assert sorted(map(tuple, audit.record_counts(perf, "team").collect())) == [("a", 3, 1), ("b", 1, 0)]
    assert [r.team for r in api.teams(spark.createDataFrame([("Emma",), ("Orono",), ("abc",), ("ABC",)], "team string")).collect()] == ["ABC", "Orono"]
    table = {(r.athlete_id, r.mark): r.place for r in scoring.result_table(spark.createDataFrame([(1, 1, "e", "DNF", 1), (2, 2, "e", "7.2", 1), (3, 3, "e", "7.1", 2), (4, 3, "e", "7.3", 1), (5, 4, "e", "7.2", 2)], "id long, athlete_id long, event string, mark string, date int"), "event").collect()}
    assert table == {(3, "7.1"): 1, (2, "7.2"): 2, (4, "7.2"): 3, (1, "DNF"): 4}


def test_every_athlete_and_supplier_is_ranked(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{LARGER}/events.parquet'")
    got = [tuple(r) for r in entry.queries()["history_sorted"](spark, LARGER).select("id", "athlete_id", "mark", "place").collect()]
    # every athlete has one row for each event and season, with places without gaps
    assert sorted(got) == sorted(db.sql(entry.oracle_sql()["history_sorted"]).select("id", "athlete_id", "mark", "place").fetchall())
    groups = perf_events(spark, LARGER).select("athlete_id", "event", "season").distinct().groupBy("athlete_id").count().collect()
    places = {}
    for _, athlete, _, place in got:
        places.setdefault(athlete, []).append(place)
    assert max(places) > 20 and {a: sorted(p) for a, p in places.items()} == {r["athlete_id"]: list(range(1, r["count"] + 1)) for r in groups}
    lines = [(s, o, 1, float((s * o) % 5)) for s in (1, 20, 21, 500) for o in range(9)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    ranks = sorted((r.l_suppkey, r.l_orderkey, r["rank"], r.potential) for r in entry.queries()["comp_rank"](spark, str(tmp_path)).collect())
    rank = {(s, o): 1 + sum(t == s and other > q for t, _, _, other in lines) for s, o, _, q in lines}
    assert ranks == sorted((s, o, n, float([10, 8, 6, 4, 2, 1, *[0] * 9][n - 1])) for (s, o), n in rank.items())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
