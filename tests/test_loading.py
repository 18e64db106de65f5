"""Loading in batches, the manifest and lookup lists."""

import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from cinderpath.functions.lookups import fitting_entry, looked_up_first
from cinderpath.operators.cleanse import date_in_name
from cinderpath.sources import batches, warehouse
from cinderpath.streaming.incremental import PERFORMANCES, Rules, load_meets, load_new_meets

RULES = Rules("Indoor", "2025")


def meet(name, mark, who="Al Example"):
    return {"meet_name": name, "date": "2025-02-08", "events": [{"event": "55 Meter Dash", "gender": "Boys", "is_relay": False, "results": [{"athlete": who, "school": "North", "result": mark, "type": "Finals"}]}]}


def tables(spark, root):
    athletes = batches.read_batches(spark, root, "athletes", warehouse.ATHLETES)
    return sorted(map(tuple, batches.read_batches(spark, root, "performances", PERFORMANCES).join(athletes.drop("batch"), "athlete_id").select("id", "athlete_id", "athlete_name", "mark", "meet_name", "batch").collect()))


def test_stream(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def load():
        load_new_meets(spark, str(inbox), root, str(tmp_path / "cp"), RULES).awaitTermination()
        return tables(spark, root)

    (inbox / "m1.json").write_text(json.dumps(meet("m1", "6.79"), indent=4))
    assert load() == [(1, 1, "Al Example", "6.79", "m1", 0)]
    (inbox / "m2.json").write_text(json.dumps(meet("m2", "6.79")))  # the same performance from another meet file
    (inbox / "m3.json").write_text(json.dumps(meet("m3", "6.70", "Bo Sample")))
    (inbox / "old.json").write_text(json.dumps(meet("x", "6.60")["events"]))  # the older form: a list, no date
    assert load() == [(1, 1, "Al Example", "6.79", "m1", 0), (2, 2, "Bo Sample", "6.70", "m3", 1), (3, 1, "Al Example", "6.60", "old", 1)] == load()
    assert warehouse.read_meets(spark, str(inbox / "old.json")).first().meet_name == "old"
    assert warehouse.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_a_half_written_batch_is_not_seen_and_runs_again(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda *m: spark.createDataFrame([(x["meet_name"], x["date"], x["events"]) for x in m], f"stem string, date string, events {warehouse.EVENTS}")
    first, second = frame(meet("m1", "6.79")), frame(meet("m1", "6.79"), meet("m2", "6.70", "Bo"), meet("m3", "6.60", "Cy"))
    load_meets(spark, root, first, 0, RULES)
    before = tables(spark, root)
    load_meets(spark, root, second, 1, RULES)
    after = tables(spark, root)
    (Path(root) / "_committed" / "1").unlink()  # as if it had stopped between the tables and the name
    assert tables(spark, root) == before and len(after) == 3
    load_meets(spark, root, second, 1, RULES)
    assert tables(spark, root) == after
    load_meets(spark, root, second, 2, RULES)  # nothing new
    assert tables(spark, root) == after


def test_manifest_moves_an_address_once(spark, tmp_path):
    root = str(tmp_path)
    when = lambda n: F.lit(f"2025-01-0{n}").cast("timestamp")
    found = lambda n, *rows: spark.createDataFrame(rows, "url string, year string").withColumn("seen", when(n))
    batches.file_under(spark, root, found(1, ("http://a/x.htm?q=1", "2024"), ("http://a/", "2024"), ("http://a/", "2023")), 0)
    batches.file_under(spark, root, found(2, ("http://a/x.htm?q=1", "2025")), 1)
    batches.file_under(spark, root, found(3, ("http://a/x.htm?q=1", "2025"), ("http://b/y.pdf", "2025")), 2)
    now = sorted((r.url, r.year, r.path, r.seen.day) for r in batches.manifest(spark, root).collect())
    assert now == [("http://a/", "2024", "2024/index.html", 1), ("http://a/x.htm?q=1", "2025", "2025/x.htm", 2), ("http://b/y.pdf", "2025", "2025/y.pdf", 3)]
    assert [batches.read_batches(spark, root, "manifest", batches.MANIFEST).where(f"batch = {n}").count() for n in range(3)] == [2, 1, 1]
    batches.file_under(spark, root, found(4, ("http://b/y.pdf", "2026")), 3, whole=True)
    assert batches.committed(spark, root) == [3]
    assert {(r.url, r.year) for r in batches.manifest(spark, root).collect()} == {("http://a/", "2024"), ("http://a/x.htm?q=1", "2025"), ("http://b/y.pdf", "2026")}


def test_long_lookup_lists(spark):
    """100,000 entries against brute force, by equi-joins only."""
    n = 100_000
    entries = spark.range(n).selectExpr(f"(id * 7919) % {n} AS ord", "upper(substr(sha2(cast(id AS string), 256), 1, int(2 + id % 9))) AS key", "concat('e', id) AS full")
    rows = spark.range(300).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE sha2(cast(id * 31 AS string), 256) END AS v").unionByName(spark.createDataFrame([(900, ""), (901, "ab")], "id long, v string"))
    listed = sorted((r.ord, r.key.lower(), r.full) for r in entries.collect())
    best = {}
    for _, key, full in listed:
        best.setdefault(key, (_, full))
    for how, parts in (("prefix", lambda v: [v[:k] for k in range(2, 11)]), ("contains", lambda v: [v[i : i + k] for k in range(2, 11) for i in range(len(v))]), ("equal", lambda v: [v])):
        want = {}
        for r in rows.collect():
            hits = [best[p] for p in parts(r.v or "") if p in best and r.v is not None]
            want[r.id] = min(hits)[1] if hits else None
        found = looked_up_first(rows, "v", entries, "found", how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        start = time.perf_counter()
        assert {r.id: r.found for r in found.collect()} == want, how
        assert time.perf_counter() - start < 60
    few = spark.createDataFrame([(1, "", "all"), (0, "Ab", "first"), (2, None, "never")], "ord int, key string, full string")
    assert {r.id: r.found for r in fitting_entry(rows.where("id >= 900 OR id = 0"), "v", few, "found", "prefix", F.lit("none")).collect()} == {0: "none", 900: "all", 901: "first"}
    assert looked_up_first(rows, "v", few.limit(0), "found", "contains").where("found IS NOT NULL").isEmpty()


def test_dates_in_names(spark):
    cases = [("results7feb2025", "2025-02-07"), ("x-2-7-2025", "2025-02-07"), ("x_12_30_2024", "2024-12-30"), ("7xyz2025", None), ("none", None), (None, None)]
    found = spark.createDataFrame(cases, "name string, want string").select(date_in_name(F.col("name")).alias("d"), "want").collect()
    assert [r.d for r in found] == [r.want for r in found]


def test_many_fitting_keys_are_not_sorted(spark):
    """Every prefix of a value is a key: the first entry is kept by hash, without a sort of all that fits. Equal ords, null ords and null texts as before."""
    from cinderpath.functions.lookups import looked_up_first

    texts = [f"{'abcdefgh' * 4}{i}" for i in range(20)] + ["", None, "zz"]
    entries = [((n * 7) % 5 if n % 6 else None, t[:n].upper(), None if n == 12 else f"e{n % 3}") for t in texts[:3] for n in range(1, 35)] + [(9, None, "never"), (3, "Z", "z")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = looked_up_first(rows, "t", spark.createDataFrame(entries, "ord int, key string, full string"), "found", "prefix")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[_value" in plan and "SortAggregate(key=[_value" not in plan, plan
    low = lambda o, k, f: (o is not None, o or 0, f is not None, f or "")
    for r in found.collect():
        fit = [e for e in entries if e[1] is not None and r.t is not None and r.t.lower().startswith(e[1].lower())]
        assert r.found == (min(fit, key=lambda e: low(*e))[2] if fit else None), r
