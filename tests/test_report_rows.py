"""Questions about reports that need no document of a whole file."""

import pytest

from cinderpath.operators import audit, report_parser
from cinderpath.plans import report_queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    """Two printed reports, one whose first event has no result, and one without events."""
    files = report_queries.reports(spark, SF).orderBy("file").limit(2)
    first = files.first()
    at = first["text"].index("Event 12  ")
    title, rest = first["text"][:at], first["text"][at:]
    empty = "Boys 55 Meter Dash\n" + "=" * 70 + "\n    Name                     Yr School                   Finals Points\n\n"
    odd = [("empty-event", f"{title}{empty}{rest}"), ("no-events", "Licensed to Example Timing\n     Example Field House, Town\n 1/2/2024")]
    return files.unionByName(spark.createDataFrame(odd, "file string, text string")).cache()


def test_rows_tell_what_documents_tell(spark):
    files = texts(spark)
    meets = report_parser.meets(files)
    size = lambda v, f: None if v is None else f(v)
    wanted = {(r["file"], r["meet_name"], r["date"], size(r["events"], len), size(r["events"], lambda v: sum(len(e["results"]) for e in v))) for r in meets.collect()}
    assert {tuple(r[c] for c in ("file", "meet_name", "date", "events", "results")) for r in report_parser.counted_meets(files).collect()} == wanted
    assert len(wanted) == 4 and ("no-events", "Example Field House, Town", "2024-01-02", None, None) in wanted
    found, old = audit.first_warnings(report_parser.results(files), 1000), audit.warnings_report(meets, 1000)
    assert found.columns == old.columns and [tuple(r) for r in found.collect()] == [tuple(r) for r in old.collect()] and found.count() > 2


@pytest.mark.parametrize("query", [report_queries.report_meets, report_queries.report_warnings])
def test_no_task_holds_the_results_of_a_file(spark, query):
    """Lists of all results were collected for each block and again for each file."""
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(block" not in plan and "collect_list(struct(result_ord" not in plan
