import re

from pyspark.sql import functions as F

from cinderpath.operators import audit, entry_sheet, list_parser, report_parser
from cinderpath.operators.cleanse import flatten_meets, flatten_results
from cinderpath.sources import pages

RULE = "=" * 71
REPORT = "\n".join(
    [
        "             2025 Example League Meet 3 - 2/8/2025", "                  Example Field House, Town", "", "Boys 55 Meter Dash Small School", RULE, "League Record: R  6.46  2024        Old Holder, North",
        "    Name                    Year School                  Finals  Points", RULE, "  1 Al Example                12 North Academ              6.79   10", "  2 Bo Sample                 11 South High S              6.81q   8",
        " -- Cy Nobody                 10 South High S                NH", "", "Boys Long Jump", RULE, "    Name                    Year School                  Finals  Points", RULE,
        "  1 Di Leap                   12 North Academ        J10-06.00   10", "", "Event 2  Girls 4x800 Meter Relay", RULE, "    School                                               Finals  Points", RULE,
        "  1 North Academy                                       9:14.11   10", "     1) Ann Roe 12                      2) Bea Poe 11", "     3) Cat Doe 10                      4) Dot Loe 9", "     2:18.100 (2:18.100)  4:36.400 (2:18.300)", "",
        "             Men - Small School - Team Rankings - 2 Events Scored", "    1) North Academy   10",
    ]
)


def test_report(spark):
    files = spark.createDataFrame([("m1", REPORT), ("empty", "")], "file string, text string")
    docs = {r.file: r for r in report_parser.meets(files).collect()}
    assert docs["empty"].events is None
    meet = docs["m1"]
    assert (meet.meet_name, meet.date) == ("Example Field House, Town", "2025-02-08")
    dash, jump, relay = meet.events
    assert (dash.event, dash.gender, dash.is_relay) == ("55 Meter Dash", "Boys", False)
    assert [(r.athlete, r.school, r.result, r.type) for r in dash.results] == [("Al Example", "North Academ", "6.79", "Finals"), ("Bo Sample", "South High S", "6.81", "Finals"), ("Cy Nobody", "South High S", "NH", "Finals")]
    assert jump.results[0].result == "10-06.00" and jump.results[0].warnings == ["Original result: J10-06.00"]
    assert relay.is_relay and relay.results[0].athletes == ["Ann Roe", "Bea Poe", "Cat Doe", "Dot Loe"]
    assert (relay.results[0].school, relay.results[0].result, relay.results[0].splits) == ("North Academy", "9:14.11", ["2:18.100", "2:18.300"])
    flat = flatten_meets(report_parser.meets(files).where("file = 'm1'").withColumnRenamed("file", "stem")).collect()
    assert len(flat) == 5 and {r.athlete_name for r in flat if r.is_relay} == {"Ann Roe, Bea Poe, Cat Doe, Dot Loe"}
    assert audit.digit_audit(report_parser.meets(files).where("file = 'm1'")).first().entries == 5


def test_delimited_and_lists(spark):
    standard = "Example Meet 3 - 12/20/2025\nGirls 55 Meter Dash\n1  Example, Ann  12  North Academy  7.79q\n"
    smaa = "Example Meet 4 - 11/30/2025\nBoys 55 Meter Dash\n1  Example, Al  North Academy  6.79  2\nBoys 4x200 Meter Relay\n1  South High  1:37.84\n"
    files = spark.createDataFrame([("a", standard, "u", "Indoor"), ("b", smaa, "u", "Indoor")], "file string, text string, url string, season string")
    rows = [(r.file, r.athlete_name, r.grade, r.school, r.event, r.mark, r.season) for r in list_parser.delimited(files).orderBy("file", "pos").collect()]
    assert rows == [
        ("a", "Example, Ann", "12", "North Academy", "Girls 55 Meter Dash", "7.79", "2026 Indoor"), ("b", "Example, Al", "--", "North Academy", "Boys 55 Meter Dash", "6.79", "2026 Indoor"),
        ("b", "South High Relay", "--", "South High", "Boys 4x200 Meter Relay", "1:37.84", "2026 Indoor"),
    ]
    text = "Girls 55 Meter Dash ===\n1 7.79 F Ann Example 12 North Academy 12/20/2025\n2 7.99 F Bea Other 11 Far School 11/30/2025\nBoys 4x200 Relay\n1 1:37.84 F A 'North Academy' 11/30/2025\n"
    lists = list_parser.performance_list(spark.createDataFrame([("f", text, "Indoor")], "file string, text string, season string"), [("north", "North Academy")])
    assert [(r["name"], r.mark, r.year) for r in lists.orderBy("pos").collect()] == [("Ann Example", "7.79", "2026"), ("North Academy Relay", "1:37.84", "2025")]


def test_lists_of_an_index(spark):
    rows = "Girls 55 Meter Dash ===\n1 7.79 F Ann Example 12 North Academy 12/20/2025\n"
    index = spark.createDataFrame([("https://h.example/in/", '<a href="/x/emitlgirls12.htm">g</a><a href="pvcboysrelays3.htm">b</a><a href="/x/emitlgirls12.htm">g</a><a href="news.htm">n</a>', "Indoor")], "url string, html string, season string")
    stored = spark.createDataFrame([("https://h.example/x/emitlgirls12.htm", f"<html><pre>{rows}</pre></html>"), ("https://h.example/in/news.htm", f"<pre>{rows}</pre>")], "url string, html string")
    found = list_parser.latest_lists(index, stored, [("north", "North Academy")]).collect()
    assert [(r.file, r["name"], r.mark, r.season) for r in found] == [("https://h.example/x/emitlgirls12.htm", "Ann Example", "7.79", "Indoor")]


def test_sheet(spark):
    csv = ["Girls,4x8,55H,55,1mi,400,LJ", "Ann Roe,x,,y,,?,x", "Bea Poe,(x),,,x,,", "Total,2,0,1,1,1,1", ",,,,,,", "Boys,4x8,55H,55,1mi,400,LJ", "Al Example,y,x,,,,(y)"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(csv)], "sheet int, pos int, line string")
    entries = entry_sheet.unpivot_sheet(lines)
    assert sorted((r.gender, r.name, r.event, r.role) for r in entries.collect())[:3] == [("boys", "Al Example", "4X800m Relay", "y"), ("boys", "Al Example", "55 M. Hurdles", "x"), ("boys", "Al Example", "Long Jump", "(y)")]
    slots = spark.createDataFrame([(0, "Girls 4X800m Relay")], "ord int, slot string")
    assert entry_sheet.meet_sheet(slots, entries).first().entries == ["Ann Roe (A)", "Bea Poe (Alt)"]
    finals = spark.createDataFrame([(1, "Girls 55 M. Dash Final"), (2, "Girls 55 M. Dash Prelim")], "ord long, slot string")
    assert [r.tentative for r in entry_sheet.meet_sheet(finals, entries).orderBy("ord").collect()] == [True, False]


def test_pages(spark):
    html = "<table><tr><td>December 20-22, 2025</td><td><a href=\"x/m1.htm\">a</a></td></tr><tr><td><a href=\"m2.htm\">b</a></td></tr></table><table><tr><td>January 3, 2026</td><td><a href=\"m1.htm\">c</a></td></tr></table>"
    df = spark.createDataFrame([("p", html)], "page string, html string")
    assert {(r.filename, r.date_text) for r in pages.link_dates(df).collect()} == {("m1.htm", "January 3, 2026"), ("m2.htm", "December 20-22, 2025")}
    bio = '<meta name="favTitle" content="TF - Al Example"><div class="card"><div class="card-header"><h5>2026 Indoor North</h5></div><div class="card-block"><table><tr><td><h5>55 Meter</h5></td></tr><tr result-id="1"><td>1</td><td>-</td><td>6.79 PR</td><td>Dec 20</td><td>Meet A</td></tr></table></div></div>'
    row = pages.bio_results(spark.createDataFrame([("f", bio)], "file string, html string")).first()
    assert (row.athlete_name, row.season, row.event, row.mark, row.is_pr, row.is_sb, row.meet_name) == ("Al Example", "2026 Indoor", "55 Meter", "6.79", True, False, "Meet A")


def test_rows_of_results_do_not_hold_their_event(spark):
    """Results become rows without the list that they come from, and rows that skip the document are the document's."""
    meets = spark.createDataFrame([("m", "Hall", "2025-01-10", [("55 Meter Dash", "Girls", None, [("Al", "North", "7.0", "Finals", None, ["1.0"], None)] * 3), ("Relay", "Boys", True, None)])], f"stem string, meet_name string, date string, events array<struct<event:string,gender:string,is_relay:boolean,results:array<{report_parser.RESULT}>>>")
    flat = flatten_meets(meets)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"Generate posexplode\([^)]*\), \[(.*?)\], false", plan)
    assert kept and not [c for k in kept for c in k.split(", ") if c.split("#")[0] in ("e", "events", "results")], plan
    assert [(r.event_ord, r.result_ord, r.event, r.is_relay, r.athlete_name, r.splits) for r in flat.orderBy("result_ord").collect()] == [(0, i, "Girls 55 Meter Dash", False, "Al", '["1.0"]') for i in range(3)]
    files = spark.createDataFrame([("m1", REPORT), ("m2", REPORT.replace("2/8/2025", "2/9/2025")), ("empty", "")], "file string, text string")
    columns = ["file", "event_ord", "result_ord", "event", "is_relay", "athlete_name", "team", "mark", "date", "splits"]
    of_documents = flatten_meets(report_parser.meets(files), ("file",)).select(columns).withColumn("event_ord", F.col("event_ord") + 1)
    of_rows = flatten_results(report_parser.dated_results(files), ("file",)).select(columns)
    assert sorted(map(str, of_rows.collect())) == sorted(map(str, of_documents.collect())) and of_rows.count() == 10
