"""Fixed-width result reports to rows (PAR-1 to 17, WIN-8, 9).

Lines are numbered per file and all steps are column expressions and windows within a file or an event block; files are small and
many, so the work spreads over files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END, block_number, normalise_event
from .ranking import looked_up

#: Result codes that stand for a mark, and patterns of the reports.
CODES = ("DQ", "FOUL", "NH", "NM", "DNS", "DNF", "SCR")
LIKELY = ("DQ", "DNS", "NH", "FOUL", "DNF")
SPLIT = r"\(((?:\d+:)?\d+\.\d+)\)"
SPLIT_LINE = r"(?:\d+:)?\d+\.\d+\s+\((?:\d+:)?\d+\.\d+\)"
RESULT = "struct<athlete:string,school:string,result:string,type:string,athletes:array<string>,splits:array<string>,warnings:array<string>>"


def meet_name(files: DataFrame) -> DataFrame:
    """PAR-2: the first of the first 30 lines without date, rule or licence note and longer than five characters."""
    lines = files.select("file", F.posexplode(F.split("text", LINE_END, 31)).alias("pos", "line")).where("pos < 30")
    dated = F.col("line").rlike(r"\d{1,2}/\d{1,2}/\d{2,4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4}")
    clean = lines.where(~dated & ~F.contains("line", F.lit("===")) & ~F.contains("line", F.lit("Licensed to")) & (F.length(F.trim("line")) > 5))
    return clean.groupBy("file").agg(F.trim(F.min_by("line", "pos")).alias("meet_name"))


def meet_date(files: DataFrame) -> DataFrame:
    """PAR-3: of the dates in the first 30 lines outside record lines, one of a line about the meet first, then the earliest."""
    lines = files.select("file", F.posexplode(F.split("text", LINE_END, 31)).alias("pos", "line")).where("pos < 30")
    low = F.lower("line")
    lines = lines.where(~low.rlike("record:|r  |ht:")).withColumn("priority", F.when(low.rlike("meet|results|wk"), 0).otherwise(1))
    slashed = F.transform(F.expr(r"regexp_extract_all(line, '(\\d{1,2}/\\d{1,2}/\\d{2,4})', 1)"), lambda d: _slashed(d))
    named = F.transform(F.expr(r"regexp_extract_all(line, '([A-Za-z]+\\s+\\d{1,2},?\\s+\\d{4})', 1)"), lambda d: _worded(d))
    found = lines.select("file", "priority", "pos", F.posexplode(F.filter(F.concat(slashed, named), lambda d: d.isNotNull())).alias("ord", "date"))
    return found.groupBy("file").agg(F.min_by("date", F.struct("priority", "pos", "ord")).alias("date"))


def _slashed(d: Column) -> Column:
    parts = F.split(d, "/")
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    return F.concat_ws("-", year, F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))


def _worded(d: Column) -> Column:
    months = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(F.substring(d, 1, 3)))
    group = lambda i: F.regexp_extract(d, r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", i)
    return F.when(month > 0, F.concat_ws("-", group(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(group(2), 2, "0")))


def event_blocks(files: DataFrame) -> DataFrame:
    """PAR-4 to 6: file, pos, line, block, event, gender, is_relay of every line below an event header."""
    lines = files.select("file", F.posexplode(F.split("text", LINE_END)).alias("pos", "line"))
    whole, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("pos")
    ends = F.contains("line", F.lit("Team Rankings")) & F.col("line").rlike("Men|Women|Boys|Girls")
    lines = lines.withColumn("_end", F.min(F.when(ends, F.col("pos"))).over(whole)).withColumn("_next", F.lead("line").over(order)).where("_end IS NULL OR pos < _end")
    numbered, plain = r"(?i)Event\s+\d+\s+(Girls|Boys)\s+(.*)", r"(?i)^\s*(Girls|Boys)\s+(.*)$"
    pattern = F.when(F.col("line").rlike(numbered), 1).when(F.col("line").rlike(plain) & F.contains(F.coalesce("_next", F.lit("")), F.lit("=====")), 2)
    lines = lines.withColumn("_header", pattern)
    part = lambda i: F.trim(F.when(F.col("_header") == 1, F.regexp_extract("line", numbered, i)).when(F.col("_header") == 2, F.regexp_extract("line", plain, i)))
    lines = lines.withColumn("_gender", part(1)).withColumn("_name", part(2)).withColumn("block", block_number(F.col("_header").isNotNull(), ["file"], "pos")).where("block > 0")
    head = Window.partitionBy("file", "block")
    event = normalise_event(F.col("_raw"))
    lines = lines.withColumn("gender", F.max("_gender").over(head)).withColumn("_raw", F.max("_name").over(head)).withColumn("event", event)
    return lines.withColumn("is_relay", F.lower(F.concat_ws(" ", "event", "_raw")).rlike("relay|4x")).where("_header IS NULL").select("file", "pos", "line", "block", "event", "gender", "is_relay")


def with_anchors(lines: DataFrame) -> DataFrame:
    """PAR-7: the columns of each block's first column header; lines at or above it, and blocks without one, are left out. Offsets from 0."""
    has = lambda w: F.contains("line", F.lit(w))
    is_header = F.when(F.col("is_relay"), has("School") & (has("Finals") | has("Prelims"))).otherwise(has("Name") & has("School"))
    block = Window.partitionBy("file", "block")
    lines = lines.withColumn("_at", F.min(F.when(is_header, F.col("pos"))).over(block)).where("_at IS NOT NULL")
    head = F.max(F.when(F.col("pos") == F.col("_at"), F.col("line"))).over(block)
    lines = lines.withColumn("_head", head).where("pos > _at")
    at = lambda w: F.instr("_head", w) - 1
    lines = lines.withColumn("anchor_type", F.when(at("Finals") >= 0, "Finals").when(at("Prelims") >= 0, "Prelims"))
    lines = lines.withColumn("anchor", F.when(F.col("anchor_type") == "Finals", at("Finals") + 6).when(F.col("anchor_type") == "Prelims", at("Prelims") + 7).otherwise(-1))
    after = lambda w: F.nullif(F.expr(f"locate('{w}', _head, anchor + 1)"), F.lit(0)) - 1
    stop = F.when(F.col("anchor") >= 0, F.coalesce(after("H#"), after("Points"), after("Pts")))
    lines = lines.withColumn("school_col", at("School")).withColumn("right", F.coalesce(stop, F.col("anchor") + 12))
    # the relay parser and the individual one skip blank and dashed lines, and end at team rankings
    rank = F.min(F.when(F.contains("line", F.lit("Team Rankings")), F.col("pos"))).over(block)
    lines = lines.withColumn("_rank", rank).where("_rank IS NULL OR pos < _rank")
    return lines.where((F.trim("line") != "") & ~F.contains("line", F.lit("---"))).drop("_at", "_head", "_rank")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def result_token(line: Column, anchor: Column, right: Column) -> Column:
    """PAR-10: of the tokens before ``right`` the one that begins nearest to the header's column, if it looks like a result; else the last one.

    The line is cut behind each token; the lengths of the pieces up to a token add up to its end.
    """

    def placed(pieces: Column) -> Column:
        end = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p))
        return F.transform(pieces, lambda p, i: _let(F.regexp_replace(p, r"(?U)^\s+", ""), lambda t: F.struct((end(i) - F.length(t)).alias("at"), i.alias("i"), t.alias("token"))))

    def chosen(tokens: Column) -> Column:
        likely = F.filter(tokens, lambda t: t["token"].rlike(r"(?U)\d") | F.upper(t["token"]).isin(*LIKELY))
        nearest = F.array_min(F.transform(likely, lambda t: F.struct(F.abs(t["at"] - anchor).alias("far"), t["i"].alias("i"), t["token"].alias("token"))))
        last = F.get(tokens, F.size(tokens) - 1)["token"]
        return _let(nearest, lambda n: F.when((anchor >= 0) & (n["far"] < 20), n["token"]).otherwise(last))

    pieces = F.regexp_extract_all(F.substring(line, F.lit(1), right), F.lit(r"(?U)\s*\S+"), 0)
    return _let(pieces, lambda p: _let(placed(p), chosen))


def clean_result(raw: Column) -> tuple[Column, Column]:
    """PAR-12: the mark without exhibition X, qualifier q and stray characters; the warnings that this gives."""
    bare = F.when(F.upper(raw).startswith("X") & (F.length(raw) > 1), F.substring(raw, 2, 1000)).otherwise(raw)
    plain = F.when(F.upper(bare) == "DQ", bare).otherwise(F.regexp_replace(bare, "(?i)q$", ""))
    fine = F.upper(plain).isin(*CODES) | plain.rlike("^[0-9:.-]+$")
    cleaned = F.regexp_replace(plain, "[^0-9:.-]", "")
    note = F.when(fine, F.array().cast("array<string>")).when(cleaned != "", F.array(F.concat(F.lit("Original result: "), plain))).otherwise(F.array(F.concat(F.lit("Result contains unusual characters: "), plain)))
    return F.when(fine | (cleaned == ""), plain).otherwise(cleaned), note


def _last_in(line: Column, token: Column, end: Column) -> Column:
    """The place of the last occurrence of a token before ``end``, from 0."""
    head = F.substring(line, F.lit(1), end)
    return F.length(head) - (F.position(F.reverse(token), F.reverse(head)) - 1) - F.length(token)


def result_rows(lines: DataFrame) -> DataFrame:
    """PAR-8, 10 to 15: for each line the result that it gives, if any, with the line's splits and runners."""
    line, school_col = F.col("line"), F.col("school_col")
    splits = F.when(line.rlike(SPLIT_LINE), F.expr(rf"regexp_extract_all(line, '{SPLIT}', 1)".replace("\\", "\\\\")))
    runners = F.expr(r"regexp_extract_all(line, '(\\d\\)\\s+.*?)(?=\\s*\\d\\)|$)', 1)")
    runners = F.transform(runners, lambda r: F.regexp_replace(F.trim(F.regexp_replace(r, r"^\d\)\s+", "")), r"\s+\d+$", ""))
    lines = lines.withColumn("splits", splits).withColumn("runners", F.when(F.col("is_relay") & splits.isNull() & (F.size(runners) > 0), runners))
    area = F.trim(F.substring(line, F.lit(1), school_col))
    long_enough = F.when(F.col("is_relay"), F.length(line) > school_col).otherwise((F.length(line) >= school_col) & (F.length(line) >= F.col("anchor") - 5) & (area != "") & ~F.lower(area).isin("finals", "preliminaries", "prelims") & ~line.rlike(r"^\s*\d+\)\s+[A-Za-z]"))
    row = long_enough & F.col("splits").isNull() & F.col("runners").isNull()
    last = F.nullif(F.regexp_extract(F.rtrim(F.substring(line, F.lit(1), F.col("right"))), r"(\S+)$", 1), F.lit(""))
    lines = lines.withColumn("_row", row).withColumn("_raw", F.when(F.col("is_relay"), last).when(F.col("_row"), result_token(line, F.col("anchor"), F.col("right"))))
    value = F.when(F.upper("_raw").startswith("X") & (F.length("_raw") > 1), F.substring("_raw", 2, 1000)).otherwise(F.col("_raw"))
    lines = lines.withColumn("_value", F.when(F.col("_row"), value))
    ok = F.col("_value").rlike(r"\d") | F.upper("_value").isin(*CODES)
    place = _last_in(line, F.col("_value"), F.col("right") + 2)
    marker = r"^\s*(?:#|--|\d+)\s+"
    first = lambda c: F.trim(F.get(F.split(c, r"\s{2,}"), F.lit(0)))
    name = first(F.trim(F.regexp_replace(F.substring(line, F.lit(1), school_col), marker, "")))
    start = F.greatest(F.lit(0), school_col - 5)
    school = first(F.trim(F.regexp_replace(F.trim(F.substring(line, start + 1, place - start)), r"^\d+\s+", "")))
    school = F.trim(F.when(F.col("anchor_type").isNotNull(), F.replace(school, F.col("anchor_type"), F.lit(""))).otherwise(school))
    relay_school = first(F.trim(F.regexp_replace(F.trim(F.substring(line, school_col + 1, place - school_col)), marker, "")))
    lines = lines.withColumn("_name", name).withColumn("school", F.when(F.col("is_relay"), relay_school).otherwise(school))
    good_name = ~F.col("_name").rlike(r"^\d*$") & ~F.upper("_name").isin(*CODES) & ~F.col("_name").rlike(r"^[0-9\s.-]+$") & ~(F.col("_name").rlike(r"\d") & (F.length("_name") < 10))
    good_school = (F.col("school") != "") & (~F.col("is_relay") | (~F.col("school").rlike(r"^[\d.]+$") & ~F.contains("school", F.lit("1)"))))
    emitted = F.coalesce(F.col("_row") & ok & good_school & (F.col("is_relay") | good_name) & ~F.col("_value").eqNullSafe(F.col("anchor_type")), F.lit(False))
    result, notes = clean_result(F.col("_value"))
    digits = lambda c, what: F.when(F.col(c).rlike(r"\d") & ~F.col("is_relay"), F.array(F.concat(F.lit(f"{what} name contains numbers: "), F.col(c)))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(notes, digits("_name", "Athlete"), digits("school", "School"))
    return lines.withColumn("emitted", emitted).withColumn("result", result).withColumn("warnings", warnings).withColumn("athlete", F.when(~F.col("is_relay"), F.col("_name")))


def results(files: DataFrame) -> DataFrame:
    """file, block, event, gender, is_relay, result_ord and the result's fields: one row per result.

    Splits and runners belong to the last result emitted above them in the block (PAR-9, 16); blocks without results vanish (PAR-17).
    """
    rows = result_rows(with_anchors(event_blocks(files)))
    block = Window.partitionBy("file", "block").orderBy("pos")
    rows = rows.withColumn("result_ord", F.count(F.when(F.col("emitted"), 1)).over(block)).where("result_ord > 0")
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))), lambda s: s["v"]))
    single = lambda c: F.max(F.when(F.col("emitted"), F.col(c))).alias(c)
    fields = ["athlete", "school", "result", "anchor_type"]
    found = rows.groupBy("file", "block", "event", "gender", "is_relay", "result_ord").agg(
        *[single(c) for c in fields], F.first(F.when(F.col("emitted"), F.col("warnings")), True).alias("warnings"), ordered("splits").alias("splits"), ordered("runners").alias("athletes")
    )
    return found.withColumnRenamed("anchor_type", "type")


def _heads(files: DataFrame) -> DataFrame:
    return files.select("file").join(meet_name(files), "file", "left").join(meet_date(files), "file", "left")


def _result() -> Column:
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.struct("athlete", "school", "result", "type", F.when(F.col("is_relay"), F.col("athletes")).alias("athletes"), empty("splits").alias("splits"), empty("warnings").alias("warnings")).cast(RESULT).alias("r")


def dated_results(files: DataFrame) -> DataFrame:
    """file, meet_name, date, event_ord, event, gender, is_relay, result_ord, r: the results of ``meets`` as rows, without a document that
    holds all of a file. ``event_ord`` is in the order of the events, with gaps where blocks have no results."""
    found = results(files).select("file", F.col("block").alias("event_ord"), "event", "gender", "is_relay", (F.col("result_ord") - 1).alias("result_ord"), _result())
    return looked_up(found, _heads(files), ["file"])


def meets(files: DataFrame) -> DataFrame:
    """file, meet_name, date, events: the parsed-meet document of each file (file, text)."""
    one = F.struct("result_ord", _result())
    events = results(files).groupBy("file", "block", "event", "gender", "is_relay").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["r"]).alias("results"))
    listed = events.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "event", "gender", "is_relay", "results"))), lambda e: F.struct(e["event"].alias("event"), e["gender"].alias("gender"), e["is_relay"].alias("is_relay"), e["results"].alias("results"))).alias("events"))
    return _heads(files).join(listed, "file", "left")


def counted_meets(files: DataFrame) -> DataFrame:
    """file, meet_name, date, events, results: the numbers of events and results of the documents of ``meets``, counted on the results as rows; null where there are none."""
    blocks = results(files).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    numbers = blocks.groupBy("file").agg(F.count(F.lit(1)).alias("events"), F.sum("n").alias("results"))
    return _heads(files).join(numbers, "file", "left")
