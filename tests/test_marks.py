import pytest
from pyspark.sql import functions as F

from cinderpath.functions.marks import format_distance, format_improvement, format_time, parse_mark, with_marks

GOLDEN = [
    ("7.40", 7.40, True, True), ("1:02.87", 62.87, True, True), ("10:16.15", 616.15, True, True), ("5-08.00", 68.0, False, True), ("19' 9.5\"", 237.5, False, True), ("J10-06.00", 6.0, False, True),
    ("NH", 0, True, False), ("DNF", 0, True, False), ("X2:05", 0, True, False), ("FOUL", 0, True, False), ("", 0, True, False), (None, 0, True, False), ("0.00", 0, True, False), ("--", 0, True, False), ("NM", 0, True, False), ("12.3h", 12.3, True, True),
]


def test_golden_marks(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, mark string").withColumn("m", parse_mark(F.col("mark"))).orderBy("i").collect()
    for row, (_, value, is_time, valid) in zip(rows, GOLDEN, strict=True):
        assert (row.m.value, row.m.is_time, row.m.valid) == (pytest.approx(value), is_time, valid), row


def test_key_orders_times_up_distances_down_invalid_last(spark):
    def order(*marks):
        df = with_marks(spark.createDataFrame([(m,) for m in marks], "mark string"))
        return [r.mark for r in df.orderBy("k").collect()]

    assert order("1:02.87", "DNF", "58.10") == ["58.10", "1:02.87", "DNF"]
    assert order("14-08.50", "NH", "14-11.75") == ["14-11.75", "14-08.50", "NH"]


def test_formats(spark):
    row = spark.range(1).select(
        format_time(F.lit(62.87)).alias("a"), format_time(F.lit(7.4)).alias("b"), format_distance(F.lit(237.5)).alias("c"),
        format_improvement(parse_mark(F.lit("7.00")), parse_mark(F.lit("7.45"))).alias("d"), format_improvement(parse_mark(F.lit("5-08.00")), parse_mark(F.lit("5-02.00"))).alias("e"),
    ).first()
    assert tuple(row) == ("1:02.87", "7.40", "19' 9.50\"", "-0.45s", '+6.00"')
