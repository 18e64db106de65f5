"""Stored documents and tables (SRC-14 to 18, SNK-1 to 4, M1 to M13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

RESULT = "struct<athlete:string,school:string,result:string,type:string,athletes:array<string>,splits:array<string>,warnings:array<string>>"
EVENTS = f"array<struct<event:string,gender:string,is_relay:boolean,results:array<{RESULT}>>>"
MEET = f"meet_name string, date string, events {EVENTS}"
ATHLETES = "athlete_id long, athlete_name string"
PERFORMANCES = "id long, athlete_id long, event string, mark string, place string, team string, date string, season string, year string, meet_name string, meet_url string, splits string"


def read_meets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: stem, meet_name, date, events; also of the older form, a bare list of events."""
    return parsed_meets(spark.read.text(path, wholetext=True))


def parsed_meets(raw: DataFrame) -> DataFrame:
    """SRC-14 of files (value), also of a stream of them."""
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)[.][^.]+$", 1).alias("stem"), "value")
    doc = F.when(F.ltrim("value").startswith("["), F.struct(F.lit(None).cast("string").alias("meet_name"), F.lit(None).cast("string").alias("date"), F.from_json("value", EVENTS).alias("events"))).otherwise(F.from_json("value", MEET))
    return raw.select("stem", doc.alias("d")).select("stem", F.coalesce("d.meet_name", "stem").alias("meet_name"), F.coalesce("d.date", F.lit("Unknown")).alias("date"), "d.events")


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """SRC-16, 17: a small configuration table; empty where the path doesn't exist."""
    parsed = T.StructType.fromDDL(schema)
    try:
        return spark.read.format(form).schema(parsed).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], parsed)


def create_tables(spark: SparkSession, database: str = "default", wipe: bool = False) -> None:
    """SNK-2: the warehouse's tables, partitioned where the original had indexes."""
    for name, schema, by in (("athletes", ATHLETES, ""), ("performances", PERFORMANCES, "PARTITIONED BY (year, season)")):
        if wipe:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet {by}")


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """SRC-18: the tables of a database."""
    return spark.sql(f"SHOW TABLES IN {database}")


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_meets(meets: DataFrame, path: str) -> None:
    """SNK-1: parsed meets, always rewritten, by year."""
    meets.write.mode("overwrite").partitionBy("year").json(path)
