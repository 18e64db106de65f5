"""A corpus pipeline: quality rules, exact and near de-duplication, removal of personal data, packing.

Each stage works on all that its predecessor kept and gets the predecessor's table as ``docs``; all but the last return the columns of
``documents``. Every row is judged by itself, also where ids are null or repeated. Near copies are similar on shingles of five words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderpath.llm.best_fit import best_fit_packing
from cinderpath.llm.common import documents, sized, written
from cinderpath.llm.exact_dedup import exact_dedup
from cinderpath.llm.near_dedup import near_groups
from cinderpath.llm.pii import redact
from cinderpath.llm.quality import judge

KEY = "_row_key"
SHINGLE = 5


def _without(docs: DataFrame, verdicts: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """``docs`` without the rows that a verdict drops. Where an id is null or repeated, the verdicts are on keys of the rows, in the order of the ids."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if not unique:
        ordered = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text"))
        docs = written(ordered.withColumn(KEY, F.monotonically_increasing_id()), f"{label}-rows")
    key = "doc_id" if unique else KEY
    columns = [c for c in docs.columns if c != KEY]
    judged = verdicts(docs if unique else docs.drop("doc_id").withColumnRenamed(KEY, "doc_id"))
    dropped = written(judged.where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), label)
    return docs.join(sized(dropped), key, "left_anti").select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, judge, "rejected")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup, "copies")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda rows: near_groups(rows, size=SHINGLE), "near-copies")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Reliabilities, similarity components and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
