"""Exact de-duplication of texts by content hash, native to Spark SQL.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

1. One pass writes each document's id, length, MD5 and SHA-256 of its normalised text; these small rows are grouped by MD5.
2. Bytes decide whether a group is one text: the texts of all documents whose MD5 occurs twice or more are grouped by MD5 *and text*,
   which compares the bytes. Only these texts are shuffled, each once for each task that has it. An MD5 with several texts is a
   collision, and its documents are grouped by MD5 and text from there on; without collisions, as a rule, nothing more is done.
3. The row that stays: most code points in the original text, then smallest id.
4. The way back to the single documents is an equi-join on the MD5 of rows of about 100 bytes. Groups that hold a thousandth of all
   rows or more, so at most a thousand, are broadcast, and a hot group needs no shuffle.

Defined cases: a null text counts as empty, and all empty texts are one group; a null id loses against any other id, and a group
of null ids only keeps the null (``kept`` is then true); rows that repeat an id and text are the same document and carry the same
verdict, each counted in ``group_size``; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sized, text_or_empty, without_spaces, written


HOT_SHARE = 1000


def md5_of(norm: Column) -> Column:
    return F.unhex(F.md5(F.encode(norm, "UTF-8")))


def normalised(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, n_points, norm (normalised text), md5."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text_or_empty()).cast("long").alias("n_points"), without_spaces(text_or_empty()).alias("norm"))
    return rows.withColumn("md5", digest(F.col("norm")))


def groups_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, keep_id, group_size."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), (-F.col("n_points")).alias("shortness"), F.col("doc_id").alias("id")))
    return rows.groupBy(*keys).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(*keys, F.col("best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = md5_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha256")
    slim = written(normalised(docs, digest).select("doc_id", "n_points", "md5", sha), "fingerprints")
    groups = written(groups_of(slim, "md5"), "groups")
    repeated = sized(groups.where("group_size > 1").select("md5"))
    texts = normalised(docs, digest).join(repeated, "md5", "left_semi").groupBy("md5", "norm").agg(F.count(F.lit(1)).alias("n"))
    collisions = written(texts.groupBy("md5").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("md5"), "collisions")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE >= max(1000, slim.count())))
    found = slim.join(hot, "md5").unionByName(slim.join(hot.select("md5"), "md5", "left_anti").join(groups, "md5"))
    columns = ("doc_id", "keep_id", "group_size", "sha256")
    if collisions.isEmpty():
        found = found.select(*columns)
    else:
        apart = sized(collisions)
        rows = written(normalised(docs, digest).join(apart, "md5", "left_semi").withColumn("sha256", sha), "collided")
        found = found.join(apart, "md5", "left_anti").select(*columns).unionByName(rows.join(groups_of(rows, "md5", "norm"), ["md5", "norm"]).select(*columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
