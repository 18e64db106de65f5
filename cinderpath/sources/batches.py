"""Tables written in numbered batches that readers see together or not at all (SRC-3, SRC-5, SNK-3, JOIN-5).

A batch writes a folder for each table under its number, overwriting what an earlier try has left, and last an empty file that names it.
Readers take the folders of named batches only. So a batch that stops half-way is not seen, and running it again gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = ".whole"


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def commit(spark: SparkSession, root: str, number: int, tables: dict[str, DataFrame], whole: bool = False) -> None:
    """Writes a batch of tables and names it; ``whole``: the batch holds all that batches before it hold, so readers start there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
    files, place = _place(spark, f"{root}/_committed/{number}{WHOLE if whole else ''}")
    files.create(place, True).close()


def committed(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches that a reader needs, ascending."""
    files, place = _place(spark, f"{root}/_committed")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    start = max((int(n.removesuffix(WHOLE)) for n in names if n.endswith(WHOLE)), default=-1)
    return sorted({int(n.removesuffix(WHOLE)) for n in names if int(n.removesuffix(WHOLE)) >= start})


def read_batches(spark: SparkSession, root: str, name: str, schema: str, but: int | None = None) -> DataFrame:
    """A table's rows of all committed batches, with their ``batch``; ``but`` leaves out one that is being written again."""
    paths = [f"{root}/{name}/batch={n}" for n in committed(spark, root) if n != but]
    if not paths:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/{name}").parquet(*paths)


MANIFEST = "url string, year string, path string, seen timestamp"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3: url, year, path, seen: the last version of each address."""
    rows = read_batches(spark, root, "manifest", MANIFEST)
    return rows.groupBy("url").agg(F.max(F.struct("batch", "year", "path", "seen")).alias("row")).select("url", "row.year", "row.path", "row.seen")


def file_under(spark: SparkSession, root: str, found: DataFrame, number: int, whole: bool = False) -> None:
    """SRC-3, 5: files addresses (url, year, seen) under their years: new ones are added, those of another year moved, the rest left as they are.

    Of several years for an address the one seen last counts, the greater of those seen together. A batch holds changes only; ``whole``
    writes all addresses, and readers need nothing before it.
    """
    before = read_batches(spark, root, "manifest", MANIFEST, number).groupBy("url").agg(F.max(F.struct("batch", "year", "path", "seen")).alias("old"))
    last = found.groupBy("url").agg(F.max(F.struct("seen", "year")).alias("new"))
    met = last.join(before, "url", "full")
    file = F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)(?:[?#].*)?$", 1), F.lit("")), F.lit("index.html"))
    moved = F.col("new").isNotNull() & ~F.col("new.year").eqNullSafe(F.col("old.year"))
    told = lambda c, new: F.when(moved, new).otherwise(F.col(f"old.{c}")).alias(c)
    rows = met.where(moved | F.lit(whole)).select("url", told("year", F.col("new.year")), told("path", F.concat_ws("/", F.col("new.year"), file)), told("seen", F.col("new.seen")))
    commit(spark, root, number, {"manifest": rows}, whole)
