"""What the operators of this subpackage share: the shared folder, lineage cuts and ASCII rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where none is set: a temporary one in local mode, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinderpath-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/cinderpath-shared")
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and not again when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cinderpath/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def unshuffled(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles that no frame refers to any more."""
    for _ in range(2):  # what the first round lets go of is collected in the second
        gc.collect()
        spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again, and lets Spark's cleaner drop the shuffles that made them."""
    if frames:
        unshuffled(frames[0].sparkSession)
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without_spaces(text: Column) -> Column:
    for char in SPACES:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for an empty text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that a text operator reads, whatever else ``docs`` has; the text as UTF-8 bytes, null as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))


#: Ids below this number are broadcast (16 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A one-column frame of ids, marked for broadcast only if it has been counted to have fewer than ``most`` rows."""
    return F.broadcast(ids) if ids.limit(most).count() < most else ids


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is always shuffled and merged.

    Spark guesses the size of what it reads and explodes from the size of the file: an exploded array counts as one element, and what
    Parquet packs counts as packed. A side of some 10 MB by that guess can be hundreds of MB once the driver has to build it.
    """
    return df.hint("merge")
