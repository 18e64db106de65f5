"""Intermediate tables in the folder that the cluster shares, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame of fewer rows than this may be broadcast (narrow rows: some 16 to 64 MB).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where none is set: a temporary one in local mode, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinderpath-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/cinderpath-shared")
        found = spark.sparkContext.getCheckpointDir()
    return found


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and not again when an executor is lost. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cinderpath/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        files, place = _file_system(df.sparkSession, df.stored_at)
        files.delete(place, True)


def narrow(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it has been counted to have fewer than ``most`` rows; beyond that it is shuffled and merged.

    That isn't left to Spark: it guesses the size of a table from its files, and what Parquet packs well (repeated parts of names or
    structs) is many times as large in memory, where the driver would build it.
    """
    return F.broadcast(df) if df.limit(most).count() < most else df.hint("merge")
