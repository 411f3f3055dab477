"""Shared helpers: table reading, durable intermediate tables, keyed hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory (any file system that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by spark.checkpoint.dir.

    Only where that is unset and the master is local (tests), a temporary folder is made and set as
    the checkpoint folder; on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark's own readers open them."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path, file_system = hadoop_path(spark, path)
    file_system.deleteOnExit(jvm_path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Remove tables made by saved() that nothing will read again."""
    for df in stored:
        path, file_system = hadoop_path(df.sparkSession, df._stored_at)
        file_system.delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """`name`, or with as many underscores before it as no column has (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text, which fixes the held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def spread(text: Column, limit: int, parts: int = 8) -> Column:
    """A text of at most `limit` code points: a longer one as evenly spread windows of the whole text."""
    width = limit // parts - 1
    step = (F.length(text) - width) / (parts - 1)
    windows = [F.substring(text, F.floor(step * i).cast("int") + 1, F.lit(width)) for i in range(parts)]
    return F.when(F.length(text) > limit, F.concat_ws(" ", *windows)).otherwise(text)
