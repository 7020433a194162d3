"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one
    machine. On a cluster without one, an error: its executors would each write to their own disk."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key in as many parts as a shuffle has. Spark joins parts by their bytes otherwise, so that a few tasks get rows of few
    bytes and much work, as packed files are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def materialize(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage, and outlives lost executors. few_files: as one
    file for each core of the cluster, for tables of narrow rows that rounds of a loop write again and again. Zstandard makes texts
    and ids a third smaller than Spark's default, in no more time."""
    path = new_path(df.sparkSession, name)
    (df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)) if few_files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialize() made, once nothing reads it again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
