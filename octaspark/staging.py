"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may do without and gets one of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder, so that the rows survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table below the shared folder, in folders ``by`` columns: it has a known size, and scans are pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table that was written, marked for broadcast if it has at most ``most`` rows (of a few numbers)."""
    return F.broadcast(table) if table.count() <= most else table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` (without folders by column) that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries, none if it isn't there."""
    files, at = _files(spark, folder)
    return sorted(e.getPath().getName() for e in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.mkdirs(at)
