"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without the setting (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it several times computes it once, its lineage is cut, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly, for work on each of them: a file of few row groups is read, and would be worked on, by as few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    fs, path = _path(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def removed(spark: SparkSession, at: str) -> None:
    fs, path = _path(spark, at)
    fs.delete(path, True)


def touched(spark: SparkSession, at: str) -> None:
    """Make an empty file."""
    fs, path = _path(spark, at)
    fs.create(path, True).close()
