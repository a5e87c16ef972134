"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local master, as in tests, keeps them if no folder is set.
OWN = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a cluster has to name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = OWN
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = folder(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none where there is no such folder."""
    fs, at = folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here, any executor may be lost, and nothing above it runs again.

    The files go when the driver's JVM ends, or before that by `drop`; a job that reruns writes anew.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    fs, at = folder(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """rows as a side of a join whose sides are dealt over tasks by its keys. Planned by the bytes of compressed files, also where rows are made of
    rows, a side that grows with the input would pass for a small one, and be gathered whole in the driver."""
    return rows.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        fs, at = folder(t.sparkSession, t.written_at)
        fs.delete(at, True)
