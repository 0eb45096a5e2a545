"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a temporary one if all runs in one JVM (master
    local, as in tests), else an error: a folder of one machine would lose what others wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="heatline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_own: dict[str, tuple[SparkSession, str]] = {}


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; clean() deletes it, at the latest when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not _own:
            atexit.register(clean)
        _own[app] = spark, f"{shared_dir(spark)}/heatline-{app}"
    return _own[app][1]


def clean() -> None:
    """Delete every intermediate table, once no DataFrame that was built on them is needed any more."""
    while _own:
        _, (spark, path) = _own.popitem()
        try:
            remove(spark, path)
        except Exception:  # the JVM is gone; nothing can be deleted through it
            continue


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    return stored(df, tag)[0]


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """written() and its path, for remove() once nothing reads it any more."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
