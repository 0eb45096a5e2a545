"""Shared plumbing: documents as operators read them, row ids, names, Arrow output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.sources.package import ship
from heatline.sources.shared import clean, new_path, remove, stored, written

#: White space and words as the digest contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of numbers and short names that a task may hold.
BROADCAST_ROWS = 100_000


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text with nulls as empty; other columns are left behind."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filed(docs: DataFrame) -> DataFrame:
    """docs if it is a scan of Parquet files behind filters and projections at most, else as written to such: a
    generator, a union or a join would give several rows one place."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    bare = plan.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2Relation")
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        bare = False
    return docs if bare else written(docs, "rows")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, which filed() gave, with a row id that is the same in every job, whatever executors come and go: the row's file (128 bits of its path) and place in it."""
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), F.xxhash64(place["file_path"], F.lit(1)).alias("twin"), place["row_index"].alias("row")))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, by names that may hold any character."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if its `rows` are few; beyond, Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def batches(columns: dict, schema: pa.Schema, rows: int = 4096):
    """Record batches of at most `rows` rows from whole columns."""
    table = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=rows)
