"""Scans along an order, in chunks: what a row needs of all earlier rows of its key, though no task sorts a key's whole history.

A chunk passes on one row (its sums, its last row). Those rows, of which a key has as many as chunks, are scanned in turn and
given back to the chunks. Sums and last rows are associative, so the chunks may be of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the keys are left's."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_key_{k}" for k in keys])


def time_chunk(us: str, chunk_s: int) -> Column:
    return F.floor(F.col(us) / (chunk_s * 1_000_000))


def carried(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column for each name: of `sums`, the sum of its expression over the key's earlier rows (0 on the first); of
    `lasts`, its expression on the row before (null on the first). `chunk` must never fall as `order` grows, and order must be
    unique within a key where the result is to be; a null chunk comes first. A task sorts the rows of one key and chunk."""
    sums, lasts = sums or {}, lasts or {}
    own, between = Window.partitionBy(*keys, "_chunk").orderBy(*order), Window.partitionBy(*keys).orderBy("_chunk")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.withColumns({"_chunk": chunk, **{f"_v_{n}": c for n, c in sums.items()}, **{f"_v_{n}": F.struct(c.alias("v")) for n, c in lasts.items()}})
    ends = parts.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums], *[F.max_by(f"_v_{n}", F.struct(*order)).alias(f"_v_{n}") for n in lasts])
    given = ends.select(*keys, "_chunk", *[F.sum(f"_v_{n}").over(earlier(between)).alias(f"_g_{n}") for n in sums], *[F.lag(f"_v_{n}").over(between).alias(f"_g_{n}") for n in lasts])
    local = parts.withColumns({**{f"_o_{n}": F.sum(f"_v_{n}").over(earlier(own)) for n in sums}, **{f"_o_{n}": F.lag(f"_v_{n}").over(own) for n in lasts}})
    out = joined(local, given, [*keys, "_chunk"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*rows.columns, *[(zero(f"_o_{n}") + zero(f"_g_{n}")).alias(n) for n in sums], *[F.coalesce(f"_o_{n}", f"_g_{n}").getField("v").alias(n) for n in lasts])


def numbered(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str, first: int = 1) -> DataFrame:
    """rows numbered within keys, from `first`."""
    return carried(rows, keys, order, chunk, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + first)


def stretches(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, inside: str, name: str) -> DataFrame:
    """rows with the length of the stretch of `inside` rows that each lies in, 0 outside. A stretch is a row, counted map-side."""
    outside = (~F.col(inside)).cast("long")
    marked = carried(rows, keys, order, chunk, {"_island": outside}).withColumn("_island", F.col("_island") + outside)
    sizes = marked.where(inside).groupBy(*keys, "_island").agg(F.count("*").alias(name))
    return joined(marked, sizes, [*keys, "_island"], "left").withColumn(name, F.when(F.col(inside), F.col(name)).otherwise(F.lit(0).cast("long"))).drop("_island")
