"""Inventory and sampling profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import column_role, correlation_of, finite, out_of_range, percent
from .population import mode_of, quantiles, value_counts


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: nulls, rows, percentage. One pass."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot(["rows"], columns, "column", "nulls").select("column", "nulls", "rows", percent(F.col("nulls"), F.col("rows")).alias("null_pct"))


def range_violations(df: DataFrame, keys: list[str], temp: str, power: str, low: float = 0.0, high: float = 125.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(out_of_range(F.col(temp), low, high)).alias("temp_out_of_range"), F.count_if(F.col(power) < 0).alias("power_negative"), F.min(temp).alias("temp_min"), F.max(temp).alias("temp_max"))


def duplicate_identity(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Rows, distinct stamps, distinct rows, exact duplicates and conflicting rows, by key."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(us).alias("distinct_ts"))
    full = df.distinct().groupBy(*keys).agg(F.count("*").alias("distinct_rows"))
    out = rows.join(full, keys)
    return out.select(*keys, "rows", "distinct_ts", "distinct_rows", (F.col("rows") - F.col("distinct_ts")).alias("duplicate_ts"), (F.col("rows") - F.col("distinct_rows")).alias("exact_duplicate_rows"), (F.col("distinct_rows") - F.col("distinct_ts")).alias("conflicting_rows"))


def intervals(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Positive steps in seconds."""
    step = (F.col(us) - F.lag(us).over(Window.partitionBy(*keys).orderBy(us))) / 1_000_000.0
    return df.select(*keys, step.alias("dt")).where("dt > 0")


def interval_histogram(df: DataFrame, keys: list[str], us: str, k: int = 5) -> DataFrame:
    """The k most frequent steps of each key, ties to the smaller."""
    counted = intervals(df, keys, us).groupBy(*keys, "dt").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "dt")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def interval_mode(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """The dominant step of each key, ties to the smaller."""
    return mode_of(value_counts(intervals(df, keys, us), keys, "dt"), keys, "dt_dominant")


def sampling_summary(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Least, greatest, median and dominant step; steps off the dominant one; gaps of over three of it. All from the counts of
    distinct steps."""
    steps = value_counts(intervals(df, keys, us), keys, "dt")
    dominant, median = mode_of(steps, keys, "dt_dominant"), quantiles(steps, keys, {"dt_median": 0.5})
    v, d = F.col("v"), F.col("dt_dominant")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    out = steps.join(dominant, keys).groupBy(*keys).agg(
        F.min("v").alias("dt_min"), F.max("v").alias("dt_max"), F.max(d).alias("dt_dominant"), percent(total(v != d), F.sum("w")).alias("pct_deviating"),
        total(v > 3 * d).alias("gaps"), total((v != d) & (v <= 3 * d)).alias("irregular"),
    )
    return out.join(median, keys).select(*keys, "dt_min", "dt_max", "dt_median", "dt_dominant", "pct_deviating", "gaps", "irregular")


def quick_audit(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Median, p05 and p95 steps, gaps of over three medians, span in hours."""
    steps = value_counts(intervals(df, keys, us), keys, "dt")
    of = quantiles(steps, keys, {"dt_median": 0.5, "dt_p05": 0.05, "dt_p95": 0.95})
    gaps = steps.join(of, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("v") > 3 * F.col("dt_median"), F.col("w"))), F.lit(0)).alias("gaps"))
    span = df.groupBy(*keys).agg(F.count("*").alias("rows"), ((F.max(us) - F.min(us)) / 3.6e9).alias("span_hours"))
    return span.join(of, keys).join(gaps, keys)


def pair_quality(df: DataFrame, keys: list[str], temp: str, power: str) -> DataFrame:
    ok = finite(F.col(temp)) & finite(F.col(power))
    return df.groupBy(*keys).agg(F.count_if(ok).alias("valid_pairs"), (F.count_if(~ok) / F.count("*")).alias("missing_fraction"), F.min(F.when(ok, F.col(temp))).alias("temp_min"), F.max(F.when(ok, F.col(temp))).alias("temp_max"), F.min(F.when(ok, F.col(power))).alias("power_min"), F.max(F.when(ok, F.col(power))).alias("power_max"), correlation_of(F.col(power), F.col(temp)).alias("corr"))


def sanity(pairs: DataFrame, low: float = 10.0, high: float = 110.0) -> DataFrame:
    """pair_quality() with a pass of plausible temperatures, no negative power and a positive correlation."""
    passes = (F.col("temp_min") > low) & (F.col("temp_max") < high) & (F.col("power_min") >= 0) & (F.col("corr") > 0)
    return pairs.withColumn("passes", F.coalesce(passes, F.lit(False)))


def clean_nodes(checked: DataFrame, least: int) -> DataFrame:
    return checked.agg(F.count_if("passes").alias("clean"), F.count("*").alias("nodes")).withColumn("enough", F.col("clean") >= least)


def schema_signatures(footers: DataFrame) -> DataFrame:
    """Of each signature (columns and types of a file): files, hosts and rows."""
    return footers.groupBy("signature").agg(F.count("*").alias("files"), F.count_distinct("host").alias("hosts"), F.sum("rows").alias("rows"))


def column_coverage(footers: DataFrame) -> DataFrame:
    """Of each column name: its role and how many hosts have it. footers: an array `columns` for each file."""
    return footers.select("host", F.explode("columns").alias("column")).groupBy("column").agg(F.count_distinct("host").alias("hosts")).withColumn("role", column_role(F.col("column")))


def footer_profile(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and column of column_ranges(): files, rows, nulls and their percentage, least and greatest value, bytes read beside
    footers. Unreadable files take no part."""
    per = ranges.where("error is null").groupBy(*keys, "column").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("data_bytes").alias("data_bytes"))
    return per.withColumn("null_pct", percent(F.col("nulls"), F.col("rows")))


def fleet_inventory(df: DataFrame, host: str, us: str, temp: str, low: float = 0.0, high: float = 125.0) -> DataFrame:
    """One row: hosts, rows, time range, and hosts with duplicates or range violations."""
    per = df.groupBy(host).agg(F.count("*").alias("rows"), F.min(us).alias("lo"), F.max(us).alias("hi"), (F.count("*") - F.count_distinct(us)).alias("dup"), F.count_if(out_of_range(F.col(temp), low, high)).alias("bad"))
    return per.agg(F.count("*").alias("hosts"), F.sum("rows").alias("rows"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.count_if(F.col("dup") > 0).alias("hosts_with_duplicates"), F.count_if(F.col("bad") > 0).alias("hosts_out_of_range"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("bad") > 0, F.col(host).cast("string")))), ",").alias("hosts_listed"))
