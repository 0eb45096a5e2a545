"""Binning, gaps, segments, audits and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation_of, finite, node_hours, out_of_range, percent
from .population import mode_of, quantiles, value_counts
from .scan import carried, time_chunk

GRID_S, GAP_S, STEP_FLAG = 10, 30, 5.0


def numeric_columns(df: DataFrame, skip=("timestamp", "hostname", "host", "us")) -> list[str]:
    return [f.name for f in df.schema if f.name not in skip and f.dataType.typeName() in ("double", "float", "long", "integer", "short")]


def reducer(name: str):
    return F.min if name.endswith("_min") else F.max if name.endswith("_max") else F.avg


def bin_dedupe(df: DataFrame, keys: list[str], us: str, columns: list[str], grid_s: int | None = None, reducers: dict | None = None) -> DataFrame:
    """One row for each bin: _min by least, _max by greatest, others by mean; n_merged counts its rows. No grid: equal stamps."""
    stamp = F.col(us) if grid_s is None else F.floor(F.col(us) / (grid_s * 1_000_000)).cast("long") * (grid_s * 1_000_000)
    pick = reducers or {}
    aggregates = [pick.get(c, reducer(c))(F.col(c).cast("double")).alias(c) for c in columns]
    return df.groupBy(*keys, stamp.alias(us)).agg(*aggregates, F.count("*").alias("n_merged"))


def with_gaps(df: DataFrame, keys: list[str], us: str) -> DataFrame:
    """dt_s: whole seconds since the row before, null on a key's first."""
    w = Window.partitionBy(*keys).orderBy(us)
    return df.withColumn("dt_s", ((F.col(us) - F.lag(us).over(w)) / 1_000_000).cast("long"))


def with_segments(df: DataFrame, keys: list[str], us: str, gap_s: float = GAP_S) -> DataFrame:
    """segment_id from 0: a step of over gap_s seconds begins another."""
    w = Window.partitionBy(*keys).orderBy(us)
    opens = F.coalesce((F.col("dt_s") > gap_s).cast("long"), F.lit(0).cast("long"))
    return df.withColumn("segment_id", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chunked_segments(df: DataFrame, keys: list[str], us: str, gap_s: float = GAP_S, chunk_s: int = 30 * 86_400) -> DataFrame:
    """with_gaps() and with_segments() in chunks of time: a task sorts one key's chunk, not its history. What a chunk passes
    on (its last stamp, how many segments began) is a row for each chunk, summed over a key's chunks and given back to them."""
    chunk = F.floor(F.col(us) / (chunk_s * 1_000_000))
    rows = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(us)
    inner = rows.withColumn("_d", ((F.col(us) - F.lag(us).over(w)) / 1_000_000).cast("long"))
    opens = F.coalesce((F.col("_d") > gap_s).cast("long"), F.lit(0).cast("long"))
    inner = inner.withColumn("_s", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    ends = inner.groupBy(*keys, "_chunk").agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.max("_s").alias("_more"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.withColumn("_d0", ((F.col("_first") - F.lag("_last").over(order)) / 1_000_000).cast("long"))
    step = F.coalesce((F.col("_d0") > gap_s).cast("long"), F.lit(0).cast("long"))
    before = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_more").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    given = ends.select(*keys, "_chunk", "_d0", before.alias("_before"))
    out = inner.join(given, [*keys, "_chunk"])
    dt = F.when(F.col("_n") == 1, F.col("_d0")).otherwise(F.col("_d"))
    return out.select(*df.columns, dt.alias("dt_s"), (F.col("_s") + F.col("_before")).alias("segment_id"))


def median_gap_segments(df: DataFrame, keys: list[str], us: str, factor: float = 3.0, least: int = 100) -> DataFrame:
    """Rows with `seg`: a step of over `factor` medians of the key's steps begins another; segments of fewer than `least` rows go."""
    w = Window.partitionBy(*keys).orderBy(us)
    stepped = df.withColumn("_dt", (F.col(us) - F.lag(us).over(w)) / 1_000_000.0)
    median = quantiles(value_counts(stepped, keys, "_dt"), keys, {"_m": 0.5})
    opens = F.coalesce((F.col("_dt") > factor * F.col("_m")).cast("long"), F.lit(0).cast("long"))
    marked = stepped.join(median, keys, "left").withColumn("seg", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "seg"))).where(F.col("_n") >= least).drop("_dt", "_m", "_n")


#: Fixed value: the coolant's assumed temperature.
COOLANT_C = 21.0


def with_coolant(df: DataFrame, celsius: float = COOLANT_C) -> DataFrame:
    return df.withColumn("coolant_C_assumed", F.lit(celsius))


def clean(df: DataFrame, keys: list[str], us: str, columns: list[str], grid_s: int | None = None, gap_s: float = GAP_S, chunk_s: int | None = None) -> DataFrame:
    """Bins with gaps and segments; one exchange serves all three, and a key's history is one task's. With chunk_s, so long
    a chunk of it is."""
    if chunk_s:
        return chunked_segments(bin_dedupe(df, keys, us, columns, grid_s), keys, us, gap_s, chunk_s)
    return with_segments(with_gaps(bin_dedupe(df, keys, us, columns, grid_s), keys, us), keys, us, gap_s)


def quality_mask(cleaned: DataFrame, keys: list[str], us: str) -> DataFrame:
    return cleaned.select(*keys, us, "n_merged", "segment_id", "dt_s", (F.col("n_merged") > 1).alias("was_merged"))


def within_segment_step(df: DataFrame, keys: list[str], us: str, column: str) -> Column:
    return F.col(column) - F.lag(column).over(Window.partitionBy(*keys, "segment_id").orderBy(us))


def chunked_steps(df: DataFrame, keys: list[str], us: str, column: str, name: str, chunk_s: int) -> DataFrame:
    """df with the step of a column since the row before of its segment, as within_segment_step() gives it, in chunks of time."""
    rows = carried(df, keys, [us], time_chunk(us, chunk_s), lasts={"_before": F.struct("segment_id", F.col(column).alias("v"))})
    return rows.withColumn(name, F.when(F.col("_before.segment_id") == F.col("segment_id"), F.col(column) - F.col("_before.v"))).drop("_before")


def chunked_islands(rows: DataFrame, keys: list[str], us: str, inside: Column, chunk_s: int) -> DataFrame:
    """(keys, len) of each maximal stretch of a key's rows, in order of time, where `inside` holds. A task sorts one key's chunk
    of time. A stretch within a chunk is whole; what touches a chunk's first or last row, two of a chunk at most, is put
    together with what it touches in the key's next chunk."""
    chunk = F.floor(F.col(us) / (chunk_s * 1_000_000))
    own = Window.partitionBy(*keys, "_chunk")
    marked = rows.select(*keys, us, chunk.alias("_chunk"), inside.alias("_in")).withColumns({
        "_island": F.sum((~F.col("_in")).cast("long")).over(own.orderBy(us).rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(own.orderBy(us)), "_size": F.count("*").over(own),
    })
    chunks = marked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows")).withColumn("_seq", F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_rows")
    parts = marked.where("_in").groupBy(*keys, "_chunk", "_island").agg(F.count("*").alias("len"), (F.min("_at") == 1).alias("_opens"), (F.max("_at") == F.max("_size")).alias("_closes"))
    whole = parts.where("not _opens and not _closes").select(*keys, "len")
    order = Window.partitionBy(*keys).orderBy("_seq", "_island")
    edges = parts.where("_opens or _closes").join(chunks, [*keys, "_chunk"])
    follows = F.col("_opens") & F.lag("_closes").over(order) & (F.lag("_seq").over(order) == F.col("_seq") - 1)
    named = edges.withColumn("_fresh", ~F.coalesce(follows, F.lit(False))).withColumn("_g", F.sum(F.col("_fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.unionByName(named.groupBy(*keys, "_g").agg(F.sum("len").alias("len")).drop("_g"))


def null_runs(df: DataFrame, keys: list[str], us: str, column: str, chunk_s: int | None = None) -> DataFrame:
    """Nulls, runs of them, the longest, runs of one, runs of over two. A key's history is one task's; with chunk_s, so long a
    chunk of it is."""
    missing = F.col(column).isNull()
    if chunk_s:
        runs = chunked_islands(df, keys, us, missing, chunk_s)
    else:
        w = Window.partitionBy(*keys).orderBy(us)
        marked = df.select(*keys, us, missing.alias("m"), F.sum((~missing).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
        runs = marked.where("m").groupBy(*keys, "island").agg(F.count("*").alias("len"))
    totals = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(missing.cast("long")).alias("nulls"))
    stats = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("len").alias("max_run"), F.count_if(F.col("len") == 1).alias("isolated"), F.count_if(F.col("len") > 2).alias("clustered_gt2"))
    out = totals.join(stats, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*keys, "rows", "nulls", zero("runs"), zero("max_run"), zero("isolated"), zero("clustered_gt2"), percent(F.col("nulls"), F.col("rows")).alias("null_pct"))


def temporal_audit(segmented: DataFrame, keys: list[str], us: str, grid_s: int = GRID_S, gap_s: float = GAP_S) -> DataFrame:
    """Steps within segments, duplicates, gaps, monotonicity and node-hours, by key."""
    step = F.when(F.col("dt_s") <= gap_s, F.col("dt_s"))
    sizes = segmented.groupBy(*keys, "segment_id").agg(F.count("*").alias("len")).groupBy(*keys).agg(F.max("len").alias("longest"))
    out = segmented.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        percent(F.count_if(step == grid_s), F.count(step)).alias("pct_on_grid"), (F.count("*") - F.count_distinct(us)).alias("remaining_duplicate_ts"),
        (F.max("segment_id") + 1).alias("segments"), F.count_if((F.col("dt_s") > grid_s) & (F.col("dt_s") <= gap_s)).alias("short_gaps"), F.count_if(F.col("dt_s") > gap_s).alias("large_gaps"),
        F.coalesce(F.max("dt_s"), F.lit(0).cast("long")).alias("max_gap_s"), F.coalesce(F.min("dt_s") > 0, F.lit(True)).alias("monotonic"),
        node_hours(F.count("*"), grid_s).alias("node_hours"),
    )
    steps = value_counts(segmented, keys, step)
    typical = mode_of(steps, keys, "dominant_dt_s").join(quantiles(steps, keys, {"median_dt_s": 0.5}), keys).withColumn("dominant_dt_s", F.col("dominant_dt_s").cast("long"))
    return out.join(sizes, keys).join(typical, keys, "left").withColumn("longest_segment_hours", node_hours(F.col("longest"), grid_s)).drop("longest")


def physical_audit(segmented: DataFrame, keys: list[str], us: str, temp: str, power: str, low: float = 0.0, high: float = 125.0, step_flag: float = STEP_FLAG, least: int = 100, chunk_s: int | None = None) -> DataFrame:
    """Ranges, steps within segments (flagged, never dropped), and the correlation of power and temperature over `least` pairs.
    A segment is one task's to sort; with chunk_s, so long a chunk of a key."""
    rows = chunked_steps(segmented, keys, us, temp, "step", chunk_s) if chunk_s else segmented.withColumn("step", within_segment_step(segmented, keys, us, temp))
    both = finite(F.col(temp)) & finite(F.col(power))
    return rows.groupBy(*keys).agg(
        F.min(temp).alias("temp_min"), F.max(temp).alias("temp_max"), F.count_if(out_of_range(F.col(temp), low, high)).alias("temp_out_of_range"),
        F.min(power).alias("power_min"), F.count_if(F.col(power) < 0).alias("power_negative"),
        F.stddev_pop("step").alias("step_std"), F.max(F.abs("step")).alias("step_max"), F.count_if(F.abs("step") > step_flag).alias("step_flagged"),
        F.when(F.count_if(both) > least, correlation_of(F.col(power), F.col(temp))).alias("corr_power_temp"),
    )


def gates(temporal: DataFrame, physical: DataFrame, keys: list[str], grid_s: int = GRID_S) -> DataFrame:
    """Failure messages of each key, none where all is well."""
    tests = [
        (F.col("remaining_duplicate_ts") != 0, "duplicate timestamps remain"),
        (~F.col("monotonic"), "timestamps not strictly increasing"),
        (F.coalesce(F.col("dominant_dt_s") != grid_s, F.lit(False)), "dominant step is off the grid"),
        (F.col("temp_out_of_range") > 0, "temperature out of range"),
        (F.col("power_negative") > 0, "negative power"),
    ]
    messages = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in tests]))
    return temporal.join(physical, keys).select(*keys, messages.alias("failures"))


def policy_bins(df: DataFrame, keys: list[str], us: str, column: str, order: list[str], grid_s: int | None = None) -> DataFrame:
    """Of each bin: rows, spread, mean and first value by `order`."""
    stamp = F.col(us) if grid_s is None else F.floor(F.col(us) / (grid_s * 1_000_000)).cast("long") * (grid_s * 1_000_000)
    v = F.col(column).cast("double")
    return df.groupBy(*keys, stamp.alias(us)).agg(F.count("*").alias("n"), (F.max(v) - F.min(v)).alias("spread"), (F.sum(v) / F.count(v)).alias("mean"), F.min_by(v, F.struct(*order)).alias("first"))


def policy_report(bins: DataFrame, keys: list[str], grid_s: int = GRID_S) -> DataFrame:
    """What keeping one row for each bin would cost: rows removed, spreads of merged bins, first against mean."""
    merged, off = F.col("n") > 1, F.col("mean") - F.col("first")
    spread, dev = F.when(merged, F.col("spread")), F.when(merged, off * off)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    before, after = F.sum("n"), F.count("*")
    return bins.groupBy(*keys).agg(
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("removed"), percent(before - after, before).alias("pct_removed"),
        F.count_if(merged).alias("merged_bins"), F.max("n").alias("max_multiplicity"), node_hours(after, grid_s).alias("node_hours"),
        zero(F.avg(spread)).alias("mean_spread"), zero(F.max(spread)).alias("max_spread"), zero(F.sqrt(F.avg(dev))).alias("first_vs_mean_rms"),
    )


def policy_totals(bins: DataFrame) -> DataFrame:
    """One row over all keys, with the median and p99 of the spreads of merged bins, which are as many as readings."""
    spreads = value_counts(bins.where("n > 1"), [], "spread")
    before, after = F.sum("n"), F.count("*")
    totals = bins.agg(before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("removed"), percent(before - after, before).alias("pct_removed"))
    return totals.crossJoin(quantiles(spreads, [], {"spread_median": 0.5, "spread_p99": 0.99}))  # a row each
