"""Rolling time constants, robust scores and persisted alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation_of, time_constant
from ..sources.shared import written
from .arx import moments, solved
from .population import quantiles, value_counts
from .scan import numbered, stretches, time_chunk

THRESHOLD, PERSIST, MIN_WINDOWS, MIN_HALF, EPS = 3.5, 2, 12, 4, 1e-9


def window_samples(window_s: float, dt: float) -> int:
    return max(8, round(window_s / dt))


def rolling(runs: DataFrame, keys: list[str], dt: float, samples: int, us: str = "us", chunk_s: int | None = None) -> DataFrame:
    """Count-tumbling windows within runs: tau, mean power and temperature of each stable one, with at least 0.6 of
    its samples and one; no pair crosses a window. Windows are numbered over what survives, in order of time: a key's in
    one task, or, with chunk_s, those that begin in so long a chunk (of chunked_runs(), no task then sorts a history)."""
    least = int(0.6 * samples) + 1
    rows = runs.withColumn("win", F.floor(F.col("idx") / samples))
    rows = rows.withColumn("y", F.lead("t").over(Window.partitionBy(*keys, "run_id", "win").orderBy("idx")))
    named = rows.groupBy(*keys, "run_id", "win").agg(F.min(us).alias("first_us"), F.count("*").alias("samples"), (F.sum("p") / F.count("*")).alias("mean_p"), (F.sum("t") / F.count("*")).alias("mean_t"))
    fits = solved(rows.where("y is not null").groupBy(*keys, "run_id", "win").agg(*moments()))
    out = named.where(F.col("samples") >= least).join(fits.select(*keys, "run_id", "win", "alpha"), [*keys, "run_id", "win"])
    out = out.withColumn("tau", time_constant(F.col("alpha"), float(dt))).where("tau is not null")
    if chunk_s:
        return numbered(written(out.drop("alpha"), "windows"), keys, ["run_id", "win"], time_chunk("first_us", chunk_s), "ord")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("run_id", "win")).cast("long")).drop("alpha")


def scored(windows: DataFrame, keys: list[str], threshold: float = THRESHOLD, persist: int = PERSIST, min_windows: int = MIN_WINDOWS, min_half: int = MIN_HALF) -> DataFrame:
    """Windows with their half, robust z against the baseline half, alert and persisted (a run of `persist` alerts marks all of it)."""
    whole = Window.partitionBy(*keys)
    half = F.floor(F.col("n") / 2)
    rows = windows.withColumn("n", F.count("*").over(whole)).where((F.col("n") >= min_windows) & (half >= min_half) & (F.col("n") - half >= min_half)).withColumn("baseline", F.col("ord") <= half)
    base = lambda c: F.when(F.col("baseline"), F.col(c))
    rows = rows.withColumn("med", F.median(base("tau")).over(whole)).withColumn("p_med", F.median(base("mean_p")).over(whole))
    rows = rows.withColumn("dev", F.abs(F.col("tau") - F.col("med"))).withColumn("mad", F.median(base("dev")).over(whole))
    rows = rows.withColumn("z", F.col("dev") / (1.4826 * F.col("mad") + EPS)).withColumn("alert", F.col("z") > threshold)
    part = Window.partitionBy(*keys, "baseline").orderBy("ord")
    rows = rows.withColumn("island", F.sum((~F.col("alert")).cast("long")).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("alert").cast("long")).over(Window.partitionBy(*keys, "baseline", "island"))
    return rows.withColumn("persisted", F.col("alert") & (run >= persist)).drop("island")


def chunked_scored(windows: DataFrame, keys: list[str], threshold: float = THRESHOLD, persist: int = PERSIST, min_windows: int = MIN_WINDOWS, min_half: int = MIN_HALF, size: int = 4096) -> DataFrame:
    """scored() of any number of windows a key: medians come from counts of values, and runs of alerts are put together over
    chunks of `size` windows. Windows and scores are written to the shared folder, as both are read again. A key of null or with a tau that is not finite takes no part."""
    half = F.floor(F.col("n") / 2)
    windows = written(windows, "windows")
    sizes = windows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") >= min_windows) & (half >= min_half) & (F.col("n") - half >= min_half))
    rows = windows.join(sizes, keys).withColumn("baseline", F.col("ord") <= half)
    middle = lambda df, c, name: quantiles(value_counts(df.where("baseline"), keys, c), keys, {name: 0.5})
    rows = rows.join(middle(rows, "tau", "med"), keys).join(middle(rows, "mean_p", "p_med"), keys, "left")
    rows = rows.withColumn("dev", F.abs(F.col("tau") - F.col("med")))
    rows = rows.join(middle(rows, "dev", "mad"), keys).withColumn("z", F.col("dev") / (1.4826 * F.col("mad") + EPS)).withColumn("alert", F.col("z") > threshold)
    rows = written(rows, "scores")
    found = stretches(rows, [*keys, "baseline"], ["ord"], F.floor(F.col("ord") / size), "alert", "_len")
    return found.withColumn("persisted", F.col("alert") & (F.col("_len") >= persist)).drop("_len")


def unit_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each unit: baseline and later medians, alert rates of both halves, and the correlation of |z| with the shift in power."""
    base, later = F.col("baseline"), ~F.col("baseline")
    rate = lambda c: F.avg(F.when(c, F.col("persisted").cast("double")))
    z, d = F.when(later, F.col("z")), F.when(later, F.abs(F.col("mean_p") - F.col("p_med")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.first("med").alias("baseline_tau_median"), F.first("mad").alias("baseline_tau_mad"), F.median(F.when(later, F.col("tau"))).alias("oos_tau_median"),
        F.median(F.when(later, F.col("dev"))).alias("oos_tau_madev"), rate(later).alias("oos_alert_rate"), rate(base).alias("baseline_alert_rate"),
        correlation_of(z, d).alias("power_confound_corr"), (F.first("mad") / (F.first("med") + EPS)).alias("baseline_rel_spread"),
    )


def alerts_against_null(units: DataFrame) -> DataFrame:
    diff = F.col("oos_alert_rate") - F.col("baseline_alert_rate")
    return units.agg(F.count("*").alias("units"), F.avg("oos_alert_rate").alias("oos_mean"), F.avg("baseline_alert_rate").alias("baseline_mean"), F.median(diff).alias("median_difference"), F.avg((diff > 0).cast("double")).alias("fraction_above"), F.median("baseline_rel_spread").alias("rel_spread_median"))


def busiest(units: DataFrame, keys: list[str]) -> DataFrame:
    """The unit with most windows, the first by key among equals."""
    best = units.agg(F.max_by(F.struct(*keys, "n_windows"), F.struct("n_windows", *[-F.col(k) for k in keys])).alias("u"))
    return best.select("u.*")
