"""Statistics over units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation_of, finite, ratio, relative_difference

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def summary(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, population spread, range and exact quantiles of the finite values."""
    v = F.when(finite(F.col(column).cast("double")), F.col(column).cast("double"))
    parts = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *[F.percentile(v, q).alias(f"p{round(100 * q):02d}") for q in QUANTILES]]
    return df.groupBy(*keys).agg(*parts) if keys else df.agg(*parts)


#: Ranges that a key's values are cut into: a task sorts the distinct values of some of them, never all of a key's.
RANGES = 4096


def value_counts(df: DataFrame, keys: list[str], column: str | Column, weight: str | None = None) -> DataFrame:
    """(keys, v, w): each finite value of readings and how often it comes (each row `weight` times), with map-side sums."""
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    rows = df.select(*keys, v.alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return rows.where(finite(F.col("v"))).groupBy(*keys, "v").agg(F.sum("w").alias("w"))


def placed_values(counts: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """value_counts() with `n`, a key's values, and `before`, how many of them are less. A key's span is cut into equal ranges;
    their sizes are summed in order, a row each, and a task orders the values of a range."""
    span = counts.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("w").alias("n"))
    share = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * ranges), F.lit(ranges - 1))).otherwise(0)
    rows = counts.join(span, keys).withColumn("_b", share.cast("int")).drop("_lo", "_hi")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_b").agg(F.sum("w").alias("_w")).select(*keys, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_skip"))
    own = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sizes, [*keys, "_b"]).select(*keys, "v", "w", "n", (F.col("_skip") + F.coalesce(F.sum("w").over(own), F.lit(0))).alias("before"))


def quantiles(counts: DataFrame, keys: list[str], qs: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """(keys, a column for each name): exact quantiles, linear between neighbours, of what value_counts() counted; without keys
    one row, of nulls if there are no values."""
    own = keys or ["_all"]
    rows = placed_values(counts if keys else counts.withColumn("_all", F.lit(0)), own, ranges)
    parts = []
    for name, q in qs.items():
        x = F.lit(float(q)) * (F.col("n") - 1)
        at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("w")), F.col("v")))
        low, high = at(F.floor(x)), at(F.ceil(x))
        parts.append((low + (high - low) * F.max(x - F.floor(x))).alias(name))
    return rows.groupBy(*keys).agg(*parts) if keys else rows.agg(*parts)


def mode_of(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the value that comes most often, the least among equals."""
    return counts.groupBy(*keys).agg(F.max_by("v", F.struct("w", -F.col("v"))).alias(name))


def dispersion(stats: DataFrame) -> DataFrame:
    """summary() with relative spreads."""
    return stats.withColumn("cov", ratio(F.col("std"), F.col("mean"))).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("iqr_over_median", ratio(F.col("p75") - F.col("p25"), F.col("p50"))).withColumn("p95_over_p05", ratio(F.col("p95"), F.col("p05")))


def socket_pairs(units: DataFrame, host: str, socket: str, column: str) -> DataFrame:
    """Hosts with both sockets: one row with both values."""
    wide = units.groupBy(host).agg(F.max(F.when(F.col(socket) == 0, F.col(column))).alias("a"), F.max(F.when(F.col(socket) == 1, F.col(column))).alias("b"))
    return wide.where("a is not null and b is not null")


def pairing(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("hosts"), correlation_of(F.col("a"), F.col("b")).alias("corr"), F.median(F.abs(F.col("a") - F.col("b"))).alias("median_abs_diff"), F.median(relative_difference(F.col("a"), F.col("b"))).alias("median_rel_diff"))


def paired(units: DataFrame, keys: list[str], condition: str, column: str, reference: str = "F0") -> DataFrame:
    """Units valid in a condition and in the reference: both values and their ratio. The units are read once."""
    ref = F.max(F.when(F.col(condition) == reference, F.col(column))).over(Window.partitionBy(*keys))
    rest = units.select(*keys, condition, F.col(column).alias("value"), ref.alias("ref")).where(F.col(condition) != reference)
    return rest.where("value is not null and ref is not null").withColumn("ratio", ratio(F.col("value"), F.col("ref")))


def by_condition(analytic: DataFrame, replicates: DataFrame, condition: str = "condition", reference: str = "F0") -> DataFrame:
    """Analytic estimates (condition, unit, tau, cov, ci_width) beside bootstrap ones (condition, unit, tau of each draw):
    medians over units of both, the ratio to the reference, and the percentage of draws without a time constant."""
    a = analytic.where("tau is not null").groupBy(condition).agg(F.count("*").alias("units"), F.median("tau").alias("tau_point"), F.median("cov").alias("analytic_cov"), F.median("ci_width").alias("analytic_ci_width"))
    each = replicates.groupBy(condition, "unit").agg(F.count("*").alias("draws"), F.count("tau").alias("valid"), F.median("tau").alias("tau"), F.try_divide(F.stddev_pop("tau"), F.avg("tau")).alias("cov"), (F.percentile("tau", 0.975) - F.percentile("tau", 0.025)).alias("ci_width"))
    share = 100.0 * (1.0 - F.sum("valid") / F.sum("draws"))
    b = each.groupBy(condition).agg(F.median("tau").alias("tau_boot"), F.median("cov").alias("boot_cov"), F.median("ci_width").alias("boot_ci_width"), share.alias("invalid_pct"))
    both = a.join(b, condition, "left")
    return both.withColumn("tau_ratio", ratio(F.col("tau_boot"), F.max(F.when(F.col(condition) == reference, F.col("tau_boot"))).over(Window.partitionBy(F.lit(0)))))  # a row for each condition


def swing(ratios: DataFrame, condition: str, column: str, high: str = "F2", low: str = "F1") -> DataFrame:
    """One row: how far the conditions move the estimate, the highest over the lowest and `high` over `low`."""
    of = lambda c: F.max(F.when(F.col(condition) == c, F.col(column)))
    return ratios.agg(ratio(of(high), of(low)).alias("swing"), ratio(F.max(column), F.min(column)).alias("span"))


#: Why a unit isn't valid.
REASONS = ("no segments", "unstable alpha", "below MIN_PAIRS or few boot fits")


def unit_validity(fits: DataFrame, boots: DataFrame | None, keys: list[str], min_pairs: int = 2000, min_fits: int = 20) -> DataFrame:
    """fits with `valid` and why not: a stable coefficient, min_pairs pairs and (where boots, a row for each unit with
    `valid_fits`, is given) min_fits bootstrap fits. Every unit stays."""
    rows = fits if boots is None else fits.join(boots.select(*keys, "valid_fits"), keys, "left")
    stable = (F.col("alpha") > 0) & (F.col("alpha") < 1)
    enough = F.col("n_pairs") >= min_pairs
    if boots is not None:
        enough = enough & (F.coalesce("valid_fits", F.lit(0)) >= min_fits)
    reason = F.when(F.coalesce(F.col("n_pairs"), F.lit(0)) == 0, REASONS[0]).when(~F.coalesce(stable, F.lit(False)), REASONS[1]).when(~enough, REASONS[2])
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def ratio_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.median("ratio").alias("median"), F.percentile("ratio", 0.05).alias("p05"), F.percentile("ratio", 0.95).alias("p95"), F.min("ratio").alias("min"), F.max("ratio").alias("max"), ratio(F.percentile("value", 0.75) - F.percentile("value", 0.25), F.percentile("ref", 0.75) - F.percentile("ref", 0.25)).alias("iqr_ratio"))


def with_average_ranks(rows: DataFrame, keys: list[str], columns: dict[str, str], weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with, for each name of `columns`, the rank of its column within keys: from 1, ties at their mean, each row counting
    `weight` times. Ranks come from counts of distinct values in ranges of a key's span, so no task sorts a key's rows.
    Values that are not finite have no rank; a key of null or a zero weight is not ranked with others."""
    own = keys or ["_all"]
    base = out = rows if keys else rows.withColumn("_all", F.lit(0))
    for name, column in columns.items():
        placed = placed_values(value_counts(base, own, column, weight), own, ranges)
        ranks = placed.select(*own, F.col("v").alias("_v"), (F.col("before") + (F.col("w") + 1) / 2).alias(name))
        out = out.withColumn("_v", F.col(column).cast("double")).join(ranks, [*own, "_v"], "left").drop("_v")
    return out if keys else out.drop("_all")


def rank_correlation_of(n: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """From n and the sums of products of average ranks, whose mean is known; null where either is constant or n is below 3."""
    off = n * (n + 1) * (n + 1) / 4  # n times the square of the mean rank
    return F.when((n > 2) & (xx - off > 0) & (yy - off > 0), (xy - off) / (F.sqrt(xx - off) * F.sqrt(yy - off)))


def spearman(pairs: DataFrame, x: str, y: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """n and the rank correlation of each group's pairs, those with both values finite; each counts `weight` times. Null where
    either is constant, or for fewer than three pairs."""
    both = pairs.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double")))
    ranked = with_average_ranks(both, keys, {"_x": x, "_y": y}, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # twice a rank is whole and the mean rank known, so the sums need no second pass
    parts = ranked.groupBy(*keys).agg(F.sum(w).cast("long").alias("n"), *[F.sum(w * F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in (("_x", "_x"), ("_x", "_y"), ("_y", "_y"))])
    rho = rank_correlation_of(F.col("n").cast("double"), F.col("__x_x"), F.col("__x_y"), F.col("__y_y"))
    return parts.select(*keys, "n", rho.alias("rho"))


def top_units(df: DataFrame, unit: str, n: int) -> DataFrame:
    """The n units with most rows, ties by name, in order of name."""
    return df.groupBy(unit).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), unit).limit(n).orderBy(unit)


def top_by_files(df: DataFrame, unit: str, file: str, n: int) -> DataFrame:
    """The n units with most distinct files, ties by name, in order of name."""
    return df.groupBy(unit).agg(F.count_distinct(file).alias("files")).orderBy(F.desc("files"), unit).limit(n).orderBy(unit)


def flagged_subset(units: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Units with in_subset; the subset is named by key."""
    return units.join(subset.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn("in_subset", F.coalesce("_in", F.lit(False))).drop("_in")


def all_valid(units: DataFrame, keys: list[str], column: str, conditions: int) -> DataFrame:
    """How many units have a value under every condition."""
    per = units.groupBy(*keys).agg(F.count(column).alias("n"))
    return per.agg(F.count_if(F.col("n") == conditions).alias("valid_in_all"), F.count("*").alias("units"))
