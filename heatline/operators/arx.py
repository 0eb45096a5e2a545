"""First-order models y = alpha t + beta p + gamma: grouped least squares, uncertainty, prediction, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation_of, effective, squares_about_mean, time_constant

#: Of a group's (t, p, y): rows, means, and sums of products of distances from the means.
MOMENTS = ("n", "mt", "mp", "my", "ctt", "ctp", "cpp", "cty", "cpy", "cyy")
CROSS = MOMENTS[4:]
#: A determinant below this part of its terms is rounding, and so is a sum of squares below this part of what it is the rest of.
SINGULAR, ROUNDING = 1e-11, 1e-13


def moments() -> list[Column]:
    """Aggregates over t, p, y, centred and mergeable: map-side, ten numbers to a group."""
    n = F.count("*").cast("double")
    return [n.alias("n"), *[F.avg(x).alias(f"m{x}") for x in "tpy"], *[(F.covar_pop(F.col(c[1]), F.col(c[2])) * n).alias(c) for c in CROSS]]


def of_sums(n: Column, sums: dict[str, Column], products: dict[str, Column], origin: dict[str, Column] | None = None) -> list[Column]:
    """The moments from sums of (t, p, y) and of their products, both taken from `origin` on (zero if none), which should be near."""
    mean = {x: F.try_divide(sums[x], n) for x in "tpy"}
    means = [(mean[x] + origin[x] if origin else mean[x]).alias(f"m{x}") for x in "tpy"]
    rest = {c: products[c] - sums[c[1]] * mean[c[2]] for c in CROSS}
    rest |= {c: F.when(rest[c] > ROUNDING * products[c], rest[c]).otherwise(F.when(n > 0, 0.0)) for c in ("ctt", "cpp", "cyy")}
    return [n.alias("n"), *means, *[rest[c].alias(c) for c in CROSS]]


def united(blocks: DataFrame, keys: list[str], order: str, others: list[str], combine: Callable[[Column], Column]) -> DataFrame:
    """(keys, others, moments) of unions of a key's blocks. `combine` adds a column over the blocks of a union; what it gets are
    sums taken from the mean of the key's first block on, so that nothing cancels."""
    first = Window.partitionBy(*keys).orderBy(order)
    n = F.col("n")
    out = blocks.withColumns({f"_{x}": F.first(f"m{x}").over(first) for x in "tpy"})
    off = {x: F.col(f"m{x}") - F.col(f"_{x}") for x in "tpy"}
    out = out.withColumns({f"_s{x}": n * off[x] for x in "tpy"} | {f"_{c}": F.col(c) + n * off[c[1]] * off[c[2]] for c in CROSS})
    names = ["n", *[f"_s{x}" for x in "tpy"], *[f"_{c}" for c in CROSS]]
    out = out.select(*keys, *others, *[f"_{x}" for x in "tpy"], *[combine(F.col(c)).alias(f"u{c}") for c in names])
    sums, products = {x: F.col(f"u_s{x}") for x in "tpy"}, {c: F.col(f"u_{c}") for c in CROSS}
    return out.select(*keys, *others, *of_sums(F.col("un"), sums, products, {x: F.col(f"_{x}") for x in "tpy"}))


def solved(df: DataFrame) -> DataFrame:
    """Adds alpha, beta, gamma from the moments (null where singular), i00, the (t, t) entry of the inverse, and rss."""
    n, mt, mp, my, ctt, ctp, cpp, cty, cpy, cyy = (F.col(c) for c in MOMENTS)
    out = df.withColumn("_det", ctt * cpp - ctp * ctp)
    det = F.when((n > 2) & (F.col("_det") > SINGULAR * ctt * cpp), F.col("_det"))
    out = out.withColumn("alpha", F.try_divide(cty * cpp - cpy * ctp, det)).withColumn("beta", F.try_divide(cpy * ctt - cty * ctp, det))
    out = out.withColumn("gamma", my - F.col("alpha") * mt - F.col("beta") * mp)
    rss = F.greatest(cyy - F.col("alpha") * cty - F.col("beta") * cpy, F.lit(0.0))
    return out.withColumn("i00", F.try_divide(cpp, det)).withColumn("rss", F.when(F.col("alpha").isNotNull(), rss)).drop("_det")


def fit(pairs: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """alpha, beta, gamma, tau and the effective parameters of each group."""
    out = solved(pairs.groupBy(*keys).agg(*moments()))
    out = out.withColumn("tau", time_constant(F.col("alpha"), float(dt)))
    extra = effective(F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("tau"))
    return out.select(*keys, F.col("n").cast("long").alias("n_pairs"), "alpha", "beta", "gamma", "tau", *[v.alias(k) for k, v in extra.items()], "i00", "rss", *MOMENTS[1:])


def residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with yhat and r = y - yhat. Coefficients are one row for each group."""
    coefficients = fits.select(*keys, "alpha", "beta", "gamma")
    out = pairs.join(coefficients, keys)
    return out.withColumn("yhat", F.col("alpha") * F.col("t") + F.col("beta") * F.col("p") + F.col("gamma")).withColumn("r", F.col("y") - F.col("yhat"))


def uncertainty(fits: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """Standard errors of fit() by the delta method; the residuals' squares come from the moments, so pairs are read once."""
    a, tau = F.col("alpha"), F.col("tau")
    out = fits.withColumn("se_alpha", F.sqrt(F.col("rss") / F.greatest(F.col("n_pairs") - 3, F.lit(1)) * F.col("i00")))
    out = out.withColumn("se_tau", F.when(tau.isNotNull(), F.abs(F.try_divide(F.lit(float(dt)), a * F.ln(a) * F.ln(a))) * F.col("se_alpha")))
    return out.select(*keys, "n_pairs", "alpha", "tau", "rss", "se_alpha", "se_tau", (tau - 1.96 * F.col("se_tau")).alias("ci_low"), (tau + 1.96 * F.col("se_tau")).alias("ci_high"), F.try_divide(F.col("se_tau"), tau).alias("cov"))


def metrics(resid: DataFrame, keys: list[str]) -> DataFrame:
    """One-step RMSE, MAE, R2; persistence RMSE and the R2 of the increment."""
    r, y, dy = F.col("r"), F.col("y"), F.col("y") - F.col("t")
    explained = lambda x: 1.0 - F.try_divide(F.sum(r * r), F.nullif(squares_about_mean(x), F.lit(0.0)))
    return resid.where("r is not null").groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), explained(y).alias("r2"),
        F.sqrt(F.avg(dy * dy)).alias("persistence_rmse"), explained(dy).alias("increment_r2"),
    )


def increment_stats(pairs: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """Spread and largest size of the increment and its rate."""
    dy = F.col("y") - F.col("t")
    std = F.stddev_pop(dy)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), std.alias("dt_std"), F.max(F.abs(dy)).alias("dt_max"), (std / dt).alias("rate_std"), (F.max(F.abs(dy)) / dt).alias("rate_max"))


def residual_structure(resid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, spread, lag-one correlation over the unit's whole sequence (across runs), and correlations with p and t."""
    w = Window.partitionBy(*keys).orderBy("run_id", "idx")
    lagged = resid.where("r is not null").withColumn("before", F.lag("r").over(w))
    r = F.col("r")
    corr = lambda c: correlation_of(r, F.col(c))
    return lagged.groupBy(*keys).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), corr("before").alias("lag1"), corr("p").alias("corr_p"), corr("t").alias("corr_t"))
