"""Column functions of the telemetry model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def quantize(c: Column, step: float = 1.0) -> Column:
    """To the nearest multiple of step, ties to even."""
    return F.rint(c) if step == 1.0 else F.rint(c / step) * step


def stable(alpha: Column) -> Column:
    return (alpha > 0) & (alpha < 1)


def time_constant(alpha: Column, dt: float | Column) -> Column:
    """-dt / ln(alpha), null unless 0 < alpha < 1."""
    return F.when(stable(alpha), -F.lit(dt) / F.ln(alpha)) if not isinstance(dt, Column) else F.when(stable(alpha), -dt / F.ln(alpha))


def decay(tau: Column, dt: float) -> Column:
    """The inverse of time_constant."""
    return F.exp(F.try_divide(F.lit(-float(dt)), tau))


def effective(alpha: Column, beta: Column, gamma: Column, tau: Column) -> dict[str, Column]:
    """Thermal resistance, reference temperature and capacity."""
    r = F.try_divide(beta, 1 - alpha)
    return {"r_eff": r, "t_ref": F.try_divide(gamma, 1 - alpha), "c_eff": F.try_divide(tau, r)}


def out_of_range(c: Column, low: float = 0.0, high: float = 125.0) -> Column:
    return F.coalesce((c < low) | (c > high), F.lit(False))


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(100.0 * part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"), digits)


def node_hours(rows: Column, grid_s: float = 10.0) -> Column:
    return F.round(rows.cast("double") * float(grid_s) / 3600.0, 1)


def ratio(value: Column, reference: Column) -> Column:
    return F.try_divide(value, reference)


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), (a + b) / 2.0)


def column_role(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "timestamp", "timestamp").when(low == "hostname", "host_id").when(low.contains("temp"), "temperature").when(low.contains("power"), "power").otherwise("other")


def micros(ts_ntz: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.datediff(F.to_date(ts_ntz), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts_ntz)) * 3600 + F.minute(ts_ntz) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts_ntz) * 1_000_000).cast("long")


# -- aggregates that centre as they go, and merge, so that readings far from zero lose no digits


def correlation_of(x: Column, y: Column) -> Column:
    """Over rows where both are finite; null unless there are over two and both vary."""
    ok = finite(x) & finite(y)
    a, b = F.when(ok, x), F.when(ok, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) > 2) & (sa > 0) & (sb > 0), F.try_divide(F.covar_pop(a, b), sa * sb))


def squares_about_mean(x: Column) -> Column:
    """The sum of squared distances from the mean."""
    return F.var_pop(x) * F.count(x)
