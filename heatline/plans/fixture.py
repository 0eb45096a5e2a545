"""The events table as telemetry: unit = user, t = value in hundredths, p = the k of props; whole numbers, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..operators import arx, clean, runs

GAP_S, DT = 43_200, 10.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("unit"), "event_type", micros(F.col("ts")).alias("us"), F.round(F.col("value") * 100).cast("double").alias("t"), F.get_json_object("props", "$.k").cast("long").cast("double").alias("p"))


def with_faults(e: DataFrame) -> DataFrame:
    """Readings of error events have no temperature."""
    return e.withColumn("t", F.when(F.col("event_type") != "error", F.col("t")))


def hourly(e: DataFrame, key: str) -> DataFrame:
    """Hourly bins: mean and greatest t, mean p."""
    return e.withColumn("t_max", F.col("t")).transform(lambda d: clean.bin_dedupe(d, [key], "us", ["t", "t_max", "p"], 3600))


def segmented(e: DataFrame, key: str = "unit", gap_s: int = GAP_S) -> DataFrame:
    return clean.with_segments(clean.with_gaps(e, [key], "us"), [key], "us", gap_s)


def unit_runs(spark: SparkSession, sf_dir: str, gap_s: int = GAP_S) -> DataFrame:
    return runs.finite_runs(segmented(events(spark, sf_dir), gap_s=gap_s), ["unit"], "us", "t", "p")


def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.lead_pairs(unit_runs(spark, sf_dir), ["unit"])


def unit_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arx.fit(unit_pairs(spark, sf_dir), ["unit"], DT)


def r(c: Column | str, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    """Doubles rounded; the others as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


# -- the same in SQL

EV = """ev AS (SELECT event_id, user_id AS unit, event_type, CAST(epoch_us(ts) AS BIGINT) AS us,
  CAST(round(value * 100) AS DOUBLE) AS t, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS p FROM events)"""


def seg(source: str = "ev", key: str = "unit", gap_s: int = GAP_S) -> str:
    return f"""g AS (SELECT *, CAST(trunc((us - lag(us) OVER (PARTITION BY {key} ORDER BY us)) / 1000000) AS BIGINT) AS dt_s FROM {source}),
s AS (SELECT *, CAST(sum(CASE WHEN dt_s > {gap_s} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM g)"""


RUN = """o AS (SELECT *, t IS NOT NULL AND p IS NOT NULL AS ok FROM s),
b AS (SELECT *, coalesce(segment_id <> lag(segment_id) OVER w OR NOT lag(ok) OVER w, true) AS fresh FROM o WINDOW w AS (PARTITION BY unit ORDER BY us)),
i AS (SELECT *, CAST(sum(CASE WHEN ok AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM b),
j AS (SELECT unit, run_id, row_number() OVER (PARTITION BY unit, run_id ORDER BY us) - 1 AS idx, us, t, p, count(*) OVER (PARTITION BY unit, run_id) AS run_len FROM i WHERE ok),
runs AS (SELECT * FROM j WHERE run_len >= 2)"""

PAIR = """pairs AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY unit, run_id ORDER BY idx) AS y FROM runs) WHERE y IS NOT NULL)"""

SUMS = ("n", "st", "sp", "sy", "stt", "stp", "spp", "sty", "spy", "syy")
MOMENTS = "CAST(count(*) AS DOUBLE) AS n, sum(t) AS st, sum(p) AS sp, sum(y) AS sy, sum(t*t) AS stt, sum(t*p) AS stp, sum(p*p) AS spp, sum(t*y) AS sty, sum(p*y) AS spy, sum(y*y) AS syy"


def solve(source: str, keys: str, out: str = "fit") -> str:
    """A chain of CTEs from moments in `source` to `out` with alpha, beta, gamma, i00."""
    return f"""{out}_c AS (SELECT *, n*stt - st*st AS ctt, n*stp - st*sp AS ctp, n*spp - sp*sp AS cpp, n*sty - st*sy AS cty, n*spy - sp*sy AS cpy FROM {source}),
{out}_d AS (SELECT *, CASE WHEN ctt*cpp - ctp*ctp > 0 THEN ctt*cpp - ctp*ctp END AS det FROM {out}_c),
{out}_e AS (SELECT *, (cty*cpp - cpy*ctp) / det AS alpha, (cpy*ctt - cty*ctp) / det AS beta, n*cpp / det AS i00 FROM {out}_d),
{out} AS (SELECT *, (sy - alpha*st - beta*sp) / n AS gamma FROM {out}_e)"""


def tau(alpha: str = "alpha", dt: float = DT) -> str:
    return f"CASE WHEN {alpha} > 0 AND {alpha} < 1 THEN -{dt}::DOUBLE / ln({alpha}) END"


FIT = f"m AS (SELECT unit, {MOMENTS} FROM pairs GROUP BY unit), {solve('m', 'unit')}, fits AS (SELECT *, {tau()} AS tau FROM fit)"
BASE = f"WITH {EV}, {seg()}"
RUNS = f"{BASE}, {RUN}"
PAIRS = f"{RUNS}, {PAIR}"
FITS = f"{PAIRS}, {FIT}"
RESID = f"{FITS}, resid AS (SELECT pairs.*, alpha*t + beta*p + gamma AS yhat, y - (alpha*t + beta*p + gamma) AS r FROM pairs JOIN fits USING (unit))"


def corr(x: str, y: str, where: str = "true") -> str:
    """The guarded correlation from sums."""
    a, b = f"CASE WHEN {where} THEN {x} END", f"CASE WHEN {where} THEN {y} END"
    n, sa, sb, saa, sbb, sab = f"CAST(count({a}) AS DOUBLE)", f"sum({a})", f"sum({b})", f"sum(({a})*({a}))", f"sum(({b})*({b}))", f"sum(({a})*({b}))"
    return f"CASE WHEN {n} > 2 AND {n}*{saa} - {sa}*{sa} > 0 AND {n}*{sbb} - {sb}*{sb} > 0 THEN ({n}*{sab} - {sa}*{sb}) / (sqrt({n}*{saa} - {sa}*{sa}) * sqrt({n}*{sbb} - {sb}*{sb})) END"
