"""Conditions, contiguous runs and lead pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, quantize
from ..sources.shared import written
from .scan import carried, joined, time_chunk


@dataclass(frozen=True)
class Condition:
    code: str
    temp: str
    quantized: bool
    decimated: bool
    dt: float
    note: str


#: The five measurement conditions.
CONDITIONS = (
    Condition("F0", "mean", False, False, 10.0, "full (reference)"),
    Condition("F1", "mean", True, False, 10.0, "quantization"),
    Condition("F2", "mean", False, True, 20.0, "downsample"),
    Condition("F3", "max", False, False, 10.0, "spatial"),
    Condition("F4", "max", True, True, 20.0, "combined"),
)


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.code, c.temp, c.quantized, c.decimated, c.dt, c.note) for c in CONDITIONS], "condition string, temp string, quantized boolean, decimated boolean, dt double, note string")


def sockets(wide: DataFrame, keys: list[str], us: str, temp: str = "mean") -> DataFrame:
    """Wide readings of both sockets as long rows (keys, socket, us, t, p)."""
    parts = ", ".join(f"{s}, p{s}_core_temp_{temp}, p{s}_power" for s in (0, 1))
    return wide.select(*keys, us, "segment_id", F.expr(f"stack(2, {parts}) as (socket, t, p)"))


def enumerated(wide: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Wide readings of both sockets as rows (keys, socket, condition, us, t, p), in the form that each condition reads."""
    forms = [sockets(wide, keys, us, temp).withColumn("temp", F.lit(temp)) for temp in ("mean", "max")]
    five = conditions(wide.sparkSession).select("condition", "temp")
    return forms[0].unionByName(forms[1]).join(F.broadcast(five), "temp").drop("temp")


def finite_runs(df: DataFrame, keys: list[str], us: str, temp: str, power: str, least: int = 2) -> DataFrame:
    """Rows (keys, run_id, idx, us, t, p, run_len) of the maximal stretches of finite pairs within a segment."""
    w = Window.partitionBy(*keys).orderBy(us)
    ok = finite(F.col(temp).cast("double")) & finite(F.col(power).cast("double"))
    broken = df.withColumn("_ok", ok).withColumn("_new", F.coalesce((F.col("segment_id") != F.lag("segment_id").over(w)) | ~F.lag("_ok").over(w), F.lit(True)))
    named = broken.withColumn("run_id", F.sum((F.col("_ok") & F.col("_new")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_ok")
    run = Window.partitionBy(*keys, "run_id")
    out = named.withColumn("idx", F.row_number().over(run.orderBy(us)).cast("long") - 1).withColumn("run_len", F.count("*").over(run))
    return out.where(F.col("run_len") >= least).select(*keys, "run_id", "idx", us, F.col(temp).cast("double").alias("t"), F.col(power).cast("double").alias("p"), "run_len")


def chunked_runs(segmented: DataFrame, keys: list[str], us: str, temp: str, power: str, chunk_s: int = 30 * 86_400, least: int = 2) -> DataFrame:
    """finite_runs() in chunks of time, so that a task sorts one key's chunk of readings, not its history. Readings with their
    runs are written to the shared folder once: what follows reads them twice."""
    ok = finite(F.col(temp).cast("double")) & finite(F.col(power).cast("double"))
    rows = segmented.select(*keys, "segment_id", us, F.col(temp).cast("double").alias("t"), F.col(power).cast("double").alias("p"), ok.alias("_ok"))
    chunk = time_chunk(us, chunk_s)
    before = carried(rows, keys, [us], chunk, lasts={"_before": F.struct("segment_id", "_ok")})
    begins = (F.col("_ok") & F.coalesce((F.col("segment_id") != F.col("_before.segment_id")) | ~F.col("_before._ok"), F.lit(True))).cast("long")
    scanned = carried(before, keys, [us], chunk, {"run_id": begins, "_place": F.col("_ok").cast("long")}).withColumn("run_id", F.col("run_id") + begins).where("_ok")
    named = written(scanned.select(*keys, "run_id", us, "t", "p", "_place"), "runs")
    starts = named.groupBy(*keys, "run_id").agg(F.count("*").alias("run_len"), F.min("_place").alias("_first")).where(F.col("run_len") >= least)
    return joined(named, starts, [*keys, "run_id"]).select(*keys, "run_id", (F.col("_place") - F.col("_first")).alias("idx"), us, "t", "p", "run_len")


def decimate(runs: DataFrame, keys: list[str], step: int = 2, least: int = 2) -> DataFrame:
    """Every step-th row of each run from its first; runs left with fewer than `least` go."""
    kept = runs.where(F.col("idx") % step == 0).withColumn("idx", F.floor(F.col("idx") / step)).withColumn("run_len", F.floor((F.col("run_len") + step - 1) / step))
    return kept.where(F.col("run_len") >= least)


def degrade(runs: DataFrame, keys: list[str], condition: Condition) -> DataFrame:
    """Decimate, then quantize; the block of a run is the month of its first row."""
    out = decimate(runs, keys) if condition.decimated else runs
    return out.withColumn("t", quantize(F.col("t"))) if condition.quantized else out


def with_blocks(runs: DataFrame, keys: list[str], us: str, form: str | None = None, seconds: int | None = None) -> DataFrame:
    """`block` of a run, by its first row: the month (or another date form), or a number of `seconds`-long periods."""
    first = F.min(us).over(Window.partitionBy(*keys, "run_id"))
    name = F.floor(first / (seconds * 1_000_000)).cast("long") if seconds else F.date_format(F.timestamp_micros(first), form or "yyyy-MM")
    return runs.withColumn("block", name)


def lead_pairs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with y, the next t of the same run."""
    return runs.withColumn("y", F.lead("t").over(Window.partitionBy(*keys, "run_id").orderBy("idx"))).where("y is not null")


def chunked_pairs(segmented: DataFrame, keys: list[str], us: str, temp: str, power: str, chunk_s: int = 30 * 86_400) -> DataFrame:
    """lead_pairs(finite_runs(segmented)) in chunks of time: a task sorts one key's chunk, not its history. A chunk passes on
    a row (whether it ended in a run, how many runs began), and each run a row for each chunk that it is in."""
    chunk = F.floor(F.col(us) / (chunk_s * 1_000_000)).alias("_chunk")
    ok = finite(F.col(temp).cast("double")) & finite(F.col(power).cast("double"))
    rows = segmented.select(*keys, chunk, "segment_id", us, F.col(temp).cast("double").alias("t"), F.col(power).cast("double").alias("p"), ok.alias("_ok"))
    own, order = Window.partitionBy(*keys, "_chunk").orderBy(us), Window.partitionBy(*keys).orderBy("_chunk")
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(F.struct("segment_id", "_ok"), us).alias("_end"))
    given = ends.select(*keys, "_chunk", F.lag("_end").over(order).alias("_given"))
    before = F.coalesce(F.lag(F.struct("segment_id", "_ok")).over(own), F.col("_given"))
    begun = rows.join(given, [*keys, "_chunk"]).withColumn("_before", before)
    begins = F.col("_ok") & F.coalesce((F.col("segment_id") != F.col("_before.segment_id")) | ~F.col("_before._ok"), F.lit(True))
    begun = begun.withColumn("_run", F.sum(begins.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = begun.groupBy(*keys, "_chunk").agg(F.max("_run").alias("_runs")).select(*keys, "_chunk", F.coalesce(F.sum("_runs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_earlier"))
    named = begun.where("_ok").join(earlier, [*keys, "_chunk"]).withColumn("run_id", F.col("_run") + F.col("_earlier"))
    part = [*keys, "_chunk", "run_id"]
    pieces = named.groupBy(*part).agg(F.count("*").alias("_n"), F.min_by("t", us).alias("_t"))
    run = Window.partitionBy(*keys, "run_id").orderBy("_chunk")
    lengths = F.sum("_n").over(Window.partitionBy(*keys, "run_id"))
    pieces = pieces.select(*part, lengths.alias("run_len"), F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_skip"), F.lead("_t").over(run).alias("_next"))
    inside = Window.partitionBy(*part).orderBy(us)
    out = named.join(pieces, part).withColumn("idx", F.col("_skip") + F.row_number().over(inside) - 1).withColumn("y", F.coalesce(F.lead("t").over(inside), F.col("_next")))
    return out.where("y is not null").select(*keys, "run_id", "idx", us, "t", "p", "run_len", "y")


def prefix_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums of the nine cross products along each run, beginning with a row of zeros at idx 0."""
    w = Window.partitionBy(*keys, "run_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    t, p, y, one = F.col("t"), F.col("p"), F.col("y"), F.lit(1.0)
    names = ("tt", "tp", "t1", "pp", "p1", "n", "ty", "py", "y1")
    products = (t * t, t * p, t, p * p, p, one, t * y, p * y, y)
    sums = pairs.select(*keys, "run_id", (F.col("idx") + 1).alias("idx"), *[F.sum(x).over(w).alias(n) for n, x in zip(names, products, strict=True)])
    zeros = pairs.where("idx = 0").select(*keys, "run_id", F.col("idx"), *[F.lit(0.0).alias(n) for n in names])
    return sums.unionByName(zeros)
