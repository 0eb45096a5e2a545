"""Decision gates, claims, validation and artifact checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import ship
from ..sources.telemetry import OPENED, opened

#: Phrases that a finished document must not hold.
BANNED = {
    "draft": r"DRAFT PENDING",
    "todo": r"\bTODO\b|\bFIXME\b",
    "comment": r"<!--",
    "webview": r"vscode-webview",
    "process": r"Phase 3[ABCD]\b|STEP\s+\d",
}
#: The gates.
GATES = ("A_OBSERVABILITY_IMPROVEMENT", "A_TAU_IDENTIFIABILITY__B_RESIDUAL_NULL (split)", "B_UNIVERSAL_NULL", "C_INCONCLUSIVE")


def decision_gate(medians: DataFrame, increment: str = "increment_r2", residual: str = "residual_r2", cov: str = "tau_cov") -> DataFrame:
    """One row of medians to a gate: a time constant known to 5 %, a residual that can be learned (0.05 or 0.02)."""
    known = F.coalesce(F.col(cov) < 0.05, F.lit(False))
    learnable = F.coalesce(F.col(increment) > 0.05, F.lit(False)) | F.coalesce(F.col(residual) > 0.02, F.lit(False))
    gate = F.when(known & learnable, GATES[0]).when(known, GATES[1]).when(~learnable, GATES[2]).otherwise(GATES[3])
    return medians.withColumn("gate", gate)


def claims(results: DataFrame, columns: list[str], phase: str) -> DataFrame:
    """A one-row result as rows (metric, value, phase)."""
    return results.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value").withColumn("phase", F.lit(phase))


CLAIM = "pattern string, phase string, figure string, table string, claim string, classification string"


def claim_manifest(measured: DataFrame, spec: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """measured (metric, value) with what a report says of it: its phase, figure, table, claim and classification, by the
    first matching pattern (a regular expression) of spec, and the hash of its phase's source (phase, digest), if given."""
    order = spec.withColumn("_n", F.length("pattern"))
    told = measured.join(F.broadcast(order), F.expr("metric rlike concat('^(?:', pattern, ')$')"), "left")  # spec is a short list
    best = told.groupBy("metric").agg(F.max_by(F.struct("value", "phase", "figure", "table", "claim", "classification"), "_n").alias("x")).select("metric", "x.*")
    if sources is None:
        return best.withColumn("source_hash", F.lit(None).cast("string"))
    return best.join(F.broadcast(sources.select("phase", F.substring("digest", 1, 12).alias("source_hash"))), "phase", "left").select(*best.columns, "source_hash")


# -- the study's locked numbers

#: What the study's numbers must be, by condition and for the population, and how far they may be off.
LOCKED = {
    "tau_point": {"F0": 394, "F1": 116, "F2": 910, "F3": 283, "F4": 352},
    "tau_boot": {"F0": 394, "F1": 116, "F2": 909, "F3": 283, "F4": 352},
    "tau_ratio": {"F0": 1.00, "F1": 0.29, "F2": 2.31, "F3": 0.72, "F4": 0.89},
    "fleet": {"n_valid": 116, "median": 439, "mean": 552, "std": 365, "p05": 275, "p95": 1200, "min": 205, "max": 2596},
    "socket_corr": 0.789, "socket_rel_diff": 0.242, "residual_trees_max": 0.066, "rel_spread": 0.62, "power_confound": 0.0, "runtime_ms": 0.041,
}
NEAR, MOST, LEAST, BELOW = "near", "at_most", "at_least", "below"


def study_spec() -> list[tuple[str, str, str, float | None, str | None, float, float]]:
    """44 checks (name, metric, kind, want, other metric to compare with, its factor, tolerance). A check of several parts
    has a row for each part and holds if all do, or any where its name's parts are marked so."""
    out: list[tuple] = []
    for k in ("F0", "F1", "F2", "F3", "F4"):
        for m in ("tau_point", "tau_boot"):
            want = float(LOCKED[m][k])
            out.append((f"{m}_{k}", f"{m}_{k}", NEAR, want, None, 1.0, max(2.0, 0.01 * want)))
        out.append((f"tau_ratio_{k}", f"tau_ratio_{k}", NEAR, LOCKED["tau_ratio"][k], None, 1.0, 0.02))
        out.append((f"boot_ci_ge_analytic_{k}", f"boot_ci_width_{k}", LEAST, None, f"analytic_ci_width_{k}", 0.9, 0.0))
        out.append((f"boot_valid_{k}", f"invalid_pct_{k}", MOST, 1.0, None, 1.0, 0.0))
    out += [("F1_precise_but_biased", "boot_cov_F1", BELOW, None, "boot_cov_F0", 1.0, 0.0), ("F1_precise_but_biased", "tau_ratio_F1", BELOW, 0.5, None, 1.0, 0.0)]
    out.append(("residual_trees_max", "residual_trees_max", NEAR, LOCKED["residual_trees_max"], None, 1.0, 0.01))
    out += [("residual_not_improved_by_fidelity|any", "residual_trees_F0", BELOW, None, f"residual_trees_{k}", 1.0, 0.0) for k in ("F1", "F4")]
    out += [("residual_nulls_negative", f"null_p95_{k}", BELOW, 0.0, None, 1.0, 0.0) for k in ("F0", "F1", "F2", "F3", "F4")]
    for m, want in LOCKED["fleet"].items():
        out.append((f"fleet_{m}", f"fleet_{m}", NEAR, float(want), None, 1.0, 1.0 if m == "n_valid" else max(2.0, 0.02 * want)))
    out += [("fleet_socket_corr", "socket_corr", NEAR, LOCKED["socket_corr"], None, 1.0, 0.02), ("fleet_socket_rel_diff", "socket_rel_diff", NEAR, LOCKED["socket_rel_diff"], None, 1.0, 0.02)]
    out.append(("quantized_below_fleet_min", "tau_point_F1", BELOW, None, "fleet_min", 1.0, 0.0))
    out.append(("stream_near_baseline", "stream_oos_difference", BELOW, 0.03, None, 1.0, 0.0))
    out += [(f"stream_{m}", f"stream_{m}", NEAR, LOCKED[m], None, 1.0, t) for m, t in (("rel_spread", 0.05), ("power_confound", 0.05), ("runtime_ms", 0.03))]
    return out


SPEC = "check string, metric string, kind string, want double, other string, factor double, tolerance double"


def study_checks(measured: DataFrame, spec: list[tuple] | None = None) -> DataFrame:
    """The study's checks over measured (metric, value): check, ok and how many parts. What wasn't measured fails."""
    rows = measured.sparkSession.createDataFrame(spec or study_spec(), SPEC)
    values = measured.select("metric", F.col("value").cast("double").alias("value"))
    both = rows.join(values, "metric", "left").join(values.select(F.col("metric").alias("other"), F.col("value").alias("beside")), "other", "left")
    v, b = F.col("value"), F.coalesce(F.col("want"), F.col("factor") * F.col("beside"))
    ok = F.when(F.col("kind") == NEAR, F.abs(v - b) <= F.col("tolerance") + 1e-12).when(F.col("kind") == MOST, v <= b).when(F.col("kind") == LEAST, v >= b).otherwise(v < b)
    part = both.select(F.split("check", r"\|").alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"))
    grouped = part.groupBy(F.get("name", F.lit(0)).alias("check")).agg(F.count("*").alias("parts"), F.bool_and("ok").alias("all"), F.bool_or("ok").alias("any"), F.max(F.size("name") > 1).alias("one"))
    return grouped.select("check", F.when(F.col("one"), F.col("any")).otherwise(F.col("all")).alias("ok"), "parts")


def validate(got: DataFrame, expected: DataFrame) -> DataFrame:
    """got (metric, value) against expected (metric, want, tolerance, relative): the larger tolerance holds; absent values fail."""
    allowed = F.greatest(F.col("tolerance"), F.col("relative") * F.abs("want"))
    ok = F.coalesce(F.abs(F.col("value") - F.col("want")) <= allowed, F.lit(False))
    return expected.join(got, "metric", "left").select("metric", "value", "want", ok.alias("ok"))


def tally(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("n_checks"), F.count_if(~F.col("ok")).alias("n_fail"))


def drift(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sources whose digest differs from the recorded one, or is gone. Both: (source, digest)."""
    joined = recorded.withColumnRenamed("digest", "was").join(now, "source", "left")
    return joined.where(~F.col("was").eqNullSafe(F.col("digest"))).select("source", "was", "digest")


def banned_counts(texts: DataFrame, text: str = "text", patterns: dict[str, str] = BANNED) -> DataFrame:
    return texts.withColumns({f"banned_{k}": F.regexp_count(F.col(text), F.lit(p)) for k, p in patterns.items()})


def artifacts(spark: SparkSession, folder: str, needed: list[str], documents: list[str] = ()) -> DataFrame:
    """(artifact, problem) of each file that is missing below folder, and of each banned phrase that a document holds."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("artifact")).distinct()
    want = spark.createDataFrame([(n,) for n in needed], "artifact string")
    out = want.join(there, "artifact", "left_anti").withColumn("problem", F.lit("missing"))
    if documents:
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("artifact"), F.col("content").cast("string").alias("text")).where(F.col("artifact").isin(*documents))
        hits = banned_counts(texts).unpivot(["artifact"], [f"banned_{k}" for k in BANNED], "phrase", "hits").where("hits > 0")
        out = out.unionByName(hits.select("artifact", F.concat(F.col("hits").cast("string"), F.lit(" x "), F.regexp_replace("phrase", "^banned_", "")).alias("problem")))
    return out


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Plot data: counts of equal bins over [low, high], the last one closed."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("left_edge", F.col("bin") * width + low)


def series(df: DataFrame, x: str, ys: list[str], by: str | None = None) -> DataFrame:
    """Plot data of lines: (series, x, y)."""
    keys = [x, *([by] if by else [])]
    out = df.select(*keys, *[F.col(y).cast("double").alias(y) for y in ys]).unpivot(keys, ys, "series", "y")
    return out.select(F.concat_ws(" ", "series", F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("series"), F.col(x).cast("double").alias("x"), "y")


def boxes(df: DataFrame, column: str, by: str) -> DataFrame:
    """Plot data of box plots: quartiles, the whiskers within 1.5 interquartile ranges, and how many lie beyond."""
    q = df.groupBy(by).agg(F.count(column).alias("n"), *[F.percentile(column, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).withColumn("_in", F.col(column).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(by, "n", "q1", "median", "q3").agg(F.min(F.when(F.col("_in"), F.col(column))).alias("low"), F.max(F.when(F.col("_in"), F.col(column))).alias("high"), F.count_if(~F.col("_in")).alias("outliers"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Plot data of points, of rows with both."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(color) if color else F.lit(None)).cast("string").alias("color"))


#: Bytes of a file that a task holds while it hashes.
BLOCK = 8 << 20


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        found = []
        for path in pdf["path"]:
            mixed = hashlib.sha256()
            with opened(path) as f:
                while block := f.read(BLOCK):
                    mixed.update(block)
            found.append(mixed.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "digest": pd.Series(found, dtype=object), "bytes": pdf["length"]})


def digests(spark: SparkSession, path: str, length: int = 64) -> DataFrame:
    """SHA-256 of each file below path, or its first hex digits. Files of any size are hashed in blocks; on a store that is
    not in telemetry.OPENED, as one value below 2 GB. Spark's source lists no file of zero bytes, so such a file has no row
    (and drift() reports it as gone)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() in OPENED:
        ship(spark)
        found = files.select("path", "length").mapInPandas(_hashed, "path string, digest string, bytes long")
    else:
        found = files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", F.substring("digest", 1, length).alias("digest"), "bytes")


def markdown(df: DataFrame, formats: dict[str, str] | None = None) -> str:
    """A small result as a Markdown table."""
    shown = df.select(*[F.format_string(formats[c], F.col(c)).alias(c) if formats and c in formats else F.col(c).cast("string").alias(c) for c in df.columns])
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else v for v in r) + " |" for r in shown.collect())]) + "\n"


def titled(title: str, df: DataFrame, formats: dict[str, str] | None = None, heads: dict[str, str] | None = None, note: str = "") -> str:
    """markdown() under a title, with other column heads and a note."""
    named = df.select(*[F.col(c).alias((heads or {}).get(c, c)) for c in df.columns])
    table = markdown(named, {(heads or {}).get(c, c): f for c, f in (formats or {}).items()})
    return f"# {title}\n\n{table}" + (f"\n{note}\n" if note else "")


def study_tables(conditions: DataFrame, fidelity: DataFrame, residual: DataFrame, population: DataFrame, extended: DataFrame) -> dict[str, str]:
    """The five tables of a study as Markdown, from its small results."""
    two, four, one, three, zero = "%.2f", "%.4f", "%.1f", "%.3f", "%.0f"
    strongest = residual.agg(F.max("trees")).first()[0]
    note = f"Note: the strongest model reaches {strongest:.3f} out of sample." if strongest is not None else ""
    return {
        "table01_conditions.md": titled("Table 1. Measurement-quality conditions", conditions),
        "table02_tau_identification.md": titled("Table 2. Effective-tau identification", fidelity, {"tau_point": zero, "tau_boot": zero, "analytic_cov": four, "analytic_ci_width": one, "boot_cov": four, "boot_ci_width": one, "tau_ratio": two, "invalid_pct": one}),
        "table03_residual_prediction.md": titled("Table 3. Out-of-sample residual prediction (R^2)", residual, {c: three for c in residual.columns if c != "condition"}, note=note),
        "table04_fleet_streaming.md": titled("Table 4. Population and streaming summary", population, {"value": three}),
        "table05_extended_ablation.md": titled("Table 5. Extended ablation", extended, {c: three for c, t in extended.dtypes if t == "double"}),
    }


class Blocked(Exception):
    """A job whose source is missing; its status says where the source belongs."""


def guarded(spark: SparkSession, source: str, job, instructions: str = "") -> DataFrame:
    """job(), or one row (status, reason, expected) where the source can't be found: a blocked job ends without an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        try:
            return job()
        except Blocked as e:
            instructions = str(e)
    return spark.createDataFrame([("BLOCKED", instructions or "the source is missing", source)], "status string, reason string, expected string")
