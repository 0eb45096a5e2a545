"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import arx, clean, evaluate, monitor, population, profile, report, resample, runs
from ..sources import shared, telemetry
from ..streaming import rolling
from .fixture import BASE, DT, EV, GAP_S, FITS, MOMENTS, PAIRS, RESID, RUNS, SUMS, corr, events, hourly, rounded, seg, segmented, solve, tau, unit_fits, unit_pairs, unit_runs, with_faults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
U = ["unit"]


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# -- bins, profiles, audits

HOURLY = "h AS (SELECT event_type, CAST(floor(us / 3600000000) AS BIGINT) * 3600000000 AS us, sum(t) / count(*) AS t, max(t) AS t_max, sum(p) / count(*) AS p, count(*) AS n_merged FROM ev GROUP BY 1, 2)"


@register("bin_dedupe", f"WITH {EV}, {HOURLY} SELECT event_type, us, round(t, 6) AS t, t_max, round(p, 6) AS p, n_merged FROM h")
def bin_dedupe(spark, d):
    return rounded(hourly(events(spark, d), "event_type"))


@register("quality_mask", f"WITH {EV}, {HOURLY}, {seg('h', 'event_type', 7200)} SELECT event_type, us, n_merged, segment_id, coalesce(dt_s, -1) AS dt_s, n_merged > 1 AS was_merged FROM s")
def quality_mask(spark, d):
    return clean.quality_mask(segmented(hourly(events(spark, d), "event_type"), "event_type", 7200), ["event_type"], "us").withColumn("dt_s", F.coalesce("dt_s", F.lit(-1).cast("long")))


@register("null_counts", "WITH e AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN user_id % 7 = 0 THEN NULL ELSE props END AS props, event_id FROM events), c AS (SELECT count(*) AS n, count(*) - count(value) AS a, count(*) - count(props) AS b, count(*) - count(event_id) AS c FROM e) SELECT col AS \"column\", nulls, n AS rows, round(100.0::DOUBLE * nulls / greatest(n, 1), 3) AS null_pct FROM (SELECT 'value' AS col, a AS nulls, n FROM c UNION ALL SELECT 'props', b, n FROM c UNION ALL SELECT 'event_id', c, n FROM c)")
def null_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    faulty = e.select(F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("user_id") % 7 != 0, F.col("props")).alias("props"), "event_id")
    return profile.null_counts(faulty, ["value", "props", "event_id"])


@register("range_violations", f"WITH {EV} SELECT unit, count(*) AS rows, count(*) FILTER (t < 500 OR t > 12500) AS temp_out_of_range, count(*) FILTER (p - 10 < 0) AS power_negative, min(t) AS temp_min, max(t) AS temp_max FROM ev GROUP BY unit")
def range_violations(spark, d):
    return profile.range_violations(events(spark, d).withColumn("p", F.col("p") - 10), U, "t", "p", 500.0, 12500.0)


@register("duplicate_identity", "WITH e AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS us, user_id % 5 AS v FROM events), a AS (SELECT event_type, count(*) AS rows, count(DISTINCT us) AS distinct_ts FROM e GROUP BY 1), b AS (SELECT event_type, count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM e) GROUP BY 1) SELECT event_type, rows, distinct_ts, distinct_rows, rows - distinct_ts AS duplicate_ts, rows - distinct_rows AS exact_duplicate_rows, distinct_rows - distinct_ts AS conflicting_rows FROM a JOIN b USING (event_type)")
def duplicate_identity(spark, d):
    e = events(spark, d).select("event_type", F.floor(F.col("us") / 3_600_000_000).cast("long").alias("us"), (F.col("unit") % 5).alias("v"))
    return profile.duplicate_identity(e, ["event_type"], "us")


DIFF = f"WITH {EV}, {HOURLY}, x AS (SELECT event_type, (us - lag(us) OVER (PARTITION BY event_type ORDER BY us)) / 1000000.0::DOUBLE AS dt FROM h), d AS (SELECT * FROM x WHERE dt > 0), md AS (SELECT event_type, dt AS dominant FROM (SELECT event_type, dt, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, dt) AS k FROM d GROUP BY 1, 2) WHERE k = 1)"


@register("interval_mode", f"{DIFF} SELECT event_type, dominant AS dt_dominant FROM md")
def interval_mode(spark, d):
    return profile.interval_mode(hourly(events(spark, d), "event_type"), ["event_type"], "us")


@register("interval_histogram_topk", f"{DIFF} SELECT event_type, dt, n, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, dt, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, dt) AS rank FROM d GROUP BY 1, 2) WHERE rank <= 5")
def interval_histogram(spark, d):
    return profile.interval_histogram(hourly(events(spark, d), "event_type"), ["event_type"], "us")


@register("sampling_summary", f"{DIFF} SELECT event_type, min(dt) AS dt_min, max(dt) AS dt_max, quantile_cont(dt, 0.5) AS dt_median, min(dominant) AS dt_dominant, round(100.0::DOUBLE * count(*) FILTER (dt <> dominant) / count(*), 3) AS pct_deviating, count(*) FILTER (dt > 3 * dominant) AS gaps, count(*) FILTER (dt <> dominant AND dt <= 3 * dominant) AS irregular FROM d JOIN md USING (event_type) GROUP BY event_type")
def sampling_summary(spark, d):
    return profile.sampling_summary(hourly(events(spark, d), "event_type"), ["event_type"], "us")


@register("quick_audit", f"WITH {EV}, x AS (SELECT unit, (us - lag(us) OVER (PARTITION BY unit ORDER BY us)) / 1000000.0::DOUBLE AS dt FROM ev), d AS (SELECT * FROM x WHERE dt > 0), q AS (SELECT unit, quantile_cont(dt, 0.5) AS dt_median, quantile_cont(dt, 0.05) AS dt_p05, quantile_cont(dt, 0.95) AS dt_p95 FROM d GROUP BY 1), g AS (SELECT unit, count(*) FILTER (dt > 3 * dt_median) AS gaps FROM d JOIN q USING (unit) GROUP BY 1), sp AS (SELECT unit, count(*) AS rows, (max(us) - min(us)) / 3600000000.0::DOUBLE AS span_hours FROM ev GROUP BY 1) SELECT unit, rows, {rd('span_hours', 'dt_median', 'dt_p05', 'dt_p95', digits=3)}, gaps FROM sp JOIN q USING (unit) JOIN g USING (unit)")
def quick_audit(spark, d):
    return rounded(profile.quick_audit(events(spark, d), U, "us"), digits=3)


@register("pair_quality", f"WITH {EV}, e AS (SELECT unit, CASE WHEN event_type <> 'error' THEN t END AS t, p FROM ev), q AS (SELECT unit, count(t) AS valid_pairs, (count(*) - count(t)) / count(*)::DOUBLE AS missing_fraction, min(t) AS temp_min, max(t) AS temp_max, min(CASE WHEN t IS NOT NULL THEN p END) AS power_min, max(CASE WHEN t IS NOT NULL THEN p END) AS power_max, {corr('p', 't', 't IS NOT NULL')} AS corr FROM e GROUP BY unit) SELECT unit, valid_pairs, {rd('missing_fraction', 'corr')}, temp_min, temp_max, power_min, power_max, coalesce(temp_min > 1000 AND temp_max < 1000000 AND power_min >= 0 AND corr > 0, false) AS passes FROM q")
def pair_quality(spark, d):
    return rounded(profile.sanity(profile.pair_quality(with_faults(events(spark, d)), U, "t", "p"), 1000.0, 1_000_000.0))


@register("clean_nodes", f"WITH {EV}, q AS (SELECT unit, min(t) AS a, max(t) AS b, min(p) AS c, {corr('p', 't')} AS r FROM ev GROUP BY unit) SELECT count(*) FILTER (a > 1000 AND b < 1000000 AND c >= 0 AND r > 0) AS clean, count(*) AS nodes, count(*) FILTER (a > 1000 AND b < 1000000 AND c >= 0 AND r > 0) >= 5 AS enough FROM q")
def clean_nodes(spark, d):
    return profile.clean_nodes(profile.sanity(profile.pair_quality(events(spark, d), U, "t", "p"), 1000.0, 1_000_000.0), 5)


@register("fleet_inventory", f"WITH {EV}, h AS (SELECT unit, count(*) AS rows, min(us) AS lo, max(us) AS hi, count(*) - count(DISTINCT us) AS dup, count(*) FILTER (t < 100 OR t > 12500) AS bad FROM ev GROUP BY 1) SELECT count(*) AS hosts, CAST(sum(rows) AS BIGINT) AS rows, min(lo) AS first_us, max(hi) AS last_us, count(*) FILTER (dup > 0) AS hosts_with_duplicates, count(*) FILTER (bad > 0) AS hosts_out_of_range, coalesce(string_agg(CASE WHEN bad > 0 THEN CAST(unit AS VARCHAR) END, ',' ORDER BY CAST(unit AS VARCHAR)), '') AS hosts_listed FROM h")
def fleet_inventory(spark, d):
    return profile.fleet_inventory(events(spark, d), "unit", "us", "t", 100.0, 12500.0)


TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")
NAMED = ("timestamp", "hostname", "p0_core_temp_mean", "p0_power", "ps0_input_power", "n_merged", "gpu3_mem_temp")
ROLE = "CASE WHEN lower(c) = 'timestamp' THEN 'timestamp' WHEN lower(c) = 'hostname' THEN 'host_id' WHEN contains(lower(c), 'temp') THEN 'temperature' WHEN contains(lower(c), 'power') THEN 'power' ELSE 'other' END"
COLUMN_NAMES = " UNION ALL ".join([*(f"SELECT '{t}' AS host, column_name AS c FROM (DESCRIBE {t})" for t in TABLES), *(f"SELECT 'telemetry', '{c}'" for c in NAMED)])


def _column_names(spark, d):
    """(host, columns): the columns of each table, from its footer, and the sensors' names."""
    found = telemetry.footers(spark, d).select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("host"), "columns").where(F.col("host").isin(*TABLES)).distinct()
    return found.unionByName(spark.createDataFrame([("telemetry", list(NAMED))], "host string, columns array<string>"))


@register("column_roles", f"SELECT DISTINCT c AS \"column\", {ROLE} AS role FROM ({COLUMN_NAMES})")
def column_roles(spark, d):
    names = _column_names(spark, d).select(F.explode("columns").alias("column")).distinct()
    return names.withColumn("role", scalar.column_role(F.col("column")))


@register("column_coverage", f"SELECT c AS \"column\", count(DISTINCT host) AS hosts, {ROLE} AS role FROM ({COLUMN_NAMES}) GROUP BY 1, 3")
def column_coverage(spark, d):
    return profile.column_coverage(_column_names(spark, d))


@register("schema_signatures")
def schema_signatures(spark, d):
    return profile.schema_signatures(telemetry.footers(spark, d))


#: Tables with nulls and the columns that have a range.
RANGED = {"events": ("event_id", "user_id", "value", "ts"), "sales": ("sale_id", "client_id", "total", "priority", "sold_at", "arrived_at"), "clicks": ("click_id", "client_id", "value", "ts", "arrived_at")}
UNRANGED = {"events": ("event_type", "props"), "sales": ("status",), "clicks": ("kind", "props")}


def _range_sql(t: str, c: str, ranged: bool) -> str:
    v = f"epoch_us({c})" if c in ("ts", "sold_at", "arrived_at") else c
    ends = f"CAST(min({v}) AS DOUBLE) AS least, CAST(max({v}) AS DOUBLE) AS greatest" if ranged else "CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS greatest"
    return f"SELECT '{t}' AS host, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, {ends} FROM {t}"


@register("footer_profile", " UNION ALL ".join(_range_sql(t, c, ranged) for group, ranged in ((RANGED, True), (UNRANGED, False)) for t, cs in group.items() for c in cs))
def footer_profile(spark, d):
    """Rows, nulls and ranges of whole tables from their footers, as a scan gives them."""
    tables = telemetry.column_ranges(spark, d).withColumn("host", F.regexp_extract("path", r"([^/]+)\.parquet", 1)).where(F.col("host").isin(*RANGED))
    return profile.footer_profile(tables, ["host"]).select("host", "column", "rows", "nulls", "least", "greatest")


SEGH = f"WITH {EV}, {HOURLY}, {seg('h', 'event_type', 7200)}"
TEMPORAL = """ln AS (SELECT event_type, max(len) AS longest FROM (SELECT event_type, segment_id, count(*) AS len FROM s GROUP BY 1, 2) GROUP BY 1),
dm AS (SELECT event_type, dt_s AS dominant_dt_s FROM (SELECT event_type, dt_s, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, dt_s) AS k FROM s WHERE dt_s <= 7200 GROUP BY 1, 2) WHERE k = 1),
ta AS (SELECT event_type, count(*) AS rows, quantile_cont(CASE WHEN dt_s <= 7200 THEN dt_s END, 0.5)::DOUBLE AS median_dt_s, round(100.0::DOUBLE * count(*) FILTER (dt_s = 3600) / greatest(count(*) FILTER (dt_s <= 7200), 1), 3) AS pct_on_grid, count(*) - count(DISTINCT us) AS remaining_duplicate_ts, max(segment_id) + 1 AS segments, count(*) FILTER (dt_s > 3600 AND dt_s <= 7200) AS short_gaps, count(*) FILTER (dt_s > 7200) AS large_gaps, coalesce(max(dt_s), 0) AS max_gap_s, coalesce(min(dt_s) > 0, true) AS monotonic, round(count(*)::DOUBLE * 3600.0::DOUBLE / 3600.0::DOUBLE, 1) AS node_hours FROM s GROUP BY 1)"""


@register("temporal_audit", f"{SEGH}, {TEMPORAL} SELECT ta.*, dominant_dt_s, round(longest::DOUBLE * 3600.0::DOUBLE / 3600.0::DOUBLE, 1) AS longest_segment_hours FROM ta JOIN ln USING (event_type) LEFT JOIN dm USING (event_type)")
def temporal_audit(spark, d):
    return clean.temporal_audit(segmented(hourly(events(spark, d), "event_type"), "event_type", 7200), ["event_type"], "us", 3600, 7200)


PHYSICAL = f"""st AS (SELECT *, t_max - lag(t_max) OVER (PARTITION BY event_type, segment_id ORDER BY us) AS step FROM s),
pa AS (SELECT event_type, min(t_max) AS temp_min, max(t_max) AS temp_max, count(*) FILTER (t_max < 0 OR t_max > 30000) AS temp_out_of_range, min(n_merged - 2) AS power_min, count(*) FILTER (n_merged - 2 < 0) AS power_negative, sqrt(greatest((count(step) * sum(step * step) - sum(step) * sum(step)) / (count(step)::DOUBLE * count(step)), 0)) AS step_std, max(abs(step)) AS step_max, count(*) FILTER (abs(step) > 5) AS step_flagged, CASE WHEN count(t_max) > 100 THEN {corr('CAST(n_merged - 2 AS DOUBLE)', 't_max')} END AS corr_power_temp FROM st GROUP BY 1)"""


def _physical(spark, d):
    s = segmented(hourly(events(spark, d), "event_type"), "event_type", 7200).withColumn("w", F.col("n_merged").cast("double") - 2)
    return s, clean.physical_audit(s, ["event_type"], "us", "t_max", "w", 0.0, 30000.0)


@register("physical_audit", f"{SEGH}, {PHYSICAL} SELECT event_type, temp_min, temp_max, temp_out_of_range, power_min::DOUBLE AS power_min, power_negative, {rd('step_std')}, step_max, step_flagged, {rd('corr_power_temp')} FROM pa")
def physical_audit(spark, d):
    return rounded(_physical(spark, d)[1])


@register("chunked_physical_audit", ORACLE_SQL["physical_audit"])
def chunked_physical_audit(spark, d):
    """The same in chunks of four days."""
    rows = clean.chunked_segments(hourly(events(spark, d), "event_type"), ["event_type"], "us", 7200, 4 * 86_400).withColumn("w", F.col("n_merged").cast("double") - 2)
    return rounded(clean.physical_audit(rows, ["event_type"], "us", "t_max", "w", 0.0, 30000.0, chunk_s=4 * 86_400))


@register("fail_loud_gates", f"{SEGH}, {TEMPORAL}, {PHYSICAL} SELECT ta.event_type, concat_ws('; ', CASE WHEN remaining_duplicate_ts <> 0 THEN 'duplicate timestamps remain' END, CASE WHEN NOT monotonic THEN 'timestamps not strictly increasing' END, CASE WHEN dominant_dt_s <> 3600 THEN 'dominant step is off the grid' END, CASE WHEN temp_out_of_range > 0 THEN 'temperature out of range' END, CASE WHEN power_negative > 0 THEN 'negative power' END) AS failures FROM ta LEFT JOIN dm USING (event_type) JOIN pa USING (event_type)")
def fail_loud_gates(spark, d):
    s, physical = _physical(spark, d)
    temporal = clean.temporal_audit(s, ["event_type"], "us", 3600, 7200)
    return clean.gates(temporal, physical, ["event_type"], 3600).withColumn("failures", F.array_join("failures", "; "))


@register("null_run_lengths", f"WITH {EV}, e AS (SELECT unit, us, event_type = 'error' AS m FROM ev), i AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM e), r AS (SELECT unit, g, count(*) AS len FROM i WHERE m GROUP BY 1, 2), a AS (SELECT unit, count(*) AS rows, count(*) FILTER (m) AS nulls FROM e GROUP BY 1), b AS (SELECT unit, count(*) AS runs, max(len) AS max_run, count(*) FILTER (len = 1) AS isolated, count(*) FILTER (len > 2) AS clustered_gt2 FROM r GROUP BY 1) SELECT unit, rows, nulls, coalesce(runs, 0) AS runs, coalesce(max_run, 0) AS max_run, coalesce(isolated, 0) AS isolated, coalesce(clustered_gt2, 0) AS clustered_gt2, round(100.0::DOUBLE * nulls / greatest(rows, 1), 3) AS null_pct FROM a LEFT JOIN b USING (unit)")
def null_run_lengths(spark, d):
    return clean.null_runs(with_faults(events(spark, d)), U, "us", "t")


@register("chunked_null_runs", ORACLE_SQL["null_run_lengths"])
def chunked_null_runs(spark, d):
    """The same in chunks of three days."""
    return clean.null_runs(with_faults(events(spark, d)), U, "us", "t", 3 * 86_400)


POLICY = f"WITH {EV}, pb AS (SELECT event_type, CAST(floor(us / 3600000000) AS BIGINT) AS hour, count(*) AS n, max(t) - min(t) AS spread, sum(t) / count(*) AS mean, arg_min(t, event_id) AS first FROM ev GROUP BY 1, 2)"


def _policy(spark, d):
    return clean.policy_bins(events(spark, d), ["event_type"], "us", "t", ["event_id"], 3600)


@register("policy_spread", f"{POLICY} SELECT event_type, CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS removed, round(100.0::DOUBLE * (sum(n) - count(*)) / sum(n), 3) AS pct_removed, count(*) FILTER (n > 1) AS merged_bins, max(n) AS max_multiplicity, round(count(*)::DOUBLE * 3600.0::DOUBLE / 3600.0::DOUBLE, 1) AS node_hours, round(coalesce(avg(spread) FILTER (n > 1), 0), 6) AS mean_spread, coalesce(max(spread) FILTER (n > 1), 0) AS max_spread, round(coalesce(sqrt(avg((mean - first) * (mean - first)) FILTER (n > 1)), 0), 6) AS first_vs_mean_rms FROM pb GROUP BY 1")
def policy_spread(spark, d):
    return rounded(clean.policy_report(_policy(spark, d), ["event_type"], 3600))


@register("policy_totals", f"{POLICY} SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS removed, round(100.0::DOUBLE * (sum(n) - count(*)) / sum(n), 3) AS pct_removed, quantile_cont(CASE WHEN n > 1 THEN spread END, 0.5) AS spread_median, round(quantile_cont(CASE WHEN n > 1 THEN spread END, 0.99), 6) AS spread_p99 FROM pb")
def policy_totals(spark, d):
    return rounded(clean.policy_totals(_policy(spark, d)))


@register("gap_segments", f"{BASE} SELECT unit, segment_id, count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2")
def gap_segments(spark, d):
    return segmented(events(spark, d)).groupBy("unit", "segment_id").agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@register("chunked_segments", f"{BASE} SELECT unit, segment_id, count(*) AS rows, min(us) AS first_us, max(us) AS last_us, coalesce(sum(dt_s), 0)::BIGINT AS steps FROM s GROUP BY 1, 2")
def chunked_segments(spark, d):
    rows = clean.chunked_segments(events(spark, d), U, "us", 43_200, 3 * 86_400)
    return rows.groupBy("unit", "segment_id").agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.coalesce(F.sum("dt_s"), F.lit(0).cast("long")).alias("steps"))


@register("assumed_coolant", "SELECT event_id, CAST(round(value * 100) AS DOUBLE) AS t, 21.0::DOUBLE AS \"coolant_C_assumed\" FROM events")
def assumed_coolant(spark, d):
    return clean.with_coolant(events(spark, d).select("event_id", "t"))


@register("median_gap_segments", f"WITH {EV}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY unit ORDER BY us)) / 1000000.0::DOUBLE AS dt FROM ev), m AS (SELECT unit, quantile_cont(dt, 0.5) AS med FROM g WHERE dt IS NOT NULL GROUP BY 1), s AS (SELECT g.unit, us, t, p, CAST(sum(CASE WHEN dt > 3 * med THEN 1 ELSE 0 END) OVER (PARTITION BY g.unit ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM g JOIN m USING (unit)) SELECT unit, seg, us, t, p FROM (SELECT *, count(*) OVER (PARTITION BY unit, seg) AS n FROM s) WHERE n >= 10")
def median_gap_segments(spark, d):
    """Readings of (t, p) in segments of ten rows where the study asks for 100, as units here have fewer."""
    return clean.median_gap_segments(events(spark, d), U, "us", least=10).select("unit", "seg", "us", "t", "p")


FAULTY = f"WITH {EV.replace('ev AS (SELECT', 'ev0 AS (SELECT', 1)}, ev AS (SELECT unit, us, CASE WHEN event_type <> 'error' THEN t END AS t, p FROM ev0), {seg()}, " + RUNS[len(BASE) + 2 :]


def _faulty_runs(spark, d):
    return runs.finite_runs(segmented(with_faults(events(spark, d))), U, "us", "t", "p")


@register("finite_runs", f"{FAULTY} SELECT unit, run_id, idx, us, t, p, run_len FROM runs")
def finite_runs(spark, d):
    return _faulty_runs(spark, d)


@register("chunked_runs", ORACLE_SQL["finite_runs"])
def chunked_runs(spark, d):
    """The same in chunks of three days."""
    rows = clean.chunked_segments(with_faults(events(spark, d)), U, "us", GAP_S, 3 * 86_400)
    return runs.chunked_runs(rows, U, "us", "t", "p", 3 * 86_400)


@register("decimate", f"{RUNS} SELECT unit, run_id, CAST(idx // 2 AS BIGINT) AS idx, us, t, p, CAST((run_len + 1) // 2 AS BIGINT) AS run_len FROM runs WHERE idx % 2 = 0 AND (run_len + 1) // 2 >= 2")
def decimate(spark, d):
    return runs.decimate(unit_runs(spark, d), U)


@register("quantize_half_even", f"{RUNS} SELECT unit, run_id, idx, round_even(t / 50, 0) * 50 AS t FROM runs")
def quantize_half_even(spark, d):
    return unit_runs(spark, d).select("unit", "run_id", "idx", scalar.quantize(F.col("t"), 50.0).alias("t"))


@register("lead_pairs", f"{PAIRS} SELECT unit, run_id, idx, t, p, y FROM pairs")
def lead_pairs(spark, d):
    return unit_pairs(spark, d).select("unit", "run_id", "idx", "t", "p", "y")


@register("chunked_pairs", f"{PAIRS} SELECT unit, run_id, idx, t, p, run_len, y FROM pairs")
def chunked_pairs(spark, d):
    """The same pairs in chunks of five days."""
    rows = clean.chunked_segments(events(spark, d), U, "us", 43_200, 5 * 86_400)
    return runs.chunked_pairs(rows, U, "us", "t", "p", 5 * 86_400).drop("us")


@register("prefix_sums", f"{PAIRS}, x AS (SELECT unit, run_id, idx + 1 AS idx, " + ", ".join(f"sum({e}) OVER w AS {n}" for n, e in (("tt", "t*t"), ("tp", "t*p"), ("t1", "t"), ("pp", "p*p"), ("p1", "p"), ("n", "1.0::DOUBLE"), ("ty", "t*y"), ("py", "p*y"), ("y1", "y"))) + " FROM pairs WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) SELECT * FROM x UNION ALL SELECT unit, run_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM pairs WHERE idx = 0")
def prefix_sums(spark, d):
    return runs.prefix_sums(unit_pairs(spark, d), U)


# -- identification


@register("arx_fit", f"{FITS} SELECT unit, CAST(n AS BIGINT) AS n_pairs, {rd('alpha', 'beta', digits=9)}, {rd('gamma', digits=4)} FROM fits")
def arx_fit(spark, d):
    return unit_fits(spark, d).select("unit", "n_pairs", F.round("alpha", 9).alias("alpha"), F.round("beta", 9).alias("beta"), F.round("gamma", 4).alias("gamma"))


@register("arx_tau", f"{FITS} SELECT unit, {rd('tau')}, round(beta / nullif(1 - alpha, 0), 6) AS r_eff, round(gamma / nullif(1 - alpha, 0), 4) AS t_ref, round(tau / nullif(beta / nullif(1 - alpha, 0), 0), 4) AS c_eff, round(exp(-10.0::DOUBLE / tau), 6) AS alpha_back FROM fits")
def arx_tau(spark, d):
    return unit_fits(spark, d).select("unit", F.round("tau", 6).alias("tau"), F.round("r_eff", 6).alias("r_eff"), F.round("t_ref", 4).alias("t_ref"), F.round("c_eff", 4).alias("c_eff"), F.round(scalar.decay(F.col("tau"), DT), 6).alias("alpha_back"))


@register("arx_delta_ci", f"{RESID}, q AS (SELECT unit, sum(r * r) AS rss FROM resid GROUP BY 1), e AS (SELECT unit, n, alpha, tau, rss, sqrt(rss / greatest(n - 3, 1) * i00) AS se_alpha FROM fits JOIN q USING (unit)), f AS (SELECT *, CASE WHEN tau IS NOT NULL THEN abs(10.0::DOUBLE / (alpha * ln(CASE WHEN alpha > 0 THEN alpha END) * ln(CASE WHEN alpha > 0 THEN alpha END))) * se_alpha END AS se_tau FROM e) SELECT unit, CAST(n AS BIGINT) AS n_pairs, {rd('alpha', 'tau')}, {rd('rss', digits=2)}, {rd('se_alpha', 'se_tau')}, round(tau - 1.96 * se_tau, 6) AS ci_low, round(tau + 1.96 * se_tau, 6) AS ci_high, round(se_tau / tau, 6) AS cov FROM f")
def arx_delta_ci(spark, d):
    return rounded(rounded(arx.uncertainty(unit_fits(spark, d), U, DT)).withColumn("rss", F.round("rss", 2)), "rss")


METRICS = "SELECT unit, count(*) AS n_pairs, sqrt(sum(r*r) / count(*)) AS rmse, sum(abs(r)) / count(*) AS mae, 1.0::DOUBLE - sum(r*r) / nullif(sum(y*y) - sum(y)*sum(y)/count(*), 0) AS r2, sqrt(sum((y-t)*(y-t)) / count(*)) AS persistence_rmse, 1.0::DOUBLE - sum(r*r) / nullif(sum((y-t)*(y-t)) - sum(y-t)*sum(y-t)/count(*), 0) AS increment_r2 FROM resid WHERE r IS NOT NULL GROUP BY 1"


def _resid(spark, d):
    pairs = unit_pairs(spark, d)
    return arx.residuals(pairs, arx.fit(pairs, U, DT), U)


def _metrics(spark, d):
    return rounded(arx.metrics(_resid(spark, d), U), digits=5)


for _name, _cols in (("one_step_metrics", ("rmse", "mae", "r2")), ("increment_r2", ("increment_r2",)), ("persistence_rmse", ("persistence_rmse",))):
    register(_name, f"{RESID}, q AS ({METRICS}) SELECT unit, n_pairs, {rd(*_cols, digits=5)} FROM q")(lambda spark, d, cols=_cols: _metrics(spark, d).select("unit", "n_pairs", *cols))


@register("increment_stats", f"{PAIRS}, q AS (SELECT unit, count(*) AS n_pairs, sqrt(greatest((count(*) * sum((y-t)*(y-t)) - sum(y-t)*sum(y-t)) / (count(*)::DOUBLE*count(*)), 0)) AS dt_std, max(abs(y-t)) AS dt_max FROM pairs GROUP BY 1) SELECT unit, n_pairs, round(dt_std, 6) AS dt_std, dt_max, round(dt_std / 10, 6) AS rate_std, round(dt_max / 10, 6) AS rate_max FROM q")
def increment_stats(spark, d):
    return rounded(arx.increment_stats(unit_pairs(spark, d), U, DT))


STRUCTURE = f"{RESID}, l AS (SELECT *, lag(r) OVER (PARTITION BY unit ORDER BY run_id, idx) AS b FROM resid WHERE r IS NOT NULL)"


@register("residual_lag1", f"{STRUCTURE} SELECT unit, round({corr('r', 'b', 'b IS NOT NULL')}, 6) AS lag1, round(sqrt(greatest((count(*)*sum(r*r) - sum(r)*sum(r)) / (count(*)::DOUBLE*count(*)), 0)), 4) AS std FROM l GROUP BY 1")
def residual_lag1(spark, d):
    return arx.residual_structure(_resid(spark, d), U).select("unit", F.round("lag1", 6).alias("lag1"), F.round("std", 4).alias("std"))


@register("residual_corr", f"{PAIRS}, z AS (SELECT unit, t, p, y - t AS r FROM pairs) SELECT unit, round({corr('r', 'p')}, 6) AS corr_p, round({corr('r', 't')}, 6) AS corr_t FROM z GROUP BY 1")
def residual_corr(spark, d):
    """Of the persistence residual, whose correlations with p and t aren't zero by construction."""
    return arx.residual_structure(unit_pairs(spark, d).withColumn("r", F.col("y") - F.col("t")), U).select("unit", F.round("corr_p", 6).alias("corr_p"), F.round("corr_t", 6).alias("corr_t"))


# -- conditions and populations


def _sweep_pairs(spark, d):
    """Lead pairs of every unit under every condition; t in whole degrees of 100 hundredths. One pass: each reading in both
    forms, then the conditions of its form."""
    base = segmented(events(spark, d))
    forms = base.withColumn("form", F.explode(F.array(F.struct(F.lit("mean").alias("temp"), F.col("t").alias("v")), F.struct(F.lit("max").alias("temp"), (F.col("t") + F.col("p")).alias("v")))))
    long = forms.select("unit", "segment_id", "us", "p", "form.temp", "form.v")
    found = runs.finite_runs(long, ["unit", "temp"], "us", "v", "p")
    each = found.join(F.broadcast(runs.conditions(spark).select("condition", "temp", "quantized", "decimated", "dt")), "temp")  # five rows
    step = F.when(F.col("decimated"), 2).otherwise(1)
    kept = each.where(F.col("idx") % step == 0).withColumn("run_len", F.floor((F.col("run_len") + step - 1) / step)).where("run_len >= 2").withColumn("idx", F.floor(F.col("idx") / step))
    kept = kept.withColumn("t", F.when(F.col("quantized"), scalar.quantize(F.col("t"), 100.0)).otherwise(F.col("t")))
    return runs.lead_pairs(kept, ["condition", "unit"])


def _sweep(spark, d):
    """Fits of every unit under every condition."""
    fits = arx.solved(_sweep_pairs(spark, d).groupBy("condition", "unit", "dt").agg(*arx.moments()))
    return fits.select("condition", "unit", F.col("n").cast("long").alias("n_pairs"), "alpha", F.when((F.col("alpha") > 0) & (F.col("alpha") < 1), -F.col("dt") / F.ln("alpha")).alias("tau"))


def _sweep_sql() -> str:
    base = f"WITH {EV}, {seg()}"
    parts, union = [], []
    for c in runs.CONDITIONS:
        k = c.code.lower()
        t = "t" if c.temp == "mean" else "t + p"
        q = "round_even({}/100, 0) * 100" if c.quantized else "{}"
        src = f"SELECT unit, segment_id, us, {t} AS t, p, row_number() OVER (PARTITION BY unit, segment_id ORDER BY us) - 1 AS idx, count(*) OVER (PARTITION BY unit, segment_id) AS len FROM s"
        keep = "idx % 2 = 0 AND (len + 1) // 2 >= 2" if c.decimated else "len >= 2"
        parts.append(f"{k}r AS (SELECT unit, segment_id, us, {q.format('t')} AS t, p FROM ({src}) WHERE {keep}), {k}p AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY unit, segment_id ORDER BY us) AS y FROM {k}r) WHERE y IS NOT NULL), {k}m AS (SELECT unit, {MOMENTS} FROM {k}p GROUP BY unit), {solve(k + 'm', 'unit', k)}")
        union.append(f"SELECT '{c.code}' AS condition, unit, CAST(n AS BIGINT) AS n_pairs, alpha, {tau('alpha', c.dt)} AS tau FROM {k}")
    return base + ", " + ", ".join(parts) + ", sweep AS (" + " UNION ALL ".join(union) + ")"


SWEEP = _sweep_sql()


@register("condition_sweep", f"{SWEEP} SELECT condition, unit, n_pairs, {rd('alpha', 'tau')} FROM sweep")
def condition_sweep(spark, d):
    return rounded(_sweep(spark, d))


PAIRED = f"{SWEEP}, pr AS (SELECT a.condition, a.unit, a.tau AS value, b.tau AS ref, a.tau / b.tau AS ratio FROM sweep a JOIN sweep b ON a.unit = b.unit AND b.condition = 'F0' AND a.condition <> 'F0' WHERE a.tau IS NOT NULL AND b.tau IS NOT NULL)"


@register("paired_ratios", f"{PAIRED} SELECT condition, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.05), 6) AS p05, round(quantile_cont(ratio, 0.95), 6) AS p95, round(min(ratio), 6) AS min, round(max(ratio), 6) AS max, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / nullif(quantile_cont(ref, 0.75) - quantile_cont(ref, 0.25), 0), 6) AS iqr_ratio FROM pr GROUP BY 1")
def paired_ratios(spark, d):
    return rounded(population.ratio_stats(population.paired(_sweep(spark, d), U, "condition", "tau"), ["condition"]))


@register("spearman_paired", f"{PAIRED}, x AS (SELECT condition, rank() OVER (PARTITION BY condition ORDER BY value) + (count(*) OVER (PARTITION BY condition, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY condition ORDER BY ref) + (count(*) OVER (PARTITION BY condition, ref) - 1) / 2.0::DOUBLE AS b FROM pr) SELECT condition, count(*) AS n, round({corr('a', 'b')}, 6) AS rho FROM x GROUP BY 1")
def spearman_paired(spark, d):
    return rounded(population.spearman(population.paired(_sweep(spark, d), U, "condition", "tau"), "value", "ref", ["condition"]))


@register("all_conditions_valid", f"{SWEEP}, v AS (SELECT unit, count(tau) AS n FROM sweep GROUP BY 1) SELECT count(*) FILTER (n = 5) AS valid_in_all, count(*) AS units FROM v")
def all_conditions_valid(spark, d):
    return population.all_valid(_sweep(spark, d), U, "tau", len(runs.CONDITIONS))


SOCKETS = f"{FITS}, w AS (SELECT unit // 2 AS host, max(CASE WHEN unit % 2 = 0 THEN alpha END) AS a, max(CASE WHEN unit % 2 = 1 THEN alpha END) AS b FROM fits GROUP BY 1), sp2 AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"


@register("socket_pairing", f"{SOCKETS} SELECT count(*) AS hosts, round({corr('a', 'b')}, 6) AS corr, round(quantile_cont(abs(a - b), 0.5), 6) AS median_abs_diff, round(quantile_cont(abs(a - b) / nullif((a + b) / 2, 0), 0.5), 6) AS median_rel_diff FROM sp2")
def socket_pairing(spark, d):
    units = unit_fits(spark, d).select(F.expr("unit div 2").alias("host"), (F.col("unit") % 2).alias("socket"), "alpha")
    return rounded(population.pairing(population.socket_pairs(units, "host", "socket", "alpha")))


def stats_sql(column: str, source: str, group: str = "") -> str:
    q = ", ".join(f"round(quantile_cont({column}, {x}), 6) AS p{round(100 * x):02d}" for x in population.QUANTILES)
    key = f"{group}, " if group else ""
    return f"SELECT {key}count({column}) AS n, round(avg({column}), 6) AS mean, round(stddev_pop({column}), 6) AS std, round(min({column}), 6) AS min, round(max({column}), 6) AS max, {q} FROM {source}" + (f" GROUP BY {group}" if group else "")


@register("population_stats", f"{FITS} {stats_sql('tau', 'fits')}")
def population_stats(spark, d):
    return rounded(population.summary(unit_fits(spark, d), "tau"))


@register("subset_vs_rest", f"{FITS}, top AS (SELECT unit FROM (SELECT unit, count(*) AS rows FROM ev GROUP BY 1 ORDER BY rows DESC, unit LIMIT 20)), f2 AS (SELECT fits.*, unit IN (SELECT unit FROM top) AS in_subset FROM fits) {stats_sql('tau', 'f2', 'in_subset')}")
def subset_vs_rest(spark, d):
    top = population.top_units(events(spark, d), "unit", 20)
    return rounded(population.summary(population.flagged_subset(unit_fits(spark, d), top, "unit"), "tau", ["in_subset"]))


@register("dispersion_alpha_tau", f"{SWEEP}, q AS (SELECT condition, avg(tau) AS mean, stddev_pop(tau) AS std, quantile_cont(tau, 0.05) AS p05, quantile_cont(tau, 0.25) AS p25, quantile_cont(tau, 0.5) AS p50, quantile_cont(tau, 0.75) AS p75, quantile_cont(tau, 0.95) AS p95 FROM sweep GROUP BY 1), a AS (SELECT condition, stddev_pop(1 - alpha) / avg(1 - alpha) AS cv_rate, quantile_cont(alpha, 0.75) - quantile_cont(alpha, 0.25) AS alpha_iqr FROM sweep WHERE tau IS NOT NULL GROUP BY 1) SELECT condition, round(std / mean, 6) AS cov, round(p75 - p25, 6) AS iqr, round((p75 - p25) / p50, 6) AS iqr_over_median, round(p95 / p05, 6) AS p95_over_p05, round(cv_rate, 6) AS cv_rate, round(alpha_iqr, 6) AS alpha_iqr FROM q JOIN a USING (condition)")
def dispersion_alpha_tau(spark, d):
    sweep = _sweep(spark, d)
    a = sweep.where("tau is not null").groupBy("condition").agg((F.stddev_pop(1 - F.col("alpha")) / F.avg(1 - F.col("alpha"))).alias("cv_rate"), (F.percentile("alpha", 0.75) - F.percentile("alpha", 0.25)).alias("alpha_iqr"))
    out = population.dispersion(population.summary(sweep, "tau", ["condition"])).join(a, "condition")
    return rounded(out.select("condition", "cov", "iqr", "iqr_over_median", "p95_over_p05", "cv_rate", "alpha_iqr"))


@register("topn_units", "SELECT user_id AS unit, count(*) AS rows FROM events GROUP BY 1 ORDER BY rows DESC, unit LIMIT 10")
def topn_units(spark, d):
    return population.top_units(events(spark, d), "unit", 10)


# -- evaluation

DAY = 5 * 86_400
BLOCKS = PAIRS + f", blk AS (SELECT pairs.*, CAST(floor(min(us) OVER (PARTITION BY unit, run_id) / {DAY}000000) AS BIGINT) AS block FROM pairs)"


def _blocked_pairs(spark, d):
    return runs.lead_pairs(runs.with_blocks(unit_runs(spark, d), U, "us", seconds=DAY), U)


CV = f"{BLOCKS}, bm AS (SELECT unit, block, {MOMENTS} FROM blk GROUP BY 1, 2), tr AS (SELECT unit, block, row_number() OVER (PARTITION BY unit ORDER BY block) AS fold, " + ", ".join(f"sum({m}) OVER (PARTITION BY unit ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {m}" for m in SUMS) + f" FROM bm), tr2 AS (SELECT * FROM tr WHERE fold > 1), {solve('tr2', 'unit')}, te AS (SELECT blk.unit, blk.block, fit.n AS n_train, y, t, y - (alpha*t + beta*blk.p + gamma) AS r FROM blk JOIN fit ON blk.unit = fit.unit AND blk.block = fit.block WHERE alpha IS NOT NULL), cv AS (SELECT unit, block, CAST(min(n_train) AS BIGINT) AS n_train, count(*) AS n_test, sqrt(sum(r*r)/count(*)) AS rmse, sum(abs(r))/count(*) AS mae, 1.0::DOUBLE - sum(r*r) / nullif(sum(y*y) - sum(y)*sum(y)/count(*), 0) AS r2, 1.0::DOUBLE - sum(r*r) / nullif(sum((y-t)*(y-t)) - sum(y-t)*sum(y-t)/count(*), 0) AS increment_r2 FROM te GROUP BY 1, 2)"


@register("expanding_cv", f"{CV} SELECT unit, block, n_train, n_test, {rd('rmse', 'mae', digits=3)}, {rd('r2', 'increment_r2', digits=4)} FROM cv")
def expanding_cv(spark, d):
    folds = evaluate.expanding_folds(_blocked_pairs(spark, d), U)
    return folds.select("unit", "block", "n_train", "n_test", *[F.round(c, 3).alias(c) for c in ("rmse", "mae")], *[F.round(c, 4).alias(c) for c in ("r2", "increment_r2")])


@register("cv_summary", f"{CV} SELECT unit, count(*) AS n_folds, round(avg(increment_r2), 4) AS mean_increment_r2, round(quantile_cont(increment_r2, 0.5), 4) AS median_increment_r2 FROM cv GROUP BY 1")
def cv_summary(spark, d):
    return rounded(evaluate.fold_summary(evaluate.expanding_folds(_blocked_pairs(spark, d), U), U), digits=4)


@register("holdout_split", f"{BLOCKS}, l AS (SELECT unit, max(block) AS last FROM blk GROUP BY 1), bo AS (SELECT unit, block, row_number() OVER (PARTITION BY unit ORDER BY block) AS block_no FROM (SELECT DISTINCT unit, block FROM blk)) SELECT unit, count(*) FILTER (block <> last) AS n_train, count(*) FILTER (block = last) AS n_test, max(block_no) AS blocks, CAST(sum(block_no) AS BIGINT) AS block_sum FROM blk JOIN l USING (unit) JOIN bo USING (unit, block) GROUP BY 1")
def holdout_split(spark, d):
    marked = evaluate.last_block(_blocked_pairs(spark, d), U)
    return marked.groupBy("unit").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), F.max("block_no").alias("blocks"), F.sum("block_no").alias("block_sum"))


@register("residual_features", f"{RESID}, f AS (SELECT unit, run_id, idx, p, p - lag(p) OVER w AS dp, t, lag(p) OVER w AS lag_p, lag(t) OVER w AS lag_t, round(r, 4) AS r FROM resid WHERE run_len >= 3 WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx)) SELECT * FROM f WHERE lag_p IS NOT NULL")
def residual_features(spark, d):
    f = evaluate.features(_resid(spark, d), U)
    return f.select("unit", "run_id", "idx", "p", "dp", "t", "lag_p", "lag_t", F.round("r", 4).alias("r"))


@register("zero_prediction_r2", f"{RESID} SELECT unit, count(*) AS n, round(1.0::DOUBLE - sum(r*r) / nullif(sum(r*r) - sum(r)*sum(r)/count(*), 0), 6) AS r2 FROM resid WHERE r IS NOT NULL GROUP BY 1")
def zero_prediction_r2(spark, d):
    return rounded(evaluate.r2(_resid(spark, d).where("r is not null"), "r", F.lit(0.0), U))


PRIME = 2147483647
LCG = "((event_id * 7919 + draw * 104729) * 48271) % 2147483647"


@register("perm_null_lcg", f"WITH {EV}, base AS (SELECT event_id, t AS y, 50 * p + 5000 AS pred FROM ev), r AS (SELECT event_id, y, pred, draw FROM base CROSS JOIN (SELECT unnest(range(200)) AS draw)), a AS (SELECT draw, pred, row_number() OVER (PARTITION BY draw ORDER BY event_id) AS i FROM r), b AS (SELECT draw, y, row_number() OVER (PARTITION BY draw ORDER BY {LCG}, event_id) AS i FROM r) SELECT draw, count(*) AS n, round(1.0::DOUBLE - sum((y-pred)*(y-pred)) / nullif(sum(y*y) - sum(y)*sum(y)/count(*), 0), 6) AS r2 FROM a JOIN b USING (draw, i) GROUP BY 1")
def perm_null_lcg(spark, d):
    """All events, in the operator's own number of draws. From ids that are not negative the recurrence is a sum modulo a prime, so
    that each draw rotates one order; the remainders of others do not turn round, and each draw is sorted."""
    base = events(spark, d).select("event_id", F.col("t").alias("y"), (50 * F.col("p") + 5000).alias("pred"))
    if (base.agg(F.min("event_id")).first()[0] or 0) < 0:
        return rounded(evaluate.permutation_null(base, "y", "pred", "event_id", shuffle=lambda k, draw: ((k * 7919 + draw * 104729) * 48271) % PRIME, bits=31))
    return rounded(evaluate.rotated_null(base, "y", "pred", "event_id", F.col("event_id") * 7919 % PRIME * 48271 % PRIME, [draw * 104729 * 48271 % PRIME for draw in range(200)], PRIME))


#: A move of a place, for one draw: halves, then rounds that add a mix of one half to the other.
MIX = "((({v}) * 7919 + draw * 104729 + {k} * 15485863) * 48271) % 2147483647"
_ROUND = lambda k: f"(h{k} + ({MIX.format(v=f'l{k}', k=k)}) % side) % side AS l{k + 1}, l{k} AS h{k + 1}"
MOVED = "x // side AS h0, x % side AS l0, " + ", ".join(map(_ROUND, range(4))) + ", h4 * side + l4 AS moved"
PLACED = f"base AS (SELECT event_id, t AS y, 50 * p + 5000 AS pred FROM ev WHERE t IS NOT NULL AND p IS NOT NULL), pl AS (SELECT y, pred, row_number() OVER (ORDER BY event_id * 48271 % 2147483647, event_id, y, pred) - 1 AS i, count(*) OVER () AS n FROM base), sd AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side FROM pl)"
WALKED = f"w AS (SELECT draw, i, n, side, moved AS j FROM (SELECT draw, i, n, side, i AS x, {MOVED} FROM sd, (SELECT unnest(range(200)) AS draw)) UNION ALL SELECT draw, i, n, side, moved FROM (SELECT draw, i, n, side, j AS x, {MOVED} FROM w WHERE j >= n))"


@register("perm_null_keyed", f"WITH RECURSIVE {EV}, {PLACED}, {WALKED} SELECT draw, count(*) AS n, round(1.0::DOUBLE - sum((b.y-a.pred)*(b.y-a.pred)) / nullif(sum(b.y*b.y) - sum(b.y)*sum(b.y)/count(*), 0), 6) AS r2 FROM w JOIN pl a ON a.i = w.i JOIN pl b ON b.i = w.j WHERE w.j < w.n GROUP BY 1")
def perm_null_keyed(spark, d):
    """Permutations computed from places, in whole numbers, in the operator's own number of draws."""
    base = events(spark, d).select("event_id", F.col("t").alias("y"), (50 * F.col("p") + 5000).alias("pred"))
    mix = lambda v, draw, k: ((v * 7919 + draw * 104729 + k * 15485863) * 48271) % 2147483647
    return rounded(evaluate.keyed_permutation_null(base, "y", "pred", "event_id", mix=mix, spread=lambda k: (k * 48271) % 2147483647, bits=31))


@register("perm_null")
def perm_null(spark, d):
    """The same by a hash, which SQL elsewhere doesn't have."""
    base = events(spark, d).select("event_id", F.col("t").alias("y"), (50 * F.col("p") + 5000).alias("pred"))
    return rounded(evaluate.keyed_permutation_null(base, "y", "pred", "event_id"))


@register("perm_null_summary", f"WITH pn AS ({ORACLE_SQL['perm_null_lcg']}) SELECT count(*) AS draws, round(quantile_cont(r2, 0.95), 5) AS null_p95, round(avg(r2), 5) AS null_mean FROM pn")
def perm_null_summary(spark, d):
    return rounded(evaluate.null_summary(perm_null_lcg(spark, d)), digits=5)


def _residual_rows(spark, d):
    pairs = _blocked_pairs(spark, d)
    rows = evaluate.features(arx.residuals(pairs, arx.fit(pairs, U, DT), U).where("r is not null"), U)
    # once: the last block, the ranges of capped(), its rows and the test rows would each make them twice
    return evaluate.last_block(shared.written(rows.select("unit", "run_id", "idx", "block", *evaluate.FEATURES, "r"), "residuals"), [])


#: Rows that networks are fitted on at most, by hash; every test row is scored.
TRAIN_ROWS = 150_000


def _split(spark, d, cap=None):
    rows = _residual_rows(spark, d)
    train, test = rows.where("not is_test"), rows.where("is_test")
    if cap:  # in one partition, as limit() leaves them, and in its order; hundreds of passes over them carry no plan
        train = shared.written(evaluate.capped(train, F.concat_ws("|", "unit", "run_id", "idx"), cap), "train").coalesce(1)
    return train, test


FEATURED = f"{BLOCKS}, bm AS (SELECT unit, {MOMENTS} FROM blk GROUP BY 1), {solve('bm', 'unit')}, rs AS (SELECT blk.*, y - (alpha*t + beta*blk.p + gamma) AS r FROM blk JOIN fit USING (unit)), fe AS (SELECT unit, run_id, idx, block, p, p - lag(p) OVER w AS dp, t, lag(p) OVER w AS lag_p, lag(t) OVER w AS lag_t, r FROM rs WHERE r IS NOT NULL AND run_len >= 3 WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx)), f0 AS (SELECT unit, run_id, idx, p, dp, t, lag_p, lag_t, r, block = max(block) OVER () AS is_test FROM fe WHERE lag_p IS NOT NULL)"


def _linear_sql() -> str:
    """Least squares by sweeping out one feature after another: each is centred, and what earlier ones explain is taken off."""
    names = ["p", "dp", "t", "lag_p", "lag_t"]
    parts = ["c0 AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}" for n in (*names, "r")) + " FROM f0 WHERE NOT is_test)", "z0 AS (SELECT is_test, r, " + ", ".join(f"{n} - m_{n} AS {n}" for n in names) + ", r - m_r AS e, m_r AS prediction FROM f0, c0)"]
    for k, n in enumerate(names):
        rest = names[k + 1 :]
        parts.append(f"c{k + 1} AS (SELECT CASE WHEN sum({n}*{n}) > 1e-6 THEN sum({n}*e) / sum({n}*{n}) ELSE 0 END AS b_e" + "".join(f", CASE WHEN sum({n}*{n}) > 1e-6 THEN sum({n}*{m}) / sum({n}*{n}) ELSE 0 END AS b_{m}" for m in rest) + f" FROM z{k} WHERE NOT is_test)")
        parts.append(f"z{k + 1} AS (SELECT is_test, r, e - b_e*{n} AS e, prediction + b_e*{n} AS prediction" + "".join(f", {m} - b_{m}*{n} AS {m}" for m in rest) + f" FROM z{k}, c{k + 1})")
    return f"{FEATURED}, " + ", ".join(parts) + ", lin AS (SELECT count(*) AS n, 1.0::DOUBLE - sum((r-prediction)*(r-prediction)) / nullif(sum(r*r) - sum(r)*sum(r)/count(*), 0) AS r2 FROM z5 WHERE is_test)"


LINEAR = _linear_sql()


@register("linear_residual", f"{LINEAR} SELECT n, round(r2, 5) AS r2 FROM lin")
def linear_residual(spark, d):
    return rounded(evaluate.r2(evaluate.residual_model(*_split(spark, d), "linear"), "r", F.col("prediction")), digits=5)


@register("gbt_residual")
def gbt_residual(spark, d):
    return rounded(evaluate.r2(evaluate.residual_model(*_split(spark, d), "trees"), "r", F.col("prediction")))


@register("neural_residual")
def neural_residual(spark, d):
    return rounded(evaluate.r2(evaluate.neural_residual(*_split(spark, d), list(evaluate.FEATURES), train_rows=TRAIN_ROWS), "r", F.col("prediction")))


WIDE = 30 * 86_400


def _windows(spark, d):
    pairs = runs.lead_pairs(runs.with_blocks(unit_runs(spark, d, WIDE), U, "us", seconds=DAY), U)
    rows = evaluate.features(arx.residuals(pairs, arx.fit(pairs, U, DT), U).where("r is not null"), U)
    # all runs begin in the first block here, so whole units are held out
    return evaluate.trailing(rows.withColumn("is_test", F.col("unit") % 5 == 0), U)


@register("sequence_windows", f"WITH {EV}, {seg(gap_s=WIDE)}, {RUNS[len(BASE) + 2 :]}, {PAIRS[len(RUNS) + 2 :]}, fe AS (SELECT unit, run_id, idx, p, p - lag(p) OVER w AS dp, t, lag(p) OVER w AS lag_p, lag(t) OVER w AS lag_t FROM pairs WHERE run_len >= 3 WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx)), fz AS (SELECT unit, run_id, idx, " + ", ".join(f"coalesce(({n} - avg({n}) OVER r) / nullif(stddev_pop({n}) OVER r, 0), 0) AS {n}" for n in ("p", "dp", "t", "lag_p", "lag_t")) + " FROM fe WHERE lag_p IS NOT NULL WINDOW r AS (PARTITION BY unit, run_id)), fl AS (SELECT unit, run_id, idx, " + ", ".join(f"list({n}) OVER w AS {n}" for n in ("p", "dp", "t", "lag_p", "lag_t")) + " FROM fz WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT unit, run_id, idx, " + ", ".join(f"round(list_sum(list_transform(range(1, 9), lambda k: k * {n}[k])), 5) + 0.0::DOUBLE AS {n}" for n in ("p", "dp", "t", "lag_p", "lag_t")) + " FROM fl WHERE len(p) = 8")
def sequence_windows(spark, d):
    """Of each window, the sum of its standardised values weighted by their place, for each feature."""
    w = _windows(spark, d)
    total = lambda k: F.aggregate(F.transform("window", lambda x, i: (i + 1) * x[k]), F.lit(0.0), lambda acc, x: acc + x)
    return w.select("unit", "run_id", "idx", *[(F.round(total(k), 5) + 0.0).alias(n) for k, n in enumerate(evaluate.FEATURES)])  # no negative zeros


@register("recurrent_residual")
def recurrent_residual(spark, d):
    return rounded(evaluate.r2(evaluate.recurrent_residual(_windows(spark, d)), "r", F.col("prediction")))


# -- bootstraps


@register("block_bootstrap")
def block_bootstrap(spark, d):
    return rounded(resample.block_bootstrap(unit_runs(spark, d), U, DT))


@register("block_bootstrap_lcg", f"{PAIRS}, x AS (SELECT unit, run_id, idx + 1 AS idx, " + ", ".join(f"sum({e}) OVER w AS {n}" for n, e in (("stt", "t*t"), ("stp", "t*p"), ("st", "t"), ("spp", "p*p"), ("sp", "p"), ("n", "1.0::DOUBLE"), ("sty", "t*y"), ("spy", "p*y"), ("sy", "y"))) + " FROM pairs WINDOW w AS (PARTITION BY unit, run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)), pre AS (SELECT * FROM x UNION ALL SELECT unit, run_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM pairs WHERE idx = 0), ln AS (SELECT *, count(*) OVER (PARTITION BY unit, run_id) - 1 AS len FROM pre), st AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY run_id, idx) - 1 AS place, count(*) OVER (PARTITION BY unit) AS places FROM ln WHERE idx + 4 <= len), dr AS (SELECT unit, draw, (((unit * 7919 + draw * 104729 + k * 1299709) * 48271) % 2147483647) % places AS place FROM (SELECT DISTINCT unit, places FROM st) CROSS JOIN (SELECT unnest(range(500)) AS draw) CROSS JOIN (SELECT unnest(range(12)) AS k)), bl AS (SELECT dr.unit, draw, " + ", ".join(f"sum(h.{n} - st.{n}) AS {n}" for n in ("stt", "stp", "st", "spp", "sp", "n", "sty", "spy", "sy")) + f" FROM dr JOIN st ON dr.unit = st.unit AND dr.place = st.place JOIN pre h ON h.unit = st.unit AND h.run_id = st.run_id AND h.idx = st.idx + 4 GROUP BY 1, 2), {solve('bl', 'unit')} SELECT unit, draw, round(alpha, 6) AS alpha FROM fit")
def block_bootstrap_lcg(spark, d):
    return rounded(resample.lcg_blocks(unit_pairs(spark, d), U, "unit", 4, 12, resample.DRAWS))


@register("paired_bootstrap")
def paired_bootstrap(spark, d):
    pairs = population.paired(_sweep(spark, d).where("condition in ('F0', 'F1')"), U, "condition", "tau")
    return rounded(resample.paired_bootstrap(pairs, "value", "ref"))


@register("paired_bootstrap_lcg", f"{PAIRED}, un AS (SELECT value, ref, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS places FROM pr WHERE condition = 'F1'), dr AS (SELECT draw, ((place * 7919 + draw * 104729 + 12345) * 48271 % 2147483647) % places AS place FROM un CROSS JOIN (SELECT unnest(range(2000)) AS draw)), x AS (SELECT draw, value, ref FROM dr JOIN un USING (place)), k AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY value) + (count(*) OVER (PARTITION BY draw, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY draw ORDER BY ref) + (count(*) OVER (PARTITION BY draw, ref) - 1) / 2.0::DOUBLE AS b FROM x) SELECT draw, count(*) AS n, round({corr('a', 'b')}, 6) AS rho FROM k GROUP BY 1")
def paired_bootstrap_lcg(spark, d):
    pairs = population.paired(_sweep(spark, d).where("condition in ('F0', 'F1')"), U, "condition", "tau")
    return rounded(resample.lcg_correlations(pairs.select("unit", "value", "ref"), "unit", "value", "ref", 2000))


# -- monitor


def monitor_sql(samples: int = 8, gap_s: int = WIDE) -> str:
    least = int(0.6 * samples) + 1
    return f"WITH {EV}, {seg(gap_s=gap_s)}, {RUNS[len(BASE) + 2 :]}, rw AS (SELECT *, idx // {samples} AS win, CASE WHEN (idx + 1) // {samples} = idx // {samples} THEN lead(t) OVER (PARTITION BY unit, run_id ORDER BY idx) END AS y FROM runs), nm AS (SELECT unit, run_id, win, min(us) AS first_us, count(*) AS samples, sum(p) / count(*) AS mean_p, sum(t) / count(*) AS mean_t FROM rw GROUP BY 1, 2, 3), wm AS (SELECT unit, run_id, win, {MOMENTS} FROM rw WHERE y IS NOT NULL GROUP BY 1, 2, 3), {solve('wm', 'unit')}, wt AS (SELECT nm.unit, nm.run_id, CAST(nm.win AS BIGINT) AS win, first_us, samples, mean_p, mean_t, {tau('fit.alpha')} AS tau FROM nm JOIN fit ON nm.unit = fit.unit AND nm.run_id = fit.run_id AND nm.win = fit.win WHERE samples >= {least}), roll AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY run_id, win) AS ord FROM wt WHERE tau IS NOT NULL)"


ROLL = monitor_sql()
SCORED = """, n1 AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM roll), n2 AS (SELECT *, ord <= n // 2 AS baseline FROM n1 WHERE n >= 4 AND n // 2 >= 2 AND n - n // 2 >= 2),
n3 AS (SELECT n2.*, med, p_med, abs(tau - med) AS dev FROM n2 JOIN (SELECT unit, quantile_cont(tau, 0.5) AS med, quantile_cont(mean_p, 0.5) AS p_med FROM n2 WHERE baseline GROUP BY 1) USING (unit)),
n4 AS (SELECT n3.*, mad, dev / (1.4826 * mad + 1e-9) AS z FROM n3 JOIN (SELECT unit, quantile_cont(dev, 0.5) AS mad FROM n3 WHERE baseline GROUP BY 1) USING (unit)),
n5 AS (SELECT *, z > 1.5 AS alert FROM n4), n6 AS (SELECT *, sum(CASE WHEN alert THEN 0 ELSE 1 END) OVER (PARTITION BY unit, baseline ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM n5),
scored AS (SELECT *, alert AND sum(CASE WHEN alert THEN 1 ELSE 0 END) OVER (PARTITION BY unit, baseline, island) >= 2 AS persisted FROM n6)"""


def _rolling(spark, d, samples=8):
    return monitor.rolling(unit_runs(spark, d, WIDE), U, DT, samples)


def _scored(spark, d):
    return monitor.scored(_rolling(spark, d), U, 1.5, 2, 4, 2)


@register("rolling_tau", f"{ROLL} SELECT unit, run_id, win, first_us, samples, {rd('mean_p', 'mean_t', 'tau', digits=5)}, ord FROM roll")
def rolling_tau(spark, d):
    return rounded(_rolling(spark, d), digits=5)


@register("robust_z", f"{ROLL}{SCORED} SELECT unit, ord, baseline, round(med, 5) AS med, round(mad, 5) AS mad, round(z, 4) AS z FROM scored")
def robust_z(spark, d):
    return _scored(spark, d).select("unit", "ord", "baseline", F.round("med", 5).alias("med"), F.round("mad", 5).alias("mad"), F.round("z", 4).alias("z"))


@register("persisted_alerts", f"{ROLL}{SCORED} SELECT unit, ord, alert, persisted FROM scored")
def persisted_alerts(spark, d):
    return _scored(spark, d).select("unit", "ord", "alert", "persisted")


def _chunked_rolling(spark, d):
    """Windows of runs in chunks of five days."""
    rows = clean.chunked_segments(events(spark, d), U, "us", WIDE, 5 * 86_400)
    return monitor.rolling(runs.chunked_runs(rows, U, "us", "t", "p", 5 * 86_400), U, DT, 8, chunk_s=5 * 86_400)


@register("chunked_rolling", ORACLE_SQL["rolling_tau"])
def chunked_rolling(spark, d):
    return rounded(_chunked_rolling(spark, d), digits=5)


@register("chunked_alerts", f"{ROLL}{SCORED} SELECT unit, ord, baseline, round(med, 5) AS med, round(mad, 5) AS mad, round(z, 4) AS z, alert, persisted FROM scored")
def chunked_alerts(spark, d):
    """Scores, with runs of alerts put together over chunks of four windows."""
    rows = monitor.chunked_scored(_chunked_rolling(spark, d), U, 1.5, 2, 4, 2, size=4)
    return rows.select("unit", "ord", "baseline", F.round("med", 5).alias("med"), F.round("mad", 5).alias("mad"), F.round("z", 4).alias("z"), "alert", "persisted")


@register("paired_ratio_ci")
def paired_ratio_ci(spark, d):
    """The interval of the median of how far quantization moves a unit's time constant."""
    pairs = population.paired(_sweep(spark, d).where("condition in ('F0', 'F1')"), U, "condition", "tau").withColumn("one", F.lit(1.0))
    return rounded(resample.paired_bootstrap(pairs, "ratio", "one", resample.median_difference))


UNITS = f"{ROLL}{SCORED}, un AS (SELECT unit, count(*) AS n_windows, avg(CASE WHEN NOT baseline THEN persisted::INT::DOUBLE END) AS oos, avg(CASE WHEN baseline THEN persisted::INT::DOUBLE END) AS base, min(mad) / (min(med) + 1e-9) AS rel FROM scored GROUP BY 1)"


@register("alert_rate_vs_null", f"{UNITS} SELECT count(*) AS units, round(avg(oos), 6) AS oos_mean, round(avg(base), 6) AS baseline_mean, round(quantile_cont(oos - base, 0.5), 6) AS median_difference, round(avg((oos - base > 0)::INT::DOUBLE), 6) AS fraction_above, round(quantile_cont(rel, 0.5), 5) AS rel_spread_median FROM un")
def alert_rate_vs_null(spark, d):
    out = monitor.alerts_against_null(monitor.unit_report(_scored(spark, d), U))
    return rounded(out.withColumn("rel_spread_median", F.round("rel_spread_median", 5)))


@register("confound_corr", f"{ROLL}{SCORED} SELECT unit, count(*) AS n_windows, round({corr('z', 'abs(mean_p - p_med)', 'NOT baseline')}, 4) AS power_confound_corr FROM scored GROUP BY 1")
def confound_corr(spark, d):
    return monitor.unit_report(_scored(spark, d), U).select("unit", "n_windows", F.round("power_confound_corr", 4).alias("power_confound_corr"))


@register("busiest_unit", f"{UNITS} SELECT unit, n_windows FROM un ORDER BY n_windows DESC, unit LIMIT 1")
def busiest_unit(spark, d):
    return monitor.busiest(monitor.unit_report(_scored(spark, d), U), U)


@register("window_sensitivity", " UNION ALL ".join(f"(SELECT {w}::BIGINT AS samples, count(*) AS windows, count(DISTINCT unit) AS units, round(quantile_cont(tau, 0.5), 5) AS tau_median FROM ({monitor_sql(w)} SELECT * FROM roll))" for w in (8, 12, 16)))
def window_sensitivity(spark, d):
    out = None
    for w in (8, 12, 16):
        one = _rolling(spark, d, w).agg(F.count("*").alias("windows"), F.count_distinct("unit").alias("units"), F.round(F.median("tau"), 5).alias("tau_median")).select(F.lit(w).cast("long").alias("samples"), "windows", "units", "tau_median")
        out = one if out is None else out.unionByName(one)
    return out


@register("session_segments", f"WITH {EV}, {seg()} SELECT unit, count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY unit, segment_id")
def session_segments(spark, d):
    """Gaps are whole seconds, as in SQL: a session lasts until the next whole second after GAP_S."""
    e = events(spark, d).withColumn("ts", F.timestamp_micros("us"))
    return e.groupBy("unit", F.session_window("ts", f"{GAP_S} seconds 999999 microseconds").alias("w")).agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).drop("w")


PART, LATE, GAP = 6 * 86_400, 12 * 86_400, 129_600


def _stream_sql() -> str:
    """Every window of the batch, with the alerts that a stream gives as they come."""
    done = ", done AS (SELECT roll.*, ord AS \"window\" FROM roll)"
    alerts = ", ba AS (SELECT unit, quantile_cont(tau, 0.5) AS med FROM done WHERE \"window\" <= 3 GROUP BY 1), bm2 AS (SELECT done.unit, min(med) AS med, quantile_cont(abs(tau - med), 0.5) AS mad FROM done JOIN ba ON done.unit = ba.unit WHERE \"window\" <= 3 GROUP BY 1), az AS (SELECT done.*, CASE WHEN \"window\" > 3 THEN abs(tau - med) / (1.4826 * mad + 1e-9) END AS z FROM done JOIN bm2 ON done.unit = bm2.unit), aa AS (SELECT *, coalesce(z > 1.5, false) AS alert FROM az), ai AS (SELECT *, sum(CASE WHEN alert THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY \"window\" ROWS UNBOUNDED PRECEDING) AS island FROM aa), ap AS (SELECT *, alert AND sum(CASE WHEN alert THEN 1 ELSE 0 END) OVER (PARTITION BY unit, island ORDER BY \"window\" ROWS UNBOUNDED PRECEDING) >= 2 AS persisted FROM ai)"
    return monitor_sql(gap_s=GAP) + done + alerts


STREAM = _stream_sql()


def _streamed(spark, d):
    """The events replayed in files of six days, every third row a file late, through a Parquet sink; then a beat, so that
    the watermark passes the newest row's gap."""
    e = events(spark, d).select("unit", "us", "t", "p", (F.floor(F.col("us") / (PART * 1_000_000)) + (F.col("event_id") % 3 == 0).cast("int")).cast("int").alias("part"))
    none = F.lit(None).cast("double")
    beat = e.agg(F.max("us").alias("us"), F.max("part").alias("part")).select(F.lit(rolling.BEAT).alias("unit"), (F.col("us") + (LATE + GAP + 2) * 1_000_000).alias("us"), none.alias("t"), none.alias("p"), (F.col("part") + 1).alias("part"))
    folder = shared.new_path(spark, "stream")
    units = e.agg(F.approx_count_distinct("unit")).first()[0]  # one number
    job = lambda stream: rolling.count_windows(stream, 8, GAP, DT, LATE, baseline=3, threshold=1.5, buckets=max(rolling.BUCKETS, units // 512))
    return rolling.replayed(e.unionByName(beat), "part", f"{folder}/in", job, f"{folder}/out", 1)


@register("stream_rolling_tau", f"{STREAM} SELECT unit, \"window\", first_us, CAST(samples AS INTEGER) AS samples, {rd('tau', 'mean_p', 'mean_t', digits=5)} FROM ap")
def stream_rolling_tau(spark, d):
    return rounded(_streamed(spark, d).drop("z", "alert", "persisted"), digits=5)


@register("stream_alerts", f"{STREAM} SELECT unit, \"window\", round(z, 3) AS z, alert, persisted FROM ap")
def stream_alerts(spark, d):
    return _streamed(spark, d).select("unit", "window", F.round("z", 3).alias("z"), "alert", "persisted")


# -- reports


DELTA = "q2 AS (SELECT unit, sum(r * r) AS rss FROM resid GROUP BY 1), e2 AS (SELECT unit, alpha, tau, sqrt(rss / greatest(n - 3, 1) * i00) AS se_alpha FROM fits JOIN q2 USING (unit)), dl AS (SELECT unit, tau, CASE WHEN tau IS NOT NULL THEN abs(10.0::DOUBLE / (alpha * ln(CASE WHEN alpha > 0 THEN alpha END) * ln(CASE WHEN alpha > 0 THEN alpha END))) * se_alpha END AS se_tau FROM e2)"


@register("decision_gate", f"WITH a AS (SELECT quantile_cont(increment_r2, 0.5) AS increment_r2 FROM ({CV} SELECT increment_r2 FROM cv)), b AS ({LINEAR} SELECT r2 AS residual_r2 FROM lin), c AS (SELECT quantile_cont(se_tau / tau, 0.5) AS tau_cov FROM ({RESID}, {DELTA} SELECT * FROM dl)) SELECT round(increment_r2, 4) AS increment_r2, round(residual_r2, 4) AS residual_r2, round(tau_cov, 4) AS tau_cov, CASE WHEN coalesce(tau_cov < 0.05, false) AND (coalesce(increment_r2 > 0.05, false) OR coalesce(residual_r2 > 0.02, false)) THEN 'A_OBSERVABILITY_IMPROVEMENT' WHEN coalesce(tau_cov < 0.05, false) THEN 'A_TAU_IDENTIFIABILITY__B_RESIDUAL_NULL (split)' WHEN NOT (coalesce(increment_r2 > 0.05, false) OR coalesce(residual_r2 > 0.02, false)) THEN 'B_UNIVERSAL_NULL' ELSE 'C_INCONCLUSIVE' END AS gate FROM a, b, c")
def decision_gate(spark, d):
    """From the folds' increment R2, the linear residual model and the delta method's spread: one row each."""
    folds = evaluate.expanding_folds(_blocked_pairs(spark, d), U).agg(F.median("increment_r2").alias("increment_r2"))
    residual = evaluate.r2(evaluate.residual_model(*_split(spark, d), "linear"), "r", F.col("prediction")).select(F.col("r2").alias("residual_r2"))
    cov = arx.uncertainty(unit_fits(spark, d), U, DT).agg(F.median("cov").alias("tau_cov"))
    return rounded(report.decision_gate(folds.crossJoin(residual).crossJoin(cov)), digits=4)


FIDELITY = f"{SWEEP}, " + ", ".join(f"{c.code.lower()}q AS (SELECT unit, sum((y - (alpha*t + beta*p + gamma)) * (y - (alpha*t + beta*p + gamma))) AS rss FROM {c.code.lower()}p JOIN {c.code.lower()} USING (unit) GROUP BY 1), {c.code.lower()}a AS (SELECT '{c.code}' AS condition, unit, n, alpha, {tau('alpha', c.dt)} AS tau, {c.dt}::DOUBLE AS dt, rss, i00 FROM {c.code.lower()} JOIN {c.code.lower()}q USING (unit))" for c in runs.CONDITIONS) + ", an0 AS (" + " UNION ALL ".join(f"SELECT * FROM {c.code.lower()}a" for c in runs.CONDITIONS) + "), an AS (SELECT condition, unit, tau, abs(dt / (alpha * ln(alpha) * ln(alpha))) * sqrt(rss / greatest(n - 3, 1) * i00) AS se FROM an0 WHERE tau IS NOT NULL)"


def _analytic(spark, d):
    """(condition, unit, tau, cov, ci_width) by the delta method, for every condition in one pass."""
    pairs = _sweep_pairs(spark, d)
    keys = ["condition", "unit"]
    fits = arx.solved(pairs.groupBy(*keys, "dt").agg(*arx.moments())).where("alpha > 0 and alpha < 1").withColumn("tau", -F.col("dt") / F.ln("alpha"))
    a = F.col("alpha")
    se = F.abs(F.col("dt") / (a * F.ln(a) * F.ln(a))) * F.sqrt(F.col("rss") / F.greatest(F.col("n") - 3, F.lit(1.0)) * F.col("i00"))
    return fits.select(*keys, "tau", F.try_divide(se, F.col("tau")).alias("cov"), (2 * 1.96 * se).alias("ci_width"))


def _replicates(spark, d):
    """(condition, unit, tau) of leave-one-block-out refits: unions of moments but those of one of eight interleaved blocks."""
    pairs = _sweep_pairs(spark, d)
    keys = ["condition", "unit"]
    by = pairs.groupBy(*keys, "dt", (F.floor(F.col("idx") / 4) % 8).alias("left_out")).agg(*arx.moments())
    w = Window.partitionBy(*keys).orderBy("left_out")
    sides = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rest = arx.united(by, keys, "left_out", ["dt"], lambda c: F.coalesce(F.sum(c).over(sides[0]), F.lit(0.0)) + F.coalesce(F.sum(c).over(sides[1]), F.lit(0.0)))
    return arx.solved(rest).select(*keys, F.when((F.col("alpha") > 0) & (F.col("alpha") < 1), -F.col("dt") / F.ln("alpha")).alias("tau"))


def _replicates_sql() -> str:
    parts = []
    for c in runs.CONDITIONS:
        k = c.code.lower()
        parts.append(f"{k}b AS (SELECT unit, ((row_number() OVER (PARTITION BY unit, segment_id ORDER BY us) - 1) // 4) % 8 AS left_out, t, p, y FROM {k}p), {k}g AS (SELECT unit, left_out, {MOMENTS} FROM {k}b GROUP BY 1, 2), {k}h AS (SELECT unit, left_out, " + ", ".join(f"sum({m}) OVER (PARTITION BY unit) - {m} AS {m}" for m in SUMS) + f" FROM {k}g), {solve(k + 'h', 'unit', k + 'j')}")
    union = " UNION ALL ".join(f"SELECT '{c.code}' AS condition, unit, {tau('alpha', c.dt)} AS tau FROM {c.code.lower()}j" for c in runs.CONDITIONS)
    return ", ".join(parts) + f", rp AS ({union})"


@register("fidelity_by_condition", f"{FIDELITY}, {_replicates_sql()}, a1 AS (SELECT condition, count(*) AS units, quantile_cont(tau, 0.5) AS tau_point, quantile_cont(se / tau, 0.5) AS analytic_cov, quantile_cont(2 * 1.96 * se, 0.5) AS analytic_ci_width FROM an GROUP BY 1), b0 AS (SELECT condition, unit, count(*) AS draws, count(tau) AS valid, quantile_cont(tau, 0.5) AS tau, stddev_pop(tau) / avg(tau) AS cov, quantile_cont(tau, 0.975) - quantile_cont(tau, 0.025) AS ci_width FROM rp GROUP BY 1, 2), b1 AS (SELECT condition, quantile_cont(tau, 0.5) AS tau_boot, quantile_cont(cov, 0.5) AS boot_cov, quantile_cont(ci_width, 0.5) AS boot_ci_width, 100.0::DOUBLE * (1.0::DOUBLE - sum(valid) / sum(draws)::DOUBLE) AS invalid_pct FROM b0 GROUP BY 1), ab AS (SELECT *, tau_boot / max(CASE WHEN condition = 'F0' THEN tau_boot END) OVER () AS tau_ratio FROM a1 LEFT JOIN b1 USING (condition)) SELECT condition, units, {rd('tau_point', 'analytic_cov', 'analytic_ci_width', 'tau_boot', 'boot_cov', 'boot_ci_width', 'invalid_pct', 'tau_ratio', digits=4)} FROM ab")
def fidelity_by_condition(spark, d):
    """Analytic beside resampled estimates of each condition."""
    return rounded(population.by_condition(_analytic(spark, d), _replicates(spark, d)), digits=4)


@register("fidelity_swing", f"{SWEEP}, m2 AS (SELECT condition, quantile_cont(tau, 0.5) AS med FROM sweep GROUP BY 1) SELECT round(max(CASE WHEN condition = 'F2' THEN med END) / max(CASE WHEN condition = 'F1' THEN med END), 6) AS swing, round(max(med) / min(med), 6) AS span FROM m2")
def fidelity_swing(spark, d):
    return rounded(population.swing(_sweep(spark, d).groupBy("condition").agg(F.median("tau").alias("med")), "condition", "med"))


@register("unit_validity", f"{FITS} SELECT unit, CAST(n AS BIGINT) AS n_pairs, round(tau, 6) AS tau, coalesce(alpha > 0 AND alpha < 1, false) AND n >= 40 AS valid, CASE WHEN NOT coalesce(alpha > 0 AND alpha < 1, false) THEN 'unstable alpha' WHEN n < 40 THEN 'below MIN_PAIRS or few boot fits' END AS reason FROM fits")
def unit_validity(spark, d):
    """With 40 pairs where the study asks for 2000, as units here have fewer than 100."""
    return population.unit_validity(unit_fits(spark, d), None, U, min_pairs=40).select("unit", "n_pairs", F.round("tau", 6).alias("tau"), "valid", "reason")


@register("top_by_files", "SELECT user_id AS unit, count(DISTINCT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT)) AS files FROM events GROUP BY 1 ORDER BY files DESC, unit LIMIT 10")
def top_by_files(spark, d):
    """Units by daily files, one for each day with readings."""
    return population.top_by_files(events(spark, d).withColumn("file", F.floor(F.col("us") / 86_400_000_000)), "unit", "file", 10)


@register("socket_conditions", "SELECT host, socket, condition, count(*) AS rows, sum(t) AS t FROM (SELECT user_id // 2 AS host, CAST(round(value * 100) AS DOUBLE) AS a, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS b FROM events) CROSS JOIN (VALUES ('F0', 'mean'), ('F1', 'mean'), ('F2', 'mean'), ('F3', 'max'), ('F4', 'max')) AS c(condition, temp) CROSS JOIN LATERAL (VALUES (0, CASE WHEN temp = 'mean' THEN a ELSE a + b END), (1, CASE WHEN temp = 'mean' THEN b ELSE b + 1 END)) AS x(socket, t) GROUP BY 1, 2, 3")
def socket_conditions(spark, d):
    """Every host, socket and condition: readings of both sockets as long rows, in the form that each condition reads."""
    e = events(spark, d).withColumn("host", F.expr("unit div 2")).withColumn("segment_id", F.lit(0).cast("long"))
    wide = e.select("host", "us", "segment_id", F.col("t").alias("p0_core_temp_mean"), (F.col("t") + F.col("p")).alias("p0_core_temp_max"), F.col("p").alias("p1_core_temp_mean"), (F.col("p") + 1).alias("p1_core_temp_max"), F.lit(0.0).alias("p0_power"), F.lit(0.0).alias("p1_power"))
    return runs.enumerated(wide, ["host"], "us").groupBy("host", "socket", "condition").agg(F.count("*").alias("rows"), F.sum("t").alias("t"))


MEASURED = f"""me AS (
  SELECT 'tau_point_' || condition AS metric, quantile_cont(tau, 0.5) AS value FROM ({SWEEP} SELECT condition, tau FROM sweep) GROUP BY condition
  UNION ALL SELECT 'tau_ratio_' || condition, med / max(CASE WHEN condition = 'F0' THEN med END) OVER () FROM (SELECT condition, quantile_cont(tau, 0.5) AS med FROM ({SWEEP} SELECT condition, tau FROM sweep) GROUP BY 1)
  UNION ALL SELECT 'fleet_' || k, v FROM (UNPIVOT (SELECT count(tau)::DOUBLE AS n_valid, quantile_cont(tau, 0.5) AS median, avg(tau) AS mean, stddev_pop(tau) AS std, quantile_cont(tau, 0.05) AS p05, quantile_cont(tau, 0.95) AS p95, min(tau) AS "min", max(tau) AS "max" FROM ({FITS} SELECT tau FROM fits)) ON COLUMNS(*) INTO NAME k VALUE v)
)"""
CHECKS = "ck AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in report.study_spec()) + ") AS v(chk, metric, kind, want, other, factor, tolerance))"


def _measured(spark, d):
    """(metric, value) of what the events have of a study's numbers."""
    med = _sweep(spark, d).groupBy("condition").agg(F.median("tau").alias("med"))
    point = med.select(F.concat(F.lit("tau_point_"), "condition").alias("metric"), F.col("med").alias("value"))
    ratio = med.select(F.concat(F.lit("tau_ratio_"), "condition").alias("metric"), scalar.ratio(F.col("med"), F.max(F.when(F.col("condition") == "F0", F.col("med"))).over(Window.partitionBy(F.lit(0)))).alias("value"))  # five rows
    fleet = population.summary(unit_fits(spark, d), "tau").withColumnRenamed("n", "n_valid").withColumnRenamed("p50", "median")
    names = ["n_valid", "median", "mean", "std", "p05", "p95", "min", "max"]
    return point.unionByName(ratio).unionByName(report.claims(fleet, names, "").select(F.concat(F.lit("fleet_"), "metric").alias("metric"), "value"))


@register("study_validation", f"WITH {MEASURED}, {CHECKS}, pt AS (SELECT string_split(chk, '|')[1] AS \"check\", contains(chk, '|') AS one, coalesce(CASE kind WHEN 'near' THEN abs(m.value - coalesce(want, factor * o.value)) <= tolerance + 1e-12 WHEN 'at_most' THEN m.value <= coalesce(want, factor * o.value) WHEN 'at_least' THEN m.value >= coalesce(want, factor * o.value) ELSE m.value < coalesce(want, factor * o.value) END, false) AS ok FROM ck LEFT JOIN me m ON ck.metric = m.metric LEFT JOIN me o ON ck.other = o.metric) SELECT \"check\", CASE WHEN bool_or(one) THEN bool_or(ok) ELSE bool_and(ok) END AS ok, count(*) AS parts FROM pt GROUP BY 1")
def study_validation(spark, d):
    """The 44 checks, over what the events can tell; what they can't fails."""
    return report.study_checks(_measured(spark, d))


SPECS = [("tau_point_.*", "2B", "fig02", "table02", "measurement quality changes the identified time constant", "V"), ("tau_ratio_.*", "2C", "fig02", "table02", "measurement quality biases the time constant", "V"), ("fleet_.*", "2D", "fig04", "table04", "natural variation of the time constant", "V")]


@register("claim_manifest", f"WITH {MEASURED}, sp AS (SELECT * FROM (VALUES {', '.join(str(s) for s in SPECS)}) AS v(pattern, phase, figure, \"table\", claim, classification)) SELECT metric, round(value, 6) AS value, phase, figure, \"table\", claim, classification, substr(sha256(phase), 1, 12) AS source_hash FROM me JOIN sp ON regexp_full_match(metric, pattern)")
def claim_manifest(spark, d):
    spec = spark.createDataFrame(SPECS, report.CLAIM)
    sources = spec.select("phase", F.sha2("phase", 256).alias("digest"))
    return rounded(report.claim_manifest(_measured(spark, d), spec, sources))


@register("unpivot_manifest", f"{FITS}, q AS (SELECT count(tau)::DOUBLE AS n, round(quantile_cont(tau, 0.5), 6) AS p50, round(min(tau), 6) AS min FROM fits) SELECT metric, value, 'fit' AS phase FROM (SELECT 'n' AS metric, n AS value FROM q UNION ALL SELECT 'p50', p50 FROM q UNION ALL SELECT 'min', min FROM q)")
def unpivot_manifest(spark, d):
    return rounded(report.claims(population.summary(unit_fits(spark, d), "tau"), ["n", "p50", "min"], "fit"))


@register("validation_checks", f"{BASE}, q AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM s UNION ALL SELECT 'units', count(DISTINCT unit)::DOUBLE FROM s), e AS (SELECT * FROM (VALUES ('rows', 10000.0::DOUBLE, 0.0::DOUBLE, 0.01::DOUBLE), ('units', 100.0::DOUBLE, 5.0::DOUBLE, 0.0::DOUBLE), ('absent', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)) AS v(metric, want, tolerance, relative)) SELECT e.metric, value, want, coalesce(abs(value - want) <= greatest(tolerance, relative * abs(want)), false) AS ok FROM e LEFT JOIN q ON e.metric = q.metric")
def validation_checks(spark, d):
    s = events(spark, d)
    got = report.claims(s.agg(F.count("*").alias("rows"), F.count_distinct("unit").alias("units")), ["rows", "units"], "x").drop("phase")
    expected = spark.createDataFrame([("rows", 10000.0, 0.0, 0.01), ("units", 100.0, 5.0, 0.0), ("absent", 1.0, 1.0, 1.0)], "metric string, want double, tolerance double, relative double")
    return report.validate(got, expected)


@register("histogram", f"WITH {EV} SELECT CAST(least(floor(p / 9.9), 9) AS INTEGER) AS bin, count(*) AS n, round(CAST(least(floor(p / 9.9), 9) AS INTEGER) * 9.9::DOUBLE, 6) AS left_edge FROM ev WHERE p BETWEEN 0 AND 99 GROUP BY 1, 3")
def histogram(spark, d):
    return rounded(report.histogram(events(spark, d), "p", 0.0, 99.0, 10))


DIGEST = "sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(event_id) AS VARCHAR), CAST(CAST(sum(round(value * 100)) AS BIGINT) AS VARCHAR)))"


@register("drift", f"WITH a AS (SELECT event_type AS source, {DIGEST} AS digest FROM events GROUP BY 1), b AS (SELECT event_type AS source, {DIGEST} AS was FROM events WHERE event_type <> 'error' OR event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'gone', 'x') SELECT source, was, digest FROM b LEFT JOIN a USING (source) WHERE was IS DISTINCT FROM digest")
def drift(spark, d):
    """Digests of each source's readings against ones that were recorded before readings of errors were added and a source went."""
    digest = lambda e: e.groupBy(F.col("event_type").alias("source")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum("event_id").cast("string"), F.sum("t").cast("long").cast("string")), 256).alias("digest"))
    e = events(spark, d)
    recorded = digest(e.where("event_type <> 'error' or event_id % 2 = 0")).unionByName(spark.createDataFrame([("gone", "x")], "source string, digest string"))
    return report.drift(digest(e), recorded)


@register("box_data", f"{FITS}, bq AS (SELECT unit % 3 AS grp, count(alpha) AS n, quantile_cont(alpha, 0.25) AS q1, quantile_cont(alpha, 0.5) AS median, quantile_cont(alpha, 0.75) AS q3 FROM fits GROUP BY 1), bi AS (SELECT bq.*, alpha, alpha BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM fits JOIN bq ON unit % 3 = grp) SELECT grp, n, {rd('q1', 'median', 'q3')}, round(min(CASE WHEN inside THEN alpha END), 6) AS low, round(max(CASE WHEN inside THEN alpha END), 6) AS high, count(*) FILTER (NOT inside) AS outliers FROM bi GROUP BY 1, 2, 3, 4, 5")
def box_data(spark, d):
    return rounded(report.boxes(unit_fits(spark, d).withColumn("grp", F.col("unit") % 3), "alpha", "grp"))


@register("scatter_data", f"{SOCKETS} SELECT round(a, 6) AS x, round(b, 6) AS y, CAST(host % 2 AS VARCHAR) AS color FROM sp2")
def scatter_data(spark, d):
    units = unit_fits(spark, d).select(F.expr("unit div 2").alias("host"), (F.col("unit") % 2).alias("socket"), "alpha")
    return rounded(report.scatter(population.socket_pairs(units, "host", "socket", "alpha").withColumn("c", F.col("host") % 2), "a", "b", "c"))


@register("series_data", f"{SEGH} SELECT event_type AS kind, us::DOUBLE AS x, s2.name || ' ' || event_type AS series, s2.y AS y FROM s CROSS JOIN LATERAL (VALUES ('n_merged', n_merged::DOUBLE), ('segment_id', segment_id::DOUBLE)) AS s2(name, y)".replace("event_type AS kind, ", ""))
def series_data(spark, d):
    return report.series(segmented(hourly(events(spark, d), "event_type"), "event_type", 7200), "us", ["n_merged", "segment_id"], "event_type")


# -- sources and sinks, there and back

TWO = ("p0_core_temp_mean", "p0_power")
TREE = f"{EV}, tr AS (SELECT event_type AS host, us, CASE WHEN event_type <> 'error' THEN t END AS p0_core_temp_mean, p AS p0_power FROM ev)"


def _tree(spark, d) -> str:
    """The events as a telemetry tree, a folder for each type; error events have NaN for a temperature."""
    e = with_faults(events(spark, d))
    path = shared.new_path(spark, "tree")
    rows = e.select(F.col("event_type").alias("host"), F.timestamp_micros("us").alias("timestamp"), F.coalesce("t", F.lit(float("nan"))).alias("p0_core_temp_mean"), F.col("p").alias("p0_power"))
    rows.write.partitionBy("host").parquet(path)
    return path


@register("tree_hosts", "SELECT DISTINCT event_type AS host FROM events")
def tree_hosts(spark, d):
    return telemetry.hosts(spark, _tree(spark, d))


@register("tree_readings", f"WITH {TREE} SELECT * FROM tr")
def tree_readings(spark, d):
    return telemetry.readings(spark, _tree(spark, d), TWO)


@register("footer_rows", "SELECT event_type AS host, count(*) AS rows, 3::BIGINT AS columns FROM events GROUP BY 1")
def footer_rows(spark, d):
    """Rows and columns of each host, from footers alone."""
    return telemetry.footers(spark, _tree(spark, d)).groupBy("host").agg(F.sum("rows").alias("rows"), F.max(F.size("columns")).cast("long").alias("columns"))


@register("archive_members", "SELECT DISTINCT event_type AS host, event_type || '/all/00000.parquet' AS first, true AS sound FROM events")
def archive_members(spark, d):
    path = shared.new_path(spark, "archives")
    telemetry.write_archives(spark, _tree(spark, d), path)
    return telemetry.archive_members(spark, path).groupBy("host").agg(F.min("member").alias("first"), F.every(F.col("error").isNull() & (F.col("offset") % 512 == 0)).alias("sound"))


@register("archive_readings", f"WITH {TREE} SELECT * FROM tr")
def archive_readings(spark, d):
    """The tree packed into an archive for each host, and its members read by byte range."""
    path = shared.new_path(spark, "archives")
    telemetry.write_archives(spark, _tree(spark, d), path)
    return telemetry.archive_readings(spark, path, list(TWO))


@register("file_digests", "SELECT event_type AS host, sha256(string_agg(CAST(event_id AS VARCHAR) || chr(10), '' ORDER BY event_id)) AS digest, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def file_digests(spark, d):
    """A file of each type's ids, in order, hashed in blocks."""
    path = shared.new_path(spark, "ids")
    e = events(spark, d).select("event_type", F.col("event_id").cast("string").alias("value"), "event_id")
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    return report.digests(spark, path).where("source like 'part-%'").select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("host"), "digest", "bytes")


CLEANED = f"{SEGH}, cl AS (SELECT event_type AS host, us, t, t_max, p, n_merged, dt_s, segment_id FROM s)"


def _cleaned(spark, d):
    return segmented(hourly(events(spark, d), "event_type"), "event_type", 7200).withColumnRenamed("event_type", "host")


@register("cleaned_round_trip", f"{CLEANED} SELECT host, us, round(t, 6) AS t, t_max, n_merged, segment_id, coalesce(dt_s, -1) AS dt_s FROM cl")
def cleaned_round_trip(spark, d):
    path = shared.new_path(spark, "cleaned")
    telemetry.write_cleaned(_cleaned(spark, d), path)
    back = spark.read.parquet(path)
    return back.select("host", "us", F.round("t", 6).alias("t"), "t_max", "n_merged", "segment_id", F.coalesce("dt_s", F.lit(-1).cast("long")).alias("dt_s"))


@register("mask_round_trip", f"{CLEANED} SELECT host, us, n_merged, segment_id, coalesce(dt_s, -1) AS dt_s, n_merged > 1 AS was_merged FROM cl")
def mask_round_trip(spark, d):
    path = shared.new_path(spark, "mask")
    telemetry.write_mask(clean.quality_mask(_cleaned(spark, d), ["host"], "us"), path)
    return spark.read.parquet(path).withColumn("dt_s", F.coalesce("dt_s", F.lit(-1).cast("long"))).select("host", "us", "n_merged", "segment_id", "dt_s", "was_merged")


@register("pilot_round_trip", "SELECT host, us, t_max FROM (" + CLEANED + " SELECT * FROM cl WHERE host < 'm')")
def pilot_round_trip(spark, d):
    path = shared.new_path(spark, "pilot")
    telemetry.write_pilot(_cleaned(spark, d).where("host < 'm'"), path, ["t_max"])
    return spark.read.parquet(path).select("host", "us", "t_max")


@register("manifest_round_trip", f"{CLEANED}, rb AS (SELECT event_type AS host, count(*) AS rows_before FROM events GROUP BY 1) SELECT host, min(rows_before) AS rows_before, count(*) AS rows_after, min(rows_before) - count(*) AS removed, count(*) FILTER (n_merged > 1) AS merged_bins, max(t_max) AS greatest FROM cl JOIN rb USING (host) GROUP BY 1")
def manifest_round_trip(spark, d):
    """Documents of what cleaning did, written and read back."""
    path = shared.new_path(spark, "manifests")
    cleaned = _cleaned(spark, d)
    audits = cleaned.groupBy("host").agg(F.max("t_max").alias("greatest"))
    telemetry.write_manifests(telemetry.host_manifest(cleaned, telemetry.footers(spark, _tree(spark, d)), audits), path)
    back = spark.read.schema("host string, cleaning struct<rows_before: long, rows_after: long, removed: long, merged_bins: long>, audit struct<greatest: double>").json(path)
    return back.select("host", "cleaning.*", "audit.greatest")


@register("csv_round_trip", ORACLE_SQL["gap_segments"])
def csv_round_trip(spark, d):
    path = shared.new_path(spark, "csv")
    segments = gap_segments(spark, d)
    telemetry.write_table(segments, path, one=False)
    return spark.read.schema(segments.schema).option("header", True).csv(path)


@register("resumed", ORACLE_SQL["gap_segments"])
def resumed(spark, d):
    """A job that stopped after half of the units, and its second run, which computes the rest."""
    path = shared.new_path(spark, "resumed")
    segments = gap_segments(spark, d)
    telemetry.checkpointed(segments.where("unit % 2 = 0"), path, U)
    return telemetry.checkpointed(segments, path, U)


@register("month_blocks", f"{RUNS} SELECT unit, run_id, strftime(make_timestamp(min(us)), '%Y-%m') AS block, count(*) AS rows FROM runs GROUP BY 1, 2")
def month_blocks(spark, d):
    return runs.with_blocks(unit_runs(spark, d), U, "us").groupBy("unit", "run_id", "block").agg(F.count("*").alias("rows"))
