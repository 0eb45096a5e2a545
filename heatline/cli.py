"""Command line: python -m heatline.cli inventory|clean|compare DATA OUT [options]."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import clean, profile, report
from .operators.population import top_by_files
from .sources import telemetry

log = logging.getLogger("heatline")


def logged(path: str | None) -> None:
    """Messages to standard error, and to a file if one is named; a second call begins anew."""
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in (logging.StreamHandler(sys.stderr), *([logging.FileHandler(path, encoding="utf-8")] if path else [])):
        handler.setFormatter(logging.Formatter("[%(asctime)s] %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    log.propagate = False


def chosen(readings, nodes: int):
    """Readings of the `nodes` hosts with most files; 0: of all."""
    if not nodes:
        return readings
    return readings.join(F.broadcast(top_by_files(readings, "host", "_file", nodes).select("host")), "host", "left_semi")  # `nodes` rows


def inventory(spark: SparkSession, data: str, out: str) -> None:
    footers = telemetry.footers(spark, data)
    readings = telemetry.readings(spark, data)
    telemetry.write_table(profile.schema_signatures(footers), f"{out}/schema_signatures")
    telemetry.write_table(profile.column_coverage(footers), f"{out}/column_coverage")
    telemetry.write_table(profile.fleet_inventory(readings, "host", "us", telemetry.SENSORS[0]), f"{out}/fleet", "json")
    telemetry.write_table(profile.sampling_summary(readings, ["host"], "us"), f"{out}/sampling")


def build(spark: SparkSession, data: str, out: str, nodes: int) -> int:
    """Cleaned tables, masks and manifests; the number of hosts with failures."""
    readings = chosen(telemetry.readings(spark, data, files=True), nodes)
    telemetry.write_cleaned(clean.clean(readings, ["host"], "us", list(telemetry.SENSORS)), f"{out}/cleaned")
    cleaned = spark.read.parquet(f"{out}/cleaned")
    telemetry.write_mask(clean.quality_mask(cleaned, ["host"], "us"), f"{out}/mask")
    temporal = clean.temporal_audit(cleaned, ["host"], "us")
    physical = clean.physical_audit(cleaned, ["host"], "us", "p0_core_temp_mean", "p0_power")
    gates = clean.gates(temporal, physical, ["host"])
    telemetry.write_manifests(telemetry.host_manifest(cleaned, telemetry.footers(spark, data), temporal.join(gates, "host")), f"{out}/manifests")
    bad = gates.where(F.size("failures") > 0)
    telemetry.write_table(bad.withColumn("failures", F.array_join("failures", "; ")), f"{out}/failures")
    return bad.count()


def compare(spark: SparkSession, data: str, out: str, nodes: int) -> None:
    readings = chosen(telemetry.readings(spark, data, files=True), nodes)
    bins = clean.policy_bins(readings, ["host"], "us", "p0_core_temp_mean", ["_file", "_row"])
    telemetry.write_table(clean.policy_report(bins, ["host"]), f"{out}/policy")
    telemetry.write_table(clean.policy_totals(bins), f"{out}/policy_totals")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heatline", description=__doc__)
    parser.add_argument("job", choices=("inventory", "clean", "compare"))
    parser.add_argument("data")
    parser.add_argument("out")
    parser.add_argument("--nodes", type=int, default=0, help="only the hosts with most files, so many (default: all)")
    parser.add_argument("--log", help="a file for messages")
    a = parser.parse_args(argv)
    logged(a.log)
    spark = SparkSession.builder.appName(f"heatline-{a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    path = spark._jvm.org.apache.hadoop.fs.Path(a.data)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        blocked = report.guarded(spark, a.data, lambda: None, "put the telemetry tree at the expected path")
        telemetry.write_table(blocked, f"{a.out}/status", "json")
        log.info("BLOCKED: %s is missing", a.data)
        return 0
    log.info("%s %s -> %s", a.job, a.data, a.out)
    failed = 0
    if a.job == "inventory":
        inventory(spark, a.data, a.out)
    elif a.job == "clean":
        failed = build(spark, a.data, a.out, a.nodes)
    else:
        compare(spark, a.data, a.out, a.nodes)
    log.info("done, %d hosts with failures", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
