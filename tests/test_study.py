"""Reports, learned models, sinks, streams and the command line."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heatline import cli
from heatline.operators import clean, evaluate, monitor, population, profile, report, resample, runs
from heatline.sources import shared, telemetry
from heatline.streaming import rolling

from .test_semantics import U, arx_series, segmented, series

#: The study's published numbers.
PUBLISHED = {
    "tau_point": (393.8, 115.8, 910.5, 282.6, 352.0), "tau_boot": (394, 116, 909, 283, 352), "tau_ratio": (1.00, 0.29, 2.31, 0.72, 0.89), "boot_ci_width": (79.0, 8.3, 254.2, 19.0, 23.3), "analytic_ci_width": (38.7, 4.1, 178.7, 10.7, 15.4),
    "residual_trees": (0.034, 0.055, 0.006, 0.046, 0.066), "null_p95": (-0.028, -0.054, -0.037, -0.057, -0.081), "invalid_pct": (0.0, 0.0, 0.0, 0.0, 0.0),
}
ONE = {"fleet_n_valid": 116, "fleet_median": 438.9, "fleet_mean": 551.7, "fleet_std": 364.7, "fleet_p05": 274.6, "fleet_p95": 1199.9, "fleet_min": 205.4, "fleet_max": 2596.2, "socket_corr": 0.7888, "socket_rel_diff": 0.2417, "boot_cov_F0": 0.05, "boot_cov_F1": 0.02, "residual_trees_max": 0.066, "stream_oos_difference": 0.001, "stream_rel_spread": 0.620, "stream_power_confound": 0.004, "stream_runtime_ms": 0.04138}


def published(spark, **changed):
    values = {f"{m}_F{k}": float(x) for m, row in PUBLISHED.items() for k, x in enumerate(row)} | {k: float(v) for k, v in ONE.items()} | changed
    return spark.createDataFrame(list(values.items()), "metric string, value double")


def test_the_44_checks_hold_for_the_published_numbers_and_name_what_fails(spark):
    rows = report.study_checks(published(spark)).collect()
    assert len(rows) == 44 and all(r["ok"] for r in rows)
    bad = report.study_checks(published(spark, tau_point_F1=130.0, null_p95_F3=0.01, residual_trees_F1=0.01, residual_trees_F4=0.02, fleet_n_valid=114.0)).where("not ok").collect()
    assert {r["check"] for r in bad} == {"tau_point_F1", "residual_nulls_negative", "residual_not_improved_by_fidelity", "fleet_n_valid"}
    one = report.study_checks(published(spark, residual_trees_F1=0.01)).where("not ok").count()  # the other part holds
    assert one == 0
    assert report.tally(report.study_checks(published(spark).limit(0))).first()[1] == 44


def test_claims_take_the_longest_pattern_and_the_source_hash(spark):
    spec = spark.createDataFrame([("tau_.*", "2B", "f", "t", "c", "V"), ("tau_boot_.*", "2C", "f2", "t2", "c2", "V")], report.CLAIM)
    sources = spark.createDataFrame([("2C", "0123456789abcdef")], "phase string, digest string")
    rows = {r["metric"]: r for r in report.claim_manifest(published(spark), spec, sources).collect()}
    assert (rows["tau_boot_F0"]["phase"], rows["tau_boot_F0"]["source_hash"]) == ("2C", "0123456789ab")
    assert rows["tau_point_F0"]["phase"] == "2B" and rows["fleet_min"]["phase"] is None


def test_decision_gate_has_every_outcome(spark):
    rows = spark.createDataFrame([(0.1, 0.0, 0.01), (0.0, 0.03, 0.01), (0.0, 0.0, 0.01), (0.0, 0.0, 0.2), (0.1, 0.0, 0.2), (None, None, None)], "increment_r2 double, residual_r2 double, tau_cov double")
    assert [r["gate"] for r in report.decision_gate(rows).collect()] == [report.GATES[k] for k in (0, 0, 1, 2, 3, 2)]


def test_artifacts_missing_and_banned(spark, tmp_path):
    (tmp_path / "a.md").write_text("TODO FIXME <!-- x --> STEP 3 vscode-webview")
    got = {tuple(r) for r in report.artifacts(spark, str(tmp_path), ["a.md", "b.pdf"], ["a.md"]).collect()}
    assert got == {("b.pdf", "missing"), ("a.md", "2 x todo"), ("a.md", "1 x comment"), ("a.md", "1 x process"), ("a.md", "1 x webview")}


def test_tables_of_a_study(spark):
    residual = spark.createDataFrame([("F0", 0.0, 0.034)], "condition string, linear double, trees double")
    fidelity = spark.createDataFrame([("F0", 393.84, 394.0, 0.0256, 38.7)], "condition string, tau_point double, tau_boot double, analytic_cov double, analytic_ci_width double")
    population_ = spark.createDataFrame([("median", 438.9)], "metric string, value double")
    tables = report.study_tables(runs.conditions(spark), fidelity, residual, population_, fidelity)
    assert len(tables) == 5 and "| F0 | 394 | 394 | 0.0256 | 38.7 |" in tables["table02_tau_identification.md"]
    assert tables["table03_residual_prediction.md"].endswith("0.034 out of sample.\n")


def plain_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_average_ranks_and_their_correlation(spark):
    x, y = np.array([3.0, 1, 3, 2, 2, 2, -7e9]), np.array([1.0, 5, 2, 2, 9, 9, 0])
    rows = [("a", float(i), float(j), int(k)) for k, (i, j) in enumerate(zip(x, y))] + [("flat", 1.0, 1.0, 0), ("flat", 1.0, 2.0, 1), ("flat", 1.0, 3.0, 2), ("few", 1.0, 2.0, 0), ("odd", float("nan"), 2.0, 0), ("odd", None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, k long")
    for ranges in (1, 3, 4096):
        got = population.with_average_ranks(df, ["g"], {"rx": "x", "ry": "y"}, ranges=ranges).where("g = 'a'").orderBy("k").collect()
        assert [r["rx"] for r in got] == plain_ranks(x).tolist() and [r["ry"] for r in got] == plain_ranks(y).tolist()
    assert {r["rx"] for r in population.with_average_ranks(df, ["g"], {"rx": "x"}).where("g = 'odd'").collect()} == {None}
    rho = {r["g"]: (r["n"], r["rho"]) for r in population.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["a"] == (7, pytest.approx(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1])) and rho["flat"] == (3, None) and rho["few"] == (1, None) and "odd" not in rho
    whole = population.with_average_ranks(df.where("g = 'a'"), [], {"r": "x"}).orderBy("k")
    assert [r["r"] for r in whole.collect()] == plain_ranks(x).tolist() and whole.columns == [*df.columns, "r"]
    weighted = df.where("g = 'a'").withColumn("w", F.col("k") % 3 + 1)
    w = np.arange(7) % 3 + 1
    a, b = np.repeat(x, w), np.repeat(y, w)
    assert population.spearman(weighted, "x", "y", ["g"], "w").first()["rho"] == pytest.approx(np.corrcoef(plain_ranks(a), plain_ranks(b))[0, 1])


def test_spearman_sorts_no_group_in_one_task(spark):
    df = spark.range(100).selectExpr("id % 2 g", "cast(id as double) x", "cast(-id as double) y")
    plan = population.spearman(df, "x", "y", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b#" in line for line in windows)


def test_weights_are_one_multinomial_over_tasks_that_never_meet(spark):
    table = spark.range(90).selectExpr("cast(id as double) x", "cast(id % 7 as double) y")
    for size in (8, 90):
        rows = resample.bootstrap_weights(table, ["x", "y"], 300, seed=3, size=size)
        per = rows.groupBy("draw").agg(F.sum("w").alias("n"), F.count_distinct("x").alias("rows")).collect()
        assert len(per) == 300 and {r["n"] for r in per} == {90}
        assert np.mean([r["rows"] for r in per]) == pytest.approx(90 * (1 - (1 - 1 / 90) ** 90), abs=1.5)
        of = rows.groupBy("x").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("s")).collect()
        assert max(abs(r["n"] / 300 - 1) for r in of) < 0.3 and np.mean([r["s"] for r in of]) / 300 == pytest.approx(2, abs=0.1)  # mean 1, variance near 1
        again = resample.bootstrap_weights(table.repartition(3), ["x", "y"], 300, seed=3, size=size)
        assert rows.exceptAll(again).count() == 0 and again.exceptAll(rows).count() == 0


@pytest.mark.parametrize("size", [16, 512])
def test_paired_bootstrap_of_tied_ranks(spark, size):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=60), 1)
    b = np.round(a + rng.normal(size=60), 1)
    table = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (1.0, float("nan"))], "a double, b double")
    got = resample.paired_bootstrap(table, "a", "b", draws=800, size=size).first()
    draws = [rng.integers(0, 60, 60) for _ in range(800)]
    plain = [np.corrcoef(plain_ranks(a[i]), plain_ranks(b[i]))[0, 1] for i in draws]
    assert got["draws"] == 800 and got["ci_low"] == pytest.approx(np.percentile(plain, 2.5), abs=0.05) and got["ci_high"] == pytest.approx(np.percentile(plain, 97.5), abs=0.05)
    got = resample.paired_bootstrap(table, "a", "b", resample.median_difference, draws=800, size=size).first()
    plain = [np.median(a[i] - b[i]) for i in draws]
    assert got["ci_low"] == pytest.approx(np.percentile(plain, 2.5), abs=0.1) and got["ci_high"] == pytest.approx(np.percentile(plain, 97.5), abs=0.1)
    assert tuple(resample.paired_bootstrap(table.where("a > 1e9"), "a", "b", draws=5).first()) == (0, None, None)


def test_lstm_gradients_and_learning(spark):
    rng = np.random.default_rng(0)
    net, x, y = evaluate.Recurrent(3, 4, rng), rng.normal(size=(6, 5, 3)), rng.normal(size=6)
    loss = lambda: ((net.forward(x)[0] - y) ** 2).mean()
    for p, g in zip(net.params, net.gradients(x, y)):
        for k in range(0, p.size, 7):
            p.flat[k] += 1e-6
            up = loss()
            p.flat[k] -= 2e-6
            down = loss()
            p.flat[k] += 1e-6
            assert g.flat[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    rows = [(k % 4 == 0, rng.normal(size=(8, 5)).tolist()) for k in range(1200)]
    table = spark.createDataFrame([(t, w, float(np.tanh(w[-1][0]) + 0.5 * w[-2][1])) for t, w in rows], "is_test boolean, window array<array<double>>, r double")
    got = evaluate.recurrent_residual(table, epochs=60, batch=256)
    assert got.count() == 300 and evaluate.r2(got, "r", F.col("prediction")).first()["r2"] > 0.7
    few = evaluate.recurrent_residual(table.limit(300))
    assert few.where("prediction is not null").count() == 0


def test_network_scores_every_test_row_and_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    table = spark.createDataFrame([(float(a), float(b), float(np.sin(a) + 0.3 * b)) for a, b in x], "a double, b double, r double")
    got = evaluate.neural_residual(table, table, ["a", "b"], epochs=200, rate=2e-2, decay=0.0, train_rows=1000)
    assert got.count() == 3000 and evaluate.r2(got, "r", F.col("prediction")).first()["r2"] > 0.9


def test_last_block_counts_blocks(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (2, 7)], "unit long, block long")
    rows = {(r["unit"], r["block"]): (r["block_no"], r["is_test"]) for r in evaluate.last_block(df, U).collect()}
    assert rows == {(1, 5): (1, False), (1, 9): (2, True), (2, 7): (1, True)}
    assert evaluate.last_block(df, []).where("is_test").count() == 1


@pytest.mark.parametrize("chunk", [40, 100, 10_000])
def test_chunks_of_time_give_the_same_segments(spark, chunk):
    rng = np.random.default_rng(2)
    us = [int(x) * 1_000_000 for x in np.cumsum(rng.choice([10, 20, 30, 31, 300], 400))]
    rows = series(spark, [1.0] * 400, [1.0] * 400, us).withColumn("unit", F.col("us") % 3)
    key = lambda df: sorted(map(tuple, df.select("unit", "us", "dt_s", "segment_id").collect()))
    assert key(clean.chunked_segments(rows, U, "us", 60, chunk)) == key(segmented(rows, 60))


@pytest.mark.parametrize("chunk", [10, 25, 70, 10_000])
def test_chunks_of_time_give_the_same_null_runs(spark, chunk):
    rng = np.random.default_rng(9)
    us = [int(x) * 1_000_000 for x in np.cumsum(rng.choice([10, 20, 90], 300))]
    held, t = True, []
    for _ in range(300):
        held = held if rng.random() < 0.7 else not held
        t.append(1.0 if held else None)
    rows = series(spark, t, [1.0] * 300, us).withColumn("unit", F.col("us") % 3)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(clean.null_runs(rows, U, "us", "t", chunk)) == key(clean.null_runs(rows, U, "us", "t"))
    nothing = rows.withColumn("t", F.lit(None).cast("double"))
    assert {r["runs"] for r in clean.null_runs(nothing, U, "us", "t", chunk).collect()} == {1}


@pytest.mark.parametrize("chunk", [25, 70, 10_000])
def test_chunks_of_time_give_the_same_pairs(spark, chunk):
    rng = np.random.default_rng(6)
    us = [int(x) * 1_000_000 for x in np.cumsum(rng.choice([10, 20, 31, 300], 300, p=[0.6, 0.3, 0.05, 0.05]))]
    t = [float(x) if x > 0.08 else (None if x > 0.04 else float("nan")) for x in rng.random(300)]
    rows = series(spark, t, [float(k) for k in range(300)], us).withColumn("unit", F.floor(F.col("p") / 150).cast("long"))
    whole = segmented(rows)
    want = runs.lead_pairs(runs.finite_runs(whole, U, "us", "t", "p"), U)
    got = runs.chunked_pairs(clean.chunked_segments(rows, U, "us", 30, chunk), U, "us", "t", "p", chunk)
    key = lambda df: sorted(map(tuple, df.select("unit", "run_id", "idx", "us", "t", "p", "run_len", "y").collect()))
    assert key(got) == key(want) and len(key(want)) > 100


def test_validity_keeps_every_unit_and_says_why(spark):
    fits = spark.createDataFrame([(1, 3000, 0.9), (2, 3000, 1.2), (3, 10, 0.9), (4, 3000, 0.9), (5, 0, None)], "unit long, n_pairs long, alpha double")
    boots = spark.createDataFrame([(1, 400), (2, 400), (3, 400), (4, 5)], "unit long, valid_fits long")
    got = {r["unit"]: r["reason"] for r in population.unit_validity(fits, boots, U).collect()}
    assert got == {1: None, 2: "unstable alpha", 3: "below MIN_PAIRS or few boot fits", 4: "below MIN_PAIRS or few boot fits", 5: "no segments"}


# -- streams


def test_stream_in_any_order_of_files_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    t, p = arx_series(0.8, 0.05, 2.0, n=300, noise=0.5)
    us = [int(x) * 1_000_000 for x in np.cumsum(rng.choice([10, 10, 10, 10, 200], 300))]
    t[40] = t[41] = float("nan")
    order = np.argsort(np.arange(300) + rng.uniform(0, 20, 300))  # up to 20 places late
    rows = series(spark, t, p, us).join(spark.createDataFrame([(int(us[k]), place // 60) for place, k in enumerate(order.tolist())], "us long, part int"), "us").select("unit", "us", "t", "p", "part")
    late = 20 * 200.0
    silent = spark.createDataFrame([(2, us[k], float(t[k + 50]), float(p[k + 50]), 0) for k in range(40)], rows.schema)  # another unit, which ends early
    job = lambda s: rolling.count_windows(s, 8, 60, 10.0, late, baseline=3, threshold=1.0)
    both = rows.unionByName(silent)
    whole = {u: monitor.rolling(runs.finite_runs(segmented(both.where(F.col("unit") == u), 60), U, "us", "t", "p"), U, 10.0, 8).orderBy("ord").collect() for u in (1, 2)}
    for beat in (False, True):
        fed = both.unionByName(spark.createDataFrame([(rolling.BEAT, us[-1] + int((late + 62) * 1_000_000), None, None, 9)], rows.schema)) if beat else both
        got = rolling.replayed(fed, "part", str(tmp_path / f"in{beat}"), job, str(tmp_path / f"out{beat}"), 1)
        for u, batch in whole.items():
            own = got.where(F.col("unit") == u).orderBy("window").collect()
            n = len(own)
            assert n == len(batch) if beat or u == 2 else 5 < n < len(batch)  # what falls silent is closed without a beat
            assert [r["tau"] for r in own] == pytest.approx([r["tau"] for r in batch[:n]])
            assert [r["samples"] for r in own] == [r["samples"] for r in batch[:n]]
            assert [r["window"] for r in own] == list(range(1, n + 1))
            base = np.array([r["tau"] for r in own[:3]])
            z = [abs(r["tau"] - np.median(base)) / (1.4826 * np.median(np.abs(base - np.median(base))) + 1e-9) for r in own[3:]]
            assert [r["z"] for r in own[3:]] == pytest.approx(z) and any(r["persisted"] for r in own) == any(a > 1 and b > 1 for a, b in zip(z, z[1:]))


def test_session_stream_equals_segments(spark, tmp_path):
    rows = spark.createDataFrame([(1, k) for k in (0, 10, 40, 71, 100, 5000)], "unit long, s long").select("unit", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = rolling.sessions(stream, "ts", U, 30, "0 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["rows"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]  # the newest session is still open


# -- sources and sinks


def tree(tmp_path, hosts=("a", "b"), rows=40):
    rng = np.random.default_rng(0)
    for host in hosts:
        for day in range(1 + (host == "a")):
            d = tmp_path / "tree" / host / "202001"
            d.mkdir(parents=True, exist_ok=True)
            stamps = [(day * rows + k) * 10_000_000 for k in range(rows)]
            columns = {c: rng.uniform(30, 60, rows) for c in telemetry.SENSORS}
            pq.write_table(pa.table({"timestamp": pa.array(stamps, pa.timestamp("us", "UTC")), "hostname": [host] * rows, **columns}), d / f"2020010{day + 1}.parquet")
    return str(tmp_path / "tree")


def test_command_line(spark, tmp_path):
    data, out = tree(tmp_path), str(tmp_path / "out")
    assert cli.main(["inventory", data, out, "--log", str(tmp_path / "log.txt")]) == 0
    assert spark.read.option("header", True).csv(f"{out}/column_coverage").where("column = 'p0_power' and hosts = 2").count() == 1
    assert cli.main(["clean", data, out]) == 0
    assert spark.read.parquet(f"{out}/cleaned").count() == 120 and spark.read.parquet(f"{out}/mask").columns[-1] == "host"
    m = {r["host"]: r for r in spark.read.json(f"{out}/manifests").collect()}
    assert m["a"]["provenance"]["n_source_files"] == 2 and m["a"]["cleaning"]["rows_before"] == m["a"]["cleaning"]["rows_after"] == 80 and m["b"]["audit"]["segments"] == 1
    assert cli.main(["compare", data, out, "--nodes", "1"]) == 0
    assert [r["host"] for r in spark.read.option("header", True).csv(f"{out}/policy").collect()] == ["a"]
    assert cli.main(["clean", str(tmp_path / "nowhere"), out]) == 0
    assert spark.read.json(f"{out}/status").first()["status"] == "BLOCKED"
    assert "BLOCKED" in (tmp_path / "log.txt").read_text() or "inventory" in (tmp_path / "log.txt").read_text()


def test_scan_of_one_host_is_pushed_to_its_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "host string, us long, t double")
    telemetry.write_cleaned(rows, str(tmp_path / "c"))
    one = spark.read.parquet(str(tmp_path / "c")).where("host = 'a'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(host" in plan and [r["t"] for r in one.collect()] == [1.0]
    assert [r[0] for r in telemetry.hosts(spark, str(tmp_path / "c")).collect()] == ["a", "b"]
    telemetry.write_pilot(rows, str(tmp_path / "p"), ["t"])
    assert sorted(f.name for f in (tmp_path / "p").iterdir() if f.is_dir()) == ["host=a", "host=b"]


def test_nanosecond_files_leave_the_session_as_it_was(spark, tmp_path):
    d = tmp_path / "n" / "a" / "202001"
    d.mkdir(parents=True)
    pq.write_table(pa.table({"timestamp": pa.array([10**9], pa.timestamp("ns", "UTC")), "p0_power": [1.0]}), d / "x.parquet")
    got = telemetry.readings(spark, str(tmp_path / "n"), ["p0_power"], nanos=True)
    assert [tuple(r) for r in got.collect()] == [("a", 1_000_000, 1.0)]
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"


def test_a_stopped_job_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "host string, v double")
    path = str(tmp_path / "ck")
    assert telemetry.checkpointed(rows.where("host = 'a'"), path, ["host"]).count() == 1
    again = telemetry.checkpointed(rows.withColumn("v", F.col("v") + 10), path, ["host"])
    assert sorted(map(tuple, again.collect())) == [("a", 1.0), ("b", 12.0)]


def test_json_documents_and_dataset_override(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text(json.dumps({"a": {"b": [1, 2]}}, indent=2))
    assert telemetry.json_documents(spark, str(tmp_path / "x.json")).first()["a"]["b"] == [1, 2]
    assert telemetry.json_documents(spark, str(tmp_path / "x.json"), "a struct<b array<double>>").first()["a"]["b"] == [1.0, 2.0]
    monkeypatch.setenv(telemetry.DATASET_VARIABLE, "/elsewhere")
    assert telemetry.dataset("/here") == "/elsewhere"


def test_numeric_columns_and_seeded_caps(spark):
    df = spark.createDataFrame([("h", 1, 2.0, "x")], "host string, us long, t double, s string")
    assert clean.numeric_columns(df) == ["t"]
    many = spark.range(1000)
    assert {r[0] for r in evaluate.capped(many, F.col("id"), 100).collect()} == {r[0] for r in evaluate.capped(many.repartition(7), F.col("id"), 100).collect()}


def test_month_of_a_run_is_its_first_rows(spark):
    us = [int(x) * 1_000_000 for x in (1580515180, 1580515190, 1580515200, 1580515210)]  # 23:59:40 of January 31st on
    rows = runs.with_blocks(runs.finite_runs(segmented(series(spark, [1.0] * 4, [1.0] * 4, us)), U, "us", "t", "p"), U, "us")
    assert {r["block"] for r in rows.collect()} == {"2020-01"}


def test_shared_folder(spark, tmp_path):
    df, path = shared.stored(spark.range(5), "five")
    assert df.count() == 5 and path.startswith(shared.own_dir(spark))
    shared.remove(spark, path)
    assert not list((tmp_path).glob("five*"))


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_quantiles_by_key_are_exact(spark, ranges):
    rng = np.random.default_rng(4)
    groups = {"a": np.concatenate([rng.lognormal(0, 3, 500), np.full(300, 2.5), -rng.integers(0, 9, 200)]).astype(float), "b": np.full(5, 7.0), "c": np.array([1.0, 4.0]), "d": np.array([-1e308, 0.0, 1e308])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("e", None), ("c", float("inf"))]
    counts = population.value_counts(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    qs = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q5005": 0.5005, "q99": 0.99, "q100": 1.0}
    got = {r["k"]: r for r in population.quantiles(counts, ["k"], qs, ranges).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for k, values in groups.items():
        assert [got[k][n] for n in qs] == pytest.approx(np.percentile(values, [100 * q for q in qs.values()]).tolist()), k
    whole = spark.createDataFrame([(float(v),) for v in groups["a"]], "v double")
    assert population.quantiles(population.value_counts(whole, [], "v"), [], {"m": 0.5}).first()["m"] == pytest.approx(np.median(groups["a"]))
    assert population.quantiles(population.value_counts(whole.limit(0), [], "v"), [], {"m": 0.5}).first()["m"] is None
    places = population.placed_values(counts, ["k"], ranges).where("k = 'a'").orderBy("v").collect()
    assert [r["before"] for r in places] == np.cumsum([0, *(r["w"] for r in places)])[:-1].tolist()


def test_audits_hold_no_keys_values(spark):
    rows = series(spark, [1.0] * 50, [1.0] * 50, [10_000_000 * k for k in range(50)])
    for df in (clean.temporal_audit(segmented(rows), U, "us"), profile.sampling_summary(rows, U, "us"), profile.quick_audit(rows, U, "us"), clean.median_gap_segments(rows, U, "us", least=2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in ("median(", "percentile(", "mode(") if x in plan.lower()]


def test_ranges_come_from_footers_and_from_data_where_those_lack_them(spark, tmp_path):
    stamps = pa.array([None, 5, 7_000], pa.timestamp("ms"))
    table = pa.table({"timestamp": stamps, "a": pa.array([float("nan"), 2.5, None]), "b": pa.array([3, None, None], pa.int32()), "c": ["x", None, "y"], "d": [[1, None], None, []], "none": pa.array([None] * 3, pa.int64())})
    for host, stated in (("h1", True), ("h2", False), ("h3", ["timestamp"])):
        (tmp_path / host / "2020").mkdir(parents=True)
        pq.write_table(table, tmp_path / host / "2020" / "x.parquet", write_statistics=stated, row_group_size=2)
    pq.write_table(table.slice(0, 0), tmp_path / "h1" / "2020" / "y.parquet")
    (tmp_path / "h2" / "2020" / "z.parquet").write_bytes(b"not a file")
    rows = telemetry.column_ranges(spark, str(tmp_path))
    got = {(r["host"], r["column"]): r for r in profile.footer_profile(rows, ["host"]).collect()}
    want = {"timestamp": (1, 5_000.0, 7_000_000.0), "a": (1, 2.5, 2.5), "b": (2, 3.0, 3.0), "c": (1, None, None), "d": (1, None, None), "none": (3, None, None)}
    assert {k: (r["nulls"], r["least"], r["greatest"]) for k, r in got.items()} == {(h, c): v for h in ("h1", "h2", "h3") for c, v in want.items()}
    assert {r["rows"] for r in got.values()} == {3} and got["h1", "a"]["files"] == 2
    assert {c for h, c in got if h == "h1" and got[h, c]["data_bytes"]} == {"d"}
    assert all(got["h2", c]["data_bytes"] for c in want) and not got["h3", "timestamp"]["data_bytes"] and got["h3", "a"]["data_bytes"]
    assert rows.where("error is not null").count() == 1
    assert {r["column"] for r in telemetry.column_ranges(spark, str(tmp_path / "h1"), ["b"]).collect()} == {"b"}
