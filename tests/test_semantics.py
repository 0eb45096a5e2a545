"""Small cases with known answers."""

import hashlib
import inspect
import io
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heatline.functions import scalar
from heatline.operators import arx, clean, evaluate, monitor, population, report, resample, runs, scan
from heatline.plans import catalog
from heatline.sources import telemetry
from heatline.streaming import rolling

U = ["unit"]


def series(spark, t, p, us=None, unit=1):
    us = us or [10_000_000 * k for k in range(len(t))]
    return spark.createDataFrame([(unit, int(u), a, b) for u, a, b in zip(us, t, p, strict=True)], "unit long, us long, t double, p double")


def segmented(df, gap=30):
    return clean.with_segments(clean.with_gaps(df, U, "us"), U, "us", gap)


def test_thirty_seconds_stay_together_and_thirty_one_split(spark):
    rows = segmented(series(spark, [1.0] * 4, [1.0] * 4, [0, 30_000_000, 61_000_000, 71_000_000])).orderBy("us").collect()
    assert [r["segment_id"] for r in rows] == [0, 0, 1, 1]
    assert [r["dt_s"] for r in rows] == [None, 30, 31, 10]


def test_runs_break_at_missing_values_and_drop_singles(spark):
    df = segmented(series(spark, [1.0, 2.0, None, 4.0, float("nan"), 6.0, 7.0], [1.0] * 7))
    rows = runs.finite_runs(df, U, "us", "t", "p").orderBy("us").collect()
    assert [(r["t"], r["idx"], r["run_len"]) for r in rows] == [(1.0, 0, 2), (2.0, 1, 2), (6.0, 0, 2), (7.0, 1, 2)]


def test_quantize_is_half_even_and_decimate_keeps_even_places(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(scalar.quantize(F.col("x"))).collect()] == [0.0, 2.0, 2.0]
    got = runs.decimate(runs.finite_runs(segmented(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [1.0] * 5)), U, "us", "t", "p"), U).orderBy("us").collect()
    assert [(r["t"], r["idx"], r["run_len"]) for r in got] == [(1.0, 0, 3), (3.0, 1, 3), (5.0, 2, 3)]


def arx_series(alpha, beta, gamma, n=200, seed=1, noise=0.0):
    rng = np.random.default_rng(seed)
    p, t = rng.uniform(50, 150, n), [40.0]
    for k in range(n - 1):
        t.append(alpha * t[-1] + beta * p[k] + gamma + noise * rng.normal())
    return [float(x) for x in t], [float(x) for x in p]


def test_noiseless_coefficients_are_recovered(spark):
    t, p = arx_series(0.9, 0.02, 1.5)
    pairs = runs.lead_pairs(runs.finite_runs(segmented(series(spark, t, p)), U, "us", "t", "p"), U)
    fits = arx.fit(pairs, U, 10.0)
    r = fits.first()
    assert (r["alpha"], r["beta"], r["gamma"]) == pytest.approx((0.9, 0.02, 1.5), rel=1e-7)
    assert r["tau"] == pytest.approx(-10 / np.log(0.9), rel=1e-6)
    m = arx.metrics(arx.residuals(pairs, fits, U), U).first()
    assert m["rmse"] < 1e-6 and m["increment_r2"] == pytest.approx(1.0)


def test_unstable_and_singular_fits_have_no_time_constant(spark):
    grows = [2.0**k for k in range(12)]
    assert arx.fit(runs.lead_pairs(runs.finite_runs(segmented(series(spark, grows, [float(k % 3) for k in range(12)])), U, "us", "t", "p"), U), U, 10.0).first()["tau"] is None
    assert arx.fit(runs.lead_pairs(runs.finite_runs(segmented(series(spark, grows, [5.0] * 12)), U, "us", "t", "p"), U), U, 10.0).first()["alpha"] is None


def test_delta_method_agrees_with_numpy(spark):
    t, p = arx_series(0.8, 0.05, 2.0, noise=0.5)
    pairs = runs.lead_pairs(runs.finite_runs(segmented(series(spark, t, p)), U, "us", "t", "p"), U)
    r = arx.uncertainty(arx.fit(pairs, U, 10.0), U, 10.0).first()
    x = np.column_stack([t[:-1], p[:-1], np.ones(len(t) - 1)])
    b, *_ = np.linalg.lstsq(x, np.array(t[1:]), rcond=None)
    e = np.array(t[1:]) - x @ b
    se = np.sqrt(e @ e / (len(e) - 3) * np.linalg.inv(x.T @ x)[0, 0])
    assert r["se_alpha"] == pytest.approx(se, rel=1e-6)
    assert r["se_tau"] == pytest.approx(10 / (b[0] * np.log(b[0]) ** 2) * se, rel=1e-6)


def test_block_bootstrap_is_repeatable_and_covers(spark):
    t, p = arx_series(0.8, 0.05, 2.0, n=600, noise=0.5)
    rows = runs.finite_runs(segmented(series(spark, t, p)), U, "us", "t", "p")
    a, b = (resample.block_bootstrap(rows, U, 10.0, 100, 160.0).first() for _ in range(2))
    assert a == b and a["ci_low"] < -10 / np.log(0.8) < a["ci_high"]
    short = resample.block_bootstrap(series(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 1.0]).withColumn("run_id", F.lit(1)).withColumn("idx", F.col("us") / 10_000_000), U, 10.0).first()
    assert short["reason"] and short["tau_median"] is None


def test_alert_runs_of_two_are_marked_from_their_first(spark):
    tau = [10.0, 11.0, 9.0, 10.5, 9.5, 10.0] + [10.0, 90.0, 10.0, 90.0, 95.0, 10.0]
    w = spark.createDataFrame([(1, k + 1, x, 1.0) for k, x in enumerate(tau)], "unit long, ord long, tau double, mean_p double")
    rows = monitor.scored(w, U).orderBy("ord").collect()
    assert [r["persisted"] for r in rows[6:]] == [False, False, False, True, True, False]
    odd = monitor.scored(spark.createDataFrame([(1, k + 1, x, 1.0) for k, x in enumerate([*tau, 10.0])], "unit long, ord long, tau double, mean_p double"), U)
    assert odd.where("baseline").count() == 6


def test_spearman_of_a_monotone_map_with_ties(spark):
    df = spark.createDataFrame([(1, float(k // 2), float((k // 2) ** 3)) for k in range(10)], "g long, x double, y double")
    assert population.spearman(df, "x", "y", ["g"]).first()["rho"] == pytest.approx(1.0)


def test_gates_name_what_fails(spark):
    df = segmented(series(spark, [50.0, 200.0, 60.0], [1.0, -1.0, 2.0], [0, 20_000_000, 40_000_000]))
    got = clean.gates(clean.temporal_audit(df, U, "us"), clean.physical_audit(df, U, "us", "t", "p"), U).first()["failures"]
    assert got == ["dominant step is off the grid", "temperature out of range", "negative power"]


def test_binning_reduces_by_suffix_and_ignores_order(spark):
    rows = [(1, 0, 1.0, 1.0, 1.0), (1, 0, 3.0, 3.0, 3.0), (1, 10, 5.0, 5.0, 5.0)]
    for r in (rows, rows[::-1]):
        got = clean.bin_dedupe(spark.createDataFrame(r, "unit long, us long, a_mean double, a_min double, a_max double"), U, "us", ["a_mean", "a_min", "a_max"]).orderBy("us").collect()
        assert [tuple(x)[2:] for x in got] == [(2.0, 1.0, 3.0, 2), (5.0, 5.0, 5.0, 1)]


def test_mixed_float_types_nanoseconds_and_footers(spark, tmp_path):
    for host, kind in (("a", pa.float32()), ("b", pa.float64())):
        d = tmp_path / "tree" / host / "202001"
        d.mkdir(parents=True)
        pq.write_table(pa.table({"timestamp": pa.array([0, 10_000_000], pa.timestamp("us", "UTC")), "p0_power": pa.array([1.5, float("nan")], kind)}), d / "20200101.parquet")
    got = telemetry.readings(spark, str(tmp_path / "tree"), ["p0_power"]).orderBy("host", "us").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1.5), ("a", 10_000_000, None), ("b", 0, 1.5), ("b", 10_000_000, None)]
    assert [r[0] for r in telemetry.hosts(spark, str(tmp_path / "tree")).collect()] == ["a", "b"]
    (tmp_path / "tree" / "b" / "202001" / "bad.parquet").write_bytes(b"no")
    f = telemetry.footers(spark, str(tmp_path / "tree")).orderBy("path").collect()
    assert [(r["host"], r["rows"]) for r in f] == [("a", 2), ("b", 2), ("b", None)] and f[2]["error"]


def test_archive_members_and_readings(spark, tmp_path):
    buffer = io.BytesIO()
    pd.DataFrame({"timestamp": pd.to_datetime([0, 10], unit="s", utc=True), "p0_power": [1.0, 2.0]}).to_parquet(buffer)
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        info = tarfile.TarInfo("h1/202001/20200101.parquet")
        info.size = len(buffer.getvalue())
        tar.addfile(info, io.BytesIO(buffer.getvalue()))
    assert [tuple(r)[:2] for r in telemetry.archive_members(spark, str(tmp_path / "x.tar")).collect()] == [("h1/202001/20200101.parquet", "h1")]
    assert [tuple(r) for r in telemetry.archive_readings(spark, str(tmp_path / "x.tar"), ["p0_power"]).collect()] == [("h1", 0, 1.0), ("h1", 10_000_000, 2.0)]


def _tar(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def _parquet(seconds, **columns):
    buffer = io.BytesIO()
    pd.DataFrame({"timestamp": pd.to_datetime(seconds, unit="s", utc=True), **columns}).to_parquet(buffer)
    return buffer.getvalue()


def test_archives_plain_packed_and_cut(spark, tmp_path):
    one, two = _parquet([0, 10], p0_power=[1.0, None], p1_power=[5.0, 6.0]), _parquet([20], p1_power=[7.0])
    _tar(tmp_path / "a.tar", [("h1/202001/1.parquet", one), ("h1/readme.txt", b"x"), ("h2/202001/1.parquet", two)])
    _tar(tmp_path / "b.tar.gz", [("./h3/202001/1.parquet", one)], "w:gz")
    _tar(tmp_path / "empty.tar", [])
    want = [("h1", 0, 1.0), ("h1", 10_000_000, None), ("h2", 20_000_000, None), ("h3", 0, 1.0), ("h3", 10_000_000, None)]
    for tasks in (None, 5):
        assert sorted(map(tuple, telemetry.archive_readings(spark, str(tmp_path / "*"), ["p0_power"], tasks=tasks).collect()), key=str) == want
    members = {r["member"]: r for r in telemetry.archive_members(spark, str(tmp_path / "*")).collect()}
    assert set(members) == {"h1/202001/1.parquet", "h2/202001/1.parquet", "./h3/202001/1.parquet"} and members["./h3/202001/1.parquet"]["offset"] is None
    at = members["h2/202001/1.parquet"]["offset"]
    assert (tmp_path / "a.tar").read_bytes()[at : at + len(two)] == two
    (tmp_path / "cut.tar").write_bytes((tmp_path / "a.tar").read_bytes()[: at + 100])
    (tmp_path / "junk.tar").write_bytes(b"no archive" * 100)
    errors = sorted((r["path"].rsplit("/", 1)[1], r["member"], r["error"] == "truncated") for r in telemetry.archive_members(spark, str(tmp_path / "*.tar")).where("error is not null").collect())
    assert errors == [("cut.tar", "h2/202001/1.parquet", True), ("junk.tar", None, False)]
    with pytest.raises(Exception, match="truncated"):
        telemetry.archive_readings(spark, str(tmp_path / "cut.tar"), ["p0_power"]).collect()
    assert telemetry.archive_readings(spark, str(tmp_path / "cut.tar"), ["p0_power"], broken="skip").count() == 2


def test_archive_of_three_gigabytes_reads_in_many_tasks(spark, tmp_path):
    member = _parquet([0, 10], p0_power=[1.0, 2.0])
    with open(tmp_path / "big.tar", "wb") as f:
        for k in range(3):  # a hole of a gigabyte lies between the members, so the file takes no disk
            for name, data, size in ((f"h{k}/202001/1.parquet", member, len(member)), (f"h{k}/hole.bin", b"", 1 << 30)):
                info = tarfile.TarInfo(name)
                info.size = size
                f.write(info.tobuf(tarfile.GNU_FORMAT) + data)
                f.seek((f.tell() + size - len(data) + 511) // 512 * 512)
        f.write(b"\0" * 1024)
    assert (tmp_path / "big.tar").stat().st_size > 3 << 30
    rows = telemetry.archive_readings(spark, str(tmp_path / "big.tar"), ["p0_power"])
    assert rows.rdd.getNumPartitions() >= 24 and sorted(map(tuple, rows.where("us = 0").collect())) == [(f"h{k}", 0, 1.0) for k in range(3)]


def test_digests_in_blocks(spark, tmp_path, monkeypatch):
    files = {"a.bin": b"x" * 1000, "empty": b"", "b.bin": bytes(range(256)) * 40_000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["source"]: (r["digest"], r["bytes"]) for r in report.digests(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(x).hexdigest(), len(x)) for n, x in files.items() if x}
    monkeypatch.setattr(report, "OPENED", ())
    assert {r["source"]: (r["digest"], r["bytes"]) for r in report.digests(spark, str(tmp_path)).collect()} == got


@pytest.mark.parametrize("days", [1, 3, 400])
def test_scans_agree_at_every_chunk_size(spark, days):
    rng = np.random.default_rng(4)
    us = np.cumsum(rng.choice([3600, 7200, 90_000], 300)) * 1_000_000
    rows = [(int(k % 2), int(u), None if rng.random() < 0.1 else float(v), float(v)) for k, (u, v) in enumerate(zip(us, rng.normal(size=300)))]
    df = spark.createDataFrame([*rows, *[(None, u, t, p) for _, u, t, p in rows[:40]]], "unit int, us long, t double, p double")
    w = Window.partitionBy("unit").orderBy("us")
    want = df.select("unit", "us", F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s"), F.lag("t").over(w).alias("before"), F.row_number().over(w).alias("n"))
    got = scan.carried(df, ["unit"], ["us"], scan.time_chunk("us", days * 86_400), {"s": F.col("p"), "n": F.lit(1)}, {"before": F.col("t")})
    key = lambda rs: sorted((str(r["unit"]), r["us"], round(r["s"], 9), r["before"]) for r in rs)
    assert key(got.collect()) == key(want.collect())
    seg = clean.with_segments(clean.with_gaps(df.where("unit is not null"), ["unit"], "us"), ["unit"], "us", 50_000)
    plain, cut = runs.finite_runs(seg, ["unit"], "us", "t", "p"), runs.chunked_runs(seg, ["unit"], "us", "t", "p", days * 86_400)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.select(plain.columns).collect()))
    steps = clean.chunked_steps(seg, ["unit"], "us", "p", "step", days * 86_400).select("unit", "us", F.round("step", 9).alias("step"))
    assert sorted(map(str, steps.collect())) == sorted(map(str, seg.select("unit", "us", F.round(clean.within_segment_step(seg, ["unit"], "us", "p"), 9).alias("step")).collect()))
    alerts = df.where("unit is not null").withColumn("hot", F.col("p") > 0)
    island = F.sum((~F.col("hot")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    size = F.sum(F.col("hot").cast("long")).over(Window.partitionBy("unit", "i"))
    lengths = alerts.withColumn("i", island).select("unit", "us", F.when(F.col("hot"), size).otherwise(0).alias("len"))
    found = scan.stretches(alerts, ["unit"], ["us"], scan.time_chunk("us", days * 86_400), "hot", "len").select("unit", "us", "len")
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, found.collect()))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "host string, us long, t double")
    telemetry.write_cleaned(df, str(tmp_path / "c"))
    assert sorted(r["host"] for r in spark.read.parquet(str(tmp_path / "c")).collect()) == ["a", "b"]
    telemetry.write_table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert '"t": 1.0' in telemetry.document(df)
    assert report.markdown(df.orderBy("host"), {"t": "%.1f"}).splitlines()[2] == "| a | 0 | 1.0 |"
    assert report.digests(spark, str(tmp_path / "csv"), 12).where("length(digest) = 12").count() >= 1


def test_stream_equals_batch_on_full_windows(spark, tmp_path):
    t, p = arx_series(0.8, 0.05, 2.0, n=64, noise=0.5)
    rows = series(spark, t, p, [10_000_000 * (k + 1) for k in range(64)]).withColumn("part", F.floor(F.col("us") / 200_000_000).cast("int"))
    beat = spark.createDataFrame([(rolling.BEAT, 10**10, None, None, 10**6)], rows.schema)
    job = lambda s: rolling.count_windows(s, 16, 30, 10.0)
    stream = [r["tau"] for r in rolling.replayed(rows.unionByName(beat), "part", str(tmp_path / "in"), job, str(tmp_path / "out"), 1).orderBy("window").collect()]
    batch = monitor.rolling(runs.finite_runs(segmented(rows), U, "us", "t", "p"), U, 10.0, 16).orderBy("ord").collect()
    assert stream == pytest.approx([r["tau"] for r in batch]) and len(stream) == 4


def test_expanding_folds_match_numpy(spark):
    t, p = arx_series(0.8, 0.05, 2.0, n=120, noise=0.5)
    pairs = runs.lead_pairs(runs.finite_runs(segmented(series(spark, t, p)), U, "us", "t", "p"), U).withColumn("block", F.floor(F.col("idx") / 40))
    got = evaluate.expanding_folds(pairs, U).orderBy("block").collect()
    x, y = np.column_stack([t[:-1], p[:-1], np.ones(119)]), np.array(t[1:])
    for r in got:
        k = 40 * r["block"]
        b, *_ = np.linalg.lstsq(x[:k], y[:k], rcond=None)
        e = y[k : k + 40] - x[k : k + 40] @ b
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean(e**2)), rel=1e-6)


def test_permutation_null_takes_every_event_in_every_draw(spark, tmp_path):
    base = spark.createDataFrame([(k, float(k * k % 97), float(k % 13)) for k in range(60)], "k long, y double, pred double")
    got = {r["draw"]: r for r in evaluate.permutation_null(base, "y", "pred", "k").collect()}
    assert sorted(got) == list(range(200)) and {r["n"] for r in got.values()} == {60}
    y, pred = np.array([float(k * k % 97) for k in range(60)]), np.array([float(k % 13) for k in range(60)])
    mixed = base.crossJoin(spark.range(200).withColumnRenamed("id", "draw")).select("draw", "k", F.xxhash64("k", "draw", F.lit(0)).alias("h")).collect()
    for draw in range(200):
        order = [k for _, k in sorted((r["h"], r["k"]) for r in mixed if r["draw"] == draw)]
        assert got[draw]["r2"] == pytest.approx(1 - ((y[order] - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = catalog.QUERIES["perm_null"](spark, str(tmp_path)).collect()
    assert len(rows) == 200 and {r["n"] for r in rows} == {300}


@pytest.mark.parametrize("query, module, operator, want", [("gbt_residual", evaluate, "residual_model", {"iterations": 200}), ("block_bootstrap", resample, "block_bootstrap", {"draws": 500, "block_s": 640.0, "least": 8}), ("paired_bootstrap", resample, "paired_bootstrap", {"draws": 2000})])
def test_registered_with_the_operators_own_parameters(spark, monkeypatch, query, module, operator, want):
    class Called(Exception):
        pass

    signature = inspect.signature(getattr(module, operator))

    def called(*a, **b):
        bound = signature.bind(*a, **b)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(module, operator, called)
    with pytest.raises(Called) as e:
        catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == want


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_readings_far_from_zero_lose_no_digits(spark, shift):
    t, p = arx_series(0.8, 0.05, 2.0, n=400, noise=0.05)
    near = runs.lead_pairs(runs.finite_runs(segmented(series(spark, t, p)), U, "us", "t", "p"), U)
    far = near.withColumns({c: F.col(c) + shift for c in ("t", "p", "y")})
    a, b = (arx.uncertainty(arx.fit(x, U, 10.0), U, 10.0).first() for x in (near, far))
    for c in ("alpha", "tau"):
        assert b[c] == pytest.approx(a[c], rel=1e-8)
    assert b["se_tau"] == pytest.approx(a["se_tau"], rel=1e-6) and b["rss"] == pytest.approx(a["rss"], rel=1e-6)
    folds = [evaluate.expanding_folds(x.withColumn("block", F.floor(F.col("idx") / 40)), U).orderBy("block").collect() for x in (near, far)]
    assert [r["increment_r2"] for r in folds[1]] == pytest.approx([r["increment_r2"] for r in folds[0]], rel=1e-6)
    m = [arx.residual_structure(arx.residuals(x, arx.fit(x, U, 10.0), U), U).first() for x in (near, far)]
    assert m[1]["lag1"] == pytest.approx(m[0]["lag1"], rel=1e-5) and m[1]["std"] == pytest.approx(m[0]["std"], rel=1e-6)
    lag = [resample.lcg_blocks(x, U, "unit", 8, 20, 30).orderBy("draw").collect() for x in (near, far)]
    assert [r["alpha"] for r in lag[1]] == pytest.approx([r["alpha"] for r in lag[0]], rel=1e-7)


def test_unions_of_blocks_have_the_moments_of_their_rows(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(1, k % 5, *map(float, 1e5 + rng.normal(size=3))) for k in range(200)], "unit long, block long, t double, p double, y double")
    from pyspark.sql import Window

    by = rows.groupBy("unit", "block").agg(*arx.moments())
    got = arx.united(by, U, "block", ["block"], lambda c: F.sum(c).over(Window.partitionBy("unit")) - c).collect()
    for r in got:
        want = rows.where(F.col("block") != r["block"]).agg(*arx.moments()).first()
        assert [r[c] for c in arx.MOMENTS] == pytest.approx([want[c] for c in arx.MOMENTS], rel=1e-8)


def test_leaves_share_one_multinomial():
    places, blocks, draws = 1000, 60, 400
    parts = np.array([resample.share_of(k, places, blocks, draws, 5, 64) for k in range(-(-places // 64))])
    assert (parts.sum(axis=0) == blocks).all()
    want = np.array([min(64, places - 64 * k) for k in range(len(parts))]) * blocks / places
    assert np.abs(parts.mean(axis=1) - want).max() < 0.5
    assert np.abs(parts.var(axis=1) - want * (1 - want / blocks)).max() < 1.5


def test_block_bootstrap_agrees_with_resampling_in_one_place(spark):
    """Two runs and a short one, in leaves of different sizes, against a plain simulation."""
    t, p = arx_series(0.85, 0.05, 2.0, n=500, noise=0.5)
    us = [10_000_000 * (k + (1000 if k > 300 else 0) + (2000 if k > 490 else 0)) for k in range(500)]
    rows = runs.finite_runs(segmented(series(spark, t, p, us)), U, "us", "t", "p")
    got = [resample.block_bootstrap(rows, U, 10.0, 400, 200.0, size=size).first() for size in (37, 4096)]
    block = 20
    parts = [(np.array(t[a:b]), np.array(p[a:b])) for a, b in ((0, 301), (301, 491), (491, 500))]
    starts = [(x, s) for x, (a, _) in enumerate(parts) for s in range(len(a) - block)]
    rng, taus = np.random.default_rng(1), []
    k = round((300 + 189) / block)
    for _ in range(400):
        x = np.concatenate([np.column_stack([parts[r][0][s : s + block], parts[r][1][s : s + block], np.ones(block), parts[r][0][s + 1 : s + block + 1]]) for r, s in (starts[j] for j in rng.integers(0, len(starts), k))])
        taus.append(-10 / np.log(np.linalg.lstsq(x[:, :3], x[:, 3], rcond=None)[0][0]))
    for r in got:
        assert (r["block_pairs"], r["blocks"], r["valid"], r["draws"]) == (block, k, 400, 400)
        assert r["tau_median"] == pytest.approx(np.median(taus), rel=0.05) and r["tau_std"] == pytest.approx(np.std(taus), rel=0.25)
        assert r["ci_low"] == pytest.approx(np.percentile(taus, 2.5), rel=0.1) and r["ci_high"] == pytest.approx(np.percentile(taus, 97.5), rel=0.1)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 37, 200])
def test_places_are_permuted_whole_in_every_draw(spark, n):
    mix = lambda v, draw, k: F.xxhash64(v, draw, F.lit(k))
    moved = evaluate.permuted(spark.range(n).crossJoin(spark.range(20).withColumnRenamed("id", "draw")), "id", n, "draw", mix).collect()
    by = {draw: [r["j"] for r in sorted(moved) if r["draw"] == draw] for draw in range(20)}
    assert all(sorted(js) == list(range(n)) for js in by.values())
    assert n < 16 or len(set(map(tuple, by.values()))) == 20
    stuck = evaluate.permuted(spark.range(n).withColumn("draw", F.lit(0)), "id", n, "draw", lambda v, draw, k: F.lit(k).cast("long")).collect()  # every half moves alike
    assert sorted(r["j"] for r in stuck) == list(range(n))


def test_keyed_permutation_null(spark):
    rows = [(k // 2, float(k * k % 97), float(k % 13)) for k in range(61)] + [(None, 3.0, 1.0), (7, None, 1.0), (8, 1.0, None)]
    base = spark.createDataFrame(rows, "k long, y double, pred double")
    got = evaluate.keyed_permutation_null(base, "y", "pred", "k", batch=64).collect()
    assert sorted(r["draw"] for r in got) == list(range(200)) and {r["n"] for r in got} == {62}
    assert {r["draw"]: r["r2"] for r in got} == pytest.approx({r["draw"]: r["r2"] for r in evaluate.keyed_permutation_null(base, "y", "pred", "k", batch=200).repartition(3).collect()})
    y, p = np.array([(r[1], r[2]) for r in rows if None not in r[1:]]).T
    rng, total = np.random.default_rng(0), ((y - y.mean()) ** 2).sum()
    free = [1 - ((rng.permutation(y) - p) ** 2).sum() / total for _ in range(2000)]
    found = np.array([r["r2"] for r in got])
    assert abs(found.mean() - np.mean(free)) < 4 * np.std(free) / np.sqrt(200) and 0.8 < found.std() / np.std(free) < 1.25
    assert evaluate.keyed_permutation_null(base.where("false"), "y", "pred", "k").count() == 0
