"""Cases of the third round's findings."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatline.operators import evaluate, population, resample
from heatline.plans import catalog
from heatline.sources import telemetry
from heatline.streaming import rolling

START = datetime.datetime(2024, 1, 1)


def write_events(spark, folder, rows):
    """rows: (event_id, microseconds after START, unit, value, k)."""
    table = [(e, START + datetime.timedelta(microseconds=us), u, "view", v, None if k is None else f'{{"k": {k}}}') for e, us, u, v, k in rows]
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def by_sql(name, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(c.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_f3_sessions_end_at_whole_seconds(spark, tmp_path):
    gap, at, rows = 43_200_000_000, 0, []
    for k, more in enumerate((0, 0, 500_000, 999_999, 1_000_000, -1)):
        at += gap + more if k else 0
        rows.append((k, at, 1, 1.0, 1))
    write_events(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in catalog.QUERIES["session_segments"](spark, str(tmp_path)).collect())
    assert got == by_sql("session_segments", tmp_path) and [r[1] for r in got] == [2, 4]


def test_f1_f2_draws_of_the_recurrence_are_rotations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluate, "permutation_null", None)  # no draw is sorted
    write_events(spark, tmp_path, [(k * 1_000_003 % 5003, k * 1_000_000, k % 7, k * k % 97 / 4, k % 13) for k in range(700)])
    for name in ("perm_null_lcg", "perm_null_summary"):
        got, want = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), by_sql(name, tmp_path)
        assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r], abs=2e-6 if name == "perm_null_lcg" else 2e-5)


def test_f1_negative_ids_are_sorted(spark, tmp_path):
    write_events(spark, tmp_path, [(k - 40, k * 1_000_000, 1, k * k % 97 / 4, k % 13) for k in range(90)])
    got = sorted(tuple(r) for r in catalog.QUERIES["perm_null_lcg"](spark, str(tmp_path)).collect())
    assert [x for r in got for x in r] == pytest.approx([x for r in by_sql("perm_null_lcg", tmp_path) for x in r], abs=2e-6)


def test_f1_tiles_hold_every_pair_once():
    n, shifts, size = 103, [0, 1, 50, 102], 20
    p, y = np.random.default_rng(0).normal(size=(2, n))
    p[5] = np.nan
    found = sum(evaluate.tile_errors(p[a * size : (a + 1) * size], y[b * size : (b + 1) * size], a * size, b * size, n, shifts).groupby("draw")["se"].sum().reindex(range(4), fill_value=0.0) for a, b in evaluate.tiles_of(n, shifts, size))
    assert list(found) == pytest.approx([np.nansum((np.roll(y, -s) - p) ** 2) for s in shifts])


@pytest.mark.parametrize("coded", [4, 1 << 16])
def test_f4_f5_chunks_meet_without_pairs_of_rows(spark, monkeypatch, coded):
    """Against permuted(), the same in columns; three chunks, values coded and whole."""
    monkeypatch.setattr(evaluate, "CODED", coded)
    n, draws = 140_000, 6
    base = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 % 101).cast("double").alias("y"), (F.col("id") * 11 % 37).cast("double").alias("pred"))
    calls = []
    monkeypatch.setattr(evaluate, "permuted", lambda *a, **b: calls.append(a))
    got = {r["draw"]: (r["n"], r["r2"]) for r in evaluate.keyed_permutation_null(base, "y", "pred", "k", draws=draws, batch=4).collect()}
    monkeypatch.undo()
    places = evaluate.placed(base.withColumn("m", F.xxhash64("k", F.lit(0))), [], F.shiftright("m", 54), [F.col("m"), F.col("k")]).withColumn("i", F.col("i") - 1)
    drawn = places.select("i", "pred").crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    met = evaluate.permuted(drawn, "i", n, "draw", lambda v, draw, k: F.xxhash64(v, draw, F.lit(k), F.lit(0))).drop("i").join(places.select(F.col("i").alias("j"), "y"), "j")
    want = {r["draw"]: (r["n"], r["r2"]) for r in evaluate.r2(met, "y", F.col("pred"), ["draw"]).collect()}
    assert not calls and sorted(got) == sorted(want)
    for d, (rows, r2) in want.items():
        assert got[d] == (rows, pytest.approx(r2, abs=1e-9))


def test_f7_units_of_many_leaves_draw_as_those_of_one(spark):
    rng = np.random.default_rng(3)
    rows = [(u, r, k, *map(float, rng.normal(size=3))) for u, n in ((1, 60), (2, 9)) for r in range(2) for k in range(n)]
    pairs = spark.createDataFrame([*rows, (3, 0, 0, 1.0, 1.0, 1.0)], "unit long, run_id long, idx long, t double, p double, y double")
    one, many = ({(r["unit"], r["draw"]): r["alpha"] for r in resample.lcg_blocks(pairs, ["unit"], "unit", 4, 12, 50, size=size).collect()} for size in (4096, 16))
    assert len(one) == 100 and one.keys() == many.keys() and [many[k] for k in one] == pytest.approx(list(one.values()), rel=1e-9)
    t, p, y = np.array([r[3:] for r in rows if r[0] == 1]).T
    starts = [60 * r + k for r in range(2) for k in range(57)]
    at = [starts[(1 * 7919 + 7 * 104729 + k * 1299709) * 48271 % 2147483647 % len(starts)] for k in range(12)]
    own = np.concatenate([np.arange(a, a + 4) for a in at])
    assert one[1, 7] == pytest.approx(np.linalg.lstsq(np.column_stack([t, p, np.ones(len(t))])[own], y[own], rcond=None)[0][0], rel=1e-7)


def test_f11_rows_beyond_the_range_of_the_last_are_left_out_first(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") % 3)
    for key in (F.col("id"), F.col("x")):
        want = sorted(tuple(r) for r in df.withColumn("h", F.xxhash64(F.lit(0), key)).orderBy("h", key).limit(700).select("h").collect())
        got = evaluate.capped(df, key, 700)
        assert got.columns == df.columns and sorted(tuple(r) for r in got.select(F.xxhash64(F.lit(0), key)).collect()) == want
    assert evaluate.capped(df, F.col("id"), 30_000).count() == 20_000
    kept = evaluate.below(df, F.xxhash64(F.lit(0), "id"), 700).count()
    assert 700 <= kept < 760


@pytest.mark.parametrize("size", [8, 512])
def test_f6_f8_f12_weights_stay_packed(spark, monkeypatch, size):
    """Against the same draws in rows; values that tie in many rows, few and none. No statistic makes rows of draws."""
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(k * 3, float(k % 4 if k % 2 else rng.integers(30)), float(rng.integers(12)) if k % 3 else rng.normal()) for k in range(130)], "unit long, a double, b double")
    plain = resample.bootstrap_weights(table, ["a", "b"], 60, 0, size)
    rho = {r["draw"]: r["rho"] for r in population.spearman(plain, "a", "b", ["draw"], "w").collect()}
    middle = {r["draw"]: r["m"] for r in population.quantiles(population.value_counts(plain, ["draw"], F.col("a") - F.col("b"), "w"), ["draw"], {"m": 0.5}).collect()}
    monkeypatch.setattr(resample, "unpacked", None)
    draw = lambda rows: resample.packed_weights(rows, ["a", "b"], 60, 0, size)
    got = {r["draw"]: r["value"] for r in resample.rank_correlation(table, "a", "b", draw, 60, size).collect()}
    assert len(got) == 60 and got == {d: pytest.approx(v, abs=1e-12) for d, v in rho.items()}
    got = {r["draw"]: r["value"] for r in resample.median_difference(table, "a", "b", draw, 60, size).collect()}
    assert got == {d: pytest.approx(v, abs=1e-12) for d, v in middle.items()}


@pytest.mark.parametrize("size", [16, 4096])
def test_f12_draws_of_the_recurrence_are_scattered_in_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(resample, "BATCH", 7)
    n, draws = 101, 20
    a, b = (np.random.default_rng(s).integers(0, 40, n).astype(float) for s in (1, 2))
    table = spark.createDataFrame([(k * 5 - 9, float(a[k]), float(b[k])) for k in range(n)], "unit long, a double, b double")
    at = [np.array([(p * 7919 + d * 104729 + 12345) * 48271 % 2147483647 % n for p in range(n)]) for d in range(draws)]
    packed = resample.lcg_weights(resample.placed(table, "unit").drop("places"), n, draws, size)
    got = {r["unit"]: resample.loaded([pa.scalar(bytes(r["w"]), pa.binary())], draws)[0] for r in packed.collect()}
    assert all(list(got[k * 5 - 9]) == [int((at[d] == k).sum()) for d in range(draws)] for k in range(n))
    got = {r["draw"]: (r["n"], r["rho"]) for r in resample.lcg_correlations(table, "unit", "a", "b", draws, 16).collect()}
    ranks = lambda x: [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
    assert got == {d: (n, pytest.approx(np.corrcoef(ranks(a[i]), ranks(b[i]))[0, 1], abs=1e-12)) for d, i in enumerate(at)}


def test_f9_f10_units_share_calls_and_state(spark, tmp_path, monkeypatch):
    """A row of state for each bucket, however many units; the windows are those of one unit to a bucket."""
    rng = np.random.default_rng(4)
    rows = [(u, 10_000_000 * k + u, *map(float, rng.normal(size=2)), k // 12) for u in range(40) for k in range(36) if (u + k) % 11]
    table = spark.createDataFrame([*rows, (rolling.BEAT, 10**10, None, None, 9), (None, 5, 1.0, 1.0, 0)], "unit long, us long, t double, p double, part int")
    got = []
    for buckets in (3, 4096):
        job = lambda s: rolling.count_windows(s, 4, 30, 10.0, 60.0, baseline=1, threshold=1.0, buckets=buckets)  # noqa: B023, E731
        got.append(rolling.replayed(table, "part", str(tmp_path / f"in{buckets}"), job, str(tmp_path / f"out{buckets}"), 1).orderBy("unit", "window").toPandas())
    assert got[0].equals(got[1]) and len(got[0]) == 45 and got[0]["persisted"].sum() + got[0]["alert"].sum() > 0
    state = spark.read.format("statestore").option("path", str(tmp_path / "out3-checkpoint")).option("stateVarName", "held").load()
    assert state.count() == 3


def test_f13_tables_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    asked, write = [], telemetry.write_table
    monkeypatch.setattr(telemetry, "write_table", lambda df, path, **how: (asked.append(how), write(df, path, **how)))
    write_events(spark, tmp_path, [(k, k * 1_000_000, k % 7, 1.0, 1) for k in range(70)])
    got = sorted(tuple(r) for r in catalog.QUERIES["csv_round_trip"](spark, str(tmp_path)).collect())
    assert got == by_sql("csv_round_trip", tmp_path) and asked == [{"one": False}]
    for one, files in ((True, 1), (False, 4)):
        write(spark.range(0, 8, 1, 4), str(tmp_path / "out"), one=one)
        assert len(list((tmp_path / "out").glob("part-*"))) == files


def test_f14_a_unit_of_one_leaf_gives_one_row(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(u, r, k, *map(float, rng.normal(size=2))) for u in range(3) for r in range(2) for k in range(9 if u else 60)]
    runs, kept, write = spark.createDataFrame(rows, "unit long, run_id long, idx long, t double, p double"), [], resample.written
    monkeypatch.setattr(resample, "written", lambda df, tag: (kept.append(write(df, tag)), kept[-1])[1])
    one, many = ({r["unit"]: r for r in resample.block_bootstrap(runs, ["unit"], 10.0, 80, 80.0, size=size).collect()} for size in (4096, 16))
    assert [k.count() for k in kept] == [3, 7 * 80 + 2]  # 102 starts in 7 leaves, and two units of 2
    for u in (1, 2):
        assert one[u] == many[u]
    sums = kept[1].where("draw is not null").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", *resample.SUMS)]).toPandas()
    alpha = resample.alphas(sums["n"].to_numpy(), sums[list(resample.SUMS)].to_numpy())
    assert many[0]["valid"] == int(((alpha > 0) & (alpha < 1)).sum()) > 20
    q50, low, high, *rest = resample.stats_of(alpha, 10.0)
    got = [many[0][c] for c in ("tau_median", "ci_low", "ci_high", "tau_mean", "tau_std", "alpha_median", "alpha_std")]
    assert got == pytest.approx([q50, low, high, *rest], rel=1e-9)


def test_f15_residual_rows_are_made_once(spark, tmp_path):
    write_events(spark, tmp_path, [(k, (k // 40 + k // 400 * 24) * 3_600_000_000, k % 40, k * k % 97 / 4, k * 7 % 13) for k in range(12_000)])
    train, test = catalog._split(spark, str(tmp_path), 500)
    whole, scored = catalog._split(spark, str(tmp_path))
    for rows in (train, test, whole):
        assert rows.inputFiles() and not any("events.parquet" in f for f in rows.inputFiles())
    names = ["unit", "run_id", "idx", *evaluate.FEATURES, "r"]
    key = F.concat_ws("|", "unit", "run_id", "idx")
    got, want = train.select(names).collect(), evaluate.capped(whole, key, 500).select(names).collect()
    assert len(got) == 500 and got == want and train.rdd.getNumPartitions() == 1  # in order, as the trees sample by place
    assert test.count() == scored.count() > 0


def test_f2_trees_are_fitted_on_every_training_row(spark, monkeypatch):
    class Called(Exception):
        pass

    def called(train, test, kind, **_):
        raise Called(train.count(), test.count())

    want = [r[0] for r in catalog._residual_rows(spark, "/root/testdata/sf0.001").groupBy("is_test").count().orderBy("is_test").select("count").collect()]
    monkeypatch.setattr(catalog, "TRAIN_ROWS", want[0] // 2)
    monkeypatch.setattr(evaluate, "residual_model", called)
    with pytest.raises(Called) as e:
        catalog.QUERIES["gbt_residual"](spark, "/root/testdata/sf0.001")
    assert list(e.value.args) == want


def test_f2_trees_split_where_all_rows_cut(spark):
    """40,000 rows, more than the 10,000 from which Spark's trees take thresholds; residuals step at one of the exact quantiles."""
    rng = np.random.default_rng(7)
    data = {c: rng.normal(size=40_000) for c in evaluate.FEATURES}
    data["t"] = np.where(np.arange(40_000) < 3, 1.0, 0.0)  # a bin of three rows
    at = {c: np.array([1.0]) if c == "t" else np.unique(np.quantile(v, np.arange(1, 32) / 32)) for c, v in data.items()}
    data["r"] = np.where(data["p"] >= at["p"][12], 1.0, -1.0) + np.where(data["t"] >= 1, 100.0, 0.0)
    table = spark.createDataFrame(pa.table(data).to_pandas()).repartition(8)
    assert [pytest.approx(list(at[c]), rel=1e-12, abs=1e-12) for c in evaluate.FEATURES] == evaluate.cut_points(table)
    got = evaluate.residual_model(table, table, "trees", iterations=1).toPandas()
    near = got[got["t"] == 0]
    assert len(got) == 40_000 and np.allclose(near["prediction"], near["r"], atol=0.02)
    odd = table.withColumn("r", F.lit(2.0) * (sum((F.col("p") >= F.lit(float(x))).cast("int") for x in at["p"]) % 2) - 1)
    got = evaluate.residual_model(odd, odd, "trees", iterations=1).toPandas()  # bins have an order: 16 leaves don't tell 32 of them apart
    assert np.mean((got["prediction"] - got["r"]) ** 2) > 0.2
