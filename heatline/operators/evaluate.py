"""Out-of-sample evaluation: expanding folds, hold-outs, residual models, permutation nulls."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import squares_about_mean
from ..sources.package import ship
from ..sources.shared import written
from .arx import moments, solved, united
from .population import quantiles, value_counts

FEATURES = ("p", "dp", "t", "lag_p", "lag_t")


def expanding_folds(pairs: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """Of each block but a unit's first: a fit on all blocks before it (running unions of moments), tested on the block."""
    by = pairs.groupBy(*keys, block).agg(*moments())
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    train = united(by, keys, block, [block], lambda c: F.sum(c).over(before))
    fits = solved(train.where("n > 0")).where("alpha is not null").select(*keys, block, F.col("n").cast("long").alias("n_train"), "alpha", "beta", "gamma")
    tested = pairs.join(fits, [*keys, block])
    r, y, dy = F.col("y") - (F.col("alpha") * F.col("t") + F.col("beta") * F.col("p") + F.col("gamma")), F.col("y"), F.col("y") - F.col("t")
    total = lambda x: F.nullif(squares_about_mean(x), F.lit(0.0))
    return tested.groupBy(*keys, block).agg(F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), (1.0 - F.try_divide(F.sum(r * r), total(y))).alias("r2"), (1.0 - F.try_divide(F.sum(r * r), total(dy))).alias("increment_r2"))


def fold_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(F.count("*").alias("n_folds"), F.avg("increment_r2").alias("mean_increment_r2"), F.median("increment_r2").alias("median_increment_r2"))


def last_block(df: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """Rows with the ordinal of their block from 1 and whether it is the last, by key or over all."""
    blocks = df.select(*keys, block).distinct()
    order = Window.partitionBy(*keys).orderBy(block)  # of blocks, not rows
    named = blocks.withColumn("block_no", F.row_number().over(order).cast("long")).withColumn("is_test", F.lead(block).over(order).isNull())
    return df.join(named, [*keys, block])


def features(resid: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """[p, dp, t, lag_p, lag_t] and the residual, for pairs after a run's first, in runs of `least` samples or more."""
    w = Window.partitionBy(*keys, "run_id").orderBy("idx")
    lagged = resid.where(F.col("run_len") >= least).withColumn("lag_p", F.lag("p").over(w)).withColumn("lag_t", F.lag("t").over(w))
    return lagged.where("lag_p is not null").withColumn("dp", F.col("p") - F.col("lag_p"))


def below(df: DataFrame, mixed: Column, k: int) -> DataFrame:
    """The rows in the ranges of a hash, 65,536 in all, up to the one that holds the k-th."""
    share = F.shiftright(mixed, 48)
    sizes = df.select(share.alias("_s")).groupBy("_s").agg(F.count("*").alias("_n"))  # a row for each range
    upto = sizes.withColumn("_n", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s")))
    last = upto.agg(F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("_s"))), F.lit(1 << 15)).alias("_last"))  # one row
    return df.crossJoin(F.broadcast(last)).where(share <= F.col("_last")).select(*df.columns)


def capped(df: DataFrame, key: Column, k: int) -> DataFrame:
    """At most k rows, by a hash of their key: what a model is fitted on, never what it is scored on. The task which takes them gets
    few others, as below() leaves them out."""
    mixed = F.xxhash64(F.lit(0), key)
    return below(df, mixed, k).orderBy(mixed, key).limit(k)


def r2(df: DataFrame, y: str, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    v, e = F.col(y), F.col(y) - predicted
    out = (1.0 - F.try_divide(F.sum(e * e), F.nullif(squares_about_mean(v), F.lit(0.0)))).alias("r2")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), out) if keys else df.agg(F.count("*").alias("n"), out)


def assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


#: Bins of a feature, between which trees split, as many as Spark's trees have by default.
BINS = 32


def cut_points(train: DataFrame, bins: int = BINS) -> list[list[float]]:
    """For each feature, where bins begin but the first: at its values, if it has so many at most, else at exact quantiles of
    all rows, equal ones once."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).cast("double").alias("value")) for k, c in enumerate(FEATURES)]))
    counts = written(value_counts(train.select(each.alias("_f")).select("_f.*"), ["feature"], "value"), "values")
    found = {r[0]: sorted(set(r[1:])) for r in quantiles(counts, ["feature"], {f"q{j}": j / bins for j in range(1, bins)}).collect()}  # a row for each feature
    few = counts.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n").between(2, bins)).select("feature")
    for r in counts.join(F.broadcast(few), "feature").groupBy("feature").agg(F.sort_array(F.collect_list("v"))).collect():
        found[r[0]] = r[1][1:]
    return [found.get(k, [0.0]) for k in range(len(FEATURES))]


def residual_model(train: DataFrame, test: DataFrame, kind: str = "linear", y: str = "r", iterations: int = 200) -> DataFrame:
    """test with `prediction`, by least squares or by boosted trees of depth 4, fitted on every row of train."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    if kind == "linear":
        return LinearRegression(labelCol=y, solver="normal", regParam=0.0).fit(assembled(train)).transform(assembled(test)).drop("features")
    # Spark's trees would take thresholds from 10,000 rows. They get the numbers of bins cut by all rows, and look for these
    # in as many rows as maxBins squared (a whole number of 32 bits), all of them here; a feature has no more than BINS.
    # Added zeros drop the names of bins, by which trees would take them for categories without order.
    names = [f"{c}_bin" for c in FEATURES]
    cut = Bucketizer(inputCols=list(FEATURES), outputCols=names, splitsArray=[[-math.inf, *c, math.inf] for c in cut_points(train)])
    binned = lambda df: VectorAssembler(inputCols=names, outputCol="features").transform(cut.transform(df).withColumns({c: F.col(c) + 0.0 for c in names})).drop(*names)
    most = min(46_340, max(BINS, math.isqrt(train.count()) + 1))
    model = GBTRegressor(labelCol=y, maxDepth=4, maxBins=most, maxIter=iterations, stepSize=0.1, seed=0)
    return model.fit(binned(train).select("features", y)).transform(binned(test)).drop("features")


#: Ranges of the order, by draw: a task sorts one, not a draw.
RANGES = 10


def placed(df: DataFrame, keys: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """df with `i`, its place from 1 within keys, by (bucket, order), where bucket rises with the order: rows are sorted
    by bucket, and only the buckets' sizes are summed in one place."""
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return own.join(sizes.select(*keys, "_b", before.alias("_o")), [*keys, "_b"]).withColumn("i", F.col("_o") + F.col("_r")).drop("_b", "_n", "_o", "_r")


def permutation_null(predicted: DataFrame, y: str, prediction: str, order: str, draws: int = 200, seed: int = 0, shuffle: Callable[[Column, Column], Column] | None = None, bits: int = 64) -> DataFrame:
    """The R2 of y permuted against fixed predictions, for each draw. Each draw pairs places by key (a long) with places by
    a hash of it, of so many `bits`; both orders are cut into ranges, so no task holds a draw."""
    mix = shuffle or (lambda k, draw: F.xxhash64(k, draw, F.lit(seed)))
    rows = predicted.select(F.col(order).alias("_k"), F.col(y).alias("_y"), F.col(prediction).alias("_p"))
    span = rows.agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))  # one row
    wide = rows.crossJoin(F.broadcast(span))
    share = F.floor((F.col("_k") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1) * (1 << RANGES))
    by_key = placed(wide, [], share, [F.col("_k")]).select("i", "_p")
    drawn = rows.crossJoin(F.broadcast(predicted.sparkSession.range(draws).withColumnRenamed("id", "draw"))).withColumn("_m", mix(F.col("_k"), F.col("draw")))
    mixed = placed(drawn, ["draw"], F.shiftright("_m", bits - RANGES), [F.col("_m"), F.col("_k")]).select("draw", "i", "_y")
    return r2(mixed.join(by_key, "i"), "_y", F.col("_p"), ["draw"])


def permuted(df: DataFrame, place: str, n: int, draw: str, mix: Callable[[Column, Column, int], Column], rounds: int = 4) -> DataFrame:
    """df with `j`, its place (from 0, below n) moved by a permutation that the draw names: rounds that add a mix of one half of
    the place to the other, over the least square of at least n; a place that leaves the range moves on until it is back. At
    most 2 sqrt(n) of a draw's places leave it, and none can stay out for longer than there are places outside."""
    side = math.isqrt(max(n, 1) - 1) + 1

    def halves(x: Column) -> tuple[Column, Column]:
        low = x % side
        return ((x - low) / side).cast("long"), low

    def turned(high: Column, low: Column, k: int) -> Column:
        return (high + F.pmod(mix(low, F.col(draw), k), F.lit(side))) % side

    def walked(x: Column, steps: int) -> Column:
        def moved(at: Column) -> Column:
            pair = F.struct(*(h.alias(name) for h, name in zip(halves(at), ("_h", "_l"), strict=True)))
            turn = lambda k: lambda p: F.struct(p["_l"].alias("_h"), turned(p["_h"], p["_l"], k).alias("_l"))
            pairs = F.array(pair)
            for k in range(rounds):
                pairs = F.transform(pairs, turn(k))
            return F.transform(pairs, lambda p: p["_h"] * side + p["_l"])[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda at, _: F.when(at < n, at).otherwise(moved(at)))

    high, low = halves(F.col(place))
    out = df.select("*", high.alias("_0"), low.alias("_1"))
    for k in range(rounds):  # columns, so that each round is computed once
        out = out.withColumn(f"_{k + 2}", turned(F.col(f"_{k}"), F.col(f"_{k + 1}"), k))
    out = out.withColumn("_x", F.col(f"_{rounds}") * side + F.col(f"_{rounds + 1}"))
    out = out.withColumn("_x", F.when(F.col("_x") < n, F.col("_x")).otherwise(walked(F.col("_x"), 8)))
    out = out.withColumn("j", F.when(F.col("_x") < n, F.col("_x")).otherwise(walked(F.col("_x"), max(1, side * side - n))))
    return out.select(*df.columns, "j")


#: Places to a packed chunk: a place in it has 16 bits.
CHUNK = 1 << 16
#: Chunks to a side of a tile of rotated_null(), at most, and tiles to a row of them where fewer do.
TILE, TILES = 64, 8
#: Distinct predictions that are coded in one or two bytes, at most.
CODED = 1 << 16


def packed(rows: DataFrame, place: str, value: str) -> DataFrame:
    """(chunk, values): rows whose places from 0 come once each, CHUNK of them to a row, as doubles in order; nulls as NaN."""
    own = rows.select(F.shiftright(place, 16).alias("chunk"), F.col(place).alias("_at"), F.col(value).cast("double").alias("_v"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "values": [pdf.sort_values("_at")["_v"].to_numpy(float).tobytes()]})

    return own.groupBy("chunk").applyInPandas(pack, "chunk long, values binary")


def of_errors(errors: DataFrame, rows: DataFrame, y: str) -> DataFrame:
    """(draw, n, r2) from parts of each draw's squared errors (draw, se; null where no pair has both values)."""
    total = rows.agg(F.count("*").alias("n"), F.nullif(squares_about_mean(F.col(y)), F.lit(0.0)).alias("_total"))  # one row
    return errors.groupBy("draw").agg(F.sum("se").alias("se")).crossJoin(F.broadcast(total)).select("draw", "n", (1.0 - F.try_divide("se", "_total")).alias("r2"))


def tile_errors(p: np.ndarray, y: np.ndarray, at_p: int, at_y: int, n: int, shifts: list[int]) -> pd.DataFrame:
    """(draw, se) over the pairs of a tile: place i of p, the first of which is at_p, meets place (i + shift) mod n of y."""
    out = []
    for draw, shift in enumerate(shifts):
        for turn in (0, n):
            low, high = max(at_p, at_y - shift + turn), min(at_p + len(p), at_y + len(y) - shift + turn)
            if low < high:
                e = y[low + shift - turn - at_y : high + shift - turn - at_y] - p[low - at_p : high - at_p]
                se = e @ e
                if np.isnan(se):
                    e = e[~np.isnan(e)]
                    se = e @ e if len(e) else None
                out.append((draw, se))
    return pd.DataFrame(out, columns=["draw", "se"]).astype({"draw": "int64", "se": float})


def tiles_of(n: int, shifts: list[int], size: int) -> list[tuple[int, int]]:
    """Which tiles of so many places a side hold a pair of some draw."""
    found = set()
    for a in range(-(-n // size)):
        for shift in set(shifts):
            first, last = a * size + shift, min((a + 1) * size, n) - 1 + shift
            for low, high in ((first, min(last, n - 1)), (max(first, n) - n, last - n)):
                found.update((a, b) for b in range(low // size, high // size + 1) if low <= high)
    return sorted(found)


def rotated_null(predicted: DataFrame, y: str, prediction: str, order: str, mixed: Column, moves: list[int], modulus: int) -> DataFrame:
    """permutation_null() for a shuffle by (mixed + moves[draw]) mod modulus, where mixed is a whole number from 0 below modulus: such a
    draw is a rotation of the order by (mixed, key). So both orders are made once; blocks of predictions meet blocks of y, and
    a tile of two serves every draw. A block is sent TILES times, beyond 33 million rows in tiles of a fixed size that some
    draw needs. Two short jobs, for the rows and the rotations, run while the plan is built."""
    spark = predicted.sparkSession
    ship(spark)
    rows = written(predicted.select(F.col(order).alias("_k"), F.col(y).cast("double").alias("_y"), F.col(prediction).cast("double").alias("_p"), mixed.alias("_m")).where("_k is not null"), "rows")
    cuts = sorted({modulus - m for m in moves})

    @F.pandas_udf("long")
    def passed(m: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, m.to_numpy(), side="right").astype("int64"))

    counts = dict(rows.groupBy(passed("_m").alias("c")).count().collect())  # a row for each cut at most
    n = sum(counts.values())
    if not n:
        return spark.createDataFrame([], "draw long, n long, r2 double")
    shifts = [sum(c for k, c in counts.items() if k <= cuts.index(modulus - m)) % n for m in moves]
    span = rows.agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))  # one row
    share = F.floor((F.col("_k") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1) * (1 << RANGES))
    by_key = placed(rows.crossJoin(F.broadcast(span)), [], share, [F.col("_k")]).withColumn("i", F.col("i") - 1)
    by_mix = placed(rows, [], F.floor(F.col("_m") / modulus * (1 << RANGES)), [F.col("_m"), F.col("_k")]).withColumn("i", F.col("i") - 1)
    chunks = -(-n // CHUNK)
    per = min(TILE, -(-chunks // TILES))
    pairs = spark.createDataFrame(tiles_of(n, shifts, per * CHUNK), "a long, b long")
    block = F.floor(F.col("chunk") / per)
    sent = packed(by_key, "i", "_p").withColumn("a", block).join(F.broadcast(pairs), "a").select("a", "b", F.lit(False).alias("is_y"), "chunk", "values")
    sent = sent.unionByName(packed(by_mix, "i", "_y").withColumn("b", block).join(F.broadcast(pairs), "b").select("a", "b", F.lit(True).alias("is_y"), "chunk", "values"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        p, y = (np.frombuffer(b"".join(pdf[pdf["is_y"] == side].sort_values("chunk")["values"])) for side in (False, True))
        return tile_errors(p, y, a * per * CHUNK, b * per * CHUNK, n, shifts)

    return of_errors(sent.groupBy("a", "b").applyInPandas(tile, "draw long, se double"), rows, "_y")


def turns(draws: int, side: int, mix: Callable[[Column, Column, int], Column], rounds: int, spark) -> np.ndarray:
    """What each round of permuted() adds to a half, by draw, round and the other half: some draws * rounds * sqrt(places)
    numbers, which every task needs."""
    v, draw = F.col("v"), F.col("draw")
    table = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(spark.range(side).withColumnRenamed("id", "v"))
    got = table.select(draw.cast("int"), v.cast("int"), *[F.pmod(mix(v, draw, k), F.lit(side)).cast("int").alias(f"t{k}") for k in range(rounds)]).toArrow()
    out = np.zeros((draws, rounds, side), np.int32)
    for k in range(rounds):
        out[got["draw"].to_numpy(), k, got["v"].to_numpy()] = got[f"t{k}"].to_numpy()
    return out


def moved_places(x: np.ndarray, n: int, turn: np.ndarray, back: bool = False) -> np.ndarray:
    """permuted() on an array of places, for a draw's turns(); back: its inverse."""
    rounds, side = turn.shape

    def once(x: np.ndarray) -> np.ndarray:
        high, low = np.divmod(x, side)
        for k in reversed(range(rounds)) if back else range(rounds):
            if back:
                high, low = low - turn[k][high], high
                high += side * (high < 0)
            else:
                high, low = low, high + turn[k][low]
                low -= side * (low >= side)
        return high * side + low

    x = once(x)
    while len(out := np.nonzero(x >= n)[0]):
        x[out] = once(x[out])
    return x


def keyed_permutation_null(predicted: DataFrame, y: str, prediction: str, key: str, draws: int = 200, batch: int = 50, seed: int = 0, mix: Callable[[Column, Column, int], Column] | None = None, spread: Callable[[Column], Column] | None = None, bits: int = 64) -> DataFrame:
    """The R2 of y permuted against fixed predictions, for each draw, by permutations of places that are computed, not sorted.

    Rows get a place once, by `spread` of their key (a hash of so many `bits`, so ranges are even for any ids) and the key,
    and are packed in chunks of places. A chunk sends each other one its predictions that move there, without their places,
    which the other finds by the inverse; predictions of at most CODED distinct values travel in a byte or two, others in
    eight. A task holds a chunk in `batch` draws. Rows with a null y or prediction take no part; equal keys are placed by
    y and prediction, and share a range."""
    mix = mix or (lambda v, draw, k: F.xxhash64(v, draw, F.lit(k), F.lit(seed)))
    spread = spread or (lambda k: F.xxhash64(k, F.lit(seed)))
    spark = predicted.sparkSession
    ship(spark)
    rows = predicted.select(F.col(key).alias("_k"), F.col(y).cast("double").alias("_y"), F.col(prediction).cast("double").alias("_p")).where("_y is not null and _p is not null").withColumn("_m", F.coalesce(spread(F.col("_k")), F.lit(0)))
    places = written(placed(rows, [], F.shiftright("_m", bits - RANGES), [F.col("_m"), F.col("_k"), F.col("_y"), F.col("_p")]).select((F.col("i") - 1).alias("i"), "_y", "_p"), "places")
    n = places.count()
    if not n or not draws:
        return spark.createDataFrame([], "draw long, n long, r2 double")
    table = spark.sparkContext.broadcast(turns(draws, math.isqrt(n - 1) + 1, mix, 4, spark))
    seen = [r[0] for r in places.select("_p").distinct().limit(CODED + 1).collect()]
    book = np.sort(np.array(seen)) if len(seen) <= CODED else None
    kind = np.dtype(float) if book is None else np.min_scalar_type(len(book) - 1)
    batches, chunks = [(a, min(a + batch, draws)) for a in range(0, draws, batch)], -(-n // CHUNK)
    small = np.min_scalar_type(chunks)

    def send(parts):
        for pdf in parts:
            for chunk, raw in zip(pdf["chunk"], pdf["values"], strict=True):
                values = np.frombuffer(raw)
                codes = values if book is None else np.searchsorted(book, values).astype(kind)
                own = np.arange(chunk * CHUNK, chunk * CHUNK + len(values))
                for k, (first, end) in enumerate(batches):
                    to = np.concatenate([(moved_places(own, n, table.value[d]) >> 16).astype(small) for d in range(first, end)])
                    sent = codes[np.argsort(to, kind="stable") % len(own)]
                    ends = np.cumsum(np.bincount(to, minlength=chunks))
                    yield pd.DataFrame({"chunk": np.arange(chunks), "batch": k, "sender": chunk, "data": [s.tobytes() for s in np.split(sent, ends[:-1])]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sender")  # the chunk's own y first
        y, chunk, (first, end) = np.frombuffer(pdf["data"].iloc[0]), int(pdf["chunk"].iloc[0]), batches[int(pdf["batch"].iloc[0])]
        codes = np.frombuffer(b"".join(pdf["data"].iloc[1:]), kind)
        own = np.arange(chunk * CHUNK, chunk * CHUNK + len(y))
        met, senders = [], []
        for d in range(first, end):
            source = moved_places(own, n, table.value[d], back=True)
            order = np.argsort((source & (CHUNK - 1)).astype(np.uint16), kind="stable")
            met.append(y[order])
            senders.append((source[order] >> 16).astype(small))
        order = np.argsort(np.concatenate(senders), kind="stable")  # by sender, draw and place, as they were sent
        e = np.concatenate(met)[order] - (codes if book is None else book[codes])
        return pd.DataFrame({"draw": np.arange(first, end), "se": np.bincount(order // len(y), e * e, end - first)})

    tasks = max(spark.sparkContext.defaultParallelism, chunks // 4)
    sent = packed(places, "i", "_p").repartition(tasks, "chunk").mapInPandas(send, "chunk long, batch long, sender long, data binary")
    kept = packed(places, "i", "_y").select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(batches) - 1).cast("long"))).alias("batch"), F.lit(-1).cast("long").alias("sender"), F.col("values").alias("data"))
    return of_errors(sent.unionByName(kept).groupBy("chunk", "batch").applyInPandas(meet, "draw long, se double"), places, "_y")


def null_summary(nulls: DataFrame) -> DataFrame:
    return nulls.agg(F.count("*").alias("draws"), F.percentile("r2", 0.95).alias("null_p95"), F.avg("r2").alias("null_mean"))


def trailing(df: DataFrame, keys: list[str], size: int = 8, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """`window`: the `size` rows before each row of its run, oldest first, as arrays of the columns standardised over the
    whole run; rows with fewer go."""
    run = Window.partitionBy(*keys, "run_id")
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(run), F.stddev_pop(c).over(run)), F.lit(0.0))
    w = run.orderBy("idx").rowsBetween(-size, -1)
    return df.withColumn("_z", F.array(*[z(c) for c in columns])).withColumn("window", F.collect_list("_z").over(w)).where(F.size("window") == size).drop("_z")


def adam(params: list[np.ndarray], rate: float, decay: float = 0.0):
    """A step of the optimiser: takes gradients, changes params in place."""
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    count = 0

    def step(gradients):
        nonlocal count
        count += 1
        for p, g, m, v in zip(params, gradients, first, second, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)

    return step


def _mlp(hidden: int, epochs: int, decay: float, rate: float, inputs: list[str], y: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(0)
        x, t = pdf[inputs].to_numpy(float), pdf[y].to_numpy(float)
        mx, sx, mt, st = x.mean(0), x.std(0) + 1e-9, t.mean(), t.std() + 1e-9
        params = [rng.normal(0, 0.3, (len(inputs), hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        step, zx, zt = adam(params, rate, decay), (x - mx) / sx, (t - mt) / st
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(zx)), max(1, len(zx) // 512)):
                h = np.tanh(zx[rows] @ params[0] + params[1])
                e = (h @ params[2] + params[3] - zt[rows]) * (2 / len(rows))
                back = np.outer(e, params[2]) * (1 - h * h)
                step((zx[rows].T @ back, back.sum(0), h.T @ e, e.sum(keepdims=True)))
        w1, b1, w2, b2 = params
        layer = w1 / sx[:, None]
        return pd.DataFrame({"layer": [layer.T.tolist()], "bias": [(b1 - mx @ layer).tolist()], "out": [(w2 * st).tolist()], "shift": [float(b2[0] * st + mt)]})

    return run


def neural_residual(train: DataFrame, test: DataFrame, inputs: list[str], y: str = "r", hidden: int = 16, epochs: int = 6, decay: float = 1e-2, rate: float = 3e-3, train_rows: int = 150_000) -> DataFrame:
    """test with `prediction`, by a small tanh network fitted on at most `train_rows` rows by hash in one task. The weights
    are one row; every row of test is scored, where it lies."""
    ship(train.sparkSession)
    rows = capped(train, F.xxhash64(*inputs, y), train_rows).select(*[F.col(c).cast("double").alias(c) for c in (*inputs, y)]).withColumn("_g", F.lit(0))
    fit = rows.groupBy("_g").applyInPandas(lambda pdf: _mlp(hidden, epochs, decay, rate, inputs, y)(pdf), "layer array<array<double>>, bias array<double>, out array<double>, shift double")
    x = F.array(*[F.col(c).cast("double") for c in inputs])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    units = F.zip_with("layer", "bias", lambda w, b: F.tanh(dot(w, x) + b))
    return test.crossJoin(F.broadcast(fit)).withColumn("prediction", dot(units, F.col("out")) + F.col("shift")).drop("layer", "bias", "out", "shift")


class Recurrent:
    """An LSTM of one layer over windows (rows, steps, inputs), and a linear output."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        bound = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.params = [rng.uniform(-bound, bound, s) for s in ((inputs, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,), (hidden,), (1,))]

    def forward(self, x: np.ndarray):
        wx, wh, b, out, shift = self.params
        h = c = np.zeros((len(x), self.hidden))
        trace = []
        for k in range(x.shape[1]):
            i, f, o, g = np.split(x[:, k] @ wx + h @ wh + b, 4, axis=1)
            i, f, o, g = *(1 / (1 + np.exp(-v)) for v in (i, f, o)), np.tanh(g)
            before, c_before = h, c
            c = f * c + i * g
            h = o * np.tanh(c)
            trace.append((i, f, o, g, before, c_before, c))
        return h @ out + shift[0], h, trace

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean squared error."""
        wx, wh, _, out, _ = self.params
        p, h, trace = self.forward(x)
        e = 2 * (p - y) / len(y)
        dh, dc = np.outer(e, out), 0.0
        gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.params[2])
        for k in range(len(trace) - 1, -1, -1):
            i, f, o, g, before, c_before, c = trace[k]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            d = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gx += x[:, k].T @ d
            gh += before.T @ d
            gb += d.sum(0)
            dh, dc = d @ wh.T, dc * f
        return [gx, gh, gb, h.T @ e, e.sum(keepdims=True)]


def recurrent_residual(windows: DataFrame, y: str = "r", hidden: int = 16, epochs: int = 6, rate: float = 1e-2, batch: int = 8192, train_rows: int = 150_000, least: tuple[int, int] = (500, 200)) -> DataFrame:
    """The test rows of trailing() windows (with is_test) and `prediction`, by an LSTM fitted on at most `train_rows`
    training rows by hash in one task; null where there are fewer than `least` training or test rows. The weights are one
    row; every test row is scored where it lies."""
    ship(windows.sparkSession)
    train, test = windows.where("not is_test"), windows.where("is_test")
    counts = windows.agg(F.count_if(~F.col("is_test")), F.count_if("is_test")).first()
    if counts[0] < least[0] or counts[1] < least[1]:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    rows = capped(train, F.xxhash64("window", y), train_rows).select("window", F.col(y).cast("double").alias("y")).withColumn("_g", F.lit(0))
    stack = lambda column: np.array([[list(r) for r in w] for w in column], float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(0)
        x, t = stack(pdf["window"]), pdf["y"].to_numpy(float)
        net = Recurrent(x.shape[2], hidden, rng)
        step = adam(net.params, rate)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                own = order[a : a + batch]
                step(net.gradients(x[own], t[own]))
        return pd.DataFrame({"weights": [[p.ravel().tolist() for p in net.params]]})

    weights = rows.groupBy("_g").applyInPandas(fit, "weights array<array<double>>")

    @F.pandas_udf("double")
    def predict(window: pd.Series, weights: pd.Series) -> pd.Series:
        if not len(window):
            return pd.Series([], dtype=float)
        x = stack(window)
        net = Recurrent(x.shape[2], hidden, np.random.default_rng(0))
        net.params = [np.array(w, float).reshape(p.shape) for w, p in zip(weights.iloc[0], net.params, strict=True)]
        return pd.Series(net.forward(x)[0])

    return test.crossJoin(F.broadcast(weights)).withColumn("prediction", predict("window", "weights")).drop("weights")
