"""Exact top-k inner products by a pivot-distance index.

A vector v becomes (v, sqrt(M^2 - |v|^2)), M the largest norm, and a query (q, 0), so the largest inner
products are the nearest points. Every point is keyed by its nearest pivot and its distance to it; sorted
runs of the key are packed into blocks, which are annuli (pivot, least, largest distance). A block of queries
first expands the annuli nearest to its own key, whose k-th best distance bounds the search; the annuli that may
reach within it are sorted by their distance from the queries and expanded in rounds, each four times as long as the
one before. After each round the bound shrinks, and by the triangle inequality annuli beyond it are never expanded; a
block of queries stops when none is left within its bound. Scores are exact integers; the bounds carry a slack far
above the rounding of distances, which are computed on components scaled to 1.

Pivots are chosen from a bounded sample (`sample` rows, by hash); the index holds every row. Queries are a stated
set and meet the rows in blocks, so nothing is paired row by row; block summaries, not rows, are joined. Blocks
travel in groups: a query block goes once to each group that it needs, not to each block.

Defined results: vectors that are null or hold null or non-finite components take no part; null ids neither; vectors of
different lengths meet as if the shorter went on with zeros (an empty one scores zero); ties go to the smaller id; equal
ids (repeated rows) are all candidates but those with the query's own id, and a repeated query row is answered as often
as it comes; components beyond the largest double are held there, and scores beyond a long are computed exactly and
held at its ends; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read_table, remove, ship, small, stored, written

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, SAMPLE, BLOCK, QUERIES, SEEDS = 64, 5_000, 2048, 256, 2
#: Bytes of vectors in a block at most, blocks in a group, annuli in the first round and growth of the rounds.
BLOCK_BYTES, GROUP, FIRST, GROWTH = 4 << 20, 16, 8, 4
#: Components of a vector that pivots see; distances and scores see all.
PIVOT_WIDTH = 4096
SLACK = 1e-6
LONG = (1 << 63) - 1


def usable(table: DataFrame) -> DataFrame:
    """vec_id, floor(1024 * x) of each component as doubles, and how many, of the rows that take part."""
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def whole(x: Column) -> Column:
        held = F.greatest(F.least(x.cast("double") * float(SCALE), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(held) < float(1 << 53), F.floor(held).cast("double")).otherwise(held)  # beyond, doubles are whole

    rows = table.where(F.coalesce(ok, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"), F.size(v).alias("width"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Space:
    """What all tasks share: the scale of components, the largest squared norm in that scale, and the pivots."""

    def __init__(self, big: float, m2: float, centres: np.ndarray):
        self.big, self.m2, self.centres = big, m2, centres
        self.slack = SLACK * (np.sqrt(m2) + 1e-300)

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """From each pivot, of vectors (lifted to the sphere) or queries."""
        x = v / self.big
        n = min(v.shape[1], self.centres.shape[1] - 1)
        own = (x * x).sum(axis=1)
        dots = x[:, :n] @ self.centres[:, :n].T
        if not query:
            dots += np.sqrt(np.maximum(self.m2 - own, 0))[:, None] * self.centres[:, -1][None]
            own = np.maximum(own, self.m2)
        return np.sqrt(np.maximum(own[:, None] + (self.centres**2).sum(axis=1)[None] - 2 * dots, 0))

    def radii(self, q: np.ndarray, slots: list[int], kth: list[int]) -> np.ndarray:
        """The distance of each query's k-th candidate so far; infinite where there is none or its score is held at the low end."""
        out = np.full(len(q), np.inf)
        for t, s in zip(slots, kth, strict=True):
            if s > -LONG - 1:
                x = q[t] / self.big
                out[t] = np.sqrt(max(float(x @ x) + self.m2 - 2.0 * (float(s) / self.big) / self.big, 0.0))
        return out


def pivots_of(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-point choice, then a few rounds of means: deterministic."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen]
    for _ in range(5):
        home = ((points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)
        centres = np.array([points[home == k].mean(axis=0) if (home == k).any() else centres[k] for k in range(len(centres))])
    return centres


KEYED = pa.schema([("width", pa.int32()), ("pivot", pa.int32()), ("dist", pa.float64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])


def _key(space: Space, query: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths).tolist():
                rows = batch.take(pa.array((widths == width).nonzero()[0]))
                step = max(1, min(1 << 14, BLOCK_BYTES // (8 * max(1, width))))
                for a in range(0, rows.num_rows, step):
                    part = rows.slice(a, step)
                    d = space.distances(matrix(part["v"], width), query)
                    home = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([part["width"].cast(pa.int32()), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home]), part["vec_id"].cast(pa.int64()), part["v"].cast(pa.list_(pa.float64()))], schema=KEYED)

    return run


BLOCKS = pa.schema([("width", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
BLOCK_COLUMNS = "width int, pivot int, low double, high double, n int, ids binary, vectors binary"


def _pack(rows: int):
    """Blocks of consecutive rows of one width and pivot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def drain(width: int, most: int, last: bool):
            nonlocal held
            if not held:
                return
            pivot, dist, ids, vectors = (np.concatenate([h[k] for h in held]) for k in range(4))
            at = 0
            while at < len(ids):
                stop = min(at + most, at + int(np.searchsorted(pivot[at:], pivot[at], side="right")))
                if stop == len(ids) and not last and stop - at < most:
                    break
                own = slice(at, stop)
                yield pa.RecordBatch.from_pydict({"width": [width], "pivot": [int(pivot[at])], "low": [float(dist[own].min())], "high": [float(dist[own].max())], "n": [stop - at], "ids": [ids[own].astype("<i8").tobytes()], "vectors": [vectors[own].astype("<f8").tobytes()]}, schema=BLOCKS)
                at = stop
            held = [(pivot[at:], dist[at:], ids[at:], vectors[at:])] if at < len(ids) else []

        of, most, count = -1, rows, 0
        for batch in it:
            widths = batch["width"].to_numpy()
            cuts = [0, *((np.diff(widths) != 0).nonzero()[0] + 1).tolist(), len(widths)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if widths[a] != of:
                    yield from drain(of, most, True)
                    of, count = int(widths[a]), 0
                    most = max(1, min(rows, BLOCK_BYTES // (8 * max(1, of))))
                part = batch.slice(a, b - a)
                held.append((part["pivot"].to_numpy(), part["dist"].to_numpy(), part["vec_id"].to_numpy(), matrix(part["v"], of)))
                count += b - a
                if count >= 2 * most:
                    yield from drain(of, most, False)
                    count = sum(len(h[2]) for h in held)
        yield from drain(of, most, True)

    return run


def blocks(keyed: DataFrame, rows: int, tag: str) -> DataFrame:
    key = ("width", "pivot", "dist", "vec_id")
    order = keyed.repartitionByRange(*key).sortWithinPartitions(*key)
    packed = order.mapInArrow(_pack(rows), BLOCK_COLUMNS)
    return written(packed.withColumn("block", F.monotonically_increasing_id()).withColumn("grp", F.floor(F.col("block") / GROUP)), tag)


def unpack(n: int, width: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, width)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: in floats where every partial sum is exact there, else in whole numbers."""
    n = min(q.shape[1], v.shape[1])
    q, v = q[:, :n], v[:, :n]
    most = np.sqrt((1 << 53) / max(1, n))
    tame_q, tame_v = np.abs(q).max(axis=1, initial=0) <= most, np.abs(v).max(axis=1, initial=0) <= most
    if tame_q.all() and tame_v.all():
        return (q @ v.T).astype(np.int64)
    out = np.empty((len(q), len(v)), np.int64)
    out[np.ix_(tame_q, tame_v)] = (q[tame_q] @ v[tame_v].T).astype(np.int64)
    whole_q, whole_v = ([[int(x) for x in r] for r in a] for a in (q, v))
    for i in range(len(q)):
        for j in (~tame_v).nonzero()[0].tolist() if tame_q[i] else range(len(v)):
            out[i, j] = max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(whole_q[i], whole_v[j], strict=True))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of another id, ties to the smaller id."""
    other = ids != own
    scores, ids = scores[other], ids[other]
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= cut
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


FOUND = pa.schema([("qblock", pa.int64()), ("slot", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_COLUMNS = "qblock long, slot int, query_id long, vec_id long, score long"


def _score(k: int, space: Space):
    """Streams, for each group, its blocks and then the query blocks that want some of them: the best k of each query."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, index = None, {}
        for batch in it:
            for row in batch.to_pylist():
                if row["grp"] != of:
                    of, index = row["grp"], {}
                if row["kind"] == 0:
                    index[row["block"]] = (row["pivot"], row["low"], row["high"], row["n"], row["width"], row["ids"], row["vectors"])
                    continue
                qid, q = unpack(row["n"], row["width"], row["ids"], row["vectors"])
                radius = space.radii(q, [x["slot"] for x in row["kth"] or ()], [x["kth"] for x in row["kth"] or ()])
                d = space.distances(q, True)
                kept: list[list] = [[] for _ in qid]
                for block in row["wanted"]:
                    pivot, low, high, n, width, ids, vectors = index[block]
                    vid, v = unpack(n, width, ids, vectors)
                    near = d[:, pivot]
                    take = ((near - radius <= high + space.slack) & (near + radius >= low - space.slack)).nonzero()[0]
                    for a in range(0, len(take), 64):
                        part = take[a : a + 64]
                        for t, s in zip(part.tolist(), products(q[part], v), strict=True):
                            kept[t].append(best(s, vid, int(qid[t]), k))
                out: dict[str, list] = {c: [] for c in FOUND.names}
                for t, parts in enumerate(kept):
                    if parts:
                        top, ids = best(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), int(qid[t]), k)
                        out["slot"] += [t] * len(ids)
                        out["query_id"] += [int(qid[t])] * len(ids)
                        out["vec_id"] += ids.tolist()
                        out["score"] += top.tolist()
                if out["vec_id"]:
                    yield from batches(out | {"qblock": [row["block"]] * len(out["vec_id"])}, FOUND, 1 << 16)

    return run


REACH = pa.schema([("qblock", pa.int64()), ("pivot", pa.int32()), ("dmin", pa.float64()), ("dmax", pa.float64()), ("near", pa.float64()), ("far", pa.float64())])


def _reach(space: Space):
    """For each query block and pivot: the range of its queries' distances to the pivot, and that which their bounds reach."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                _, q = unpack(row["n"], row["width"], row["ids"], row["vectors"])
                d = space.distances(q, True)
                r = space.radii(q, [x["slot"] for x in row["kth"] or ()], [x["kth"] for x in row["kth"] or ()])[:, None]
                yield pa.RecordBatch.from_pydict({"qblock": [row["block"]] * d.shape[1], "pivot": list(range(d.shape[1])), "dmin": d.min(axis=0), "dmax": d.max(axis=0), "near": (d - r).min(axis=0), "far": (d + r).max(axis=0)}, schema=REACH)

    return run


def search(table: DataFrame, queries: DataFrame | None = None, k: int = K, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, first: int = FIRST, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, by default the rows whose vec_id is divisible by 100.
    `seen` gets how many pairs of query block and annulus there are and how many were expanded."""
    spark = table.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = usable(table)
    big = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))))).first()[0]
    if big is None:
        return empty
    big = big or 1.0
    m2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / big) * (x / big)))).first()[0]
    sampled = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.slice("v", F.lit(1), F.lit(PIVOT_WIDTH)).alias("v")).collect()]
    points = np.zeros((len(sampled), max(map(len, sampled)) + 1))
    for i, v in enumerate(sampled):
        points[i, : len(v)] = np.array(v) / big
    points[:, -1] = np.sqrt(np.maximum(m2 - (points * points).sum(axis=1), 0))
    space = Space(big, m2, pivots_of(points, pivots))
    asked = usable(queries) if queries is not None else rows.where(F.col("vec_id") % EVERY == 0)
    schema = "width int, pivot int, dist double, vec_id long, v array<double>"
    index = blocks(rows.mapInArrow(_key(space, False), schema), block, "index")
    asks = blocks(asked.mapInArrow(_key(space, True), schema), QUERIES, "queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summary = index.select("block", "grp", "pivot", "low", "high")
    gap = lambda lo, hi: F.greatest(F.col("low") - hi, lo - F.col("high"), F.lit(0.0))

    def expanded(pairs: DataFrame, kth: DataFrame | None) -> DataFrame:
        """The best k of each query in the annuli of pairs (qblock, block, grp)."""
        wants = pairs.groupBy(F.col("qblock").alias("block"), F.col("grp").alias("to")).agg(F.collect_list(pairs["block"]).alias("wanted"))
        q = asks.join(wants, "block").withColumn("grp", F.col("to"))
        q = q.join(kth, "block", "left") if kth is not None else q.withColumn("kth", F.lit(None).cast("array<struct<slot:int,kth:long>>"))
        both = ["grp", "block", "width", "pivot", "low", "high", "n", "ids", "vectors"]
        groups = pairs.select("grp").distinct()
        mine = index.join(small(groups, groups.count()), "grp", "left_semi").select(F.lit(0).alias("kind"), *both, F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast("array<struct<slot:int,kth:long>>").alias("kth"))
        stream = mine.unionByName(q.select(F.lit(1).alias("kind"), *both, "wanted", "kth"))
        return stream.repartition(parts, "grp").sortWithinPartitions("grp", "kind").mapInArrow(_score(k, space), FOUND_COLUMNS)

    top = Window.partitionBy("qblock", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    bounds = lambda df: df.where(F.col("rank") == k).groupBy(F.col("qblock").alias("block")).agg(F.collect_list(F.struct("slot", F.col("score").alias("kth"))).alias("kth"))
    reach = lambda kth: asks.join(kth, "block", "left").mapInArrow(_reach(space), "qblock long, pivot int, dmin double, dmax double, near double, far double")
    within = (F.col("low") <= F.col("far") + float(space.slack)) & (F.col("high") >= F.col("near") - float(space.slack))

    own = asks.select(F.col("block").alias("qblock"), F.col("low").alias("qlow"), F.col("high").alias("qhigh"), "pivot").join(summary, "pivot")
    nearest = Window.partitionBy("qblock").orderBy(gap(F.col("qlow"), F.col("qhigh")), "block")
    seeds = written(own.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= SEEDS).select("qblock", "block", "grp"), "seeds")
    found, path = stored(ranked(expanded(seeds, None)), "found")
    todo = reach(bounds(found)).join(summary, "pivot").where(within).join(seeds, ["qblock", "block"], "left_anti")
    order = Window.partitionBy("qblock").orderBy(gap(F.col("dmin"), F.col("dmax")), "block")
    todo = written(todo.select("qblock", "block", "grp", "pivot", "low", "high", F.row_number().over(order).alias("turn")), "annuli")
    done, size, count = 0, first, seeds.count()
    while True:
        kth = written(bounds(found), "bounds")
        left = todo.where(F.col("turn") > done).join(reach(kth).drop("dmin", "dmax"), ["qblock", "pivot"]).where(within).select("qblock", "block", "grp", "turn")
        now = written(left.where(F.col("turn") <= done + size), "round")
        n = now.count()
        if n:
            count += n
            before = path
            found, path = stored(ranked(found.drop("rank").unionByName(expanded(now, kth))), "found")
            remove(spark, before)
        elif not left.limit(1).count():
            break
        done, size = done + size, size * GROWTH
    if seen is not None:
        seen |= {"pairs": asks.count() * index.count(), "expanded": count, "rounds_to": done}
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


#: The same rows by brute force.
SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
