"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are collapsed to distinct ones and dealt into tiles of one size class and neighbouring
population counts. Two tiles meet only if their size classes and population counts allow a link: a
distance is never less than the difference of population counts. In a task, numpy compares sub-tiles by
exclusive-or and bit counts, again skipping sub-tiles whose counts (of the whole, and of 16-bit quarters)
differ too much. A tile pair reports a star for each group it finds, never all pairs, and the stars are
joined to components by alternating large-star and small-star rounds over written tables.

Every pair of distinct fingerprints within the radius is found: the work grows with their square, less
what the skips save.

Defined results: a null or empty text has no words and the fingerprint zero, and links like any other;
fewer words than a shingle make one shingle; null doc_ids are grouped and named by the smallest
other doc_id of the group (null if there is none); repeated rows are exact copies; texts of any length are
read whole; an empty table gives no rows. Other columns are not read; the stage passes them unchanged.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches, filed, fresh, numbered, own_columns, read_table, remove, ship, small, stored, written

ROW = "__hl_row"
TILE = 8192
SUB = 512
CHUNK = 1 << 16


def _shingles(text: str, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined words, and where each shingle starts and stops in them."""
    tokens = text.encode().lower().split()
    if not tokens:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(np.array(list(map(len, tokens)), np.int64) + 1) - 1
    k = min(words, len(tokens))
    return b" ".join(tokens), np.concatenate([[0], ends[: len(tokens) - k] + 1]), ends[k - 1 :]


def _hashes(joined: bytes, starts: np.ndarray, stops: np.ndarray, lane: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42 + lane) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], "<u8")


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(_hashes(*_shingles(text, words), 0))


def fingerprint(text: str, words: int, lanes: int, distinct: bool = False) -> tuple[int, list[int], bytes]:
    """Number of shingles and, for each lane of 64 bits, the bits set in over half of the shingles' hashes; with
    `distinct`, repeated shingles count once, and a digest of their set follows."""
    joined, starts, stops = _shingles(text, words)
    mark = b""
    if distinct:
        own, at = np.unique(_hashes(joined, starts, stops, 0), return_index=True)
        starts, stops, mark = starts[at], stops[at], xxhash.xxh3_128_digest(own.tobytes())
    n, out = len(stops), []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for c in range(0, n, CHUNK):
            h = own[c : c + CHUNK] if distinct and not lane else _hashes(joined, starts[c : c + CHUNK], stops[c : c + CHUNK], lane)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True) if n else 0)
    return n, out, mark


FINGERPRINTS = pa.schema([("file", pa.int64()), ("twin", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("mark", pa.binary())])


def _fingerprints(words: int, lanes: int, distinct: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, f0, f1, marks = [], [], [], []
            for value in batch["text"]:
                size, f, mark = fingerprint(value.as_py() or "", words, lanes, distinct)
                n.append(size)
                f0.append(f[0])
                f1.append(f[1] if lanes > 1 else 0)
                marks.append(mark)
            yield from batches({"file": batch["file"], "twin": batch["twin"], "row": batch["row"], "doc_id": batch["doc_id"], "n": n, "f0": f0, "f1": f1, "mark": marks}, FINGERPRINTS, 1 << 16)

    return run


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, distinct: bool = False) -> DataFrame:
    if lanes not in (1, 2):
        raise ValueError("one or two lanes of 64 bits")
    ship(docs.sparkSession)
    rows = numbered(filed(docs).select("doc_id", "text"), ROW).select(f"{ROW}.*", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_fingerprints(words, lanes, distinct), "file long, twin long, row long, doc_id long, n long, f0 long, f1 long, mark binary")
    return found.select(F.struct("file", "twin", "row").alias("rid"), "doc_id", "n", "f0", "f1", *(["mark"] if distinct else []))


# -- tiles


def _pack_tile(table: pa.Table) -> pa.Table:
    f0, f1 = table["f0"].to_numpy(), table["f1"].to_numpy()
    order = np.lexsort([*quarters(f0, f1).T[::-1]])
    blob = b"".join(table[c].to_numpy()[order].astype("<i8").tobytes() for c in ("id", "f0", "f1", "n"))
    return pa.table({"tile": table["tile"].slice(0, 1), "blob": pa.array([blob], pa.binary())})


def quarters(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """Population counts: of all bits, then of each 16-bit quarter of the first lane, then of the second lane."""
    q = np.bitwise_count(np.ascontiguousarray(f0).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    second = np.bitwise_count(np.ascontiguousarray(f1).view(np.uint64)).astype(np.int16)
    return np.column_stack([q.sum(axis=1) + second, q, second])


class Tile:
    def __init__(self, blob: bytes):
        a = np.frombuffer(blob, "<i8").reshape(4, -1)
        self.id, self.f0, self.f1, self.n = a[0], a[1].view("<u8"), a[2].view("<u8"), a[3]
        pops = quarters(a[1], a[2])
        cuts = range(0, len(self.id), SUB)
        self.low = np.array([pops[c : c + SUB].min(axis=0) for c in cuts])
        self.high = np.array([pops[c : c + SUB].max(axis=0) for c in cuts])


def near(a: Tile, b: Tile, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, hub) over the groups that the links between the two tiles make."""
    same = a is b
    ids = a.id if same else np.concatenate([a.id, b.id])
    shift = 0 if same else len(a.id)
    parent = np.arange(len(ids))
    gap = np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]).clip(0)
    close = (gap[..., 0] <= radius) & (gap[..., 1:].sum(axis=2) <= radius)
    two = bool(a.f1.any() or b.f1.any())
    for i, j in np.argwhere(close).tolist():
        if same and j < i:
            continue
        x, y = slice(i * SUB, (i + 1) * SUB), slice(j * SUB, (j + 1) * SUB)
        px, py = parent[x], parent[shift + j * SUB : shift + j * SUB + len(b.id[y])]
        if (px == px[0]).all() and (py == px[0]).all():
            continue
        d = np.bitwise_count(a.f0[x, None] ^ b.f0[None, y])
        if two:
            d = d + np.bitwise_count(a.f1[x, None] ^ b.f1[None, y])
        u, v = (d <= radius).nonzero()
        if not len(u):
            continue
        if ratio:
            na, nb = a.n[x][u], b.n[y][v]
            small, large = np.minimum(na, nb), np.maximum(na, nb)
            ok = small >= ratio * large - 1e-9
            u, v = u[ok], v[ok]
        u, v = u + i * SUB, v + j * SUB + shift
        while True:
            ru, rv = parent[u], parent[v]
            apart = ru != rv
            if not apart.any():
                break
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            parent[np.maximum(ru, rv)] = np.minimum(ru, rv)
            while (parent[parent] != parent).any():
                parent = parent[parent]
    moved = (parent != np.arange(len(ids))).nonzero()[0]
    return ids[moved], ids[parent[moved]]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(radius: int, ratio: float, group: int):
    """Streams, for each group of tiles, its tiles and then the tiles that meet some of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, {}
        for batch in it:
            columns = (batch[c].to_pylist() for c in ("grp", "kind", "tile", "low", "high", "blob"))
            for grp, kind, tile, low, high, blob in zip(*columns, strict=True):
                if grp != of:
                    of, held = grp, {}
                if kind == 0:
                    held[tile] = Tile(blob)
                    continue
                one = Tile(blob)
                for other in range(max(low, grp * group), min(high, grp * group + group - 1) + 1):
                    a, b = near(one, one if tile == other else held[other], radius, ratio)
                    if len(a):
                        yield from batches({"a": np.maximum(a, b), "b": np.minimum(a, b)}, EDGES, 1 << 16)

    return run


def plan_tiles(strata: list[tuple[int, int, int]], radius: int, reach: int, tile: int):
    """strata: (size class, population count, rows). Returns (class, count, first tile, tiles) for each stratum, and
    (first tile, last tile, from, to) for runs of tiles that meet the same range of tiles: no more than strata, whatever
    their rows. A tile meets itself and those of its range that come later."""
    homes, runs = [], []  # runs: (class, least count, greatest count, first tile, tiles)
    at = tiles = 0
    strata = sorted(strata)
    while at < len(strata):
        size, pop, rows = strata[at]
        parts, held, last = max(1, -(-rows // tile)), 0, pop
        if parts > 1:
            homes.append((size, pop, tiles, parts))
            at += 1
        while parts == 1 and at < len(strata) and strata[at][0] == size and held + strata[at][2] <= tile:
            homes.append((size, strata[at][1], tiles, 1))
            held, last = held + strata[at][2], strata[at][1]
            at += 1
        runs.append((size, pop, last, tiles, parts))
        tiles += parts
    meets = []
    for low_class in {r[0] for r in runs}:
        for other in range(low_class, low_class + reach + 1):
            there = [r for r in runs if r[0] == other]  # both ends rise with the tile number
            lows, highs = [r[1] for r in there], [r[2] for r in there]
            for _, low, high, first, parts in (r for r in runs if r[0] == low_class):
                a, b = bisect_left(highs, low - radius), bisect_right(lows, high + radius) - 1
                if a <= b:
                    meets.append((first, first + parts - 1, there[a][3], there[b][3] + there[b][4] - 1))
    return homes, meets, tiles


# -- components


def star_rounds(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and isn't its component's smallest, from edges (a, b) with a > b."""
    spark = edges.sparkSession
    e, path = stored(edges.distinct(), "edges")
    n = e.count()
    while n:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hub = large.groupBy("a").agg(F.min("b").alias("m"))
        smaller = large.join(hub, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, after = stored(smaller.unionByName(hub.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, n = n, now.count()
        settled = n == before and now.join(e, ["a", "b"], "left_anti").isEmpty()
        remove(spark, path)
        e, path = now, after
        if settled:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


#: Parts of a key's rows where the other side, a row for each key, is too long to be sent to every task.
SALTS = 16


def beside(rows: DataFrame, one: DataFrame, key: str, row: str) -> DataFrame:
    """rows with the columns of `one`, which has one row for each key: any number of rows may share a key, so they are dealt by a hash of `row` too."""
    n = one.count()
    if n <= BROADCAST_ROWS:
        return rows.join(small(one, n), key)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__hl_salt")
    return rows.withColumn("__hl_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")).join(one.select("*", salt), [key, "__hl_salt"]).drop("__hl_salt")


def linked(nodes: DataFrame, radius: int, ratio: float = 0.0, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """nodes (f0, f1, n, first and others) as written with an id, which rises with `first`, and star_rounds() over the
    links within the radius, so that a root has the least `first` of its component. With a ratio, links also need that
    ratio of shingle counts."""
    spark = nodes.sparkSession
    size = F.when(F.col("n") > 0, F.floor(F.log("n") / math.log(1 / ratio)).cast("int")).otherwise(-1) if ratio else F.lit(0)
    nodes = written(nodes, "distinct").repartitionByRange("first").sortWithinPartitions("first")
    nodes = nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("size", size)
    nodes = written(nodes.withColumn("pop", F.bit_count("f0") + F.bit_count("f1")), "nodes")
    strata = [tuple(r) for r in nodes.groupBy("size", "pop").count().collect()]  # at most 129 counts for each of some hundred classes
    homes, meets, count = plan_tiles(strata, radius, 1 if ratio else 0, tile)
    if not homes:
        return nodes, spark.createDataFrame([], "id long, root long")
    home = spark.createDataFrame(homes, "size int, pop int, base int, parts int")
    meet = spark.createDataFrame(meets, "first_tile int, last_tile int, low int, high int")
    tiles = nodes.join(F.broadcast(home), ["size", "pop"]).select((F.col("base") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("tile"), "id", "f0", "f1", "n")
    blobs = written(tiles.groupBy("tile").applyInArrow(_pack_tile, "tile int, blob binary"), "tiles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = max(1, min(64, count // (4 * parts)))  # a tile travels once to each group of partners
    grp = lambda c: F.floor(F.col(c) / group).cast("int")
    none = F.lit(None).cast("int")
    mine = blobs.select(grp("tile").alias("grp"), F.lit(0).alias("kind"), "tile", none.alias("low"), none.alias("high"), "blob")
    ranged = blobs.join(F.broadcast(meet), F.col("tile").between(F.col("first_tile"), F.col("last_tile"))).withColumn("low", F.greatest("low", "tile")).where("low <= high")
    guests = ranged.select(F.explode(F.sequence(grp("low"), grp("high"))).alias("grp"), F.lit(1).alias("kind"), "tile", "low", "high", "blob")
    stream = mine.unionByName(guests).repartition(max(parts, min(count, 4 * parts)), "grp").sortWithinPartitions("grp", "kind", "tile")
    return nodes, star_rounds(stream.mapInArrow(_compare(radius, ratio, group), "a long, b long"))


def first_row():
    """The first row of a group by (doc_id, rid), null doc_ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")).alias("first")


def components(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """prints (a written table of fingerprints()) with component_id, the smallest doc_id reachable."""
    key = ["f0", "f1"]
    nodes, roots = linked(prints.groupBy(*key).agg(first_row()).withColumn("n", F.lit(0).cast("long")), radius, tile=tile)
    heads = nodes.join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("first.doc_id").alias("head"))
    moved = beside(roots, written(heads, "heads"), "root", "id").select("id", "head", F.lit(True).alias("moved"))
    of = nodes.join(moved, "id", "left").select(*key, F.when(F.col("moved"), F.col("head")).otherwise(F.col("first.doc_id")).alias("component_id"))
    return prints.join(of, key).select("rid", "doc_id", "n", "f0", "f1", "component_id")


# -- exact similarity within candidate groups


def alike(sets: list[np.ndarray], ratio: float) -> np.ndarray:
    """A label for each set of hashes, none empty: equal for sets that links of Jaccard similarity >= ratio connect.
    Every pair is accounted for: joined already, without a common element among the rarest that such a pair must
    share (prefix filter), or counted."""
    n = np.array([len(x) for x in sets])
    start, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    el = rank[np.lexsort((rank, count[rank], owner))]
    label, seen = np.arange(len(n)), np.zeros(len(count), bool)

    def join(u: int, others: np.ndarray) -> np.ndarray:
        own = el[start[u] : start[u] + n[u]]
        seen[own] = True
        size = n[others]
        first = np.cumsum(size) - size
        hits = np.add.reduceat(seen[el[np.repeat(start[others] - first, size) + np.arange(size.sum())]], first, dtype=np.int64)
        seen[own] = False
        found = others[hits * (1 + ratio) >= ratio * (n[u] + size) - 1e-9]
        if len(found):
            label[np.isin(label, label[found])] = label[u]
        return found

    left = np.arange(len(n))
    while len(left) > 1:  # near copies of one text join at once
        u, left = left[0], left[1:]
        found = join(u, left)
        left = left[~np.isin(left, found)]
        if 8 * len(found) < len(left):
            break
    most = label == np.bincount(label).argmax()
    prefix = n - np.ceil(ratio * n - 1e-9).astype(np.int64) + 1
    in_prefix = np.arange(len(el)) - np.repeat(start, n) < np.repeat(prefix, n)
    by = np.argsort(el[in_prefix], kind="stable")
    holders = owner[in_prefix][by]
    cuts = np.searchsorted(el[in_prefix][by], np.arange(len(count) + 1))
    for u in (~most).nonzero()[0].tolist():
        v = np.unique(np.concatenate([holders[cuts[e] : cuts[e + 1]] for e in el[start[u] : start[u] + prefix[u]].tolist()]))
        v = v[(label[v] != label[u]) & ((v < u) | most[v])]
        if len(v):
            join(u, v)
    return label


def _sets(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            blobs = [shingle_set(t.as_py() or "", words).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["root"], batch["id"], batch["parts"], pa.array(blobs, pa.binary())], ["root", "id", "parts", "blob"])

    return run


def _verify(ratio: float):
    """Streams rows sorted by (root, i, j); stars over the links of each."""

    def stars(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids)
        label = alike([sets[k] for k in order], ratio)
        ids = np.array(ids)[order]
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        hub = ids[first][at]
        moved = hub != ids
        if moved.any():
            yield from batches({"a": ids[moved], "b": hub[moved]}, EDGES, 1 << 16)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, sets = None, [], []
        for batch in it:
            keys = zip(*(batch[c].to_pylist() for c in ("root", "i", "j")), strict=True)
            for key, one, blob in zip(keys, batch["id"].to_pylist(), batch["blob"], strict=True):
                if key != of and ids:
                    yield from stars(ids, sets)
                    ids, sets = [], []
                of = key
                ids.append(one)
                sets.append(np.frombuffer(blob.as_py(), "<u8"))
        if ids:
            yield from stars(ids, sets)

    return run


#: A group of candidates over SPREAD bytes of hashes is cut into parts, whose pairs each meet in a task: few, unless parts exceed PART.
SPREAD, PART, FEW = 4 << 20, 32 << 20, 8


def verified(docs: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, ratio: float, spread: int = SPREAD) -> DataFrame:
    """star_rounds() over the links of Jaccard similarity >= ratio, among nodes that `roots` puts in one group."""
    spark = docs.sparkSession
    group = nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n", F.col("first.rid").alias(ROW))
    size = F.sum(F.col("n") * 8)
    parts = F.greatest(F.least(F.ceil(size / spread), F.lit(FEW)), F.ceil(size / (spread * PART // SPREAD))).cast("int").alias("parts")
    groups = group.groupBy("root").agg(F.count("*").alias("members"), parts).where("members > 1").drop("members")
    wanted = written(beside(group, written(groups, "groups"), "root", "id").drop("n"), "candidates")
    texts = numbered(docs.select("text"), ROW).select(ROW, "text").join(small(wanted, wanted.count()), ROW)
    sets = written(texts.select("root", "id", "parts", "text").mapInArrow(_sets(words), "root long, id long, parts int, blob binary"), "sets")
    part, other = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))).alias("other")
    met = sets.withColumn("part", part).select("root", "id", "blob", "parts", "part", other).where("parts = 1 or part <> other")
    met = met.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "blob")
    tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return star_rounds(met.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(ratio), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs."""
    found = components(written(fingerprints(docs, words), "fingerprints"), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: For documents alike in 0.8 of their five-word shingles: cosine 0.889, so 19 of 128 bits differ on average (deviation 4). The radius only finds candidates.
STAGE_WORDS, STAGE_RADIUS, STAGE_RATIO = 5, 35, 0.8


def first_of_each(docs: DataFrame, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS, ratio: float = STAGE_RATIO) -> DataFrame:
    """docs without all but the first row (by doc_id) of each group that links of similarity `ratio` or more connect:
    the Jaccard similarity of sets of shingles, computed from the texts for all candidates that the fingerprints give."""
    docs = filed(docs)
    prints = written(fingerprints(docs, words, 2, distinct=True), "fingerprints")
    nodes, roots = linked(prints.groupBy("f0", "f1", "n", "mark").agg(first_row()), radius, ratio)
    links = verified(docs, nodes, roots, words, ratio)
    row = fresh(docs, ROW)
    keep = nodes.join(links, "id", "left_anti").select(F.col("first.rid").alias(row))  # roots, and what has no link
    return numbered(docs, row).join(keep, row, "left_semi").select(*own_columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
