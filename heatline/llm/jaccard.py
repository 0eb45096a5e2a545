"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with one set of shingles are one node. Shingles get a total order that puts those of crowded cells last: a fixed
table of `CELLS` counters, filled from all documents, estimates how frequent a shingle is; the order need only be the same
everywhere, so the result doesn't depend on how well it does. Two sets that are alike in the ratio share at least l of
their first n - ceil(ratio n) + l shingles, for every l. A shingle is live if two nodes have it in their longest prefix
(l = LEVELS). Each node indexes its live shingles and probes with the l that has the least estimated cost: a longer
prefix demands l matches, so the l - 1 most crowded of its shingles needn't be probed. What two nodes share of their prefixes
is counted from their lists of live shingles, which travel with them: below l matches, or below what the sizes and the
rest of the sets leave possible, a pair goes no further. Lists of at most SMALL nodes give their pairs, whose matches are
summed (what two nodes may share of longer lists is granted to them). Longer lists are for pairs that share no short one:
there nodes travel with their live shingles, a list of more than BLOCK is cut into blocks, whose pairs meet in tasks of
their own, and tasks report a star for each group of candidates, never pairs. The similarity of candidates is then
computed from the texts (simhash.verified), and only its links make components.

Shingles are compared by 64-bit hashes (words by a polynomial of their bytes, shingles by mixing those of words). Nodes of fewer shingles than any two different sets that are alike must have
(nine, for 0.9) need no candidates. Work in one crowded list grows with the square of its nodes.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing: its component is
its own doc_id; fewer words than a shingle make one shingle; null doc_ids are grouped and named by the smallest other doc_id
of the group (null if there is none); repeated rows are exact copies; texts of any length are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, filed, numbered, read_table, ship, written
from .simhash import ROW, beside, first_row, star_rounds, verified

WORDS, RATIO, LEVELS = 3, (90, 100), 4
CELLS, CHUNK = 1 << 20, 1 << 16
#: Nodes of a list that meet in one task, and the weight of a longer prefix against a node that is met.
BLOCK, PER_SHINGLE = 2048, 1.0
#: Nodes of a list that gives its pairs.
SMALL = 16
#: Shingles whose sharing is counted at once.
COLUMNS = 2048
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


#: White space, and letters A-Z in lower case, by byte.
BLANK = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
#: Bytes of texts that are hashed at once, but for a longer text.
TEXTS = 1 << 20
_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))


@cache
def powers(base: int, n: int) -> np.ndarray:
    """base ** (0, 1, ..., n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their hashes: the sum of byte * A ** place, shifted to place 0, mixed with
    the length."""
    full = ~BLANK[data]
    edge = np.diff(full.astype(np.int8), prepend=0, append=0)
    starts, stops = (edge == 1).nonzero()[0], (edge == -1).nonzero()[0]
    size = 1 << max(12, (len(data) - 1).bit_length()) if len(data) else 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[data] + np.uint64(1)) * powers(int(_A), size)[: len(data)], dtype=np.uint64)])
    h = (sums[stops] - sums[starts]) * powers(int(_INVERSE), size)[starts]
    return starts, _mixed(h + (stops - starts).astype(np.uint64) * _B)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text of a column, the sorted hashes of its distinct shingles, each of `words` words' hashes in order."""
    texts = column.cast(pa.large_string()).fill_null("")
    raw = texts.buffers()
    ends = np.frombuffer(raw[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if len(texts) and raw[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXTS, side="right")) - 1)
        own = ends[at : to + 1] - ends[at]
        # a blank after each text keeps its last word from the next text's first
        part = np.insert(data[ends[at] : ends[to]], own[1:], 0x20)
        starts, hashes = word_hashes(part)
        cuts = np.searchsorted(starts, own + np.arange(len(own)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                yield np.empty(0, np.uint64)
                continue
            k = min(words, b - a)
            h = np.full(b - a - k + 1, k, np.uint64)
            for j in range(k):
                h = _mixed(h * _A + hashes[a + j : b - k + 1 + j])
            yield np.unique(h)
        at = to


# -- how crowded cells are

CELL_ROWS = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])


def _cell_counts(words: int):
    """A task's counters, in chunks of a row each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(CELLS, np.uint64), False
        for batch in it:
            for h in shingle_sets(batch["text"], words):
                any_ |= len(h) > 0
                np.add.at(counts, (h % np.uint64(CELLS)).astype(np.int64), np.uint64(1))
        if any_:
            for c in range(0, CELLS, CHUNK):
                part = counts[c : c + CHUNK]
                if part.any():
                    yield from batches({"chunk": [c // CHUNK], "counts": [part.astype("<u4" if part.max() < 1 << 32 else "<u8").tobytes()]}, CELL_ROWS)

    return run


def _cell_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of each chunk that a task gets; at most CELLS of them are held."""
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        for chunk, raw in zip(batch["chunk"].to_pylist(), batch["counts"], strict=True):
            raw = raw.as_py()
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, "<u4" if len(raw) == 4 * CHUNK else "<u8").astype(np.uint64)
    for chunk, counts in sums.items():
        yield from batches({"chunk": [chunk], "counts": [counts.astype("<u8").tobytes()]}, CELL_ROWS)


def crowding(docs: DataFrame, words: int) -> np.ndarray:
    """Of each cell, the class of its count: quarter powers of two, so one byte holds any. CELLS bytes, whatever the input."""
    rows = docs.select("text").mapInArrow(_cell_counts(words), "chunk int, counts binary")
    for parts in (CELLS // CHUNK * 8, CELLS // CHUNK):  # in two rounds, so that no task gets every task's chunk
        dealt = rows.repartition(parts, "chunk", F.pmod(F.xxhash64("counts"), F.lit(8))) if parts > CELLS // CHUNK else rows.repartition(parts, "chunk")
        rows = dealt.mapInArrow(_cell_sums, "chunk int, counts binary")
    classes = np.zeros(CELLS, np.uint8)
    for chunk, raw in written(rows, "cells").collect():  # at most CELLS counters
        counts = np.frombuffer(bytes(raw), "<u8").astype(float)
        classes[chunk * CHUNK : chunk * CHUNK + CHUNK] = np.ceil(4 * np.log2(counts + 1)).clip(0, 255)
    return classes


# -- nodes and prefixes


def least_size(ratio: tuple[int, int]) -> int:
    """The fewest shingles of the smaller of two different sets that are alike."""
    num, den = ratio
    return -(-num // (den - num))


def prefix_lengths(n: np.ndarray, level: np.ndarray | int, ratio: tuple[int, int]) -> np.ndarray:
    num, den = ratio
    return np.minimum(n, n - -(-num * n // den) + level)


NODES = pa.schema([("file", pa.int64()), ("twin", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("prefix", pa.binary())])


def _nodes(words: int, ratio: tuple[int, int], classes: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_size(ratio)
        for batch in it:
            sizes, marks, prefixes = [], [], []
            for h in shingle_sets(batch["text"], words):
                sizes.append(len(h))
                marks.append(xxhash.xxh3_128_digest(h.tobytes()))
                if len(h) < least:
                    prefixes.append(None)
                    continue
                # the class leads, so that the key alone has the order; equal keys go by the hash
                key = (classes[(h % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                p = int(prefix_lengths(np.int64(len(h)), LEVELS, ratio))
                prefixes.append(np.sort(key)[:p].astype("<u8").tobytes())
            yield from batches({"file": batch["file"], "twin": batch["twin"], "row": batch["row"], "doc_id": batch["doc_id"], "n": sizes, "mark": marks, "prefix": prefixes}, NODES)

    return run


def nodes_of(docs: DataFrame, words: int, ratio: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(prints, nodes): doc_id, n and mark of every row of docs (which filed() gave), and a row for each distinct set that has
    shingles, with an id that rises with its first row, and the keys of its longest prefix."""
    classes = crowding(docs, words)
    rows = numbered(docs.select("doc_id", "text"), ROW).select(f"{ROW}.*", F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = rows.mapInArrow(_nodes(words, ratio, classes), "file long, twin long, row long, doc_id long, n long, mark binary, prefix binary")
    prints = written(prints.select(F.struct("file", "twin", "row").alias("rid"), "doc_id", "n", "mark", "prefix"), "prints")
    sets = prints.where("n > 0").groupBy("n", "mark").agg(first_row(), F.max("prefix").alias("prefix"))
    nodes = written(sets, "distinct").repartitionByRange("first").sortWithinPartitions("first").withColumn("id", F.monotonically_increasing_id())
    return prints.drop("prefix"), written(nodes, "nodes")


# -- candidates

KEYS = pa.schema([("id", pa.int64()), ("key", pa.int64())])


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys = [np.frombuffer(x.as_py(), "<u8") for x in batch["prefix"]]
        ids = np.repeat(batch["id"].to_numpy(), [len(k) for k in keys])
        if len(ids):
            yield from batches({"id": ids, "key": np.concatenate(keys).view(np.int64)}, KEYS, 1 << 16)


def chosen_level(at: np.ndarray, crowd: np.ndarray, n: int, ratio: tuple[int, int], levels: int = LEVELS, small: int = SMALL) -> int:
    """The l with the least estimated cost for a node whose live shingles stand at these places of its prefix and are in lists
    of these lengths: the nodes met in its lists, where the l - 1 most crowded of the long ones aren't probed, and the length
    of the prefix; nothing if it has fewer live shingles than l."""
    costs = []
    for level in range(1, levels + 1):
        p = int(prefix_lengths(np.int64(n), level, ratio))
        own = np.sort(crowd[at < p])
        long = own[own > small]
        costs.append(float(own[own <= small].sum() + long[: max(0, len(long) - level + 1)].sum()) + PER_SHINGLE * p if len(own) >= level else 0.0)
    return int(np.argmin(costs)) + 1


MET = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("first", pa.int32()), ("probe", pa.bool_()), ("live", pa.binary()), ("facts", pa.binary())])


def _meetings(ratio: tuple[int, int], levels: int, block: int, small: int):
    """Rows (id, n, prefix, live keys and their lists' lengths): the node for each list that it is in, and for each pair of blocks
    of a long one. `first`: the least l whose prefix holds the key; `live`, in long lists only: key and first of each live
    key; `facts`: for each l the last key of its prefix, and how many keys of long lists are in it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in MET.names}
        for batch in it:
            for id_, n, prefix, live in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["prefix"], batch["live"], strict=True):
                keys = np.frombuffer(prefix.as_py(), "<i8")
                live_keys, live_crowd = (live.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "crowd"))
                order = np.argsort(live_keys)
                live_keys, live_crowd = live_keys[order], live_crowd[order]
                near = np.searchsorted(live_keys, keys).clip(max=len(live_keys) - 1)
                at = (live_keys[near] == keys).nonzero()[0]
                own, crowd = keys[at], live_crowd[near[at]]
                level = chosen_level(at, crowd, n, ratio, levels, small)
                ends = prefix_lengths(np.int64(n), np.arange(1, LEVELS + 1), ratio)
                first = np.searchsorted(ends, at, side="right") + 1
                long = crowd > small
                mine = (long & (first <= level)).nonzero()[0]
                probed = np.zeros(len(at), bool)  # of ties in crowding the larger key is left out, the same on every run
                probed[mine[np.lexsort((own[mine], crowd[mine]))][: max(0, len(mine) - level + 1)]] = True
                facts = np.concatenate([keys[ends - 1], (long & (first <= np.arange(1, LEVELS + 1)[:, None])).sum(axis=1)]).astype("<i8").tobytes()
                packed = np.column_stack([own, first]).astype("<i8").tobytes() if long.any() else None
                for key, f, c, p, far in zip(own.tolist(), first.tolist(), crowd.tolist(), probed.tolist(), long.tolist(), strict=True):
                    parts = -(-c // block) if far else 1
                    home = hash_part(id_, parts) if parts > 1 else 0
                    for other in range(parts):
                        row = (key, min(home, other) if far else -1, max(home, other), id_, n, level, f, p, packed if far else None, facts)
                        for name, v in zip(MET.names, row, strict=True):
                            out[name].append(v)
                    if len(out["id"]) >= 4096:
                        yield from batches(out, MET)
                        out = {c: [] for c in MET.names}
        if out["id"]:
            yield from batches(out, MET)

    return run


def hash_part(id_: int, parts: int) -> int:
    return xxhash.xxh32_intdigest(id_.to_bytes(8, "little")) % parts


def matches_needed(nu, nv, rest_u, rest_v, end_u, end_v, level, ratio: tuple[int, int]) -> np.ndarray:
    """How many shingles of two l-prefixes must agree: l, and as many as the least overlap of sets that are alike has beyond
    the rest of the set whose prefix ends first (its prefix meets nothing beyond the other's)."""
    num, den = ratio
    least = -(-num * (nu + nv) // (num + den))
    return np.maximum(level, least - np.where(end_u <= end_v, rest_u, rest_v))


def candidates(ids: np.ndarray, n: np.ndarray, level: np.ndarray, probe: np.ndarray, live: list[np.ndarray], last: np.ndarray, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, hub) over the pairs of a list in which one probes the other, with as many shared shingles as they need."""
    num, den = ratio
    size = len(ids)
    owner = np.repeat(np.arange(size), [len(x) for x in live])
    flat = np.concatenate(live)
    keys, column, count = np.unique(flat[:, 0], return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, first = owner[shared], flat[shared, 1]
    width = int(column.max()) + 1 if len(column) else 0
    parent = np.arange(size)
    for x in np.unique(level[probe]).tolist():
        probers = (probe & (level == x)).nonzero()[0]
        overlap = np.zeros((len(probers), size), np.float32)
        for c in range(0, width, COLUMNS):
            held = (first <= x) & (column >= c) & (column < c + COLUMNS)
            matrix = np.zeros((size, min(COLUMNS, width - c)), np.float32)
            matrix[owner[held], column[held] - c] = 1
            overlap += matrix[probers] @ matrix.T
        rest, end = n - prefix_lengths(n, x, ratio), last[:, x - 1]
        for a in range(0, len(probers), 256):
            u = probers[a : a + 256]
            counts = overlap[a : a + 256].astype(np.int64)
            nu, nv = n[u, None], n[None, :]
            need = matches_needed(nu, nv, rest[u, None], rest[None, :], end[u, None], end[None, :], x, ratio)
            before = (nv < nu) | ((nv == nu) & (ids[None, :] < ids[u, None]))  # each pair is the later one's to find
            ok = before & (den * nv >= num * nu) & (counts >= need)
            i, v = ok.nonzero()
            parent = joined(parent, u[i], v)
    moved = (parent != np.arange(size)).nonzero()[0]
    return ids[moved], ids[parent[moved]]


def joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """parent with the groups of u and v united, each under its least member."""
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _facts(column: pa.Array) -> np.ndarray:
    """(last keys, counts of keys in long lists), each with a column for each l."""
    out = np.array([np.frombuffer(x.as_py(), "<i8") for x in column]).reshape(-1, 2 * LEVELS)
    return out[:, :LEVELS].view("<u8"), out[:, LEVELS:]


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64())])


def _pairs(ratio: tuple[int, int], small: int):
    """Streams rows of short lists sorted by (key, n, id): a row for each pair and shingle that it shares within the later
    one's prefix, with the number of such shingles that it needs."""
    num, den = ratio

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            own = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "level", "first")}
            own["last"], own["long"] = _facts(batch["facts"])
            if held:
                own = {c: np.concatenate([held[c], own[c]]) for c in own}
            size, done = len(own["key"]), 0 if held is None else len(held["key"])
            for d in range(1, min(small, size)):
                x = np.arange(max(d, done), size)
                y = x - d
                level = own["level"][x]
                ok = (own["key"][x] == own["key"][y]) & (own["id"][x] != own["id"][y]) & (own["first"][x] <= level) & (own["first"][y] <= level) & (den * own["n"][y] >= num * own["n"][x])
                x, y, level = x[ok], y[ok], level[ok]
                if len(x):
                    nx, ny = own["n"][x], own["n"][y]
                    rest = [v - prefix_lengths(v, level, ratio) for v in (nx, ny)]
                    need = matches_needed(nx, ny, *rest, own["last"][x, level - 1], own["last"][y, level - 1], level, ratio)
                    need = need - np.minimum(own["long"][x, level - 1], own["long"][y, level - 1])
                    yield from batches({"a": own["id"][x], "b": own["id"][y], "need": need}, PAIRS, 1 << 16)
            held = {c: v[-small:] for c, v in own.items()}

    return run


def _meet(ratio: tuple[int, int]):
    """Streams rows of long lists sorted by (key, i, j, id)."""

    def stars(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2 or not any(r[3] for r in rows):
            return
        ids, n, level = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        live = [np.frombuffer(r[4], "<i8").reshape(-1, 2) for r in rows]
        last = np.array([np.frombuffer(r[5], "<u8")[:LEVELS] for r in rows])
        a, b = candidates(ids, n, level, np.array([r[3] for r in rows]), live, last, ratio)
        if len(a):
            yield from batches({"a": np.maximum(a, b), "b": np.minimum(a, b)}, EDGES, 1 << 16)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows = None, []
        for batch in it:
            keys = zip(*(batch[c].to_pylist() for c in ("key", "i", "j")), strict=True)
            for key, *row in zip(keys, *(batch[c].to_pylist() for c in ("id", "n", "level", "probe", "live", "facts")), strict=True):
                if key != of:
                    yield from stars(rows)
                    of, rows = key, []
                rows.append(row)
        yield from stars(rows)

    return run


def candidate_groups(nodes: DataFrame, ratio: tuple[int, int], levels: int = LEVELS, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """star_rounds() over the pairs of nodes that the prefixes can't tell apart."""
    spark = nodes.sparkSession
    prefixes = nodes.where("prefix is not null").select("id", "n", "prefix")
    keys = prefixes.select("id", "prefix").mapInArrow(_keys, "id long, key long")
    crowd = keys.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    live = keys.join(crowd, "key").groupBy("id").agg(F.collect_list(F.struct("key", "crowd")).alias("live"))  # no more than a prefix
    kept = prefixes.join(live, "id")
    met = kept.mapInArrow(_meetings(ratio, levels, block, small), "key long, i int, j int, id long, n long, level int, first int, probe boolean, live binary, facts binary")
    met = written(met, "met")
    tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    short = met.where("i < 0").select("key", "n", "id", "level", "first", "facts").repartition(tasks, "key").sortWithinPartitions("key", "n", "id")
    pairs = short.mapInArrow(_pairs(ratio, small), "a long, b long, need long").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"))
    near = pairs.where("shared >= need").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    long = met.where("i >= 0").drop("first").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return star_rounds(near.unionByName(long.mapInArrow(_meet(ratio), "a long, b long")))


def join(docs: DataFrame, words: int = WORDS, ratio: tuple[int, int] = RATIO, levels: int = LEVELS, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of every row of docs."""
    if not 1 <= levels <= LEVELS:
        raise ValueError(f"one to {LEVELS} matches")
    ship(docs.sparkSession)
    docs = filed(docs)
    prints, nodes = nodes_of(docs, words, ratio)
    roots = written(candidate_groups(nodes, ratio, levels, block, small), "candidate-groups")
    links = verified(docs, nodes, roots, words, ratio[0] / ratio[1])
    heads = nodes.join(links.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("first.doc_id").alias("head"))
    moved = beside(links, written(heads, "heads"), "root", "id").select("id", "head", F.lit(True).alias("moved"))
    of = nodes.join(moved, "id", "left").select("mark", F.when(F.col("moved"), F.col("head")).otherwise(F.col("first.doc_id")).alias("component_id"))
    some = beside(prints.where("n > 0"), written(of, "components"), "mark", "rid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
