"""Ranked lexical search by sort-based accumulation.

Items (queries) are dealt into blocks of about `pairs` item-term pairs; each block passes over all documents twice: once
for the corpus statistics (documents, terms, and the documents that hold each of the block's terms), once to score. A
scoring task works on documents in chunks: the occurrences of the block's terms are sorted and counted, each (document,
term) becomes an impact for every item that asks for the term, and the concatenated impacts are summed by item and
document: a radix sort of the packed keys (item, document), then one reduceat. A chunk holds at most `impacts` impacts
and those of one document. Each task keeps the k best documents of each item in heaps; those meet in two rounds of ranges
of items, again through heaps, so that no task or group gets more than k rows of each of a bounded number of others.

What travels: a row for each term and task, and k rows for each item and task. Driver and tasks hold one block of items.

Defined results: null texts and texts without terms are no documents (they count nowhere and are never returned); items
without terms, with null text or with null item_id get no rows; rows of items that share an item_id are one item with the
terms of all; repeated rows of documents are documents of their own; a null doc_id comes last among equal scores; texts of
any length are read whole; an empty table of either gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, read_table, written

K, PAIRS, IMPACTS = 10, 1 << 16, 1 << 20
#: A token of the digest contract: ASCII letters and digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: Parts of an item's candidates that meet first.
SHARDS = 64


def _table() -> bytes:
    """Letters A-Z to lower case, what is between terms to blanks."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 0x80 and keep(b) else b if keep(b) else 0x20 for b in range(256))


TABLE = _table()


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size (but for a term that is longer)."""
    data = text.encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, sixteen bits at a time (numpy sorts those by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort(((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    starts = np.concatenate([[0], (keys[1:] != keys[:-1]).nonzero()[0] + 1])
    return keys[starts], np.add.reduceat(values[order], starts)


class Block:
    """The terms of a block of items, and the items of each term: flat[start[t] : start[t] + size[t]]."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = sorted({i for i, _ in rows})
        place = {i: k for k, i in enumerate(self.items)}
        of: dict[bytes, list[int]] = {}
        for item, term in rows:
            of.setdefault(term.encode(), []).append(place[item])
        self.vocabulary = {t: k for k, t in enumerate(sorted(of))}
        lists = [sorted(set(of[t])) for t in self.vocabulary]
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.array([i for x in lists for i in x], np.int64)


COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])


def _counts(vocabulary: dict[bytes, int]):
    """A task's number of documents (-1) and terms (-2), and how many documents hold each term of the vocabulary."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        held = np.zeros(len(vocabulary), np.int64)
        for batch in it:
            for value in batch["text"]:
                n, found = 0, set()
                for terms in terms_of(value.as_py()):
                    n += len(terms)
                    found.update(terms)
                docs, total = docs + (n > 0), total + n
                held[[vocabulary[t] for t in found & vocabulary.keys()]] += 1
        some = held.nonzero()[0]
        yield from batches({"term": np.concatenate([[-1, -2], some]).astype(np.int32), "n": np.concatenate([[docs, total], held[some]])}, COUNTS)

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Best:
    """The k best (score, document) of each item: more is better, then the smaller document, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        """Arrays of one length; doc is read where known."""
        in_race = score >= self.least[item]
        item, score, doc, known = item[in_race], score[in_race], doc[in_race], known[in_race]
        order = np.lexsort((doc, ~known, -score, item))
        item, score, doc, known = item[order], score[order], doc[order], known[order]
        first = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(item)), 0)) if len(item) else first
        near = np.arange(len(item)) - begin < self.k
        for i, s, d, ok in zip(item[near].tolist(), score[near].tolist(), doc[near].tolist(), known[near].tolist(), strict=True):
            entry, heap = (s, ok, -d), self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int, int | None]]:
        """(item, rank, score, document)."""
        for i, heap in enumerate(self.heaps):
            for rank, (s, ok, d) in enumerate(sorted(heap, reverse=True), 1):
                yield i, rank, s, -d if ok else None


PARTIAL = pa.schema([("item_id", pa.int64()), ("shard", pa.int32()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _scores(block: Block, docs: int, total: int, weights: np.ndarray, k: int, impacts: int):
    """A task's k best documents of each item."""
    vocabulary = block.vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.items), k)
        ids, known, norms, terms, counts, expected = [], [], [], [], [], 0

        def flush():
            nonlocal ids, known, norms, terms, counts, expected
            if terms:
                own = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                term, tf, norm = np.concatenate(terms), np.concatenate(counts), np.array(norms, np.int64)[own]
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
                size = block.size[term]
                ends = np.cumsum(size)
                flat = block.flat[np.repeat(block.start[term] - (ends - size), size) + np.arange(ends[-1])]
                key = flat.astype(np.uint64) * np.uint64(len(terms)) + np.repeat(own, size).astype(np.uint64)
                pairs, sums = summed(key, np.repeat(impact, size))
                item, doc = (pairs // np.uint64(len(terms))).astype(np.int64), (pairs % np.uint64(len(terms))).astype(np.int64)
                some = sums > 0
                best.offer(item[some], sums[some], np.array(ids, np.int64)[doc[some]], np.array(known, bool)[doc[some]])
            ids, known, norms, terms, counts, expected = [], [], [], [], [], 0

        for batch in it:
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                n, hits = 0, np.empty(0, np.uint64)
                seen = np.empty(0, np.int64)
                for words in terms_of(value.as_py()):
                    n += len(words)
                    found = np.array([t for t in map(vocabulary.get, words) if t is not None], np.uint64)
                    hits, seen = summed(np.concatenate([hits, found]), np.concatenate([seen, np.ones(len(found), np.int64)]))
                if not len(hits):
                    continue
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                norms.append(10 + (90 * n * docs) // total)
                terms.append(hits.astype(np.int64))
                counts.append(seen)
                expected += int(block.size[terms[-1]].sum())
                if expected >= impacts:
                    flush()
        flush()
        task = TaskContext.get()
        shard = (task.partitionId() if task else 0) % SHARDS
        rows = list(best.rows())
        yield from batches({"item_id": [block.items[r[0]] for r in rows], "shard": [shard] * len(rows), "rank": [r[1] for r in rows], "doc_id": [r[3] for r in rows], "score": [r[2] for r in rows]}, PARTIAL)

    return run


def _select(k: int):
    """The k best of each run of (item, shard) among rows sorted by it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, Best(1, k)

        def rows():
            held = list(best.rows())
            yield from batches({"item_id": [at[0]] * len(held), "shard": [at[1]] * len(held), "rank": [r[1] for r in held], "doc_id": [r[3] for r in held], "score": [r[2] for r in held]}, PARTIAL)

        for batch in it:
            item, shard, score = (batch[c].to_numpy(zero_copy_only=False) for c in ("item_id", "shard", "score"))
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            doc = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *((item[1:] != item[:-1]) | (shard[1:] != shard[:-1])).nonzero()[0] + 1, len(item)] if len(item) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at != (key := (int(item[a]), int(shard[a]))):
                    if at:
                        yield from rows()
                    at, best = key, Best(1, k)
                best.offer(np.zeros(b - a, np.int64), score[a:b], doc[a:b], known[a:b])
        if at:
            yield from rows()

    return run


ROW = "item_id long, shard int, rank int, doc_id long, score long"


def selected(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each item among the k best of each task: by ranges of (item, shard), then of items."""
    for column in (F.col("shard"), F.lit(0)):
        dealt = partial.withColumn("shard", column.cast("int")).repartitionByRange("item_id", "shard").sortWithinPartitions("item_id", "shard")
        partial = written(dealt.mapInArrow(_select(k), ROW), "ranked")
    return partial.drop("shard")


def search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS, impacts: int = IMPACTS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item (item_id, text)."""
    spark = docs.sparkSession
    rows = documents(docs)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), 1))).alias("term"))
    asked = written(words.distinct(), "terms")
    blocks = -(-asked.count() // pairs)
    found = None
    for b in range(blocks):
        own = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "term").collect()]  # some `pairs` rows
        if not own:
            continue
        block = Block(own)
        sums = dict(map(tuple, rows.mapInArrow(_counts(block.vocabulary), "term int, n long").groupBy("term").agg(F.sum("n")).collect()))  # a row for each term of the block
        n, total = sums.get(-1, 0), sums.get(-2, 0)
        if not n:
            break
        weights = np.array([weight(n, sums.get(t, 0)) for t in range(len(block.vocabulary))], np.int64)
        part = written(rows.mapInArrow(_scores(block, n, total, weights, k, impacts), ROW), "partial")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return selected(found, k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM w WHERE len(terms) > 0), tot AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
o AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM o GROUP BY 1), tot),
m AS (SELECT r, doc_id, 10 + (90 * n::BIGINT * nd) // l AS m FROM d, tot),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN o USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS k FROM s WHERE score > 0) WHERE k <= 10"""
