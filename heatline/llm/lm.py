"""Hierarchical Pitman-Yor language model, sampled by Gibbs, and text scores by averaged predictive probabilities.

The context of a token is the word before it (or the start of the text), and every context that the training texts hold
has a restaurant of its own; all share one parent restaurant over words, whose base is uniform over the known words and
one unknown. A customer is a training token; a dish's customers sit at tables; each table is a customer of the parent.
Restaurants are told apart by `CONTEXT_BITS` bits of the word's hash, words by all 64.

A Gibbs move redraws the seating of one dish in one restaurant given everything else: customers are seated in
order from a random cut on, by Chinese-restaurant probabilities given their dish, and the seating is accepted by the ratio
(new over old) of its weight to its probability, which makes the move exact. The same rule serves every count: between two
new tables the steps are a Beta-mixed geometric number, drawn at once, so a move costs its tables, not its customers.
Dishes of one restaurant move at once, given the totals of the sweep before (as in distributed samplers for topic
models); totals over the whole corpus are exchanged after each round of `SWEEPS` sweeps. Discounts come from counts of
counts. The state after each round is a sample; probabilities are averaged over samples. A customer alone has one table,
so pairs seen once are never sampled and stay at home until the end.

Layout: each task packs its tokens into one blob for each bucket of words (a range of hashes), counts pre-aggregated, so
all contexts of a word meet in one task, one entry for each pair and chunk, and fold there as they come. Buckets are as
many as the text's bytes ask for. What a restaurant has over all buckets is summed by ranges of contexts, to which each
bucket sends one sum for each of its contexts. In the end tokens meet the models of a group of buckets as a stream; groups
with more tokens than their share are salted over several tasks. Texts are read twice (counts, scores), not stored.

Defined results: null text is empty and has one token, its end; a null doc_id is a training text; repeated rows train
and score as often as they come; long texts are read whole; with no training texts every probability is that of the
unknown word, 1; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, read_table, stored

CONTEXT_BITS = 40
#: A chunk ends with the slice in which it reaches so many tokens or texts; numbers of texts fit 16 bits.
CHUNK_TOKENS, CHUNK_DOCS = 3_000_000, 1 << 15
SLICE_BYTES, SLICE_DOCS = 1 << 20, 1 << 12
#: Bytes of text whose words share a bucket, and buckets at least.
BUCKET_BYTES, BUCKETS = 16 << 20, 24
#: Buckets that score their tokens in one task at most, and such groups from which on they are several.
GROUP, GROUPS = 8, 96
ROUNDS, SWEEPS = 2, 2
STRENGTH = 1.0
FOLD = 1_000_000
FLUSH = 1 << 21
#: A byte string that is no word: what comes before a text's first token.
START = b" "
MODEL, STATE, TOTALS, TOKENS, TEXTS = 0, 1, 2, 3, 4


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes of equal rank together, which compress better."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, ord(a.dtype.kind), len(a)))], "<i8").tobytes()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def load(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    head, at, out = np.frombuffer(data, "<i8", 3 * n, 8), 8 + 24 * n, []
    for size, kind, length in head.reshape(-1, 3).tolist():
        planes = np.frombuffer(data, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{chr(kind)}{size}"))
        at += size * length
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def starts(grouped: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.append(True, grouped[1:] != grouped[:-1]).nonzero()[0] if len(grouped) else np.empty(0, np.int64)


def edges(bits: int, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of hashes of so many bits begins, but the first."""
    return np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)


def cuts(rising: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(rising, inner), [len(rising)]])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# -- tokens


def tokens_of(text: pa.Array) -> pa.ListArray:
    """The words of each text, and its end, an empty string."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(text))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(text, "", " ")))


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE_BYTES of text each, however long one text is."""
    for batch in it:
        part = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False) + SLICE_BYTES // SLICE_DOCS, dtype=np.int64) // SLICE_BYTES
        at = [*starts(part).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield batch.slice(a, b - a)


def _chunks(it: Iterator[pa.RecordBatch]):
    """(h, word, before, doc, size, doc_ids): the hashes of the chunk's words, rising, and of each token its place among
    them, that of the word before, and its text."""

    def chunk(tokens: list, sizes: list, doc_ids: list):
        coded = pa.chunked_array(tokens).dictionary_encode()  # one dictionary for all
        words = coded.chunk(0).dictionary.cast(pa.binary()).to_pylist()
        h = np.array([xxhash.xxh64_intdigest(w, 42) for w in [*words, START]], "<u8")
        order = np.argsort(h, kind="stable")
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        word, size = place[np.concatenate([c.indices.to_numpy() for c in coded.chunks])], np.concatenate(sizes).astype(np.int64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.cumsum(size) - size] = place[-1]
        return h[order], word, before, np.repeat(np.arange(len(size)), size), size, doc_ids

    tokens, sizes, doc_ids, held = [], [], [], 0
    for batch in _slices(it):
        split = tokens_of(batch["text"])
        tokens.append(split.flatten())
        sizes.append(pc.list_value_length(split).to_numpy())
        doc_ids += batch["doc_id"].to_pylist()
        held += len(tokens[-1])
        if held >= CHUNK_TOKENS or len(doc_ids) >= CHUNK_DOCS:
            yield chunk(tokens, sizes, doc_ids)
            tokens, sizes, doc_ids, held = [], [], [], 0
    if doc_ids:
        yield chunk(tokens, sizes, doc_ids)


def contexts_of(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - CONTEXT_BITS)


GRAMS = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])


def _grams(buckets: int):
    """Of each chunk and bucket: tokens, the contexts of all texts, and the training counts of pairs."""
    inner = edges(64, buckets)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, word, before, doc, _, doc_ids in _chunks(it):
            n = len(h)
            held = np.array([held_out(d) for d in doc_ids])
            key = (word * n + before) * 2 + held[doc]
            key.sort()
            first = starts(key >> 1)
            w, v = np.divmod(key[first] >> 1, n)
            count = np.add.reduceat((key & 1) ^ 1, first)  # in training texts
            pair_cuts, ctx, rank = np.searchsorted(w, cuts(h, inner)), contexts_of(h), np.empty(n, np.int64)
            sizes = np.diff(np.append(first, len(key))[pair_cuts])
            rows: dict[str, list] = {c: [] for c in GRAMS.names}
            for b in range(buckets):
                lo, hi = pair_cuts[b : b + 2].tolist()
                if lo == hi:
                    continue
                mine = np.unique(v[lo:hi])
                rank[mine] = np.arange(len(mine))
                own = lo + count[lo:hi].nonzero()[0]
                words = w[own][starts(w[own])]
                per = np.diff(np.append(starts(w[own]), len(own)))
                rows["bucket"].append(b)
                rows["size"].append(int(sizes[b]))
                rows["blob"].append(dump(steps(h[words]), small(per), steps(ctx[mine]), small(rank[v[own]]), small(count[own])))
            yield from batches(rows, GRAMS, 64)

    return run


# -- counts of a bucket

COUNTS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("stats", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())])
COUNTS_COLUMNS = "bucket int, part int, size long, stats array<long>, a binary, b binary"


class _Counts:
    """Pairs of one bucket, folded as they come: no more than twice the distinct ones are held."""

    def __init__(self):
        self.words, self.contexts = np.empty(0, "<u8"), np.empty(0, "<u8")
        self.key, self.n = np.empty(0, np.int64), np.empty(0, np.int64)  # key: place of the word times contexts + that of the context
        self.more, self.held, self.size = [], 0, 0

    def add(self, size: int, blob: bytes) -> None:
        words, per, contexts, v, n = load(blob)
        self.more.append((np.cumsum(words, dtype="<u8"), per, np.cumsum(contexts, dtype="<u8"), v, n))
        self.held += len(n) + len(contexts)
        self.size += size
        if self.held > max(FOLD, len(self.key)):
            self.fold()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of each pair's word and context."""
        return np.divmod(self.key, max(1, len(self.contexts)))

    def fold(self) -> None:
        if not self.more:
            return
        words, contexts = (np.unique(np.concatenate([x, *(m[k] for m in self.more)])) for k, x in ((0, self.words), (2, self.contexts)))
        w, v = self.pairs()
        keys = [np.searchsorted(words, self.words)[w] * len(contexts) + np.searchsorted(contexts, self.contexts)[v]]
        for own, per, near, at, _ in self.more:
            keys.append(np.repeat(np.searchsorted(words, own), per) * len(contexts) + np.searchsorted(contexts, near)[at])
        key, n = np.concatenate(keys), np.concatenate([self.n, *(m[4].astype(np.int64) for m in self.more)])
        self.more, self.held = [], 0
        order = np.argsort(key, kind="stable")  # runs that rise already
        key, n = key[order], n[order]
        first = starts(key)
        self.words, self.contexts, self.key = words, contexts, key[first]
        self.n = np.add.reduceat(n, first) if len(first) else n


def _merge(buckets: int):
    """Streams grams by bucket. Of each: a row with its counts, pairs seen once apart, and a row for each range of contexts."""
    inner = edges(CONTEXT_BITS, buckets)

    def rows(bucket: int, x: _Counts):
        x.fold()
        w, v = x.pairs()
        words, k, n = x.words, len(x.words), len(x.contexts)
        once = x.n == 1
        spread = np.bincount(w, minlength=k)
        stats = [int(s) for s in (x.n.sum(), k, len(w), once.sum(), (x.n == 2).sum(), (spread == 1).sum(), (spread == 2).sum())]
        a = dump(steps(words), steps(x.contexts), small(v[once]))
        b = dump(small(np.bincount(w[once], minlength=k)), small(np.bincount(w[~once], minlength=k)), small(v[~once]), small(x.n[~once]))
        yield (bucket, -1, x.size, stats, a, b)
        sums = [np.bincount(v, x.n, n).astype(np.int64), np.bincount(v[once], minlength=n), np.bincount(v[~once], minlength=n)]
        at = cuts(x.contexts, inner)
        for p in range(buckets):
            if at[p] < at[p + 1]:
                own = slice(at[p], at[p + 1])
                yield (bucket, p, 0, [], dump(steps(x.contexts[own]), *(small(s[own]) for s in sums)), None)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, None
        for batch in it:
            for bucket, size, blob in zip(batch["bucket"].to_pylist(), batch["size"].to_pylist(), batch["blob"], strict=True):
                if bucket != of:
                    if held is not None:
                        yield from batches(dict(zip(COUNTS.names, zip(*rows(of, held), strict=True), strict=True)), COUNTS, 64)
                    of, held = bucket, _Counts()
                held.add(size, blob.as_py())
        if held is not None:
            yield from batches(dict(zip(COUNTS.names, zip(*rows(of, held), strict=True), strict=True)), COUNTS, 64)

    return run


def _sum_up(rounds: int):
    """The rows of one range of contexts, from all buckets: what each of its contexts has over the corpus, for each bucket
    in its own order: customers, tables at first and after each round."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["round"].to_pylist(), table["bucket"].to_pylist(), table["blob"], strict=True), key=lambda r: r[:2])
        asked = {b: load(blob.as_py()) for r, b, blob in rows if r == 0}
        own = {b: np.cumsum(x[0], dtype="<u8") for b, x in asked.items()}
        contexts = np.unique(np.concatenate(list(own.values())))
        at = {b: np.searchsorted(contexts, x) for b, x in own.items()}
        sums = np.zeros((2 + rounds, len(contexts)), np.int64)
        for b, (_, c, once, more) in asked.items():
            sums[0, at[b]] += c.astype(np.int64)
            sums[1, at[b]] += once.astype(np.int64) + more
            sums[2:, at[b]] += once.astype(np.int64)
        for r, b, blob in rows:
            if r:
                sums[1 + r, at[b]] += load(blob.as_py())[0].astype(np.int64)
        blobs = [dump(*(small(s[at[b]]) for s in sums)) for b in asked]
        return pa.table({"bucket": pa.array(list(asked), pa.int32()), "part": pa.array([table["part"][0].as_py()] * len(asked), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


# -- seating


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma, for x > 0."""
    low = x < 8
    z = np.where(low, x + 8, x)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    if low.any():
        y = x[low]
        out[low] -= np.log(np.prod([y + k for k in range(8)], axis=0))
    return out


class Dishes:
    """Seatings of dishes, each by the customers that were seated when its tables but the first were opened: `at`,
    one run after another, t - 1 of each dish."""

    def __init__(self, c: np.ndarray, t: np.ndarray, at: np.ndarray):
        self.c, self.t, self.at = c.astype(np.int64), t.astype(np.int64), at.astype(np.int64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.t)), self.t - 1)

    def without(self, seated: np.ndarray) -> Dishes:
        """The first `seated` customers' tables alone."""
        own = self.owners()
        stay = self.at < seated[own]
        return Dishes(self.c, 1 + np.bincount(own[stay], minlength=len(self.c)), self.at[stay])

    def resized(self, c: np.ndarray, weight, rng) -> Dishes:
        """With other numbers of customers: the last ones leave, or more are seated."""
        stay = np.minimum(self.c, c)
        left = self.without(stay)
        return walk(Dishes(c, left.t, left.at), stay, weight, rng)[0]


def walk(x: Dishes, seated: np.ndarray, weight, rng: np.random.Generator | None = None, at: Dishes | None = None) -> tuple[Dishes, np.ndarray]:
    """x, of whose customers `seated` sit already, with the rest seated in order: drawn by rng, or as in `at`. With it, for
    each dish, the log of what the steps' probabilities leave out of the seating's weight.

    weight(dish, k) gives the weight of a new table beside k of the dish, and k discounts. A table opened early costs later
    customers of all tables a discount; for that a new table's weight is cut by a power of its place, constant between
    powers of two, and there the wait for the next table is Beta-mixed geometric and the normalisers' product is a ratio of
    Gamma functions."""
    n = len(x.c)
    rows, s, k, out = np.arange(n), seated.astype(np.float64), x.t.copy(), np.zeros(n)
    first, second = weight(rows, np.ones(n, np.int64)), weight(rows, np.full(n, 2))
    power = np.clip(second[1] - first[1] - (second[0] - first[0]), 0, None)
    if at is not None:
        end = np.cumsum(at.t - 1)
        following = end - (at.t - 1) + x.t - 1
    dishes, places = [x.owners()], [x.at]
    alive = s < x.c
    rows, s = rows[alive], s[alive]
    while len(rows):
        low = np.ldexp(1.0, np.frexp(s)[1] - 1)
        last = np.minimum(2 * low, x.c[rows]) - 1
        cut = np.minimum(1.5 * low / x.c[rows], 1) ** power[rows]
        a, dk = weight(rows, k[rows])
        a = a * cut
        if at is None:
            p = rng.beta(s - dk, a)
            with np.errstate(divide="ignore", invalid="ignore"):
                wait = np.where(p > 0, np.floor(np.log(1.0 - rng.random(len(p))) / np.log(p)), 0.0)
            place = s + np.where(p < 1, wait, np.inf)
        else:
            more = following[rows] < end[rows]
            place = np.full(len(rows), np.inf)
            place[more] = at.at[following[rows[more]]]
        opened = place <= last
        last = np.where(opened, place, last)
        out[rows] += lgamma(last + 1 - dk + a) - lgamma(s - dk + a) - np.where(opened, np.log(cut), 0)
        new = rows[opened]
        dishes.append(new)
        places.append(last[opened].astype(np.int64))
        k[new] += 1
        if at is not None:
            following[new] += 1
        s = last + 1
        alive = s < x.c[rows]
        rows, s = rows[alive], s[alive]
    order = np.argsort(np.concatenate(dishes), kind="stable")
    return Dishes(x.c, k, np.concatenate(places)[order]), out


def moved(x: Dishes, weight, rng: np.random.Generator, afresh: bool = False) -> Dishes:
    """A Gibbs move of every dish: the customers after a cut, drawn between the first and the last evenly on the scale of
    logarithms, leave and are seated again. `afresh`, all but the first do, whatever the ratio: a first seating."""
    stay = np.ones(len(x.c), np.int64) if afresh else np.minimum(x.c, np.floor(x.c ** rng.random(len(x.c))).astype(np.int64))
    left = x.without(stay)
    new, gained = walk(left, stay, weight, rng)
    if afresh:
        return new
    yes = np.log(1.0 - rng.random(len(gained))) < gained - walk(left, stay, weight, at=x)[1]
    own, old = new.owners(), x.owners()
    dish = np.concatenate([own[yes[own]], old[~yes[old]]])
    at = np.concatenate([new.at[yes[own]], x.at[~yes[old]]])
    return Dishes(x.c, np.where(yes, new.t, x.t), at[np.argsort(dish, kind="stable")])


class Level:
    """What all tasks share: corpus totals, discounts, and the parent's customers and tables, at first and after each round."""

    def __init__(self, n: int, v: int, pairs: int, d: tuple[float, float], parent: list[tuple[int, int]] | None = None):
        self.n, self.v, self.d, self.base = n, v, d, 1.0 / (v + 1)
        self.parent = parent or [(pairs, v)]

    def root(self, c0: np.ndarray, t0: np.ndarray, round_: int) -> np.ndarray:
        customers, tables = self.parent[round_]
        return (np.maximum(c0 - self.d[0] * t0, 0) + (STRENGTH + self.d[0] * tables) * self.base) / (STRENGTH + customers)


class Bucket:
    """The seatings of one bucket's words: pairs seen twice or more in their contexts, and words in the parent."""

    def __init__(self, counts: bytes, state: bytes | None = None):
        self.once, per, self.v, c = load(counts)
        self.once, self.v = self.once.astype(np.int64), self.v.astype(np.int64)
        self.w = np.repeat(np.arange(len(per)), per)
        self.fresh = state is None
        one = np.ones(len(c), np.int64)
        if state is None:
            self.pairs = Dishes(c, one, np.empty(0, np.int64))
            self.words = Dishes(self.customers(), np.ones(len(per), np.int64), np.empty(0, np.int64))
        else:
            t, at, t0, at0 = load(state)
            self.pairs = Dishes(c, t, at)
            self.words = Dishes(self.customers(), t0, at0)

    def customers(self) -> np.ndarray:
        """Of each word in the parent: a table of each pair seen once, and those of the others."""
        return self.once + np.bincount(self.w, self.pairs.t, len(self.once)).astype(np.int64)

    def state(self) -> bytes:
        return dump(small(self.pairs.t), small(self.pairs.at), small(self.words.t), small(self.words.at))

    def sweep(self, level: Level, tables: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Moves all dishes, given the tables of each context over the corpus; returns these as they change here."""
        d0, d1 = level.d
        customers, roots = level.parent[-1]
        own, c0 = self.pairs.t, self.words.c
        others, rest = np.maximum(tables[self.v] - own, 0), c0[self.w] - own
        t0 = np.clip(np.minimum(self.words.t[self.w], rest), 1, None)
        top, below = rest - d0 * t0 + (STRENGTH + d0 * roots) * level.base, STRENGTH + np.maximum(customers - own, 0)

        def weight(dish, k):
            parent = np.maximum(top[dish] + k, 1e-300) / (below[dish] + k)
            return (STRENGTH + d1 * (others[dish] + k)) * parent, d1 * k

        if len(own):
            self.pairs = moved(self.pairs, weight, rng, self.fresh)
        more = np.maximum(roots - self.words.t, 0)
        root = lambda dish, k: ((STRENGTH + d0 * (more[dish] + k)) * level.base, d0 * k)
        if len(c0):
            self.words = moved(self.words.resized(self.customers(), root, rng), root, rng, self.fresh)
        self.fresh = False
        return tables + np.bincount(self.v, self.pairs.t - own, len(tables)).astype(np.int64)


STATES = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("stats", pa.list_(pa.int64())), ("blob", pa.binary())])


def _sample(level: Level, buckets: int, round_: int):
    """Streams, for each bucket, its counts, its state if any, and its contexts' totals by range. Of each: a row with its
    new state, and for each range the tables of its contexts in pairs seen more than once."""

    def rows(bucket: int, counts: bytes, state: bytes | None, parts: list):
        x = Bucket(counts, state)
        parts = [(p, load(blob)) for p, blob in parts]
        tables = np.concatenate([p[1 + round_] for _, p in parts]).astype(np.int64)
        for s in range(SWEEPS):
            tables = x.sweep(level, tables, np.random.default_rng([42, bucket, round_, s]))
        yield (bucket, -1, [int(x.words.c.sum()), int(x.words.t.sum())], x.state())
        mine, at = np.bincount(x.v, x.pairs.t, len(tables)).astype(np.int64), 0
        for p, blob in parts:
            yield (bucket, p, [], dump(small(mine[at : at + len(blob[0])])))
            at += len(blob[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return batches(dict(zip(STATES.names, zip(*rows(of, *held[:2], held[2]), strict=True), strict=True)), STATES, 64)

        of, held = None, None
        for batch in it:
            for bucket, kind, part, blob in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "part", "blob")), strict=True):
                if bucket != of:
                    if held is not None:
                        yield from done()
                    of, held = bucket, [None, None, []]
                if kind == TOTALS:
                    held[2].append((part, blob))
                else:
                    held[0 if kind == MODEL else 1] = blob
        if held is not None:
            yield from done()

    return run


# -- scores

PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _pack(buckets: int):
    """Of each chunk and bucket: its words, contexts and pairs, and the texts that hold each; of each chunk: its texts."""
    inner = edges(64, buckets)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        for seq, (h, word, before, doc, size, doc_ids) in enumerate(_chunks(it)):
            n, docs = len(h), len(size)
            key = (word * n + before) * docs + doc
            key.sort()
            each = starts(key)
            pair, doc = np.divmod(key[each], docs)
            times = np.diff(np.append(each, len(key)))
            first = np.append(starts(pair), len(pair))
            held = np.diff(first)
            w, v = np.divmod(pair[first[:-1]], n)
            pair_cuts, ctx, rank = np.searchsorted(w, cuts(h, inner)), contexts_of(h), np.empty(n, np.int64)
            rows: dict[str, list] = {c: [] for c in PACKED.names}

            def add(*values, rows=rows):
                for c, x in zip(PACKED.names, values, strict=True):
                    rows[c].append(x)

            for b in range(buckets):
                lo, hi = pair_cuts[b : b + 2].tolist()
                if lo == hi:
                    continue
                begins = lo + starts(w[lo:hi])
                mine = np.unique(v[lo:hi])
                rank[mine] = np.arange(len(mine))
                own = slice(first[lo], first[hi])
                add(b, TOKENS, base + seq, dump(steps(h[w[begins]]), small(np.diff(np.append(begins, hi))), steps(ctx[mine]), small(rank[v[lo:hi]]), small(held[lo:hi]), doc[own].astype("<u2"), small(times[own])))
            known = np.array([d is not None for d in doc_ids], "<u1")
            add(-1, TEXTS, base + seq, dump(np.array([d or 0 for d in doc_ids], "<i8"), known, np.array([held_out(d) for d in doc_ids], "<u1"), size))
            yield from batches(rows, PACKED, 64)

    return run


class Model:
    """Probabilities of one bucket's words after any context that its texts hold."""

    def __init__(self, level: Level, names: bytes, counts: bytes, states: list[bytes], parts: list[bytes]):
        words, contexts, once = load(names)
        self.words, self.contexts = np.cumsum(words, dtype="<u8"), np.cumsum(contexts, dtype="<u8")
        totals = [np.concatenate(x).astype(np.float64) for x in zip(*map(load, parts), strict=True)] if parts else []
        samples = [Bucket(counts, s) for s in states]
        x, d1, n = samples[0], level.d[1], max(1, len(self.contexts))
        w = np.concatenate([np.repeat(np.arange(len(x.once)), x.once), x.w])
        v = np.concatenate([once.astype(np.int64), x.v])
        c = np.concatenate([np.ones(len(once), np.int64), x.pairs.c])
        self.count = np.bincount(w, c, len(self.words)).astype(np.int64)
        self.root = np.array([level.root(s.words.c, s.words.t, r + 1) for r, s in enumerate(samples)])
        self.unknown = np.array([level.root(np.zeros(1), np.zeros(1), r + 1)[0] for r in range(len(samples))])
        self.back = np.array([(STRENGTH + d1 * totals[2 + r]) / (STRENGTH + totals[0]) for r in range(len(samples))]) if totals else np.ones((len(samples), 1))
        p = np.zeros(len(w))
        for r, s in enumerate(samples):
            t = np.concatenate([np.ones(len(once), np.int64), s.pairs.t])
            p += (c - d1 * t) / (STRENGTH + totals[0][v]) + self.back[r, v] * self.root[r, w] if totals else 0
        key = w * n + v
        order = np.argsort(key)
        self.key, self.p = key[order], p[order] / len(samples)

    def look(self, h: np.ndarray, contexts: np.ndarray, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each word, and probability of each pair of word and context (places in h and contexts)."""
        place = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        found = self.words[place] == h if len(self.words) else np.zeros(len(h), bool)
        count = np.where(found, self.count[place], 0) if len(self.words) else np.zeros(len(h), np.int64)
        root = np.where(found, self.root[:, place], self.unknown[:, None]) if len(self.words) else np.broadcast_to(self.unknown[:, None], (len(self.unknown), len(h)))
        v = np.searchsorted(self.contexts, contexts)[before]
        out = (self.back[:, v] * root[:, word]).mean(axis=0)
        if len(self.key):
            key = place[word] * len(self.contexts) + v
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out = np.where(found[word] & (self.key[at] == key), self.p[at], out)
        return count, out


SUMS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _score(level: Level):
    """Streams, for each group of buckets and salt, their models and then their tokens, by chunk; sums by text within each
    chunk. Salts of one group may meet in a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, of = 0, None
        models: dict[int, Model] = {}
        parts: dict[int, dict[int, list]] = {}

        def flush():
            nonlocal held, size
            for chunk, sums in held.items():
                doc, base, score, known = (np.concatenate([s[k] for s in sums]) for k in range(4))
                docs, at = np.unique(doc, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "kind": [TOKENS], "blob": [dump(docs.astype("<u2"), np.bincount(at, base), np.bincount(at, score), np.bincount(at, known).astype("<i8"))]}, schema=SUMS)
            held, size = {}, 0

        for batch in it:
            for group, salt, bucket, kind, chunk, a, b in zip(*(batch[c].to_pylist() for c in ("group", "salt", "bucket", "kind", "chunk", "a", "b")), strict=True):
                if kind == TEXTS:
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "kind": [TEXTS], "blob": [a]}, schema=SUMS)
                    continue
                if (group, salt) != of:
                    if of and group != of[0]:  # else a further salt of the group, whose models are the same
                        models = {}
                    of, parts = (group, salt), {}
                if kind != TOKENS:
                    if bucket not in models:
                        parts.setdefault(bucket, {MODEL: [], STATE: [], TOTALS: []})[kind].append((a, b))
                    continue
                if bucket not in models:
                    own = parts.pop(bucket)
                    (names, counts), = own[MODEL]
                    models[bucket] = Model(level, names, counts, [x for x, _ in own[STATE]], [x for x, _ in own[TOTALS]])
                words, per, contexts, before, docs, doc, times = load(a)
                h, contexts = np.cumsum(words, dtype="<u8"), np.cumsum(contexts, dtype="<u8")
                word = np.repeat(np.arange(len(h)), per)
                count, p = models[bucket].look(h, contexts, word, before.astype(np.int64))
                base = np.log10((count + 1) / (level.n + (level.v + 1.0)))
                times = times.astype(np.int64)
                held.setdefault(chunk, []).append((doc, times * np.repeat(base[word], docs), times * np.repeat(np.log10(p), docs), times * np.repeat(count[word] > 0, docs)))
                size += len(doc)
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n: int):
    def run(table: pa.Table) -> pa.Table:
        sums, doc_ids = [], None
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"], strict=True):
            if kind == TEXTS:
                doc_ids, valid, held, size = load(blob.as_py())
            else:
                sums.append(load(blob.as_py()))
        doc, base, score, known = (np.concatenate([s[k] for s in sums]) for k in range(4))
        total = lambda x: np.bincount(doc, x, len(doc_ids))
        return pa.table({
            "doc_id": pa.array(doc_ids, mask=valid == 0), "held_out": held.astype(bool), "n_tokens": size, "n_known": total(known).astype(np.int64),
            "train_tokens": np.full(len(doc_ids), n, np.int64), "base_score": total(base), "score": total(score),
        })

    return run


def discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def score(docs: DataFrame, buckets: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all texts by a model learned from those that are not held out."""
    spark = docs.sparkSession
    texts = documents(docs)
    if buckets is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * buckets, 1 << 14))
    grams = texts.mapInArrow(_grams(buckets), "bucket int, size long, blob binary")
    counts, _ = stored(grams.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(buckets), COUNTS_COLUMNS), "counts")
    models = counts.where("part = -1")
    sums = models.select(*[F.sum(F.get("stats", F.lit(k))) for k in range(7)]).first()
    n, v, pairs, one, two, lone, twice = (x or 0 for x in sums)
    level = Level(n, v, pairs, (discount(lone, twice), discount(one, two)))
    asked = counts.where("part >= 0").select("part", F.lit(0).alias("round"), "bucket", F.col("a").alias("blob"))
    states: list[DataFrame] = []

    def totals() -> DataFrame:
        """(bucket, part, blob) with what each context of a bucket has over the corpus after each round so far."""
        rows = asked
        for r, s in enumerate(states):
            rows = rows.unionByName(s.where("part >= 0").select("part", F.lit(r + 1).alias("round"), "bucket", "blob"))
        return rows.groupBy("part").applyInArrow(_sum_up(len(states)), "bucket int, part int, blob binary")

    def by_bucket(df: DataFrame, kind: int, blob: str = "blob") -> DataFrame:
        return df.select("bucket", F.lit(kind).alias("kind"), "part", F.col(blob).alias("blob"))

    for r in range(rounds):
        stream = by_bucket(models, MODEL, "b").unionByName(by_bucket(totals(), TOTALS))
        if states:
            stream = stream.unionByName(by_bucket(states[-1].where("part = -1"), STATE))
        sampled = stream.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(_sample(level, buckets, r), "bucket int, part int, stats array<long>, blob binary")
        states.append(stored(sampled, f"round{r + 1}")[0])
        c0, t0 = states[-1].where("part = -1").select(F.sum(F.get("stats", F.lit(0))), F.sum(F.get("stats", F.lit(1)))).first()
        level.parent.append((c0 or 0, t0 or 0))

    # neighbours share a task, which sums up each text of a chunk over them
    per = min(GROUP, max(1, buckets // GROUPS))
    group = F.floor(F.col("bucket") / per).cast("int").alias("group")
    sizes = {r["group"]: r["size"] for r in models.groupBy(group).agg(F.sum("size").alias("size")).collect()}  # a row for each group
    share = 2 * sum(sizes.values()) / max(1, len(sizes))
    salts = {g: math.ceil(s / share) for g, s in sizes.items() if s > share}
    salted = spark.createDataFrame(list(salts.items()) or [(-2, 1)], "group int, salts int")
    some, none, long = F.coalesce("salts", F.lit(1)), F.lit(None).cast("binary"), F.lit(None).cast("long")
    model = models.select("bucket", F.lit(MODEL).alias("kind"), "part", "a", "b")
    for r, s in enumerate(states):
        model = model.unionByName(s.where("part = -1").select("bucket", F.lit(STATE).alias("kind"), F.lit(r).alias("part"), F.col("blob").alias("a"), none.alias("b")))
    model = model.unionByName(totals().select("bucket", F.lit(TOTALS).alias("kind"), "part", F.col("blob").alias("a"), none.alias("b"))).select("*", group, long.alias("chunk"))
    model = model.join(F.broadcast(salted), "group", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("salts")
    packed = texts.mapInArrow(_pack(buckets), "bucket int, kind int, chunk long, blob binary").select("bucket", "kind", F.lit(0).alias("part"), "chunk", F.col("blob").alias("a"), none.alias("b"), group)
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(tasks))).otherwise(F.pmod(F.xxhash64("chunk"), some)).cast("int")
    packed = packed.join(F.broadcast(salted), "group", "left").withColumn("salt", spread).drop("salts")
    # a model has no chunk, so comes first
    stream = model.unionByName(packed).repartition(tasks, "group", "salt").sortWithinPartitions("group", "salt", F.asc_nulls_first("chunk"), "bucket", "kind", "part")
    scored = stream.mapInArrow(_score(level), "chunk long, kind int, blob binary")
    return scored.groupBy("chunk").applyInArrow(_finish(level.n), SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
