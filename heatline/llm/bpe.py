"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position, with the position; an inner node the
least of its two, so the root is the leftmost pair of least rank. A merge takes the root, joins the
two live neighbours, and updates the leaves of the joined and the preceding position and, with that,
the logarithmic number of nodes above them. Equal-sized pieces are merged side by side in numpy, one
tree to a row; a long or lone piece runs on plain lists.

Defined results: null text is empty (no tokens); null doc_id stays null; repeated rows are encoded
alike; texts of any length are encoded whole, pieces of any length in n log n.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batches, documents, read_table
from .pieces import CACHE_BYTES, CACHE_ENTRIES, ENTRY_BYTES, FAST, LONGEST, plain

NONE = np.int64(1) << 62
#: Fewer pieces than this of one size class run on plain lists.
FEW = 12
#: Tree nodes held at once.
NODES = 1 << 20


class Ranks:
    """A vocabulary of byte strings with ranks, which are the ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.plain = pattern == public_tokenizers.PATTERN
        self.top = max(self.rank.values()) + 1
        pairs: dict[int, int] = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.top + b] = rank
        self.pair = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.kind = np.dtype("<u2" if self.top <= 1 << 16 else "<u4")
        blob = [self.token.get(i, b"") for i in range(self.top)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.size = np.array(list(map(len, blob)), np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no token joins them or a side is missing (negative)."""
        key = left * self.top + right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[i] == key) & (left >= 0) & (right >= 0), self.pair_ranks[i], NONE)

    # -- one piece, plain lists

    def merge_one(self, data: bytes) -> list[int]:
        n = len(data)
        width = 1 << max(1, (n - 1).bit_length())
        none, top, pair = int(NONE), self.top, self.pair
        ids = self.byte[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pair.get(ids[i] * top + ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int) -> None:
            j = after[i]
            r = pair.get(ids[i] * top + ids[j]) if j < n else None
            k, v = width + i, none if r is None else r * width + i
            while tree[k] != v:
                tree[k] = v
                if k == 1:
                    break
                v = min(v, tree[k ^ 1])
                k >>= 1

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            k = width + j
            v = none
            while tree[k] != v:  # the joined position starts no pair any more
                tree[k] = v
                if k == 1:
                    break
                v = min(v, tree[k ^ 1])
                k >>= 1
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    # -- many pieces of one size class, a tree to a row

    def merge_many(self, data: list[bytes], width: int) -> list[bytes]:
        rows = len(data)
        sizes = np.array(list(map(len, data)), np.int64)
        column = np.arange(width)
        live = column < sizes[:, None]
        raw = np.zeros((rows, width), np.uint8)
        raw[live] = np.frombuffer(b"".join(data), np.uint8)
        ids = np.full((rows, width + 2), -1, np.int64)  # column p + 1; both ends stay -1
        ids[:, 1:-1] = np.where(live, self.byte[raw], -1)
        after = np.tile(np.arange(1, width + 3), (rows, 1))
        before = np.tile(np.arange(-1, width + 1), (rows, 1))
        tree = np.full((rows, 2 * width), NONE)
        rank = self.lookup(ids[:, 1:-1], ids[:, 2:])
        tree[:, width:] = np.where(rank < NONE, rank * width + column, NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(r: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
            k = width + p
            tree[r, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        def pair_at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            rank = self.lookup(ids[r, c], ids[r, after[r, c]])
            return np.where(rank < NONE, rank * width + c - 1, NONE)

        active = (tree[:, 1] < NONE).nonzero()[0]
        while len(active):
            rank, p = np.divmod(tree[active, 1], width)
            i = p + 1
            j = after[active, i]
            ids[active, i] = rank
            ids[active, j] = -1
            nxt = after[active, j]
            after[active, i] = nxt
            before[active, nxt] = i
            put(active, j - 1, np.full(len(active), NONE))
            put(active, p, pair_at(active, i))
            prev = before[active, i]
            has = prev >= 1
            if has.any():
                r, q = active[has], prev[has]
                put(r, q - 1, pair_at(r, q))
            active = active[tree[active, 1] < NONE]
        inner = ids[:, 1:-1]
        kept = inner >= 0
        flat = inner[kept].astype(self.kind).tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * self.kind.itemsize
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian bytes."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(self.kind.itemsize, "little")
            else:
                classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in classes.items():
            if len(members) < FEW or width > NODES // FEW:
                for k in members:
                    out[k] = np.array(self.merge_one(pieces[k]), self.kind).tobytes()
                continue
            step = max(FEW, NODES // (2 * width))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for k, ids in zip(part, self.merge_many([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def split(self, text: str) -> list[str]:
        return FAST.findall(text) if self.plain and plain(text) else [m.group() for m in self.pattern.finditer(text)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Encode texts; pieces that were seen before come from a bounded cache."""
        if len(self.seen) >= CACHE_ENTRIES or self.held >= CACHE_BYTES:
            self.seen, self.held = {}, 0
        split = [self.split(t) for t in texts]
        new = list(dict.fromkeys(p for s in split for p in s if p not in self.seen))
        ids = self.merge([p.encode() for p in new])
        self.seen.update(zip(new, ids, strict=True))
        get = self.seen.__getitem__
        out = [np.frombuffer(b"".join(map(get, s)), self.kind) for s in split]
        for p, x in zip(new, ids, strict=True):
            if len(p) > LONGEST:
                del self.seen[p]
            else:
                self.held += ENTRY_BYTES + 4 * len(p) + len(x)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


@cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode(path: str, pattern: str, with_ids: bool, chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path, pattern)
        for batch in it:
            docs, texts, held = [], [], 0
            last = batch.num_rows - 1
            for k, (doc_id, value) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)):
                docs.append(doc_id)
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held < chars and k < last:
                    continue
                encoded = bpe.encode_batch(texts)
                decoded = [bpe.decode(x) for x in encoded]
                raw = [x.astype("<u4").tobytes() for x in encoded]
                yield from batches({
                    "doc_id": docs, "n_tokens": list(map(len, encoded)), "ids": raw if with_ids else [None] * len(raw), "decoded": decoded if with_ids else [None] * len(raw),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                }, SCHEMA)
                docs, texts, held = [], [], 0

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True, chars: int = 4_000_000) -> DataFrame:
    """ids (little-endian unsigned 32-bit) and the bytes they decode to, with digests of both, for each document."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = documents(docs).mapInArrow(_encode(path, pattern, with_ids, chars), "doc_id long, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string")
    return out if with_ids else out.drop("ids", "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), with_ids=False)
