"""Vector best-fit packing of token sequences.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go in descending length; each goes to the open bin that satisfies every constraint
and scores best, by the weighted norm of what would be left (the least) or the weighted dot product
of demand and residual (the largest). Bins with equal residuals are one class with a range of bin
numbers, and equal pieces are placed in bulk, so the work follows the distinct lengths, not the pieces.

Packing runs inside each task over windows of `window_tokens` tokens and `window_pieces` pieces at most: no shuffle,
memory bounded by the window, and a lost task repeats alone. A table in many small partitions is first coalesced to
about `partition_bytes` each, so that a window holds thousands of bins, of which the last few are not full.

At the registered query's capacities the document and attention limits follow from the token limit (a piece has a
token at least, and squares sum to the square of the sum at most): the contract asks for as few sequences of 1024 tokens
as can be, without other limits. Callers' own capacities bind.

Defined results: null text is empty (one piece holding the end id); null doc_id stays null; repeated
rows are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batches, documents, read_table
from .pieces import piece_ids

CAPACITY = 1024
END_ID = 2
#: Tokens, documents and attention cost of a sequence.
CAPACITIES = (CAPACITY, CAPACITY, CAPACITY * CAPACITY)
WEIGHTS = (1.0, 1e-4, 1e-4)
WINDOW_TOKENS, WINDOW_PIECES = 1 << 24, 1 << 20
PARTITION_BYTES = 10 << 20

SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every piece and the number of bins. Every length must fit an empty bin."""
    cap, w = np.array(capacities, np.int64), np.array(weights, float)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, first = np.unique(-lengths[order], return_index=True)
    ends = np.append(first[1:], len(lengths))
    residual = np.empty((0, 3), np.int64)  # a row for each class of bins
    members: list[list[tuple[int, int]]] = []  # its ranges of bin numbers
    used = 0
    for size, lo, hi in zip((-sizes).tolist(), first.tolist(), ends.tolist(), strict=True):
        demand = np.array([size, 1, size * size], np.int64)
        if (demand > cap).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacities {tuple(capacities)}")
        while lo < hi:
            fits = (residual >= demand).all(axis=1).nonzero()[0]
            if len(fits):
                rest = residual[fits] / cap
                if rule == "norm":
                    k = int(fits[np.argmin((((rest - demand / cap) ** 2) * w).sum(axis=1))])
                else:
                    k = int(fits[np.argmax((rest * (demand / cap) * w).sum(axis=1))])
                a, b = members[k].pop()
                state = residual[k]
                n = min(hi - lo, b - a)
                if n < b - a:
                    members[k].append((a + n, b))
            else:
                fill = int((cap // np.maximum(demand, 1)).min())  # so many of this size share a new bin
                n = -(-(hi - lo) // fill)
                a, state, k = used, cap, None
                used += n
            bins[order[lo : lo + n]] = np.arange(a, a + n)[: hi - lo]
            offsets[order[lo : lo + n]] = cap[0] - state[0]
            lo += n
            left = state - demand
            if k is not None and not members[k]:
                residual = np.delete(residual, k, axis=0)
                del members[k]
            if left[0] > 0 and left[1] > 0 and left[2] > 0:
                same = (residual == left).all(axis=1).nonzero()[0]
                if len(same):
                    members[int(same[0])].append((a, a + n))
                else:
                    residual = np.vstack([residual, left])
                    members.append([(a, a + n)])
    return bins, offsets, used


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: only a longer document is cut, and its first piece takes the remainder."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


class _Window:
    """Pieces held until they are packed, by columns."""

    def __init__(self):
        self.doc_ids, self.ids = [], []
        self.numbers = array("q")  # piece, start, length and checksum of each

    def add(self, doc_id: int | None, piece: int, start: int, raw: bytes, keep: bool) -> None:
        self.doc_ids.append(doc_id)
        self.numbers.extend((piece, start, len(raw) // 4, zlib.crc32(raw)))
        if keep:
            self.ids.append(raw)


def _pack(path: str, end_id: int, capacities, weights, rule: str, window: int, pieces: int, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_ids(path).encode
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        held, tokens = _Window(), 0
        longest = min(capacities[0], math.isqrt(capacities[2]))  # what an empty sequence can take

        def flush():
            nonlocal base, held, tokens
            if not held.doc_ids:
                return
            piece, start, length, crc = np.frombuffer(held.numbers, np.int64).reshape(-1, 4).T
            bins, offsets, used = best_fit(length, capacities, weights, rule)
            for a in range(0, len(piece), 4096):
                own = slice(a, a + 4096)
                columns = {"doc_id": held.doc_ids[own], "piece": piece[own].astype(np.int32), "start": start[own], "length": length[own], "ids": held.ids[own] or [None] * len(piece[own]), "ids_crc32": crc[own], "sequence_id": bins[own] + base, "offset": offsets[own]}
                yield from batches(columns, SCHEMA)
            base, held, tokens = base + used, _Window(), 0

        for batch in it:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encode(text.as_py() or "").astype("<u4"), np.array([end_id], "<u4"))
                for k, (start, n) in enumerate(cut(len(ids), longest)):
                    held.add(doc_id, k, start, ids[start : start + n].tobytes(), with_ids)
                    tokens += n
                    if tokens >= window or len(held.doc_ids) >= pieces:
                        yield from flush()
        yield from flush()

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacities=CAPACITIES, weights=WEIGHTS, rule: str = "norm", window_tokens: int = WINDOW_TOKENS, window_pieces: int = WINDOW_PIECES, with_ids: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A row for each piece: its place in its document, its ids (little-endian unsigned 32-bit), and its place in a sequence."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = documents(docs).coalesce(max(1, min(size // partition_bytes, 1_000_000)))  # never more partitions than there are
    out = few.mapInArrow(_pack(path, end_id, tuple(capacities), tuple(weights), rule, window_tokens, window_pieces, with_ids), "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False)
