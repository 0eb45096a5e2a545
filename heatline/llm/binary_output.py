"""Fixed-width bit-packed token files.

A file: the magic, an 8-byte header length, a JSON header (width, n_ids, n_docs, block, n_blocks),
then little-endian tables: byte offset of each block (one more than blocks), first id of each
document (one more than documents), doc_ids, doc_id validity; then the blocks. A block packs `block`
ids in `width` bits each, high bit first, so any block and any id is found without reading the rest.

Documents are dealt by ranges of doc_id and sorted in each task; a task writes files of about
`file_ids` ids under a temporary name and renames each when whole, so a repeated task leaves the same
files. Where a file starts in the corpus follows from the manifest of file sizes, not from the writer. The manifest, a
row for each file, is a table in the shared folder; the driver never holds it.

Defined results: null text is empty (just the end id); null doc_ids come first, ties in doc_id are
ordered by the text's hash, then by the text; repeated rows are written as often as they come; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, documents, new_path, read_table, small, written
from .pieces import piece_ids

MAGIC = b"HLPACK01"
BLOCK = 4096
FILE_IDS = 1 << 22
END_ID = 0


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.reshape(-1)).tobytes()


def unpack_bits(data, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype("<u4")


def file_bytes(doc_ids: list, parts: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    packed = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    header = json.dumps({"width": width, "n_ids": len(ids), "n_docs": len(doc_ids), "block": block, "n_blocks": len(packed)}).encode()
    starts = np.cumsum([0, *map(len, parts)]).astype("<u8")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    tables = starts.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + valid.tobytes()
    first = len(MAGIC) + 8 + len(header) + 8 * (len(packed) + 1) + len(tables)
    offsets = (first + np.cumsum([0, *map(len, packed)])).astype("<u8")
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, offsets.tobytes(), tables, *packed])


class TokenFile:
    """Random access to the ids and documents of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a packed token file")
        n = int.from_bytes(data[8:16], "little")
        h = json.loads(data[16 : 16 + n])
        at = 16 + n
        self.data, self.width, self.block, self.n_ids, self.n_docs = data, h["width"], h["block"], h["n_ids"], h["n_docs"]
        self.offsets = np.frombuffer(data, "<u8", h["n_blocks"] + 1, at).astype(np.int64)
        at += 8 * (h["n_blocks"] + 1)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.valid = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        if self.block * self.width % 8 == 0:  # blocks then join without padding
            n = min(b * self.block, self.n_ids) - a * self.block
            got = unpack_bits(memoryview(self.data)[self.offsets[a] : self.offsets[b]], self.width, n)
        else:
            got = np.concatenate([unpack_bits(memoryview(self.data)[self.offsets[k] : self.offsets[k + 1]], self.width, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)])
        return got[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _store(path: str, data: bytes) -> None:
    """Whole or not at all."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        task = TaskContext.get()
        own = f"{os.path.dirname(url.path)}/.{os.path.basename(url.path)}.{task.taskAttemptId() if task else 0}"
        with open(own, "wb") as out:
            out.write(data)
        os.replace(own, url.path)
    else:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(path)
        task = TaskContext.get()
        own = f"{at}.{task.taskAttemptId() if task else 0}.part"
        with fs.open_output_stream(own) as out:
            out.write(data)
        fs.move(own, at)


MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, path: str, end_id: int, file_ids: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(path)
        width = max(1, int(encoder.size - 1).bit_length())
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind)
        docs, parts, held, seq, made = [], [], 0, 0, []

        def flush():
            nonlocal docs, parts, held, seq
            name = f"tokens-{part:06d}-{seq:06d}.bin"
            data = file_bytes(docs, parts, width)
            _store(f"{folder}/{name}", data)
            made.append((part, seq, name, len(docs), held, len(data)))
            docs, parts, held, seq = [], [], 0, seq + 1

        for batch in it:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                parts.append(np.append(encoder.encode(text.as_py() or ""), end))
                docs.append(doc_id)
                held += len(parts[-1])
                if held >= file_ids:
                    flush()
        if docs:
            flush()
        if made:
            yield from batches(dict(zip(MANIFEST.names, zip(*made, strict=True), strict=True)), MANIFEST)

    return run


MANIFEST_COLUMNS = "part long, seq long, name string, n_docs long, n_ids long, n_bytes long"
#: Writing tasks whose sizes are summed together first.
TASKS = 1024


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file: sums before a file in its task, before a task among its thousand, and before that thousand."""
    before = lambda keys, order: F.coalesce(F.sum("n_ids").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("many", F.floor(F.col("part") / TASKS))
    many = tasks.groupBy("many").agg(F.sum("n_ids").alias("n_ids")).select("many", before((), "many").alias("many_start"))  # a row for each thousand tasks
    tasks = tasks.withColumn("task_start", before(("many",), "part")).join(F.broadcast(many), "many").select("part", (F.col("many_start") + F.col("task_start")).alias("task_start"))
    return manifest.withColumn("file_start", before(("part",), "seq")).join(tasks, "part").select(*manifest.columns, (F.col("task_start") + F.col("file_start")).alias("start"))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files in ascending doc_id order; their manifest, a row for each file with its start in the corpus."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ordered = documents(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    return with_starts(written(ordered.mapInArrow(_write(folder, path, end_id, file_ids), MANIFEST_COLUMNS), "manifest"))


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for start, content in zip(batch["start"].to_pylist(), batch["content"], strict=True):
            f = TokenFile(content.as_py())
            ids = f.ids(0, f.n_ids)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
            yield from batches({"doc_id": pa.array(f.doc_ids, mask=~f.valid), "start": f.starts[:-1] + start, "n_tokens": np.diff(f.starts), "ids_crc32": crc}, READ)


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files."""
    files = manifest.select("name", "start")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return content.join(small(files, manifest.count()), "name").select("start", "content").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    folder = qualified(spark, folder or new_path(spark, "tokens"))
    manifest = write_tokens(docs, folder, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read_table(spark, sf_dir, "documents"))
