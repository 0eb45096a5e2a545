"""Size-tiered sharding with versioned manifests.

A store is a folder of immutable Parquet shards and manifests. Arrivals are appended as small shards of `arrival` bytes
or so; compaction merges runs of similarly sized shards into files of half the target size to all of it, until no
tier holds `fan_in` of them or half the target. A version is a JSON manifest that lists its shards and their schema; it is
written under a temporary name and then given its number, which fails if another writer took it (a hard link on a local
path, a rename elsewhere), so readers see a whole version or the one before. The newest `retain` versions stay readable:
vacuum() deletes what only older ones list, after each pass of compaction and when called. A lost job leaves only
unlisted files; vacuum(unlisted=True) deletes these too, and must not run while another writer is between its files and
its commit.

A merge reads each shard once and writes it once, so rows are rewritten about once for each tier, which is
logarithmic in target size over arrival size. The runs of a pass are the partitions of its jobs, so a pass keeps as
many tasks busy as the cluster runs, without a shuffle. The driver holds the manifest alone: a row for each shard.

Defined results: nulls and empty or long texts are stored as they are; repeated rows stay repeated; an empty
table appends at most an empty shard and commits a version; extra columns are stored (null in rows of arrivals without
them; a column whose type changes is an error), names that differ only in case included where the session is
case-sensitive.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import fresh, new_path, read_table

TARGET, SMALLEST, FAN_IN = 128 << 20, 1 << 20, 4
#: Bytes of an arrival of the registered query, small against the target at every size of the table.
ARRIVAL_BYTES = 8 << 20
RETAIN = 2
#: Runs in the plan of one job at most, and deletions under way at a time.
RUNS, DELETERS = 256, 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    born: int

    def tier(self, smallest: int, fan_in: int) -> int:
        return 0 if self.bytes < smallest else 1 + int(math.log(self.bytes / smallest, fan_in))


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, retain: int = RETAIN):
        self.spark, self.target, self.smallest, self.fan_in, self.retain = spark, target, smallest, fan_in, retain
        jvm = spark._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self.Path(root)).toString()

    # -- manifests

    def versions(self) -> list[int]:
        folder = self.Path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max([0, *self.versions()])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": StructType([]).jsonValue()}
        stream = self.fs.open(self.Path(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:08d}.json"

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, shards: list[Shard], after: int, schema: StructType | None = None) -> int:
        """Make version after + 1 of these shards, unless someone else has."""
        self.fs.mkdirs(self.Path(f"{self.root}/manifests"))
        own, final = f"{self.root}/manifests/.{uuid.uuid4().hex}", self._name(after + 1)
        kept = schema.jsonValue() if schema is not None else self.manifest(after)["schema"]
        out = self.fs.create(self.Path(own), False)
        out.write(bytearray(json.dumps({"version": after + 1, "schema": kept, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        local = urlparse(own).scheme == "file"
        try:
            if local:
                os.link(urlparse(own).path, urlparse(final).path)
            elif not self.fs.rename(self.Path(own), self.Path(final)):
                raise FileExistsError(final)
        except FileExistsError as e:
            raise RuntimeError(f"version {after + 1} was committed by another writer") from e
        finally:
            self.fs.delete(self.Path(own), False)
        return after + 1

    # -- data

    def _files(self, folder: str, born: int) -> list[Shard]:
        path = self.Path(folder)
        if not self.fs.exists(path):
            return []
        return [Shard(f.getPath().toString(), f.getLen(), born) for f in self.fs.listStatus(path) if f.getPath().getName().endswith(".parquet")]

    def append(self, arrivals: DataFrame, by: str | None = None, rows: int = 0) -> int:
        """Commit arrivals as new small shards, of so many `rows` at most if given; `by` names a column of arrival
        numbers, each of which becomes shards of its own."""
        after = self.version()
        folder = f"{self.root}/data/{after + 1:08d}-{uuid.uuid4().hex[:8]}"
        writer = arrivals.write.option("maxRecordsPerFile", rows)
        if by:
            writer.partitionBy(by).parquet(folder)
            folders = [f.getPath().toString() for f in self.fs.listStatus(self.Path(folder)) if f.isDirectory()]
        else:
            writer.parquet(folder)
            folders = [folder]
        new = [s for f in sorted(folders) for s in self._files(f, after + 1)]
        return self.commit(self.shards(after) + new, after, self._with(arrivals.drop(by) if by else arrivals, after))

    def _with(self, arrivals: DataFrame, version: int) -> StructType:
        fields = {f.name: f for f in self.schema(version)}
        for f in arrivals.schema:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise TypeError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in this store, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, StructField(f.name, f.dataType, True))
        return StructType(list(fields.values()))

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifest(version)["schema"])

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Two shards or more of one tier each, up to the target size together, that fill half of it or are fan_in.
        A shard of half the target is full."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                tiers.setdefault(s.tier(self.smallest, self.fan_in), []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            run, held = [], 0
            for s in sorted(members, key=lambda s: (s.born, s.path)):
                if held + s.bytes > self.target:
                    out.append(run)
                    run, held = [], 0
                run.append(s)
                held += s.bytes
            if len(run) >= self.fan_in or 2 * held >= self.target:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> int:
        """Merge until no run is left. A pass is one commit; each of its runs is a partition of a job, without a shuffle,
        and makes one shard of two or more, so passes end whatever the session's settings."""
        slots = max(1, self.spark.sparkContext.defaultParallelism)
        while runs := self.runs(self.shards()):
            after = self.version()
            schema = self.schema(after)

            def merge(part: list[list[Shard]], after: int = after, schema: StructType = schema) -> list[Shard]:
                folder = f"{self.root}/data/{after + 1:08d}-{uuid.uuid4().hex}"
                each = [self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1) for run in part]
                reduce(DataFrame.union, each).write.option("maxRecordsPerFile", 0).parquet(folder)
                return self._files(folder, after + 1)

            size = min(RUNS, slots)
            jobs = [runs[k : k + size] for k in range(0, len(runs), size)]
            with ThreadPoolExecutor(-(-slots // size)) as pool:
                made = [s for part in pool.map(merge, jobs) for s in part]
            gone = {s.path for r in runs for s in r}
            self.commit([s for s in self.shards(after) if s.path not in gone] + made, after)
            self.vacuum()
        return self.version()

    def read(self, shards: list[Shard] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its shards; the newest one's if none is named."""
        shards = self.shards(version) if shards is None else shards
        if not shards:
            return self.spark.createDataFrame([], self.schema(version))
        return self.spark.read.schema(self.schema(version)).parquet(*[s.path for s in shards])

    def vacuum(self, retain: int | None = None, unlisted: bool = False) -> int:
        """Drop the versions before the newest `retain` and the shards that only they list; with `unlisted`, also the
        files that no version lists. Returns how many shards it deleted."""
        versions = self.versions()
        keep = versions[-max(1, retain or self.retain) :]
        listed = {s.path for v in keep for s in self.shards(v)}
        old = [v for v in versions if v not in keep]
        gone = {s.path for v in old for s in self.shards(v)} - listed
        if unlisted:
            files = self.fs.listFiles(self.Path(f"{self.root}/data"), True)
            while files.hasNext():
                path = files.next().getPath()
                if path.getName().endswith(".parquet") and path.toString() not in listed:
                    gone.add(path.toString())
        for v in old:
            self.fs.delete(self.Path(self._name(v)), False)
        with ThreadPoolExecutor(DELETERS) as pool:
            return sum(map(bool, pool.map(lambda path: self.fs.delete(self.Path(path), False), sorted(gone))))


def sharded(docs: DataFrame, root: str | None = None, arrivals: int | None = None, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, arrival_bytes: int = ARRIVAL_BYTES) -> Store:
    """docs appended and compacted. Each task of the scan of docs writes shards of about `arrival_bytes`, with no sort; with
    `arrivals`, rows are dealt into that many by a hash of doc_id, and each task writes a shard for each."""
    spark = docs.sparkSession
    store = Store(spark, root or new_path(spark, "shards"), target, smallest, fan_in)
    if arrivals:
        by = fresh(docs, "__hl_arrival")
        store.append(docs.withColumn(by, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by)
    else:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        store.append(docs, rows=max(1, docs.count() * arrival_bytes // max(1, size)))
    store.compact()
    return store


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, as read back: doc_id, its shard, the version that wrote it, and a digest of its text."""
    store = sharded(read_table(spark, sf_dir, "documents"))
    rows = store.read()
    if not store.shards():
        return spark.createDataFrame([], "doc_id long, shard string, version int, n_bytes long, text_sha256 string")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), folder.alias("shard"), F.substring(folder, 1, 8).cast("int").alias("version"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
