"""Telemetry trees: hosts, mixed physical types, footers, archives, and the sinks of cleaned data."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import nan_to_null
from .package import ship

DATASET_VARIABLE = "HEATLINE_DATASET"
#: The sensors of a reading.
SENSORS = (
    *(f"p{s}_core_temp_{a}" for s in (0, 1) for a in ("mean", "min", "max")), "p0_power", "p1_power",
    *(f"gpu{g}_{k}_temp" for g in range(6) for k in ("core", "mem")), *(f"p{s}_gpu{g}_power" for s in (0, 1) for g in range(3)), "ps0_input_power", "ps1_input_power",
)


def dataset(default: str) -> str:
    return os.environ.get(DATASET_VARIABLE, default)


def host_of(path):
    """The host named by the directory above the month, or by host=."""
    named = F.regexp_extract(path, r"/host=([^/]+)/", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+\.parquet$", 1))


def hosts(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of a tree, sorted, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.select(host_of(F.col("path")).alias("host")).distinct().orderBy("host")


def readings(spark: SparkSession, path: str, sensors=SENSORS, nanos: bool = False, files: bool = False) -> DataFrame:
    """host, us (microseconds) and the sensors as doubles with NaN as null. Float and double files are read alike;
    files with nanosecond stamps need nanos (read in a session of its own, by a setting for legacy files)."""
    schema = T.StructType([T.StructField("timestamp", T.LongType() if nanos else T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in sensors]])
    if nanos:  # the plan keeps the session it was made in, so other reads are not changed
        spark = spark.newSession()
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    us = F.floor(F.col("timestamp") / 1000).cast("long") if nanos else F.unix_micros("timestamp")
    return raw.select(host_of(F.col("_metadata.file_path")).alias("host"), us.alias("us"), *[nan_to_null(F.col(c)).alias(c) for c in sensors], *([F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")] if files else []))


FOOTER = "path string, host string, rows long, bytes long, columns array<string>, signature string, error string"


#: Stores whose files PyArrow opens at any place, so that only footers are read.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def uri(path: str) -> str:
    """Hadoop's name of a file as PyArrow takes it."""
    return path if "://" in path or not path.startswith("file:") else "file://" + path[5:]


def opened(path: str):
    """A file of one of the OPENED stores, to be read at any place."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(uri(path))
    return fs.open_input_file(at)


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in frames:
        out = []
        for row in pdf.itertuples():
            try:
                f = pq.ParquetFile(io.BytesIO(row.content) if "content" in pdf.columns else opened(row.path))
                names = f.schema_arrow.names
                out.append((row.path, row.host, f.metadata.num_rows, row.length, names, ",".join(f"{n}:{t}" for n, t in zip(names, map(str, f.schema_arrow.types), strict=True)), None))
            except Exception as e:  # an unreadable file is a row that says so
                out.append((row.path, row.host, None, row.length, [], None, str(e)[:200]))
        yield pd.DataFrame(out, columns=["path", "host", "rows", "bytes", "columns", "signature", "error"], dtype=object)


def _parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, host, length) of a tree's files, with their content where tasks can't open them at any place."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    return files.select("path", host_of(F.col("path")).alias("host"), "length", *([] if scheme in OPENED else ["content"]))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """Rows, bytes, columns and types of each Parquet file, or why it can't be read. Only footers are read where the store
    is one of OPENED; files of other stores are read whole."""
    return _parquet_files(spark, path).mapInPandas(_footers, FOOTER)


RANGES = "path string, host string, column string, rows long, nulls long, least double, greatest double, data_bytes long, error string"


def _scale(kind):
    """What a stored number of an Arrow type is multiplied with: stamps become microseconds. None for types without ranges."""
    import pyarrow as pa

    if pa.types.is_timestamp(kind):
        return {"s": 1_000_000.0, "ms": 1000.0, "us": 1.0, "ns": 0.001}[kind.unit]
    return 1.0 if (pa.types.is_integer(kind) and not pa.types.is_unsigned_integer(kind)) or kind in (pa.float32(), pa.float64()) else None


def _stated(meta, k: int, scale: float | None):
    """(nulls, least, greatest) of a column from the statistics of its row groups, None if any of them lacks one."""
    nulls, lows, highs = 0, [], []
    for g in range(meta.num_row_groups):
        if not meta.row_group(g).num_rows:
            continue
        chunk = meta.row_group(g).column(k)
        stats = chunk.statistics if chunk.is_stats_set else None
        if stats is None or not stats.has_null_count:
            return None
        nulls += stats.null_count
        if scale is not None and stats.null_count < chunk.num_values:
            if not stats.has_min_max or stats.min_raw != stats.min_raw or stats.max_raw != stats.max_raw:
                return None
            lows.append(stats.min_raw)
            highs.append(stats.max_raw)
    return nulls, *((min(lows) * scale + 0.0, max(highs) * scale + 0.0) if lows else (None, None))


def _scanned(f, name: str, scale: float | None):
    """The same from the column itself, in batches; NaN counts in no range."""
    import pyarrow as pa
    import pyarrow.compute as pc

    nulls, low, high = 0, None, None
    for batch in f.iter_batches(columns=[name]):
        values = batch.column(0)
        nulls += values.null_count
        if scale is None:
            continue
        if pa.types.is_floating(values.type):
            values = values.filter(pc.invert(pc.is_nan(values)))
        elif pa.types.is_timestamp(values.type):
            values = values.view(pa.int64())
        ends = pc.min_max(values).as_py()
        if ends["min"] is not None:
            low, high = (ends["min"] if low is None else min(low, ends["min"])), (ends["max"] if high is None else max(high, ends["max"]))
    return nulls, *((None, None) if low is None else (low * scale + 0.0, high * scale + 0.0))


def _ranges(wanted: list[str] | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        names = [field.split()[0] for field in RANGES.split(", ")]
        for pdf in frames:
            for row in pdf.itertuples():
                out = []
                try:
                    f = pq.ParquetFile(io.BytesIO(row.content) if "content" in pdf.columns else opened(row.path))
                    meta, flat = f.metadata, {}
                    for k in range(meta.num_columns):
                        flat.setdefault(meta.schema.column(k).path.split(".")[0], []).append(k)
                    for field in f.schema_arrow:
                        if wanted is not None and field.name not in wanted:
                            continue
                        at = flat[field.name] if "." not in field.name else []
                        single = len(at) == 1 and meta.schema.column(at[0]).path == field.name  # nested values have counts of their own
                        scale = _scale(field.type)
                        found, read = (_stated(meta, at[0], scale) if single else None), 0
                        if found is None:
                            found = _scanned(f, field.name, scale)
                            read = sum(meta.row_group(g).column(k).total_compressed_size for g in range(meta.num_row_groups) for k in at)
                        out.append((row.path, row.host, field.name, meta.num_rows, *found, read, None))
                except Exception as e:  # an unreadable file is a row that says so
                    out = [(row.path, row.host, None, None, None, None, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def column_ranges(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Of each Parquet file and column (or those named): rows, nulls, and the least and greatest of signed integers, floats and
    stamps (as microseconds), as doubles. They come from the statistics of row groups; a column for which any group lacks
    them, or which is nested, is read, alone and in batches, and `data_bytes` says how much of it. An unreadable file is a row
    with an error, an empty file has no nulls and no range. Of stores not in OPENED files are read whole, as in footers()."""
    return _parquet_files(spark, path).mapInPandas(_ranges(columns), RANGES)


class _Slice(io.RawIOBase):
    """A member of an archive as a file of its own: reads go to the archive, at the member's place."""

    def __init__(self, file, offset: int, size: int):
        self.file, self.offset, self.size, self.at = file, offset, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, place: int, whence: int = 0) -> int:
        self.at = place + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        self.file.seek(self.offset + self.at)
        found = self.file.read(max(0, min(len(buffer), self.size - self.at)))
        buffer[: len(found)] = found
        self.at += len(found)
        return len(found)


MEMBER = "member string, host string, bytes long, path string, offset long, error string"
#: Members that an index passes on at once, and the bytes of archives to a reading task.
INDEXED, TASK_BYTES = 10_000, 128 << 20
COMPRESSED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")


def _is_reading(m: tarfile.TarInfo) -> bool:
    return m.isfile() and m.name.endswith(".parquet")


def _member_host(name: str) -> str:
    parts = name.strip("./").split("/")
    return parts[-3] if len(parts) >= 3 else parts[0]


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members by their headers alone; of a compressed archive, which has no places to seek, without offsets."""
    columns = ["member", "host", "bytes", "path", "offset", "error"]
    for pdf in frames:
        for path, length, content in zip(pdf["path"], pdf["length"], pdf["content"] if "content" in pdf else [None] * len(pdf), strict=True):
            out = []
            try:
                with io.BytesIO(content) if content is not None else opened(path) as f:
                    packed = f.read(6).startswith(COMPRESSED)
                    f.seek(0)
                    with tarfile.open(fileobj=f, mode="r|*" if packed else "r:") as tar:
                        for m in tar:
                            tar.members = []  # or it would keep them all
                            if not _is_reading(m):
                                continue
                            cut = not packed and m.offset_data + m.size > length
                            out.append((m.name, _member_host(m.name), m.size, path, None if packed else m.offset_data, "truncated" if cut else None))
                            if len(out) == INDEXED:
                                yield pd.DataFrame(out, columns=columns, dtype=object)
                                out = []
            except Exception as e:  # what can't be read is a row that says so
                if not (out and out[-1][-1]):
                    out.append((None, None, None, path, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(out, columns=columns, dtype=object)


def _batches(file, host: str, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Readings of a Parquet file, only of the columns asked for; one that it lacks is null."""
    import pyarrow.parquet as pq

    f = pq.ParquetFile(file)
    have = [c for c in columns if c in f.schema_arrow.names]
    for batch in f.iter_batches(columns=["timestamp", *have]):
        rows = batch.to_pandas()
        us = pd.to_datetime(rows["timestamp"], utc=True).astype("datetime64[us, UTC]").astype("int64")
        yield pd.DataFrame({"host": pd.Series([host] * len(rows), dtype=object), "us": us, **{c: rows[c].astype("float64") if c in have else float("nan") for c in columns}})


def _ranged(columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for pdf in frames:
            for row in pdf.itertuples():
                if row.error:
                    raise ValueError(f"{row.path}: {row.member or 'archive'}: {row.error}")
                with opened(row.path) as f:
                    yield from _batches(pa.PythonFile(_Slice(f, int(row.offset), int(row.bytes)), mode="r"), row.host, columns)

    return run


def _streamed(columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"] if "content" in pdf else [None] * len(pdf), strict=True):
                with io.BytesIO(content) if content is not None else opened(path) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for m in tar:
                        tar.members = []
                        if _is_reading(m):
                            yield from _batches(io.BytesIO(tar.extractfile(m).read()), _member_host(m.name), columns)

    return run


def _archives(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(path, length) of archives, and whether tasks can open them at any place; else with their content."""
    ship(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    by_place = at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() in OPENED
    return spark.read.format("binaryFile").load(path).select("path", "length", *([] if by_place else ["content"])), by_place


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Parquet members of TAR archives, with their hosts and places, from the headers alone; an archive or a member that is
    cut off, or can't be read, is a row with an error."""
    return _archives(spark, path)[0].mapInPandas(_index, MEMBER)


def archive_readings(spark: SparkSession, path: str, columns: list[str], broken: str = "raise", tasks: int | None = None) -> DataFrame:
    """Readings of the Parquet members of TAR archives of any size. Members are read by byte range, the columns asked for alone,
    and spread over tasks (one for each TASK_BYTES of archives, if not given). A compressed archive is read by one task, a
    member at a time, and so is one on a store not in OPENED, which must be below 2 GB. A member or an archive that is cut
    off is an error, or is left out with broken="skip"; a column that a member lacks is null."""
    if broken not in ("raise", "skip"):
        raise ValueError(broken)
    schema = "host string, us long, " + ", ".join(f"`{c}` double" for c in columns)
    files, by_place = _archives(spark, path)
    if not by_place:
        return files.mapInPandas(_streamed(columns), schema).select("host", "us", *[nan_to_null(F.col(c)).alias(c) for c in columns])
    tasks = tasks or max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    members = files.mapInPandas(_index, MEMBER)
    sound = members.where("error is null")
    ranged = sound.where("offset is not null").unionByName(members.where("error is not null" if broken == "raise" else "false"))
    whole = sound.where("offset is null").select("path").distinct()
    rows = ranged.repartition(tasks, "path", "offset").mapInPandas(_ranged(columns), schema).unionByName(whole.mapInPandas(_streamed(columns), schema))
    return rows.select("host", "us", *[nan_to_null(F.col(c)).alias(c) for c in columns])


def write_archives(spark: SparkSession, tree: str, path: str) -> None:
    """A TAR archive for each host of a tree, host/month/file; files go through in blocks. Tasks write to a local path, or to one
    that PyArrow can write to."""
    ship(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        host = pdf["host"].iloc[0]
        fs, at = FileSystem.from_uri(uri(f"{path}/{host}.tar"))
        with fs.open_output_stream(at) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for k, row in enumerate(pdf.sort_values("path").itertuples()):
                info = tarfile.TarInfo(f"{host}/all/{k:05d}.parquet")
                info.size = int(row.length)
                with opened(row.path) as f:
                    tar.addfile(info, f)
        return pd.DataFrame({"host": [host]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(tree)
    files.select("path", "length", host_of(F.col("path")).alias("host")).groupBy("host").applyInPandas(pack, "host string").write.format("noop").mode("overwrite").save()


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """Parquet partitioned by host, in order within files and from file to file; a host of many rows is written by many tasks."""
    cleaned.repartitionByRange("host", "us").sortWithinPartitions("host", "us").write.mode("overwrite").partitionBy("host").parquet(path)


def write_mask(mask: DataFrame, path: str) -> None:
    """As write_cleaned()."""
    mask.repartitionByRange("host", "us").sortWithinPartitions("host", "us").write.mode("overwrite").partitionBy("host").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "csv", one: bool = True) -> None:
    """A small result as one CSV (with a header), JSON or Parquet file, by one task; or, of any length, a file for each task."""
    writer = (df.coalesce(1) if one else df).write.mode("overwrite")
    {"csv": writer.option("header", True).csv, "json": writer.json, "parquet": writer.parquet}[kind](path)


def document(df: DataFrame) -> str:
    """A small result as an indented JSON document."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, default=str)


def write_pilot(readings: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Parquet of some nodes, a folder and file for each."""
    rows = readings.select("host", "us", *columns) if columns else readings
    rows.repartition("host").sortWithinPartitions("host", "us").write.mode("overwrite").partitionBy("host").parquet(path)


def host_manifest(cleaned: DataFrame, footers: DataFrame, audits: DataFrame, policy: str = "bin mean") -> DataFrame:
    """A row for each host: what it was made of, how cleaning changed it, its audit and its failures, nested as documents."""
    sources = footers.groupBy("host").agg(F.count("*").alias("n_source_files"), F.array_sort(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("source_files"), F.sum("rows").alias("rows_before"), F.array_compact(F.collect_list("error")).alias("unreadable"))
    after = cleaned.groupBy("host").agg(F.count("*").alias("rows_after"), F.count_if(F.col("n_merged") > 1).alias("merged_bins"))
    rows = sources.join(after, "host", "left").join(audits, "host", "left")
    nested = [c for c in audits.columns if c != "host"]
    return rows.select(
        "host", F.current_timestamp().cast("string").alias("generated"), F.struct("n_source_files", "source_files").alias("provenance"),
        F.struct(F.lit(policy).alias("policy"), "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"), "merged_bins", F.lit("double").alias("dtype_cast_to"), F.lit("none").alias("interpolation")).alias("cleaning"),
        F.struct(*nested).alias("audit"), "unreadable",
    )


def write_manifests(manifests: DataFrame, path: str) -> None:
    """JSON documents, partitioned by host."""
    manifests.repartition("host").write.mode("overwrite").partitionBy("host").json(path)


def checkpointed(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """df, of which rows whose keys (of the first column's partition) already stand at path are not computed again: a job
    that stopped goes on where it was. df must be cheap to filter by its keys."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = None
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.schema(df.schema).parquet(path)
    rest = df if done is None else df.join(done.select(*keys).distinct(), keys, "left_anti")
    rest.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
