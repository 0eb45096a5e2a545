"""Streaming twins: count-tumbling windows bounded by gaps with online alerts, and session windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.package import ship

COLUMNS = ["unit", "window", "first_us", "samples", "tau", "mean_p", "mean_t", "z", "alert", "persisted"]
OUT = "unit long, window long, first_us long, samples int, tau double, mean_p double, mean_t double, z double, alert boolean, persisted boolean"
STATE = "rows binary, units binary"
#: Groups of units, if no other number is given.
BUCKETS = 64
#: The unit of rows that only move the watermark.
BEAT = -(1 << 63)
#: Fixed value: the class that keeps state on disk, which timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tau_of(t: np.ndarray, p: np.ndarray, dt: float) -> float | None:
    """Least squares over a window's pairs by centred moments."""
    a, b, y = t[:-1], p[:-1], t[1:]
    a, b, y = a - a.mean(), b - b.mean(), y - y.mean()
    tt, tp, pp = a @ a, a @ b, b @ b
    det = tt * pp - tp * tp
    alpha = ((a @ y) * pp - (b @ y) * tp) / det if det > 0 else float("nan")
    return -dt / float(np.log(alpha)) if 0 < alpha < 1 else None


def windows_of(us: np.ndarray, finite: np.ndarray, samples: int, gap_s: float, silent: bool = False) -> tuple[list[tuple[int, int]], int]:
    """(start, stop) of the windows that are closed among rows in order of time, and the row from which the open one gathers.
    A gap or a missing value ends a run, as does silence after the last row; a run's last window counts with over 0.6 of
    its samples once the run has ended."""
    least = int(0.6 * samples) + 1
    ends = (np.diff(us) // 1_000_000 > gap_s) | ~finite[1:] | ~finite[:-1]
    cuts = [0, *((ends).nonzero()[0] + 1).tolist(), len(us)]
    out, open_from = [], len(us)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b or not finite[a]:
            continue
        last = b == len(us) and not silent
        full = a + (b - a) // samples * samples
        out += [(k, k + samples) for k in range(a, full, samples)]
        if last:
            open_from = full
        elif b - full >= least:
            out.append((full, b))
    return out, open_from


class CountWindows(StatefulProcessor):
    """Of a bucket of units, as bytes of arrays: each unit's rows whose window is open or that the watermark hasn't reached, and how
    many windows it had, its baseline and its alerts in a row. Rows at or before the watermark are complete, and are taken in
    order of time when rows of the bucket come, or when its timer fires: once the watermark has passed the gap after the newest
    row of one of its units."""

    def __init__(self, samples: int, gap_s: float, dt: float, baseline: int, threshold: float, persist: int):
        self.samples, self.gap_s, self.dt, self.baseline, self.threshold, self.persist = samples, gap_s, dt, baseline, threshold, persist
        self.row = np.dtype([("unit", "<i8"), ("us", "<i8"), ("t", "<f8"), ("p", "<f8")])
        self.unit = np.dtype([("unit", "<i8"), ("windows", "<i8"), ("alerts", "<i8"), ("based", "<i8"), ("base", "<f8", (baseline,))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for f in rows:
            f = f[f["unit"] != BEAT]
            more = np.empty(len(f), self.row)
            for c in self.row.names:
                more[c] = f[c]
            fresh.append(more)
        yield from self.advance(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance([], timerValues.getCurrentWatermarkInMs())

    def advance(self, fresh: list[np.ndarray], watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting, seen = (self.held.get() if self.held.exists() else None) or (b"", b"")
        rows = np.concatenate([np.frombuffer(waiting, self.row), *fresh])
        rows = rows[np.lexsort((rows["us"], rows["unit"]))]
        if not len(rows):
            return
        known = {u["unit"].item(): u for u in np.frombuffer(seen, self.unit).copy()}
        first = np.flatnonzero(np.diff(rows["unit"], prepend=rows["unit"][0] - 1))
        out, left, due = [], [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            own = rows[a:b]
            name = own["unit"][0].item()
            state = known.get(name)
            if state is None:
                state = known[name] = np.zeros(1, self.unit)[0]
                state["unit"] = name
            rest = own[self.close_windows(own, state, watermark_ms * 1000, out) :]
            if len(rest):
                left.append(rest)
                due.append(int(rest["us"][-1]))
        self.held.update((np.concatenate(left).tobytes() if left else b"", np.array(list(known.values()), self.unit).tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(max(watermark_ms + 1, min(due) // 1000 + int((self.gap_s + 1) * 1000) + 1))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close_windows(self, rows: np.ndarray, state: np.void, now: int, out: list) -> int:
        """Adds to out what is closed of a unit's rows; the row from which it waits."""
        us, t, p = rows["us"], rows["t"], rows["p"]
        ready = int(np.searchsorted(us, now, side="right"))
        # whole seconds, as gaps are
        silent = ready == len(us) and (now - int(us[-1])) // 1_000_000 > self.gap_s
        closed, rest = windows_of(us[:ready], (np.isfinite(t) & np.isfinite(p))[:ready], self.samples, self.gap_s, silent)
        for a, b in closed:
            tau = tau_of(t[a:b], p[a:b], self.dt)
            if tau is None:
                continue
            state["windows"] += 1
            z, alert = float("nan"), False
            if state["based"] < self.baseline:
                state["base"][state["based"]] = tau
                state["based"] += 1
            elif self.baseline:
                base = state["base"]
                med = float(np.median(base))
                z = abs(tau - med) / (1.4826 * float(np.median(np.abs(base - med))) + 1e-9)
                alert = z > self.threshold
                state["alerts"] = state["alerts"] + 1 if alert else 0
            out.append((int(state["unit"]), int(state["windows"]), int(us[a]), b - a, tau, float(p[a:b].mean()), float(t[a:b].mean()), z, alert, bool(alert and state["alerts"] >= self.persist)))
        return rest

    def close(self) -> None:
        pass


def count_windows(stream: DataFrame, samples: int, gap_s: float, dt: float, late_s: float = 0.0, baseline: int = 0, threshold: float = 3.5, persist: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Windows of `samples` rows of each unit's runs, emitted as they close: tau, and, against the first `baseline` windows,
    the robust z, an alert and whether it is the persist-th in a row or later (the ones before it were emitted unmarked).

    Rows (unit, us, t, p) may come up to late_s behind the newest of all units; older ones are dropped, and so are rows without
    a unit. State of a unit: its open window and the rows that the watermark hasn't reached. Units share the calls and the
    state of one of `buckets`, which should grow with them (some hundred to one: a call costs as much as their rows). A unit that
    falls silent has its last window closed once the watermark has passed the gap; rows of the unit BEAT only move the
    watermark. The session must keep state by STORE."""
    ship(stream.sparkSession)
    timed = stream.withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", f"{int(late_s * 1000)} milliseconds")
    bucket = F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int")
    return timed.where("unit is not null").withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(CountWindows(samples, gap_s, dt, baseline, threshold, persist), OUT, "append", "EventTime")


def with_store(spark: SparkSession) -> SparkSession:
    """A session beside this one whose streams keep state by STORE."""
    own = spark.newSession()
    own.conf.set(*STORE)
    return own


def sessions(stream: DataFrame, ts: str, keys: list[str], gap_s: int = 30, late: str = "1 minute") -> DataFrame:
    """Collection segments as session windows: rows at most gap_s apart share one."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, f"{gap_s} seconds").alias("s")).agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def replayed(rows: DataFrame, part: str, path: str, job, out: str, files: int = 8) -> DataFrame:
    """job(stream) over rows that one job writes as files below path, by their `part` (a whole number), and that arrive in that
    order, `files` of them at a time; the job's rows go to Parquet at out, with a checkpoint beside them."""
    spark = rows.sparkSession
    rows.repartition(part).write.partitionBy(part).parquet(path)
    in_order(spark, path, part)
    own = with_store(spark)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = job(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def in_order(spark: SparkSession, path: str, part: str) -> None:
    """Give the files of each part a time of their own, which file streams go by: a second after the part before's."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    parts = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{part}="))  # names only
    now = int(jvm.System.currentTimeMillis()) - 1000 * (len(parts) + 1)
    for k, (_, folder) in enumerate(parts):
        for status in fs.listStatus(folder):
            fs.setTimes(status.getPath(), now + 1000 * k, -1)
