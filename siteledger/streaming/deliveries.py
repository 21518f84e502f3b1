"""Structured Streaming jobs: deliveries once, trailing re-sync, silent runs, daily series, changed pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import merge_search_days, upsert, write_facts
from ..session import cut

# Seconds of silence after which a run counts as failed.
QUEUED_LIMIT = 180
RUNNING_LIMIT = 1200
# Days that are named in the scan of a re-sync; a batch with more joins them.
MAX_DAYS = 400
# Groups of pages whose hashes are kept together.
PAGE_BUCKETS = 4096


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was ever written there; other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# ── deliveries processed once ────────────────────────────────────────────────
def once_per_delivery(stream: DataFrame, *, key: str = "delivery_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop redeliveries; state for a key is kept only until the watermark passes it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """(run, batch) of the last committed batch of every writer.

    Batches of one writer come in order, so the last id says it all. It stands in one of two slots that commits overwrite in turn:
    a commit that is cut off leaves the one before.
    """
    marks = stored(spark, f"{path}/_commits/*/*")
    return None if marks is None else marks.groupBy("run").agg(F.max("batch").alias("batch"))


def delivered(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame | None:
    """Rows of committed batches, of all days or only those named (the folders of other days are not even listed)."""
    folder = f"{path}/day=*" if days is None else f"{path}/day={{{','.join(days)}}}"
    try:
        rows = spark.read.option("basePath", path).parquet(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = committed(spark, path)
    if last is None:
        return None
    done = last.select(F.col("run").alias("_run"), F.col("batch").alias("_last"))
    return rows.join(F.broadcast(done), (F.col("run") == F.col("_run")) & (F.col("batch") <= F.col("_last"))).drop("_run", "_last", "run", "batch")  # one row per writer


def append_new(path: str, key: str = "delivery_id", *, time: str = "ts", delay_days: int = 1, run: str = "main"):
    """A ``foreachBatch`` writer that appends only unseen keys and commits whole batches.

    Rows lie in day=/run=/batch= folders and count once their batch is committed (:func:`delivered` reads those). A batch that comes again
    after a crash overwrites its own folders; one that was committed is passed over. Known keys are looked up only in the days from
    ``delay_days`` before the batch's first row to its last, as redeliveries come within that time; rows without a time are looked up
    among each other. A stream that starts over with a new checkpoint counts batches from 0 and needs another ``run`` name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = committed(spark, path)
        if last is not None and not last.filter((F.col("run") == run) & (F.col("batch") >= batch_id)).isEmpty():
            return
        fresh = cut(batch.dropDuplicates([key]).withColumn("day", F.to_date(time)))
        span = fresh.agg(F.min("day"), F.max("day")).first()
        days = ["__HIVE_DEFAULT_PARTITION__"]
        if span[0] is not None:
            days += [str(d.date()) for d in pd.date_range(span[0] - pd.Timedelta(days=delay_days), span[1])]
        known = delivered(spark, path, days)
        out = fresh if known is None else fresh.join(known.select(key), key, "left_anti")
        out = out.withColumns({"run": F.lit(run), "batch": F.lit(batch_id).cast("long")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "batch").parquet(path)
        mark = spark.range(1).select(F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"))
        mark.write.mode("overwrite").parquet(f"{path}/_commits/{run}/{batch_id % 2}")

    return write


# ── trailing-window re-sync ──────────────────────────────────────────────────
def resync(path: str):
    """A ``foreachBatch`` writer that merges late provider rows into the date-partitioned fact table.

    Only the dates a batch touches are read and rewritten; rows of other pages on those dates are kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = cut(merge_search_days(batch))
        target = stored(spark, path)
        if target is None:
            write_facts(merged, path)
            return
        # A batch holds the trailing window, so its days are few; as literals they prune the scan. More than that are joined.
        days = merged.select("date").distinct()
        few = [r.date for r in days.limit(MAX_DAYS + 1).collect()]
        rows = target.select(*merged.columns)
        affected = rows.filter(F.col("date").isin(few)) if len(few) <= MAX_DAYS else rows.join(days, "date", "left_semi")
        write_facts(cut(upsert(affected, merged, ["page_id", "date"])), path)

    return write


# ── silent runs ──────────────────────────────────────────────────────────────
def limit_of(status):
    return F.when(status == "queued", QUEUED_LIMIT).otherwise(RUNNING_LIMIT)


def stale_runs(runs: DataFrame, now: str) -> DataFrame:
    """Batch variant: active runs whose last sign of life is older than their limit."""
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("last_seen").cast("long")
    return runs.filter(F.col("status").isin("queued", "running") & (age > limit_of(F.col("status"))))


class SilentRunProcessor(StatefulProcessor):
    """Emits a failure when a run stays silent past its limit; state is one row per run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, status string")

    def _limit(self, status: str) -> int:
        return QUEUED_LIMIT * 1000 if status == "queued" else RUNNING_LIMIT * 1000

    def _row(self, key, ts: int, status: str) -> dict:
        return {"run_id": key[0], "failed_at": pd.Timestamp(ts + self._limit(status), unit="ms"), "last_status": status}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """One state update per batch: signs of life in order, each compared with the one before it."""
        frame = pd.concat(list(rows)).sort_values(["ts", "status"])
        times = frame["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        statuses = frame["status"].to_numpy()
        if self.last.exists():
            known = self.last.get()
            later = times >= known[0]
            times, statuses = np.concatenate([[known[0]], times[later]]), np.concatenate([[known[1]], statuses[later]])
        limit = np.select([statuses == "queued", statuses == "running"], [QUEUED_LIMIT * 1000, RUNNING_LIMIT * 1000], np.iinfo(np.int64).max)
        late = np.flatnonzero(np.diff(times) > limit[:-1])
        last = (int(times[-1]), statuses[-1])
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last[1] in ("queued", "running"):
            self.handle.registerTimer(last[0] + self._limit(last[1]))
        failed = pd.to_datetime(times[late] + limit[late], unit="ms")
        yield pd.DataFrame({"run_id": np.full(len(late), key[0]), "failed_at": failed, "last_status": statuses[late]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, status = self.last.get()
        self.last.clear()
        yield pd.DataFrame([self._row(key, ts, status)], columns=["run_id", "failed_at", "last_status"])

    def close(self) -> None:
        pass


def silent_runs(stream: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Failures of runs (run_id, ts, status) in event time. Needs the RocksDB state store provider."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy("run_id")
        .transformWithStateInPandas(
            statefulProcessor=SilentRunProcessor(),
            outputStructType="run_id long, failed_at timestamp, last_status string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


# ── daily series ─────────────────────────────────────────────────────────────
def daily_site_series(stream: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Per site and day: events, sessions, conversions and revenue; emitted once the day is closed."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "site_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("sessions").alias("sessions"), F.sum("conversions").alias("conversions"), F.sum("revenue").alias("revenue"))
        .select("site_id", F.to_date("window.start").alias("date"), "events", "sessions", "conversions", "revenue")
    )


# ── changed pages ────────────────────────────────────────────────────────────
class ChangedPageProcessor(StatefulProcessor):
    """Passes observations whose hash is not the one seen last of their page.

    A key is a bucket of pages and its state a map from page to hash, at first those of the stored analyses: a call of the processor costs
    far more than a value of a map, and most pages have nothing new in a batch.
    """

    def __init__(self, hash_col: str, order: list[str], columns: list[str]) -> None:
        self.hash_col, self.order, self.columns = hash_col, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "page string", "hash string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["_known"] is not None:
            self.known.updateValue((initialState["_page"],), (initialState["_known"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """One look at the state and one update per page and batch; nulls come last in the order."""
        pages: dict[str | None, list[Row]] = {}
        for row in rows:
            pages.setdefault(row["_page"], []).append(row)
        for page, seen in pages.items():
            if self.order:
                seen.sort(key=lambda r: [(r[c] is None, 0 if r[c] is None else r[c]) for c in self.order])
            stored = self.known.getValue((page,))
            before = known = stored[0] if stored else None
            for row in seen:
                now = row[self.hash_col]
                if now is None or now != known:
                    yield Row(**{c: row[c] for c in self.columns})
                known = known if now is None else now
            if known != before:
                self.known.updateValue((page,), (known,))

    def close(self) -> None:
        pass


def changed_since_analysis(
    stream: DataFrame, analysed: DataFrame, *, key: str = "page_id", hash_col: str = "content_hash", order: list[str] | None = None, buckets: int = PAGE_BUCKETS,
) -> DataFrame:
    """Observations whose content hash is not the one known of their page.

    The state of a page is its last hash. It starts as that of the newest stored analysis, which is read once, and follows the stream:
    a page that is seen twice with one new hash is passed once. Within a micro-batch rows go by ``order`` (columns of the stream).
    Rows without a hash always pass and change nothing. Pages lie in ``buckets`` by a hash of the key; a stream keeps their number as
    long as its checkpoint, and a task holds the rows that one batch has of one bucket. Needs the RocksDB state store provider.
    """
    page, bucket = F.col(key).cast("string").alias("_page"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("_bucket")
    newest = analysed.groupBy(key).agg(F.max_by(hash_col, "analysed_at").alias("_known"))
    return stream.select("*", page, bucket).groupBy("_bucket").transformWithState(
        statefulProcessor=ChangedPageProcessor(hash_col, order or [], stream.columns),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="None",
        initialState=newest.select(page, "_known", bucket).groupBy("_bucket"),
    )
