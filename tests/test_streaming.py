import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteledger.streaming import deliveries

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TS = "delivery_id string, ts timestamp, v int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def ids(df):
    return sorted(r.delivery_id for r in df.collect())


def run_stream(spark, tmp_path, batches, schema, transform):
    """Every frame of ``batches`` is one micro-batch; returns the rows each of them gave."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    write = lambda df, i: out.append([tuple(r) for r in df.collect()])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_replayed_and_redelivered_rows_change_nothing(spark, tmp_path):
    path = str(tmp_path / "d")
    write = deliveries.append_new(path)
    first = spark.createDataFrame([("a", at(1), 1), ("a", at(1, 2), 2), ("b", at(1), 3), ("n", None, 0)], TS)
    write(first, 0)
    write(first, 0)
    assert ids(deliveries.delivered(spark, path)) == ["a", "b", "n"]
    write(spark.createDataFrame([("b", at(2), 4), ("c", at(2), 5), ("n", None, 1)], TS), 1)
    assert ids(deliveries.delivered(spark, path)) == ["a", "b", "c", "n"]


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    """What was written without a commit is not read, and the batch that comes again takes its place."""
    path = str(tmp_path / "d")
    write = deliveries.append_new(path)
    write(spark.createDataFrame([("a", at(1), 1)], TS), 0)
    batch = spark.createDataFrame([("a", at(1, 3), 1), ("b", at(2), 2)], TS)
    original = spark.range

    def crash(n):
        raise RuntimeError("lost before the commit")

    type(spark).range = lambda self, *a, **k: crash(a)
    try:
        with pytest.raises(RuntimeError, match="lost"):
            write(batch, 1)
    finally:
        type(spark).range = original.__func__
    written = lambda: ids(spark.read.option("basePath", path).parquet(path + "/day=*"))
    assert written() == ["a", "b"] and ids(deliveries.delivered(spark, path)) == ["a"]
    write(batch, 1)
    assert ids(deliveries.delivered(spark, path)) == written() == ["a", "b"]
    write(spark.createDataFrame([("b", at(2), 2), ("c", at(3), 2)], TS), 2)
    assert ids(deliveries.delivered(spark, path)) == ["a", "b", "c"]


def test_only_days_within_the_delay_are_looked_up(spark, tmp_path):
    path = str(tmp_path / "d")
    write = deliveries.append_new(path, delay_days=2)
    for i in range(10):
        write(spark.createDataFrame([(f"d{i}", at(1 + i), i)], TS), i)
    files = deliveries.delivered(spark, path, ["2024-01-09", "2024-01-10", "2024-02-20"]).inputFiles()
    assert {f.split("day=")[1][:10] for f in files if "day=" in f} == {"2024-01-09", "2024-01-10"}
    write(spark.createDataFrame([("d8", at(10), 0), ("d1", at(10), 0)], TS), 10)  # d1 is older than any redelivery
    assert ids(deliveries.delivered(spark, path)).count("d8") == 1 and ids(deliveries.delivered(spark, path)).count("d1") == 2


def test_a_new_run_counts_from_zero(spark, tmp_path):
    path = str(tmp_path / "d")
    deliveries.append_new(path, run="x")(spark.createDataFrame([("a", at(1), 1)], TS), 7)
    deliveries.append_new(path, run="y")(spark.createDataFrame([("a", at(1), 1), ("b", at(1), 1)], TS), 0)
    assert ids(deliveries.delivered(spark, path)) == ["a", "b"]


PAGES = "page_id long, content_hash string, i int"


def test_changed_pages_follow_the_stream(spark, tmp_path):
    analysed = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (4, None, 1)], "page_id long, content_hash string, analysed_at int")
    batches = [
        [(1, "b", 0), (1, "c", 1), (1, "c", 2), (2, None, 3), (2, "x", 4), (3, "q", 5), (4, None, 6)],
        [(1, "c", 7), (1, "b", 8), (1, "c", 9), (2, "x", 10), (3, "q", 11), (4, "z", 12), (5, None, 13)],
        [(1, "c", 14), (4, "z", 15), (5, "n", 16)],
    ]
    got = run_stream(spark, tmp_path, batches, PAGES, lambda s: deliveries.changed_since_analysis(s, analysed, order=["i"]))
    assert [sorted(r[2] for r in rows) for rows in got if rows] == [[1, 3, 5, 6], [8, 9, 12, 13], [16]]


def test_changed_pages_that_share_a_bucket(spark, tmp_path):
    """One call for many pages of one bucket: more rows than an Arrow batch has, null pages and orders, ids beyond 2^53."""
    big = 2**53
    analysed = spark.range(big, big + 3000).select(F.col("id").alias("page_id"), F.lit("a").alias("content_hash"), F.lit(1).alias("analysed_at"))
    first = [(big + k, "b" if k % 3 == 0 else "a", 2 * k) for k in range(3000)] + [(None, "n", 6000), (None, "n", 6001), (big + 1, "c", None), (big + 1, "d", 1)]
    second = [(big + k, "b", 10_000 + k) for k in range(3000)] + [(None, "n", 6002)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = run_stream(spark, tmp_path, [first, second], PAGES, lambda s: deliveries.changed_since_analysis(s, analysed, order=["i"], buckets=1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = [(big + k, "b", 2 * k) for k in range(0, 3000, 3)] + [(None, "n", 6000), (big + 1, "d", 1), (big + 1, "a", 2), (big + 1, "c", None)]
    after = [(big + k, "b", 10_000 + k) for k in range(3000) if k % 3]
    by = lambda r: (r[0] is None, r[0] or 0, str(r[2]))
    assert [sorted(rows, key=by) for rows in got if rows] == [sorted(want, key=by), sorted(after, key=by)]


def test_changed_pages_are_not_called_for_one_by_one(spark):
    """The processor groups by bucket, so pages that only have an analysis cost no call of their own."""
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("page_id"), F.lit("h").alias("content_hash"), F.col("value").alias("i"))
    analysed = spark.createDataFrame([], "page_id long, content_hash string, analysed_at int")
    plan = deliveries.changed_since_analysis(stream, analysed, order=["i"])._jdf.queryExecution().logical().toString()
    assert "_bucket" in plan.splitlines()[0]


def test_silent_runs_in_one_update_per_batch(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    start = at(1)
    rows = [(1, start, "queued"), (1, start + 2 * minute, "running"), (1, start + 30 * minute, "running"), (2, start, "queued"), (2, start + 4 * minute, "completed"), (3, start + 40 * minute, "completed")]
    late = [(1, start + 35 * minute, "completed"), (1, start + 10 * minute, "queued"), (3, start + 90 * minute, "completed")]
    got = run_stream(spark, tmp_path, [rows, late], "run_id long, ts timestamp, status string", lambda s: deliveries.silent_runs(s, delay="60 minutes"))
    failed = sorted((r, t, s) for out in got for r, t, s in out)
    assert failed == [(1, start + 22 * minute, "running"), (2, start + 3 * minute, "queued")]


def test_silent_runs_equal_a_row_by_row_reading(spark):
    """The shifted differences of a batch against the plain loop over its rows."""
    import random

    rng = random.Random(5)

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def listTimers(self):
            return []

        def registerTimer(self, at):
            self.timer = at

    for _ in range(40):
        processor = deliveries.SilentRunProcessor()
        processor.handle, processor.last = Handle(), State()
        current, want, got = None, [], []
        for _ in range(3):
            rows = [(rng.randrange(0, 9_000_000, 1000), rng.choice(["queued", "running", "completed"])) for _ in range(rng.randint(1, 12))]
            for ts, status in sorted(rows):
                if current is not None and ts < current[0]:
                    continue
                if current is not None and current[1] in ("queued", "running") and ts - current[0] > processor._limit(current[1]):
                    want.append((current[0] + processor._limit(current[1]), current[1]))
                current = (ts, status)
            frame = pd.DataFrame({"ts": pd.to_datetime([r[0] for r in rows], unit="ms"), "status": [r[1] for r in rows]})
            for out in processor.handleInputRows((7,), iter([frame[:4], frame[4:]]), None):
                got += list(zip((out["failed_at"].astype("datetime64[ms]").astype("int64")).tolist(), out["last_status"]))
        assert got == want and processor.last.value == current
