"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Parquet of few distinct values is 20 times as large and more once read. Without this Spark takes the size of the file for that of its rows
# and sends tables of a million rows through the driver to every task.
COMPRESSION_KEY = "spark.sql.sources.fileCompressionFactor"
COMPRESSION = "20"


def build_session(name: str = "siteledger", *, master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        COMPRESSION_KEY: COMPRESSION,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Extraction holds whole documents; small Arrow batches keep the Python side flat.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
        # Materialised frames go away once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only where none is configured."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder every executor can reach.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so several consumers read it once.

    A checkpoint outlives lost executors; use it where a frame feeds more than one branch of a plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
