"""Shared parts: document columns, tables in the shared folder, the white space every operator agrees on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.session import checkpoint_dir

# The characters that part words, and the pattern of a word.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under those names, whatever else the table holds."""
    return docs.select(*[F.col(f"`{n}`").alias(n) for n in names])


BATCH_ROWS = 2000
FILE_SHIFT = 40  # bits of a row number for the position in a file; the others are the file's number


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold at most ``BATCH_ROWS`` of them, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Intermediate tables of one call, as Parquet in the cluster's shared folder.

    A written table ends the lineage, so a lost executor costs only the tasks that read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for table in tables:
            for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spare_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether every row is one row of one file: a single scan of distinct files under nothing but columns and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  not every format has it
    except AnalysisException:
        return False
    # A file that is named twice is read twice, with the same positions.
    return len(plan.relation().location().inputFiles()) == len(docs._jdf.inputFiles())


def with_rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The table with a row number, and that column's name; rows stay apart where ids are null or repeated.

    Rows of files are numbered by file and position in it, which is the same in every scan however the files are cut and
    whichever executors are alive. The number of a file is its rank by path. Anything else is written once.
    """
    name = spare_name(docs, "_row")
    if not _rows_of_files(docs):
        return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name
    meta = docs.metadataColumn("_metadata")
    paths = sorted(r[0] for r in docs.select(meta["file_path"]).distinct().collect())  # the driver lists the files anyway
    path, number = spare_name(docs, "_path"), spare_name(docs, "_number")
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), f"{path} string, {number} long")
    placed = docs.withColumns({path: meta["file_path"], name: meta["row_index"]}).join(F.broadcast(files), path)
    return placed.withColumn(name, F.shiftleft(number, FILE_SHIFT) + F.col(name)).drop(path, number).select(*[f"`{c}`" for c in docs.columns], name), name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that long documents do not add up in memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(column) -> Iterator[str]:
    """Values of an Arrow string column; null is the empty text."""
    return (x or "" for x in column.to_pylist())
