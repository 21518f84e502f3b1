"""Exact duplicates by naming: blocks get integer names, adjacent names are paired until one name is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Scratch, columns, shuffle_partitions, slices, with_rows

BLOCK = 8192
MEMBER = pa.struct(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n_blocks", pa.int32()), ("n_chars", pa.int64()), ("sha", pa.string())]
)
CUT = pa.schema([("block", pa.binary()), ("members", pa.list_(MEMBER))])
NAMED = pa.schema([*[(f.name, f.type) for f in MEMBER], ("name", pa.int64())])
_SPARK_MEMBER = "row long, doc_id long, pos int, n_blocks int, n_chars long, sha string"
LEFT_OVER = -1  # stands beside the last name of a document with an odd number of names


def cut_blocks(size: int):
    """Blocks of each text without white space; a block that repeats inside a batch is sent once, with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            places: dict[bytes, list[dict]] = {}
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                plain = text.encode().translate(None, SPACE_BYTES)
                n = max(1, -(-len(plain) // size))
                for pos in range(n):
                    sha = hashlib.sha256(plain).hexdigest() if pos == 0 else None
                    member = {"row": row, "doc_id": doc_id, "pos": pos, "n_blocks": n, "n_chars": len(text), "sha": sha}
                    places.setdefault(plain[pos * size : (pos + 1) * size], []).append(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places.keys(), pa.binary()), pa.array(places.values(), pa.list_(MEMBER))], schema=CUT
            )

    return run


def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted blocks: the name is the partition and the rank of the block in it."""
    name, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        names: list[int] = []
        lists = batch.column(1)
        for block, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist()):
            if block != last:
                name, last = name + 1, block
            names += [name] * n
        flat = lists.flatten()
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(names, pa.int64())], schema=NAMED)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """Identity of every text without the characters of ``[\\x20\\x09-\\x0D]``.

    Returns one row per input row: ``row`` (``row_col``, or a number given here), ``doc_id``, ``keep_id``, ``keep_row``,
    ``group_size``, ``kept``, ``text_sha256``. Of equal texts the one with the most code points stays, then the smallest
    id (null last), then the smallest row. Null counts as empty text, and empty texts equal one another. An empty table
    gives an empty table; other columns are not read. Names are ranks of sorted values, so equal names mean equal texts:
    the checksum is only reported. A block occurs once per batch in the shuffle, so a text with very many copies is no hot key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "block-naming")
    n = shuffle_partitions(spark)
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.monotonically_increasing_id()
    source = columns(docs, id_col, text_col, *([row_col] if row_col else []))
    source = source.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = source.mapInArrow(cut_blocks(block), f"block binary, members array<struct<{_SPARK_MEMBER.replace(' ', ':').replace(',:', ',')}>>")
    named = blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(name_blocks, f"{_SPARK_MEMBER}, name long")
    named = scratch.keep(named, "blocks")

    whole = named.filter("n_blocks = 1").select("row", "n_blocks", "name")
    level = named.filter("n_blocks > 1").select("row", "n_blocks", "name", "pos", F.col("n_blocks").alias("left"))
    widest = named.agg(F.max("n_blocks")).first()[0] or 1
    while widest > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", "n_blocks", "left", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(LEFT_OVER)).alias("b")
        )
        pairs = scratch.keep(pairs.withColumn("left", F.expr("cast((left + 1) div 2 as int)")), "pairs")
        names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        names = scratch.keep(names, "names")
        level = scratch.keep(pairs.join(names, ["a", "b"]).select("row", "n_blocks", "name", "pos", "left"), "level")
        whole = whole.union(level.filter("left = 1").select("row", "n_blocks", "name"))
        level = level.filter("left > 1")
        widest = -(-widest // 2)

    first = named.filter("pos = 0").select("row", "doc_id", "n_chars", "sha")
    ids = scratch.keep(first.join(whole, "row"), "ids")
    order = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = scratch.keep(ids.groupBy("n_blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, row = with_rows(docs, Scratch(docs.sparkSession, "exact-dedup"))
    kept = exact_groups(rows, id_col=id_col, text_col=text_col, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
