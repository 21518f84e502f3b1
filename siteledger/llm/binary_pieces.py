"""Packing by powers of two: each document is cut into pieces of binary length, and equal lengths share a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, slices
from .tokens import byte_bpe, default_path

END_ID = 0
LONGEST = 1024
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
     ("part", pa.int32()), ("bucket", pa.int32()), ("local", pa.int64())]
)
_SPARK = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, bucket int, local long"


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces: as many of the longest as fit, then the ones in the binary form of the rest, falling."""
    out = [longest] * (tokens // longest)
    rest = tokens % longest
    return out + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def cut_pieces(path: str, longest: int, end_id: int):
    """Pieces of each text, with the number a piece has among those of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(path), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        seen = [0] * longest.bit_length()
        for batch in slices(batches):
            rows: list[tuple] = []
            flat, bounds = bpe.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = flat[a:b].astype("<u4").tobytes() + end
                total, start = b - a + 1, 0
                for n in binary_lengths(total, longest):
                    bucket = n.bit_length() - 1
                    rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], total, part, bucket, seen[bucket]))
                    seen[bucket] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return run


def binary_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID
) -> DataFrame:
    """One row per piece, each a sequence of its own: no sequence holds two documents, and none needs padding.

    Returns ``doc_id``, ``start`` (ids before it), ``length`` (a power of two, at most ``longest``), ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``bucket`` (log2 of the length), ``sequence_id``, ``offset`` (always 0). Sequence ids run
    from 0 without gaps, bucket by bucket, so a range of ids is a batch of one shape. Null text is empty text, which is the
    end id alone. Null and repeated ids keep one set of pieces per row. ``longest`` must be a power of two.

    Pieces are written once with their number inside (task, bucket); the first id of each (task, bucket) follows from
    counts, of which there are tasks times buckets.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    scratch = Scratch(docs.sparkSession, "binary-pieces")
    source = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = scratch.keep(source.mapInArrow(cut_pieces(tokenizer or default_path(), longest, end_id), _SPARK), "pieces")
    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    in_bucket = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn("base", F.sum("n").over(in_bucket) - F.col("n"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("total"))  # at most eleven rows for 1024
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("first", F.sum("total").over(below) - F.col("total")).drop("total")
    starts = scratch.keep(starts.join(buckets, "bucket").select("bucket", "part", (F.col("first") + F.col("base")).alias("base")), "starts")
    return pieces.join(starts, ["bucket", "part"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "bucket", (F.col("base") + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
