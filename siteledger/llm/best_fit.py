"""Packing by best fit decreasing: a segment tree over free room finds the fullest row that still takes a piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, slices
from .tokens import byte_bpe, default_path

CAPACITY = 1024
END_ID = 0
PAD_ID = 0
BLOCK_TOKENS = 2_000_000  # ids packed together; bounds the memory of a task
PACKED = pa.schema(
    [("row_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
     ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
)
_SPARK = "row_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, positions binary, doc_ids array<long>, starts array<long>"


class FreeRoom:
    """Counts of open rows by free room, in a segment tree: the least room that is large enough, in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the open row with the least room of at least ``need``; it is open no more."""
        i = need + self.width
        if not self.tree[i]:
            # Up to the first ancestor with something open on its right, then down its left edge.
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.width
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Row of each piece, pieces taken by falling length."""
    tree, rows, row_of = FreeRoom(capacity), 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = (capacity, rows)
            rows += 1
        room, row_of[i] = found
        if room > lengths[i]:
            tree.put(room - lengths[i], row_of[i])
    return row_of


def _pack(pieces: list[tuple[int, int, bytes]], capacity: int, pad: int, first: int) -> tuple[pa.RecordBatch, int]:
    row_of = best_fit([len(p[2]) // 4 for p in pieces], capacity)
    n_rows = max(row_of) + 1
    members: list[list[int]] = [[] for _ in range(n_rows)]
    for i, row in enumerate(row_of):
        members[row].append(i)
    out: list[list] = [[] for _ in PACKED]
    for row, held in enumerate(members):
        ids = b"".join(pieces[i][2] for i in held)
        lengths = [len(pieces[i][2]) // 4 for i in held]
        ends = np.cumsum([0, *lengths])
        padding = capacity - int(ends[-1])
        positions = np.concatenate([np.arange(n, dtype="<u4") for n in (*lengths, padding)])
        values = (
            first + row, ids + pad.to_bytes(4, "little") * padding, int(ends[-1]), ends.tolist(), ends[:-1].tolist(), positions.tobytes(),
            [pieces[i][0] for i in held], [pieces[i][1] for i in held],
        )
        for column, value in zip(out, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PACKED)], schema=PACKED), n_rows


def pack_texts(path: str, capacity: int, end_id: int, pad_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = byte_bpe(path), TaskContext.get().partitionId() << 40
        end, pieces, held = end_id.to_bytes(4, "little"), [], 0
        for batch in slices(batches):
            flat, bounds = bpe.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = flat[a:b].astype("<u4").tobytes() + end
                total = b - a + 1
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    if held and held + len(piece) // 4 > block_tokens:
                        packed, n = _pack(pieces, capacity, pad_id, row)
                        yield packed
                        row, pieces, held = row + n, [], 0
                    pieces.append((doc_id, start, piece))
                    held += len(piece) // 4
        if pieces:
            yield _pack(pieces, capacity, pad_id, row)[0]

    return run


def packed_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    pad_id: int = PAD_ID, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Rows of exactly ``capacity`` ids, little-endian unsigned 32-bit, ready to be read as a matrix.

    Returns ``row_id``, ``ids``, ``n_tokens`` (before padding), ``cu_seqlens`` (0 and the end of each segment), ``resets``
    (where positions start again at 0), ``positions`` (one per id; padding counts as a segment of its own), ``doc_ids`` and
    ``starts`` (of each segment: its document, and the document's ids before it). Documents longer than a row are cut every
    ``capacity`` ids and every id lies in exactly one segment. Each block of about ``block_tokens`` ids is packed on its own
    inside a task, so there is no shuffle. Null text is empty text, which is the end id alone; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    source = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(pack_texts(tokenizer or default_path(), capacity, end_id, pad_id, block_tokens), _SPARK)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix rows with their segment columns as Parquet."""
    packed.write.parquet(path)
