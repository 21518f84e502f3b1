"""Alignment of two tokenizers over a corpus: which ids overlap, how often, and how well each document follows the usual links."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, shuffle_partitions, slices, with_rows
from .pair_bitmaps import CHUNK_BITS, POSTINGS, either, places, plane_weight, popcount, postings
from .tokens import default_path, ragged, split_pieces

SLICE = 8 << 20  # bytes of text aligned together
HELD = 2_000_000  # postings of a task that become containers together
PAIR_BITS = 31  # of a pair's number

#: A space that neither tokenizer ever joins with what is before it.
CUT = re.compile(r"(?<=\S) (?=\S)")

ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), *POSTINGS]
)
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, chunk long, plane int, bits binary"
_MERGED = "pair long, chunk long, n_docs long, n_links long, planes array<binary>"
MERGED = pa.schema([("pair", pa.int64()), ("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("planes", pa.list_(pa.binary()))])
_RETURNED = "row long, n_best long, count_sum long"
RETURNED = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


class Aligner:
    """Byte ranges of the ids of tokenizer A (ranks of a byte-level vocabulary) and B (a sentencepiece model), and how they overlap."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width_a[rank] = len(token)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self._encode_b = lambda texts: model.encode(texts, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width_b = np.array([len(b) for b in self.bytes_b])
        self.size_b = len(pieces)
        numbers = [b"%d" % i for i in range(max(len(self.width_a), self.size_b))]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.digit_count = np.array([len(x) for x in numbers])
        self.digit_start = np.cumsum(self.digit_count) - self.digit_count

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a space and each segment in A and in B, with how many each segment has; none of either where the bytes differ."""
        flat_a = np.array(self._encode_a(" " + " ".join(segments)), np.int64)
        sizes = np.array([len(s.encode()) + 1 for s in segments])
        cut = np.searchsorted(np.cumsum(self.width_a[flat_a]), np.cumsum(sizes)) + 1
        n_a = np.diff(cut, prepend=0)
        ids_b = self._encode_b(segments)
        same = np.array([s != "" and b"".join([self.bytes_b[i] for i in ids]) == b" " + s.encode() for s, ids in zip(segments, ids_b)], bool)
        flat_a = flat_a[np.repeat(same, n_a)]
        flat_b = np.fromiter(chain.from_iterable(ids for ids, ok in zip(ids_b, same) if ok), np.int64)
        return flat_a, np.where(same, n_a, 0), flat_b, np.where(same, [len(ids) for ids in ids_b], 0)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of two id sequences over the same bytes: places of linked ids in A and in B, and which ids end where the other has an end."""
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        first = np.searchsorted(end_b, end_a - self.width_a[a], "right")
        n = np.searchsorted(end_b - self.width_b[b], end_a) - first
        return np.repeat(np.arange(len(a)), n), ragged(first, n), np.isin(end_a, end_b), np.isin(end_b, end_a)

    def group_text(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups as bytes, each closed by a semicolon, and the number of bytes of each id in turn, those of A first."""
        group = np.concatenate([np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b])
        ids, after = np.concatenate([a, b]), np.concatenate([np.where(stop_a, ord("|"), ord(",")), np.where(stop_b, ord(";"), ord(","))]).astype(np.uint8)
        order = np.argsort(group, kind="stable")  # A stands before B
        ids, after = ids[order], after[order]
        size = self.digit_count[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        digit = np.ones(len(out), bool)
        digit[end - 1] = False
        out[digit] = self.digits[ragged(self.digit_start[ids], self.digit_count[ids])]
        out[end - 1] = after
        place = np.empty(len(order), np.int64)
        place[order] = size
        return out, place


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def segments_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments of a batch, the segments of all texts one after the other, and where each text's begin.

    A segment ends before a single space between characters that are no white space: neither tokenizer joins anything across it.
    """
    pieces, bounds = split_pieces(texts)
    keys, code = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
    size = pc.binary_length(keys).to_numpy()
    odd = (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(keys)).to_numpy() < size)
    found = dict(zip(keys.to_pylist(), range(len(keys))))
    mixed = np.add.reduceat(odd[code], bounds[:-1]) > 0
    if mixed.any():
        parts = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            parts.append([found.setdefault(s, len(found)) for s in CUT.split(texts[i].as_py() or "")] if mixed[i] else code[a:b])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        code = np.concatenate(parts).astype(np.int64)
    used, code = np.unique(code, return_inverse=True)
    names = list(found)
    return [names[i] for i in used.tolist()], code, bounds


def sum_by(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.add.reduceat(weight[order], head) if len(head) else weight[:0]


def align_texts(path_a: str, path_b: str):
    """One row per text, and the containers of the pairs in the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in slices(batches, 2, SLICE):
            rows = batch.column(0).to_numpy()
            docs, found = align_batch(tool, rows, batch.column(2))
            yield _padded([batch.column(0), batch.column(1), *docs], ALIGNED)
            held.append(found)
            if sum(len(h[0]) for h in held) >= HELD:
                yield from _containers(held)
                held = []
        yield from _containers(held)

    return run


def _containers(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        for batch in postings(*(np.concatenate(x) for x in zip(*held))):
            for a in range(0, batch.num_rows, 20_000):
                yield _padded([None] * 7 + batch.slice(a, 20_000).columns, ALIGNED)


def _padded(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    n = next(len(a) for a in arrays if a is not None)
    arrays = arrays + [None] * (len(schema) - len(arrays))
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if a is None else a for a, f in zip(arrays, schema)], schema=schema)


def align_batch(tool: Aligner, rows: np.ndarray, texts: pa.Array) -> tuple[list[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of the texts, and (pair, row, number of links). Each distinct segment is aligned once."""
    segments, code, bounds = segments_of(texts)
    a, n_a, b, n_b = tool.encode(segments)
    seg_a, seg_b = np.repeat(np.arange(len(segments)), n_a), np.repeat(np.arange(len(segments)), n_b)
    at_a, at_b, stop_a, stop_b = tool.links(a, b)
    count = lambda seg: np.bincount(seg, minlength=len(segments))
    n_groups, n_links = count(seg_a[stop_a]), count(seg_a[at_a])
    text, sizes = tool.group_text(a, b, stop_a, stop_b)
    width = np.bincount(np.concatenate([seg_a, seg_b]), sizes, len(segments)).astype(np.int64)
    raw, ends = text.tobytes(), np.cumsum(width).tolist()
    named = [raw[e - w : e] for e, w in zip(ends, width.tolist())]

    whole = np.minimum.reduceat(n_a[code] > 0, bounds[:-1]) if len(rows) else np.zeros(0, bool)  # a text with a segment that differs has no ids
    totals = [np.where(whole, np.add.reduceat(x[code], bounds[:-1]), 0) for x in (n_a, n_b, n_groups, n_links)] if len(rows) else [bounds[:0]] * 4
    listed = code.tolist()
    sums = [hashlib.sha256(b"".join([named[c] for c in listed[x:y]])[:-1]).hexdigest() if ok else "" for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), whole.tolist())]

    # Links of a segment by pair, then segments of a text, then pairs of a text.
    pairs, times = sum_by(seg_a[at_a] << PAIR_BITS | (a[at_a] * tool.size_b + b[at_b]), np.ones(len(at_a), np.int64))
    of_segment = np.searchsorted(pairs >> PAIR_BITS, np.arange(len(segments) + 1))
    owner = np.repeat(np.arange(len(rows)), np.diff(bounds))
    good = whole[owner]
    uses, often = sum_by(owner[good] * len(segments) + code[good], np.ones(int(good.sum()), np.int64))
    doc, seg = np.divmod(uses, max(1, len(segments)))
    n = np.diff(of_segment)[seg]
    at = ragged(of_segment[seg], n)
    key, number = sum_by((pairs[at] & ((1 << PAIR_BITS) - 1)) << 32 | np.repeat(doc, n), times[at] * np.repeat(often, n))
    return [*(pa.array(t.astype(np.int64)) for t in totals), pa.array(sums, pa.string())], (key >> 32, rows[key & 0xFFFFFFFF], number)


def merge_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair and chunk from sorted containers: planes united, documents and links counted."""
    out: list[dict] = []
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for (pair, chunk), group in groupby(rows, key=lambda r: r[:2]):
        planes: list[bytes] = []
        for plane, same in groupby(group, key=lambda r: r[2]):
            planes += [b""] * (plane - len(planes))
            planes.append(either([r[3] for r in same]))
        counts = [popcount(p) for p in planes]
        out.append({"pair": pair, "chunk": chunk, "n_docs": counts[0], "n_links": sum(plane_weight(k) * n for k, n in enumerate(counts)), "planes": planes})
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, MERGED)
            out = []
    yield pa.RecordBatch.from_pylist(out, MERGED)


def return_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sum of the counts of its links, and its links that are best for their B id; chunk by chunk."""

    def close(chunk: int, present: np.ndarray, total: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        low = np.flatnonzero(present)
        return pa.RecordBatch.from_arrays([pa.array((chunk << CHUNK_BITS) + low), pa.array(best[low]), pa.array(total[low])], schema=RETURNED)

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for chunk, group in groupby(rows, key=lambda r: r[0]):
        present = np.zeros(1 << CHUNK_BITS, bool)
        total, best = np.zeros(1 << CHUNK_BITS, np.int64), np.zeros(1 << CHUNK_BITS, np.int64)
        for _, planes, count, is_best in group:
            for plane, bits in enumerate(planes):
                low, weight = places(bits), plane_weight(plane)
                total[low] += weight * count
                if is_best:
                    best[low] += weight
                if plane == 0:
                    present[low] = True
        yield close(chunk, present, total, best)


def pair_postings(aligned: DataFrame, scratch: Scratch) -> DataFrame:
    """Merged bitmaps (``pair``, ``chunk``, ``n_docs``, ``n_links``, ``planes``) from the containers of all tasks."""
    rows = aligned.filter("pair is not null").select("pair", "chunk", "plane", "bits")
    rows = rows.repartition(shuffle_partitions(scratch.spark), "pair", "chunk").sortWithinPartitions("pair", "chunk", "plane")
    return scratch.keep(rows.mapInArrow(merge_postings, _MERGED), "postings")


def pair_counts(merged: DataFrame, size_b: int) -> DataFrame:
    """Every linked pair of ids: ``pair``, ``a_id``, ``b_id``, ``n_docs``, ``n_links``, ``best`` (no other A id has more links with this B id)."""
    counts = merged.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = counts.withColumn("a_id", F.expr(f"pair div {size_b}")).withColumn("b_id", F.col("pair") % size_b)
    best = F.col("n_links") == F.max("n_links").over(Window.partitionBy("b_id"))  # at most one row per id of A
    return counts.select("pair", "a_id", "b_id", "n_docs", "n_links", best.alias("best"))


def align_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Alignment of two tokenizers: one row per row of the table, and one row per pair of linked ids.

    A is a file of byte-level ranks and encodes a space and the text, B a sentencepiece model that adds that space. Offsets where ids
    of both end part the text into groups; an A id and a B id are linked where their bytes overlap.

    The first frame has ``row``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of
    its B id, ties included), ``count_sum`` (counts of the links' pairs, summed), ``groups_sha256``. The second is that of
    ``pair_counts``. Null and empty texts, and texts whose bytes one of the two does not give back, have no ids: zeros and an empty
    checksum. Null and repeated ids keep one row each. An empty table gives empty frames; other columns are not read.

    A pair's postings are compressed bitmaps over the numbers of the rows, with planes for how often a row holds the pair. They are
    built per task, united and counted per (pair, chunk), and return to their chunk with the pair's count, so no frequent pair meets
    in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-alignment")
    path_a, path_b = path_a or default_path("byte_bpe_50k.tiktoken"), path_b or default_path("piece_bpe_32k.model")
    numbered, row = with_rows(columns(docs, id_col, text_col), scratch)
    source = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    aligned = scratch.keep(source.mapInArrow(align_texts(path_a, path_b), _ALIGNED), "aligned")
    merged = pair_postings(aligned, scratch)
    counts = scratch.keep(pair_counts(merged, aligner(path_a, path_b).size_b), "counts")
    scores = counts.select("pair", F.col("n_links").alias("count"), "best")
    sent = merged.select("pair", "chunk", "planes").join(scores, "pair").select("chunk", "planes", "count", "best")
    returned = sent.repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(return_scores, _RETURNED)
    rows = aligned.filter("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(returned, "row", "left")
    return rows.fillna(0, ["n_best", "count_sum"]), counts
