"""Removal of repeated passages of words with suffix trees, one tree per group of suffixes with a common prefix."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, shuffle_partitions, slices
from .word_prefixes import sampled, word_hashes, words_of

LENGTH = 20  # words of a window
PREFIXES = (8, 14)  # words by which suffixes are grouped, first and where a group is too large; then whole windows
GROUP = 16_384  # suffixes of a group that one task may hold
TREE_SUFFIXES = 16_384  # suffixes of small groups that are sorted together
NO_ID = (1 << 63) - 1  # a null id comes last
SLICE = 4 << 20

PLACES = pa.schema([("prefix", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("width", pa.int64())])
_PLACES = "prefix long, context long, doc_id long, row long, start long, width long"
CONTEXTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("width", pa.int64()), ("words", pa.string())])
_CONTEXTS = "key long, doc_id long, row long, start long, width long, words string"
SPANS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("width", pa.int64())])
_SPANS = "row long, start long, width long"
CLEANED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_CLEANED = "row long, doc_id long, n_words long, kept string, spans array<struct<start:bigint,end:bigint>>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other and their bounds; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def join_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each row, as spans that do not touch."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    group = np.cumsum(np.diff(row, prepend=row[0]) != 0)
    shift = group * (int(end.max()) + 2)  # so that spans of another row lie beyond all of this one
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    return row[head], start[head], reach[tail] - shift[tail]


def find_suffixes(length: int, prefix: int):
    """Sampled suffixes of each text with a checksum of the words that their windows span.

    Inside a batch only the first of equal spans is sent on; the others are clear repeats and go out joined, without a checksum,
    under a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            rows, ids = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), NO_ID).to_numpy()
            data, bounds = _bytes(batch.column(2))
            begin, end, of_text = words_of(data, bounds)
            first, last, key, context = sampled(word_hashes(data, begin, end), of_text, length, prefix)
            if not len(first):
                continue
            text = np.searchsorted(of_text, first, "right") - 1
            doc, row, start, width = ids[text], rows[text], first - of_text[text], last - first + length
            order = np.lexsort((start, row, doc, context, key))
            again = np.zeros(len(order), bool)
            again[1:] = (key[order][1:] == key[order][:-1]) & (context[order][1:] == context[order][:-1])
            send, gone = np.sort(order[~again]), order[again]
            r, a, b = join_spans(row[gone], start[gone], start[gone] + width[gone])
            spread = r * np.int64(-7046029254386353131)
            nothing = pa.nulls(len(r), pa.int64())
            arrays = zip(
                (pa.array(x) for x in (key[send].view(np.int64), context[send].view(np.int64), doc[send], row[send], start[send], width[send])),
                (pa.array(spread), nothing, nothing, pa.array(r), pa.array(a), pa.array(b - a)),
            )
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in arrays], schema=PLACES)

    return run


def cut_words(length: int):
    """The words of wanted places; where the group is too large, one row for each window, still without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            out: list[tuple] = []
            for row, doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                words, doc_id = (text or "").encode().split(), NO_ID if doc_id is None else doc_id
                for place in wanted:
                    a, n = place["start"], place["width"]
                    if place["large"]:
                        out += ((None, doc_id, row, i, length, b" ".join(words[i : i + length])) for i in range(a, a + n - length + 1))
                    else:
                        out.append((place["prefix"], doc_id, row, a, n, b" ".join(words[a : a + n])))
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f.name == "words" else f.type).cast(f.type) for c, f in zip(zip(*out), CONTEXTS)], schema=CONTEXTS)


class SuffixTree:
    """The suffix tree of some suffixes: leaves in order, and the depth at which each parts from the one before.

    An internal node is an interval of leaves; its depth is the number of words all of them share. Suffixes are rows of word
    numbers cut at ``length`` words.
    """

    def __init__(self, suffixes: np.ndarray) -> None:
        packed = np.ascontiguousarray(suffixes.astype(">u4"))
        self.leaves = np.argsort(packed.view(f"S{4 * packed.shape[1]}").ravel(), kind="stable")
        ordered = suffixes[self.leaves]
        differ = ordered[1:] != ordered[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of the topmost internal nodes that are at least ``depth`` words deep."""
        inside = np.concatenate([[False], self.shared >= depth, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        return turns[::2], turns[1::2]


def repeated_windows(words: list[list[bytes]], doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each window of ``length`` words that also starts earlier among the given stretches of words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)), 1)}
    codes = np.fromiter((number[w] for w in chain.from_iterable(words)), np.uint32)
    sizes = np.array([len(w) for w in words])
    starts = sizes - length + 1
    owner = np.repeat(np.arange(len(words)), starts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    suffixes = np.lib.stride_tricks.sliding_window_view(codes, length)[(np.cumsum(sizes) - sizes)[owner] + offset]
    tree = SuffixTree(suffixes)
    first, last = tree.deep_nodes(length)
    if not len(first):
        return row[:0], start[:0]
    n = last - first + 1
    node = np.repeat(np.arange(len(first)), n)
    leaf = tree.leaves[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    own = owner[leaf]
    order = np.lexsort((start[own] + offset[leaf], row[own], doc[own], node))
    late = order[np.concatenate([[False], np.diff(node[order]) == 0])]  # all but the earliest leaf of a node
    return row[own[late]], start[own[late]] + offset[leaf[late]]


def grow_trees(length: int, most: int):
    """Stretches that occur earlier, from a tree for every group of suffixes; groups come one after the other."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        doc, row, start = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        at, late = repeated_windows([h[5].encode().split() for h in held], doc, row, start, length)
        r, a, b = join_spans(at, late, late + length)
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b - a)], schema=SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for item in (i for batch in batches for i in zip(*(c.to_pylist() for c in batch.columns))):
            if group and item[0] != group[0][0]:
                ready += group
                group = []
                if size >= most:
                    yield solve(ready)
                    ready, size = [], 0
            group.append(item)
            size += item[4] - length + 1
        if ready or group:
            yield solve(ready + group)

    return run


def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside each text's spans."""
    for batch in slices(batches, 2, SLICE):
        out: list[list] = [[] for _ in CLEANED]
        for row, doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text or "").encode().split()
            spans: list[dict] = []
            for s in sorted(found or [], key=lambda x: x["start"]):
                if spans and s["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s["start"] + s["width"])
                else:
                    spans.append({"start": s["start"], "end": s["start"] + s["width"]})
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(words)]
            kept = words if not spans else list(chain.from_iterable(words[a:b] for a, b in zip(edges[::2], edges[1::2])))
            for column, value in zip(out, (row, doc_id, len(words), b" ".join(kept).decode(), spans)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CLEANED)], schema=CLEANED)


def remove_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    prefixes: tuple[int, ...] = PREFIXES,
    group: int = GROUP,
) -> DataFrame:
    """Every text without the words of windows of ``length`` words that start earlier: smaller id, or same text and earlier.

    Returns ``row``, ``doc_id``, ``n_words``, ``kept`` (the words left, joined by one space), ``spans`` (removed runs of words, start and
    end), one row per row. Windows never cross texts and are judged on the input. Null is the empty text, and texts of fewer than
    ``length`` words stay whole. Null ids come last; rows with one id come in the order in which they were read. An empty table
    gives an empty one; other columns are not read.

    Suffixes are grouped by prefixes of ``prefixes[0]`` words. Each window holds the prefix of a sampled suffix, so only those go
    out, with the neighbouring windows that take the same one. A prefix that occurs once, or always among the same words, needs no
    tree: of equal stretches (64-bit checksums under a 64-bit key) all but the first go. A group of more than ``group`` suffixes is
    split by longer prefixes; what is too large at the last length shares whole windows, which are aggregated. The other groups
    become suffix trees, whose nodes at least ``length`` words deep are the repeats. Texts are shuffled once, into a table
    bucketed by row.
    """
    if not 0 < prefixes[0] <= length or list(prefixes) != sorted(set(prefixes)) or prefixes[-1] >= length:
        raise ValueError("prefixes must grow and be shorter than a window")
    spark = docs.sparkSession
    scratch = Scratch(spark, "passage-dedup")
    n = shuffle_partitions(spark)
    source = columns(docs, id_col, text_col)
    source = source.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = f"passage_dedup_{uuid.uuid4().hex}"
    source.repartition(n, "row").write.bucketBy(n, "row").sortBy("row").option("path", f"{scratch.folder}/texts").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes

    by_prefix = Window.partitionBy("prefix")
    places = texts.mapInArrow(find_suffixes(length, prefixes[0]), _PLACES).repartition(n, "prefix")
    before = F.lag("context").over(by_prefix.orderBy("context", "doc_id", "row", "start"))
    places = places.withColumn("again", F.col("context").isNull() | F.coalesce(before == F.col("context"), F.lit(False)))
    places = places.withColumn("mixed", F.min("context").over(by_prefix) != F.max("context").over(by_prefix))
    places = places.withColumn("size", F.sum(F.when(~F.col("again"), F.col("width") - length + 1)).over(by_prefix)).filter("again or mixed")
    places = scratch.keep(places.select("again", "prefix", "row", "start", "width", (F.col("size") > group).alias("large")), "places")
    covered = places.filter("again").select("row", "start", "width")

    wanted = places.filter("not again")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("prefix", "start", "width", "large")).alias("wanted"))
    contexts = scratch.keep(texts.join(wanted, "row").select("row", "doc_id", "text", "wanted").mapInArrow(cut_words(length), _CONTEXTS), "contexts")
    grouped, rest = contexts.filter("key is not null"), contexts.filter("key is null")
    if not rest.isEmpty():
        for k in prefixes[1:]:
            keyed = rest.withColumn("key", F.xxhash64(F.substring_index("words", " ", k)))
            sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
            keyed = scratch.keep(keyed.join(sizes, "key"), "keyed")
            grouped = grouped.unionByName(keyed.filter(F.col("size") <= group).drop("size"))
            rest = keyed.filter(F.col("size") > group).drop("size")
        place = F.struct("doc_id", "row", "start")
        first = rest.groupBy("words").agg(F.min(place).alias("first"), F.count("*").alias("size")).filter("size > 1")
        covered = covered.union(rest.join(first, "words").filter(place > F.col("first")).select("row", "start", "width"))
    trees = grouped.repartition(n, "key").sortWithinPartitions("key")
    covered = covered.union(trees.mapInArrow(grow_trees(length, TREE_SUFFIXES), _SPANS))
    spans = scratch.keep(covered.groupBy("row").agg(F.collect_list(F.struct("start", "width")).alias("found")), "spans")
    return texts.join(spans, "row", "left").select("row", "doc_id", "text", "found").mapInArrow(keep_words, _CLEANED)
