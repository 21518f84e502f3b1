"""Removal of long repeated substrings: strings meet by anchor, and suffix arrays of their contexts find the repeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import gram_hashes, runs
from .common import Scratch, columns, shuffle_partitions, slices
from .lyndon import suffix_array
from .passage_dedup import join_spans

LENGTH = 100
CHUNK_BYTES = 64 << 10  # contexts sorted together
GROUP_CONTEXTS = 4_000  # contexts of one anchor that a task sorts; beyond that they go string by string
RUNS = 200_000  # runs of a batch that are compared at once
NO_ID = (1 << 63) - 1  # a null id comes last

PLACES = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("width", pa.int64())])
_PLACES = "anchor long, context long, doc_id long, row long, start long, width long"
CONTEXTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_CONTEXTS = "anchor long, doc_id long, row long, start long, bytes binary"
_CLEANED = "row long, doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>"
CLEANED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def find_places(length: int):
    """Runs of starts with one anchor, and a checksum of the bytes that their strings span.

    Of ``RUNS`` runs at a time only the first of equal bytes is sent on; for the others it is clear that their bytes occur earlier, and
    they go out as rows without an anchor's context (null), under a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 << 20):
            rows, ids = batch.column(0).to_numpy(), np.array([NO_ID if i is None else i for i in batch.column(1).to_pylist()], np.int64)
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            raw = b"".join(texts)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            found = runs(np.frombuffer(raw, np.uint8), bounds, length)
            for k in range(0, len(found[0]), RUNS):
                yield distinct_places(raw, bounds, rows, ids, length, *(x[k : k + RUNS] for x in found))

    return run


def distinct_places(raw: bytes, bounds: np.ndarray, rows: np.ndarray, ids: np.ndarray, length: int, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    end = last + length
    context = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(first)).view(np.int64)
    text = np.searchsorted(bounds, first, "right") - 1
    doc, row, start, width, anchor = ids[text], rows[text], first - bounds[text], end - first, anchor.view(np.int64)
    order = np.lexsort((start, row, doc, context, anchor))
    again = np.zeros(len(order), bool)
    again[1:] = (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1])
    send, gone = np.sort(order[~again]), order[again]
    # Neighbouring repeats of a text go out as one.
    r, a, b = join_spans(row[gone], start[gone], start[gone] + width[gone])
    nothing = pa.nulls(len(r), pa.int64())
    parts = zip(
        (pa.array(x[send]) for x in (anchor, context, doc, row, start, width)),
        (pa.array(r * np.int64(-7046029254386353131)), nothing, pa.array(np.full(len(r), NO_ID)), pa.array(r), pa.array(a), pa.array(b - a)),
    )
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in parts], schema=PLACES)


def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over places sorted by anchor, context and position.

    Of equal contexts all but the first are covered: they go out with a null anchor. The first ones go out with it where the
    anchor has other contexts too, as these may share strings; a context alone with its anchor shares none.
    """
    last_key = None  # anchor and context of the row before
    pending = None  # a first context that is alone with its anchor so far

    for batch in batches:
        anchor, context, doc, row, start, width = (batch.column(i) for i in range(6))
        passed = context.is_null().to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~passed)
        a, c = anchor.to_numpy()[keep], context.take(pa.array(keep)).to_numpy()
        rest = [x.to_numpy() for x in (doc, row, start, width)]
        new_anchor, new = np.ones(len(a), bool), np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new[1:] = new_anchor[1:] | (c[1:] != c[:-1])
        if len(a) and last_key is not None:
            new_anchor[0] = a[0] != last_key[0]
            new[0] = new_anchor[0] or c[0] != last_key[1]
        covered = np.concatenate([np.flatnonzero(passed), keep[~new]])
        yield _places(None, [x[covered] for x in rest])
        firsts = np.flatnonzero(new)
        if len(firsts):
            fa, lead, at = a[firsts], new_anchor[firsts], keep[firsts]
            values = [x[at] for x in rest]
            follower = ~lead  # not the first context of its anchor
            followed = np.append(follower[1:], False)
            if pending is not None and follower[0]:
                yield _places(pending[0], pending[1])
            take = follower | followed
            pending = None
            if not take[-1]:  # the last one may yet be followed
                pending = (fa[-1:], [x[-1:] for x in values])
            yield _places(fa[take], [x[take] for x in values])
        if len(a):
            last_key = (a[-1], c[-1])


def _places(anchor: np.ndarray | None, values: list[np.ndarray]) -> pa.RecordBatch:
    n = len(values[0])
    key = pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor, pa.int64())
    return pa.RecordBatch.from_arrays([key, pa.nulls(n, pa.int64()), *(pa.array(v) for v in values)], schema=PLACES)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted places of each text."""
    for batch in slices(batches, 2, 8 << 20):
        out: list[list] = [[] for _ in CONTEXTS]
        for row, doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            raw = (text or "").encode()
            for place in wanted:
                a = place["start"]
                for column, value in zip(out, (place["anchor"], NO_ID if doc_id is None else doc_id, row, a, raw[a : a + place["width"]])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CONTEXTS)], schema=CONTEXTS)


def shared_parts(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last start of a string whose hash occurs twice; -1 for none. Equal strings have equal hashes."""
    widths = np.array([len(c) for c in contexts])
    base = np.cumsum(widths) - widths
    hashes = gram_hashes(np.frombuffer(b"".join(contexts), np.uint8), length)
    owner = np.repeat(np.arange(len(contexts)), widths - length + 1)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(widths - length + 1) - (widths - length + 1), widths - length + 1)
    own = hashes[base[owner] + starts]
    order = np.argsort(own)
    same = np.zeros(len(own) + 1, bool)
    same[1:-1] = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order] = same[1:] | same[:-1]
    first, last = np.full(len(contexts), -1), np.full(len(contexts), -1)
    at = np.flatnonzero(twice)
    last[owner[at]] = starts[at]
    first[owner[at[::-1]]] = starts[at[::-1]]
    return first, last


def repeated_starts(contexts: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and offset of each string of ``length`` bytes that occurs earlier among the contexts.

    The contexts are joined by a value below all bytes and sorted as one suffix array; in its order equal strings are
    neighbours with a common prefix of at least ``length``, an interval of which only the earliest start is no repeat.
    """
    widths = np.array([len(c) for c in contexts])
    raw = b"".join(c + b"\0" for c in contexts)
    base = np.cumsum(widths + 1) - (widths + 1)
    values = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
    values[base + widths] = 1
    order = np.array(suffix_array([*values.tolist(), 0])[1:], np.int64)
    owner = np.repeat(np.arange(len(contexts)), widths + 1)
    offset = np.arange(len(raw)) - base[owner]
    order = order[offset[order] + length <= widths[owner[order]]]
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
    same = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 16_384):
        b = min(len(order) - 1, a + 16_384)
        same[a + 1 : b + 1] = (strings[order[a:b]] == strings[order[a + 1 : b + 1]]).all(axis=1)
    own = owner[order]
    begin = start[own] + offset[order]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((begin, row[own], doc[own]))] = np.arange(len(order))
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(rank, heads) if len(heads) else rank
    interval = np.cumsum(~same) - 1
    # One start may occur in two contexts only with different anchors, so ranks in an interval are of different starts.
    late = rank > least[interval] if len(heads) else np.zeros(0, bool)
    return own[late], offset[order][late]


def find_repeats(length: int, most: int | None):
    """One pass over contexts sorted by anchor: stretches that occur earlier (null anchor), or the contexts of a group above ``most``."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        doc, row, start = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        first, last = shared_parts([h[4] for h in held], length)
        some = np.flatnonzero(first >= 0)  # only what may be shared is sorted
        doc, row, start = doc[some], row[some], start[some] + first[some]
        parts = [held[i][4][first[i] : last[i] + length] for i in some.tolist()]
        own, offset = repeated_starts(parts, doc, row, start, length) if parts else (some, some)
        if not len(own):
            return _stretches(row[:0], start[:0], start[:0])
        order = np.lexsort((offset, own))
        own, offset = own[order], offset[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        who = own[first]
        return _stretches(row[who], start[who] + offset[first], offset[last] - offset[first] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # contexts of whole groups
        ready_bytes = 0
        group: list[tuple] = []
        passing = None
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                if passing is not None and item[0] == passing:
                    group.append(item)
                    if len(group) >= 1000:
                        yield _handed(group)
                        group = []
                    continue
                if passing is not None:
                    if group:
                        yield _handed(group)
                    passing, group = None, []
                if group and item[0] != group[0][0]:
                    ready += group
                    ready_bytes += sum(len(g[4]) for g in group)
                    group = []
                    if ready_bytes >= CHUNK_BYTES:
                        yield solve(ready)
                        ready, ready_bytes = [], 0
                group.append(item)
                if most is not None and len(group) > most:
                    passing = item[0]
                    yield _handed(group)
                    group = []
        if passing is not None:
            if group:
                yield _handed(group)
        else:
            ready += group
        if ready:
            yield solve(ready)

    return run


def _stretches(row: np.ndarray, start: np.ndarray, width: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.nulls(len(row), pa.binary()), pa.array(width, pa.int64())], schema=_FOUND_SCHEMA
    )


_FOUND_SCHEMA = CONTEXTS.append(pa.field("width", pa.int64()))
_FOUND = _CONTEXTS + ", width long"


def _handed(group: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(zip(*group), CONTEXTS)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(group), pa.int64())], schema=_FOUND_SCHEMA)


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each text's stretches, and the bytes beside it."""
    for batch in slices(batches, 2, 8 << 20):
        out: list[list] = [[] for _ in CLEANED]
        for row, doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            raw = (text or "").encode()
            spans: list[dict] = []
            for s in sorted(found or [], key=lambda x: x["start"]):
                if spans and s["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s["start"] + s["width"])
                else:
                    spans.append({"start": s["start"], "end": s["start"] + s["width"]})
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for column, value in zip(out, (row, doc_id, len(raw), kept, spans)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CLEANED)], schema=CLEANED)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_contexts: int = GROUP_CONTEXTS
) -> DataFrame:
    """Every text without the bytes of strings of ``length`` bytes that start earlier: smaller id, or same text and earlier.

    Returns ``row``, ``doc_id``, ``n_bytes``, ``kept`` (the bytes left), ``spans`` (removed runs, start and end in bytes), one row per
    row. Strings never cross texts and are judged on the input. Null is empty text. Null ids come last; rows with one id come
    in the order in which they were read. Texts shorter than ``length`` stay whole.

    A string's anchor is its leftmost smallest k-gram hash, so equal strings have equal anchors. Starts with one anchor are
    one run with one context (about forty starts). Runs meet by anchor: equal contexts (64-bit checksums under a 64-bit anchor)
    keep the first, different ones are sorted as suffixes. An anchor with more than ``group_contexts`` different contexts is
    taken apart into its strings, which are aggregated by value. Texts are shuffled once, into a table bucketed by row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    n = shuffle_partitions(spark)
    source = columns(docs, id_col, text_col)
    source = source.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = f"substring_dedup_{uuid.uuid4().hex}"
    source.repartition(n, "row").write.bucketBy(n, "row").sortBy("row").option("path", f"{scratch.folder}/texts").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes

    places = texts.mapInArrow(find_places(length), _PLACES)
    sorted_places = places.repartition(n, "anchor").sortWithinPartitions("anchor", "context", "doc_id", "row", "start")
    sorted_places = scratch.keep(sorted_places.mapInArrow(sort_out, _PLACES), "places")
    covered = sorted_places.filter("anchor is null").select("row", "start", F.col("width").cast("long").alias("width"))
    wanted = sorted_places.filter("anchor is not null").groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "width")).alias("wanted"))
    contexts = texts.join(wanted, "row").select("row", "doc_id", "text", "wanted").mapInArrow(cut_contexts, _CONTEXTS)
    found = contexts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(find_repeats(length, group_contexts), _FOUND)
    found = scratch.keep(found, "found")
    covered = covered.union(found.filter("anchor is null").select("row", "start", "width"))
    handed = found.filter("anchor is not null")
    if not handed.isEmpty():
        strings = handed.withColumn("i", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)))
        strings = strings.select("doc_id", "row", (F.col("start") + F.col("i")).alias("start"), F.expr(f"substring(bytes, i + 1, {length})").alias("string"))
        strings = scratch.keep(strings, "strings")
        first = scratch.keep(strings.groupBy("string").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
        late = strings.join(first, "string").filter(F.struct("doc_id", "row", "start") > F.col("first"))
        covered = covered.union(late.select("row", "start", F.lit(length).cast("long").alias("width")))
    spans = scratch.keep(covered.groupBy("row").agg(F.collect_list(F.struct("start", "width")).alias("found")), "spans")
    return texts.join(spans, "row", "left").select("row", "doc_id", "text", "found").mapInArrow(remove_spans, _CLEANED)
