"""Near copies by verified similarity: Golay indices of several SimHash fingerprints propose, prefixes of the shingles the rest; shared shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, shuffle_partitions, slices, with_rows
from .golay_simhash import fingerprints, index_keys, shingle_hashes
from .graph import components
from .set_prefixes import candidate_pairs

SHINGLE = 5
SIMILARITY = 0.8
# Fingerprints of a text, and the shingles in the sample of each. The fingerprint of a whole text moves by about ten bits at similarity 0.8;
# a sample is the same with odds 0.8^5, so two such texts share a key with odds of 1 - (1 - 0.8^5)^16 = 0.998 at least. What that leaves out is found
# by prefixes of the shingles.
PRINTS, SAMPLE = 16, 5
SEED = 11
GROUP_ROWS = 512  # texts compared in one group, and the bytes of their shingles
GROUP_BYTES = 32 << 20
SENT_ROWS = 100_000  # rows whose numbers are sent to every task; more of them are joined

SKETCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("same", pa.binary()), ("bytes", pa.int64()), ("keys", pa.list_(pa.int64()))])
SETS = pa.schema([("row", pa.int64()), ("shingles", pa.binary())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])

_TURN, _FACTOR = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS, SAMPLE), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    return np.unique(np.array(shingle_hashes(text or "", width), np.uint64))


def sample_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints of each set, one for each sample of its shingles; no set may be empty.

    A sample holds the shingles that are least under hashes of its own, so similar sets share many samples.
    """
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    sample = np.empty((len(sets), PRINTS, SAMPLE), np.uint64)
    if len(sets):
        starts = np.cumsum(sizes) - sizes
        for i in range(PRINTS):
            for j in range(SAMPLE):
                sample[:, i, j] = np.minimum.reduceat((flat ^ _TURN[i, j]) * _FACTOR[i, j], starts)
    # Least values begin with zeros: mixed, as every bit has its vote.
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        sample = (sample ^ (sample >> np.uint64(shift))) * np.uint64(factor)
    sample ^= sample >> np.uint64(31)
    return fingerprints(sample.ravel(), np.full(len(sets) * PRINTS, SAMPLE)).reshape(-1, PRINTS)


def golay_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key per fingerprint for each set: its number, and the Golay indices of its three segments."""
    return index_keys(sample_prints(sets)) | np.arange(PRINTS, dtype=np.uint64) << np.uint64(36)


def sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = golay_keys([s for s in sets if len(s)])
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * PRINTS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, pa.array(sizes * 8), lists], schema=SKETCH)

    return run


def set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=SETS)

    return run


def set_links(rows: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that connect the members of a group as similarities of at least ``similarity`` do: each found member with the first."""
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.arange(len(rows))
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            own = sets[frontier.pop()]
            n = sizes[left]
            maybe = np.flatnonzero(np.minimum(n, len(own)) >= similarity * np.maximum(n, len(own)) - 1e-9)
            if not len(maybe):
                continue
            flat = np.concatenate([sets[i] for i in left[maybe]])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(n[maybe]) - n[maybe])
            near = maybe[shared >= similarity * (n[maybe] + len(own) - shared) - 1e-9]
            yield from ((int(rows[root]), int(rows[i])) for i in left[near])
            frontier += left[near].tolist()
            left = np.delete(left, near)


def compare_batches(similarity: float):
    """One pass over rows sorted by key: the links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = list(set_links(np.array(rows, np.int64), sets, similarity))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=LINKS)

        for batch in batches:
            for k, row, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    yield links()
                    key, rows, sets = k, [], []
                rows.append(row)
                sets.append(np.frombuffer(shingles, np.uint64))
        yield links()

    return run


def _links(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    n = shuffle_partitions(dealt.sparkSession)
    rows = dealt.join(sets, "row").select("key", "row", "shingles").repartition(n, "key").sortWithinPartitions("key", "row")
    return rows.mapInArrow(compare_batches(similarity), "u long, v long")


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shingle: int = SHINGLE,
    similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Component of every row: ``row``, ``doc_id``, ``component_id``, ``kept``.

    Two texts link if the share of common shingles (words, A-Z in lower case) is at least ``similarity``. Texts that
    share the Golay indices of one of ``PRINTS`` fingerprints are compared, then those that this leaves in different components although
    prefixes of their shingles allow the similarity; so no link between components is missed. Each link is verified on the shingles
    themselves. A component is what chains of links reach. Texts of equal shingles collapse first; texts without words equal one another. Null text is
    empty; repeated ids and rows are kept apart; ``kept`` marks the row with the smallest id (null last), then row.

    A key of more than ``group_rows`` texts is dealt out in chunks, each with the first text of the key. Only where
    that leaves texts apart from the first one's component are those also compared with every other chunk; so every pair of
    a key is compared or connected already, and a hot group of real near copies costs as many rows as it has.
    """
    if row_col is None:
        docs, row_col = with_rows(docs, Scratch(docs.sparkSession, "similar-rows"))
    scratch = Scratch(docs.sparkSession, "similar-texts")
    source = columns(docs, row_col, id_col, text_col)
    source = source.select(F.col(f"`{row_col}`").cast("long").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = source.mapInArrow(sketch_batches(shingle), "row long, doc_id long, same binary, bytes long, keys array<long>")
    sketches = scratch.keep(sketches, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    distinct = sketches.groupBy("same").agg(first, F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
    distinct = scratch.keep(distinct.select("same", F.col("first.row").alias("row"), "first", "keys", "bytes"), "distinct")

    prints = distinct.select("row", "bytes", F.explode("keys").alias("key"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    keys = prints.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("rep"), F.sum("bytes").alias("bytes"), *marks).filter("n > 1")
    # Keys with the same members need one comparison.
    keys = keys.groupBy("n", "rep", "bytes", "mark1", "mark2").agg(F.min("key").alias("key"))
    chunks = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
    keys = scratch.keep(keys.select("key", "rep", chunks.alias("chunks")), "keys")
    members = scratch.keep(prints.select("key", "row").join(keys, "key"), "members")
    sets = source.select("row", "text").join(members.select("row").distinct(), "row", "left_semi")
    sets = scratch.keep(sets.mapInArrow(set_batches(shingle), "row long, shingles binary"), "sets")

    own = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    chunk = F.explode(F.when(F.col("row") == F.col("rep"), _numbers(F.col("chunks"))).otherwise(F.array(own)))
    dealt = members.select("key", "row", chunk.alias("chunk"))
    links = scratch.keep(_links(dealt.select(F.xxhash64("key", "chunk").alias("key"), "row"), sets, similarity), "links")
    stars = components(links, scratch)

    hot = members.filter("chunks > 1")
    if not hot.isEmpty():
        hot = hot.join(stars.select(F.col("u").alias("row"), F.col("v").alias("root")), "row", "left").withColumn("root", F.coalesce("root", "row"))
        hot = scratch.keep(hot, "hot")
        main = hot.filter("row = rep").select("key", F.col("root").alias("main"))
        hot = scratch.keep(hot.join(main, "key").withColumn("apart", F.col("root") != F.col("main")).select("key", "row", "chunks", "apart"), "hot")
        apart = hot.filter("apart").groupBy("key").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("others"))
        # Tiles 0 to chunks - 1 hold the first text's component, those after them the texts apart; pairs of the former are connected.
        hot = hot.join(scratch.keep(apart, "apart"), "key")
        tile = F.when(F.col("apart"), F.col("chunks") + F.pmod(F.xxhash64("row"), F.col("others")).cast("int")).otherwise(own)
        partners = F.when(F.col("apart"), _numbers(F.col("chunks") + F.col("others"))).otherwise(F.transform(_numbers(F.col("others")), lambda i: i + F.col("chunks")))
        pair = hot.select("key", "row", tile.alias("a"), F.explode(partners).alias("b"))
        pair = pair.select(F.xxhash64("key", F.least("a", "b"), F.greatest("a", "b")).alias("key"), "row")
        links = scratch.keep(links.union(_links(pair, sets, similarity)), "links")
        stars = components(links, scratch)

    # The rest, exactly: pairs of different components that may reach the similarity.
    loose = distinct.select("row", (F.col("bytes") / 8).cast("long").alias("size")).join(stars.select(F.col("u").alias("row"), F.col("v").alias("root")), "row", "left")
    loose = scratch.keep(loose.select("row", F.coalesce("root", "row").alias("root"), "size"), "loose")
    rest = candidate_pairs(source.select("row", "text"), loose, partial(shingle_set, width=shingle), scratch, similarity=similarity, group_rows=group_rows)
    rest = scratch.keep(rest.select(F.explode(F.array("u", "v")).alias("row"), F.xxhash64("u", "v").alias("key")), "rest")
    named = scratch.keep(rest.select("row").distinct(), "rest-rows")
    n = named.count()
    if n:
        sets = source.select("row", "text").join(F.broadcast(named) if n <= SENT_ROWS else named, "row", "left_semi")
        sets = scratch.keep(sets.mapInArrow(set_batches(shingle), "row long, shingles binary"), "sets")
        links = scratch.keep(links.union(_links(rest.select("key", "row"), sets, similarity)), "links")
        stars = components(links, scratch)

    rooted = distinct.select("same", "row", "first").join(stars.select(F.col("u").alias("row"), F.col("v").alias("root")), "row", "left")
    rooted = scratch.keep(rooted.select("same", F.coalesce("root", "row").alias("root"), "first"), "rooted")
    named = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("first")), "named")
    named = scratch.keep(rooted.select("same", "root").join(named, "root").select("same", "first"), "named")
    return sketches.join(named, "same").select("row", "doc_id", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns."""
    rows, row = with_rows(docs, Scratch(docs.sparkSession, "similar"))
    kept = similar_groups(rows, row_col=row, **options).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
