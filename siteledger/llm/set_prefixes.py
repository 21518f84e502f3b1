"""Pairs of sets that may reach a similarity, none left out: similar sets share elements of their prefixes, and how many is bounded from below.

Elements have one order for all sets, frequent ones last, then by hash. Of a set of n the prefix are the first n - ceil(similarity * n) + 1. Two
sets of at least that similarity share an element of their prefixes. Of the two, an element of the prefix that ends first is in the other set
only if it is in its prefix; so what the prefixes do not share there is missing from the overlap. The least number to be shared follows from the sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, slices

COMMON_ROWS = 8  # sets that share an element before it counts as frequent
FREQUENT = 200_000  # most frequent elements, sent to every worker; they only decide the order
MARGIN = 1.5  # elements counted for that, in prefixes by hash alone
PAIR_ROWS = 1 << 20  # pairs added up in a task before they are passed on
SLACK = 1e-6  # keeps rounding from shortening a prefix or raising a bound

HASHES = pa.schema([("key", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("row", pa.int64())])
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("least", pa.int64()), ("n", pa.int64())])

Sets = Callable[[str | None], np.ndarray]


def prefix_size(n: int, similarity: float) -> int:
    return min(n, n - int(np.ceil(similarity * n - SLACK)) + 1) if n else 0


def least_shared(a: int, b: np.ndarray, similarity: float) -> np.ndarray:
    """Elements that prefixes of sets of ``a`` and of ``b`` (no fewer) elements share at least if the sets are similar."""
    overlap = np.ceil(similarity * (a + b) / (1 + similarity) - SLACK)
    return np.maximum(1, overlap - np.ceil(similarity * b - SLACK) + 1).astype(np.int64)


def least_batches(sets: Sets, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s[: int(MARGIN * prefix_size(len(s), similarity))] for s in map(sets, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], schema=HASHES)

    return run


def prefix(own: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set of sorted hashes; ``frequent`` is sorted too."""
    n = prefix_size(len(own), similarity)
    if not len(frequent) or not n:
        return own[:n]
    common = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    return np.concatenate([own[~common], own[common]])[:n]


def prefix_batches(sets: Sets, frequent: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [prefix(s, frequent, similarity) for s in map(sets, batch.column(1).to_pylist())]
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(rows)], schema=KEYS)

    return run


def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key is not theirs alone; no group is held."""
    last, paired = np.zeros((0, 2), np.int64), False  # the row before, and whether it shares its key with one before it
    for batch in batches:
        rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        equal = rows[1:, 0] == rows[:-1, 0]
        before = np.concatenate([[paired], equal])
        found = rows[:-1][before[:-1] | equal]
        last, paired = rows[-1:], bool(before[-1])
        yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in (0, 1)], schema=KEYS)
    if paired:
        yield pa.RecordBatch.from_arrays([pa.array(last[:, i].copy()) for i in (0, 1)], schema=KEYS)


def pair_batches(similarity: float):
    """One pass over (key, tiles, row, root, size, keys, tile) sorted by key and tiles: pairs of unlike roots, with the keys they must share and do.

    Pairs whose sizes do not allow the similarity are left out, and those of which one side shares fewer keys with anyone. Rows of two tiles meet across the tiles only; each tile meets itself in a group of its own.
    """

    def pairs(group: np.ndarray) -> np.ndarray:
        group = group[np.argsort(group[:, 2], kind="stable")]
        row, root, size, shared, tile = group.T
        crossed = tile.min() != tile.max()
        out = [np.zeros((0, 3), np.int64)]
        ends = np.searchsorted(size, size / similarity + SLACK, "right")
        for i, end in enumerate(ends.tolist()):
            least = least_shared(size[i], size[i + 1 : end], similarity)
            fits = (root[i + 1 : end] != root[i]) & (np.minimum(shared[i], shared[i + 1 : end]) >= least)
            if crossed:
                fits &= tile[i + 1 : end] != tile[i]
            other = row[i + 1 : end][fits]
            out.append(np.stack([np.minimum(other, row[i]), np.maximum(other, row[i]), least[fits]], axis=1))
        return np.concatenate(out)

    def added(found: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
        flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([*(pa.array(flat[at, i]) for i in range(3)), pa.array(np.diff(np.append(at, len(flat))))], schema=PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, n = np.zeros((0, 7), np.int64), [], 0
        for batch in batches:
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, int)
            for a, b in zip(starts, starts[1:]):
                found.append(pairs(rows[a:b, 2:]))
                n += len(found[-1])
                if n > PAIR_ROWS:
                    yield added(found)
                    found, n = [], 0
            rows = rows[starts[-1] :] if len(starts) else rows
        if len(rows):
            found.append(pairs(rows[:, 2:]))
        yield added(found)

    return run


def candidate_pairs(texts: DataFrame, rooted: DataFrame, sets: Sets, scratch: Scratch, *, similarity: float, group_rows: int) -> DataFrame:
    """Pairs ``u``, ``v`` that hold every two sets of at least the similarity whose roots differ, and few others.

    ``texts`` is (row, text), ``rooted`` (row, root, size) of the rows to compare; ``sets`` gives the sorted hashes of a text. A key of more than
    ``group_rows`` rows is dealt out in tiles.
    """
    n = shuffle_partitions(texts.sparkSession)
    counted = texts.mapInArrow(least_batches(sets, similarity), "key long").groupBy("key").agg(F.count("*").alias("n"))
    common = counted.filter(F.col("n") > COMMON_ROWS).orderBy(F.col("n").desc(), "key").limit(FREQUENT).select("key").collect()
    frequent = np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64))
    keys = texts.mapInArrow(prefix_batches(sets, frequent, similarity), "key long, row long")
    shared = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(shared_batches, "key long, row long")
    members = scratch.keep(scratch.keep(shared, "shared").join(rooted, "row"), "prefix-members")
    groups = members.groupBy("key").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("tiles"), F.min("root").alias("low"), F.max("root").alias("high"))
    members = scratch.keep(members.join(groups.filter("low < high").select("key", "tiles"), "key"), "prefix-members")
    dealt = members.join(members.groupBy("row").agg(F.count("*").alias("keys")), "row")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other")
    dealt = dealt.select("key", both.alias("both"), "row", "root", "size", "keys", "tile").repartition(n, "key", "both").sortWithinPartitions("key", "both")
    pairs = dealt.mapInArrow(pair_batches(similarity), "u long, v long, least long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return pairs.filter("n >= least").select("u", "v")
