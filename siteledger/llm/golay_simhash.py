"""Near duplicates by SimHash: Golay indices of fingerprint segments are the join keys, distances are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, shuffle_partitions, slices, with_rows
from .golay import around, nearest
from .graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
WIDTHS = (22, 21, 21)  # bits of the three segments, lowest first
GROUP_ROWS = 4096  # a larger group of one key is compared in tiles
SMALL = 8

PRINTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
FOUND = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

# Spread the bits of a byte over the eight bytes of a word, so that up to 255 of them add up without carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes: a bit is set if more than half of the run has it. Empty runs give zero."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    pieces = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, pieces)
    piece = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first + piece * 255
    lanes = np.stack([np.add.reduceat(_LANES[b], starts) for b in hashes.view(np.uint8).reshape(-1, 8).T], axis=1)
    bits = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[has] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z in lower case; of all words where there are fewer."""
    words = text.encode().lower().split()
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return list(map(xxhash.xxh64_intdigest, runs, repeat(SEED)))


def print_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            hashes: list[np.ndarray] = []
            for text in batch.column(2).to_pylist():
                hashes.append(np.array(shingle_hashes(text or "", width), np.uint64))
            fp = fingerprints(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], schema=PRINTS)

    return run


def segments_of(fp: np.ndarray) -> list[np.ndarray]:
    """The three segments of fingerprints."""
    segments, shift = [], 0
    for width in WIDTHS:
        segments.append((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        shift += width
    return segments


def index_keys(fp: np.ndarray) -> np.ndarray:
    """The Golay indices of the three segments in one number of 36 bits: it stays where turned bits leave every segment nearest to its codeword."""
    low, middle, high = (nearest(s).astype(np.uint64) for s in segments_of(fp))
    return low | middle << np.uint64(12) | high << np.uint64(24)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints, and the position of the fingerprint of each.

    Two fingerprints within three bits differ in the three segments by (0, at most 1, any) in some order, or by (1, 1, 1).
    In the first case one segment is equal and another at most one bit away: its bits and the Golay index of the other are
    a key, for each of the six ordered choices. In the second the three indices are the key. Of two words one bit apart, the
    index of one is among the indices around the other; so of each pair one side, in turn, spreads over its six indices and
    the other gives its own. Either fingerprint takes both parts, and a link is met at least once.
    """
    segments = segments_of(fp)
    own = [nearest(s).astype(np.uint64) for s in segments]
    wide = [around(s, w) for s, w in zip(segments, WIDTHS)]
    everyone = np.arange(len(fp))
    keys, at = [], []

    def add(scheme: int, key: np.ndarray, where: np.ndarray) -> None:
        keys.append(np.uint64(scheme << 40) | key)
        at.append(where)

    scheme = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                index, where = wide[j]
                add(scheme, segments[i][where] << np.uint64(12) | index.astype(np.uint64), where)
                add(scheme, segments[i] << np.uint64(12) | own[j], everyone)
                scheme += 1
    # (1, 1, 1): one side spreads over the outer segments, the other over the middle one.
    low, low_at = wide[0]
    high, high_at = wide[2]
    n_high = np.bincount(high_at, minlength=len(fp))
    each = np.repeat(np.arange(len(low)), n_high[low_at])
    first_high = np.cumsum(n_high) - n_high
    nth = np.arange(len(each)) - np.repeat(np.cumsum(n_high[low_at]) - n_high[low_at], n_high[low_at])
    where = low_at[each]
    outer = high[first_high[where] + nth].astype(np.uint64)
    add(scheme, low[each].astype(np.uint64) | own[1][where] << np.uint64(12) | outer << np.uint64(24), where)
    middle, where = wide[1]
    add(scheme, own[0][where] | middle.astype(np.uint64) << np.uint64(12) | own[2][where] << np.uint64(24), where)
    return np.concatenate(keys), np.concatenate(at)


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(values), 4096):
            part = values[a : a + 4096]
            keys, at = keys_of(part)
            both = np.unique(np.stack([keys, part[at]], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], schema=KEYS)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def tree_links(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one group as their verified distances do: each found member with the first."""
    u, v = [], []
    left = members
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = _near(left, frontier.pop(), distance)
            new = left[near]
            left = left[~near]
            u += [root] * len(new)
            v += new.tolist()
            frontier += new.tolist()
    return np.array(u, np.uint64), np.array(v, np.uint64)


def compare_groups(distance: int, most: int | None):
    """One pass over rows sorted by key and fingerprint: verified links, or the rows themselves of a group above ``most``."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        keys, fps = keys[new], fps[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(keys)))
        member = np.repeat(sizes, sizes)
        small = (member > 1) & (member <= SMALL)
        k, f = keys[small], fps[small]
        for step in range(1, SMALL):
            same = np.flatnonzero(k[step:] == k[:-step])
            near = same[_near(f[same], f[same + step], distance)]
            yield f[near], f[near + step]
        for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            yield tree_links(fps[a : a + n], distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, passing = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if passing is not None:  # rows of a group that is handed on
                n = int(np.searchsorted(keys, passing, "right"))
                yield _handed(keys[:n], fps[:n])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                passing = None
            last = int(np.searchsorted(keys, keys[-1], "left"))
            yield _linked(links(keys[:last], fps[:last]))
            keys, fps = keys[last:], fps[last:]
            if most is not None and len(keys) > most:
                passing = keys[0]
                yield _handed(keys, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield _linked(links(keys, fps))

    return run


def _linked(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pairs = list(found)
    u, v = (np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in pairs)]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], schema=FOUND)


def _handed(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.nulls(len(keys), pa.int64())], schema=FOUND)


def fingerprint_links(prints: DataFrame, scratch: Scratch, *, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints that connect exactly those that chains of verified links connect.

    A key with more than ``group_rows`` fingerprints is dealt out again in tiles: every pair of tiles is a group of its own,
    so no task holds more than about that many, and every pair is still compared.
    """
    n = shuffle_partitions(prints.sparkSession)
    keys = prints.mapInArrow(key_batches, "key long, fp long")
    found = keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(compare_groups(distance, group_rows), "key long, u long, v long")
    found = scratch.keep(found, "found")
    links = found.filter("key is null").select("u", "v")
    handed = found.filter("key is not null").select("key", F.col("u").alias("fp"))
    if not handed.isEmpty():
        sizes = scratch.keep(handed.groupBy("key").agg(F.ceil(F.count("*") * 2 / group_rows).cast("int").alias("tiles")), "tiles")
        dealt = handed.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        # Hash of the tile pair as key: a collision only makes a group larger, as every link is verified.
        pair = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
        dealt = dealt.select(pair.alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
        links = links.union(dealt.mapInArrow(compare_groups(distance, None), "key long, u long, v long").select("u", "v"))
    return links


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shingle: int = SHINGLE, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Fingerprint and component of every row: ``row``, ``doc_id``, ``fp`` (signed), ``component_id``, ``kept``.

    Fingerprints link at three or fewer differing bits; a component is what chains of links reach, and is named by its
    smallest id. Null text is empty; texts without words have fingerprint zero, which links like any other. Repeated ids and
    rows are kept apart; a null id only names a component in which every id is null. ``kept`` marks the row with the
    smallest id (null last), then row, of each component. Copies collapse to one fingerprint before anything is joined.
    """
    scratch = Scratch(docs.sparkSession, "golay-simhash")
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.monotonically_increasing_id()
    source = columns(docs, id_col, text_col, *([row_col] if row_col else []))
    source = source.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = scratch.keep(source.mapInArrow(print_batches(shingle), "row long, doc_id long, fp long"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    distinct = scratch.keep(prints.groupBy("fp").agg(first), "distinct")
    stars = components(fingerprint_links(distinct.select("fp"), scratch, group_rows=group_rows), scratch)
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = scratch.keep(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    named = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("first")), "named")
    named = scratch.keep(rooted.select("fp", "root").join(named, "root").select("fp", "first"), "named")
    return prints.join(named, "fp").select("row", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns."""
    rows, row = with_rows(docs, Scratch(docs.sparkSession, "near-dedup"))
    kept = near_groups(rows, id_col=id_col, text_col=text_col, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
