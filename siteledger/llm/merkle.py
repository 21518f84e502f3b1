"""Merkle manifest of a table: digests travel up a forest of runs, proofs travel down, block by block of nodes."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

FAN = 3  # nodes of a run
LEVELS = 6  # levels that one block of FAN ** LEVELS nodes climbs at a time

Side = tuple[str, str]  # siblings left and right of a node, joined


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], levels: int, fan: int) -> list[list[str]]:
    """The tiers of a block from its nodes up.

    Time-forward: every node sends its digest to its parent through a queue ordered by the label (tier, place) of the receiver,
    so a parent finds the digests of its run at the head of the queue when its turn comes.
    """
    tiers: list[list[str]] = [nodes, *([] for _ in range(levels))]
    queue = [(1, i // fan, i, d) for i, d in enumerate(nodes)] if levels else []  # in order, so it is a heap
    while queue:
        tier, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (tier, place):
            run.append(heapq.heappop(queue)[3])
        own = digest(run)
        tiers[tier].append(own)
        if tier < levels:
            heapq.heappush(queue, (tier + 1, place // fan, place, own))
    return tiers


def descend(tiers: list[list[str]], proof: list[Side], fan: int) -> list[list[Side]]:
    """The proof of each node of the lowest tier, from the proof of the top: the sweep in falling order of labels."""
    out: list[list[Side]] = [[]] * len(tiers[0])
    queue = [(1 - len(tiers), 0, proof)]
    while queue:
        tier, place, proof = heapq.heappop(queue)
        if tier == 0:
            out[place] = proof
            continue
        low = tiers[-tier - 1]
        run = low[fan * place : fan * (place + 1)]
        for i in range(len(run)):
            side = ("".join(run[:i]), "".join(run[i + 1 :]))
            heapq.heappush(queue, (tier + 1, fan * place + i, [side, *proof]))
    return out


def height(n: int, fan: int) -> int:
    """Tiers above ``n`` nodes until one is left."""
    tiers = 0
    while n > 1:
        n, tiers = -(-n // fan), tiers + 1
    return tiers


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows get their task, and their place among the rows of their tree in that task. The tree is the first column."""
    part, last, seen = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        places = []
        for tree in batch.column(0).to_pylist():
            seen = seen + 1 if (tree,) == last else 0
            last = (tree,)
            places.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def place_nodes(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows with ``index``, their place in their ``tree`` by ``order``, and ``n``, the rows of the tree.

    Rows are sorted across the cluster; a tree may span many tasks. What precedes a task in a tree follows from one count per task and tree.
    """
    rows = rows.select("tree", *[c for c in rows.columns if c != "tree"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    numbered = scratch.keep(sorted_rows.mapInArrow(_number, f"{fields}, part int, place long"), "placed")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (F.sum("rows").over(before) - F.col("rows")).alias("base"), F.sum("rows").over(tree).alias("n"))
    joined = numbered.join(counts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("base") + F.col("place")).alias("index"), "n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (tree, block), one block at a time; rows come sorted by both."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, block in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield key, list(block)


TOPS = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def climb_blocks(fan: int, levels: int):
    """The top of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (tree, block), rows in _blocks(batches):
            up = min(levels, height(rows[0]["n"], fan))
            top = climb([r["digest"] for r in rows], up, fan)[-1][0]
            out.append({"tree": tree, "index": block, "n": -(-rows[0]["n"] // fan**up), "digest": top})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, TOPS)
                out = []
        yield pa.RecordBatch.from_pylist(out, TOPS)

    return run


SIDE = pa.struct([("left", pa.string()), ("right", pa.string())])
_PROOF = "array<struct<left:string,right:string>>"
PROVED = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("digest", pa.string()), ("extra", pa.string()), ("top", pa.string()), ("root", pa.string()), ("proof", pa.list_(SIDE))])


def descend_blocks(fan: int, levels: int):
    """The proof of every node of a block; the first row of a block is its top with the proof from there to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _blocks(batches):
            top, nodes = rows[0], rows[1:]
            tiers = climb([r["digest"] for r in nodes], min(levels, height(nodes[0]["n"], fan)), fan)
            proofs = descend(tiers, [(s["left"], s["right"]) for s in top["proof"]], fan)
            sides = [s for p in proofs for s in p]
            offsets = [0]
            for p in proofs:
                offsets.append(offsets[-1] + len(p))
            flat = pa.StructArray.from_arrays([pa.array([s[k] for s in sides], pa.string()) for k in (0, 1)], fields=list(SIDE))
            n = len(nodes)
            columns = [[tree] * n, [r["index"] for r in nodes], [r["digest"] for r in nodes], [r["extra"] for r in nodes], [top["top"]] * n, [top["root"]] * n]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, PROVED)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], schema=PROVED)

    return run


class Forest:
    """Trees over placed nodes (``tree``, ``index``, ``n``, ``digest``, ``extra``), climbed in rounds of some levels.

    A round deals blocks of ``fan ** levels`` neighbours to the tasks, so a tree of any size is spread evenly and no group is larger
    than a block. A round leaves one node per block; rounds end when every tree has one. ``rounds`` keeps the nodes of each round.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, fan: int, levels: int) -> None:
        self.scratch, self.fan, self.levels = scratch, fan, levels
        self._block = F.expr(f"index div {fan**levels}")
        self.rounds = [scratch.keep(nodes, "nodes")]
        most = self.rounds[0].agg(F.max("n")).first()[0] or 1
        while most > 1:
            tops = self._dealt(self.rounds[-1]).mapInArrow(climb_blocks(fan, levels), "tree string, index long, n long, digest string")
            self.rounds.append(scratch.keep(tops.withColumn("extra", F.lit(None).cast("string")), "nodes"))
            most = -(-most // fan**levels)
        self.tops = self.rounds[-1]

    def _dealt(self, nodes: DataFrame, *first: str) -> DataFrame:
        if "block" not in nodes.columns:
            nodes = nodes.withColumn("block", self._block)
        return nodes.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", *first, "index")

    def proofs(self, tops: DataFrame) -> DataFrame:
        """Nodes of the first round with ``proof``, ``top`` and ``root``; ``tops`` holds ``proof``, ``top`` and ``root`` of the last."""
        above = tops.select("tree", F.lit(0).cast("long").alias("index"), "proof", "top", "root")
        for k, nodes in reversed(list(enumerate(self.rounds[:-1]))):
            heads = above.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "proof", "top", "root")
            below = nodes.withColumn("block", self._block)
            both = heads.unionByName(below, allowMissingColumns=True)
            above = self._dealt(both).mapInArrow(
                descend_blocks(self.fan, self.levels), f"tree string, index long, digest string, extra string, top string, root string, proof {_PROOF}"
            )
            if k:
                above = self.scratch.keep(above, "proofs")
        if len(self.rounds) == 1:  # every tree is one node
            above = above.select(F.col("tree").alias("t"), "top", "root", "proof")
            above = self.rounds[0].join(above, F.col("tree").eqNullSafe(F.col("t"))).drop("t")
        return above


def field_text(column: Column) -> Column:
    """A value as the leaf digests it: its length in UTF-8 bytes, a colon, the value; ``-`` for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda own, side: F.sha2(F.concat(side["left"], own, side["right"]).cast("binary"), 256))


def proof_text(proof: Column) -> Column:
    """Siblings from the leaf's run up, left to right."""
    return F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), "")


def dataset_manifest(
    docs: DataFrame,
    *,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree_col: str = "source",
    id_col: str = "doc_id",
    claim: dict[str, Column] | None = None,
    fan: int = FAN,
    levels: int = LEVELS,
) -> DataFrame:
    """A Merkle manifest of the table: a tree of rows per value of ``tree_col``, and a tree of their roots.

    A leaf is the digest of the row's ``fields``. Leaves of a tree ascend by id; every ``fan`` neighbours make one node (the last run may
    be shorter, even one node) until one is left, the subroot. Subroots ascend by ``tree_col`` and make the root in the same way.

    Returns one row per row: ``doc_id``, ``leaf``, ``claimed`` (the leaf with the values of ``claim`` in place of the stored ones; the
    leaf itself without them), ``subroot``, ``root``, ``proof`` (siblings left and right of the path, from the leaf up). A row is
    verified where ``folded(claimed, proof)`` is the root.

    Null fields have a mark of their own. Null ids and a null ``tree_col`` come first; rows of one id come in the order of their leaves,
    so equal rows are interchangeable. An empty table gives an empty manifest; other columns are not read. Blocks of
    ``fan ** levels`` neighbours are dealt to the tasks, whatever tree they belong to.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    stored = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_digest(list(stored.values()))
    claimed = leaf_digest(list((stored | (claim or {})).values())) if claim else leaf
    rows = docs.select(F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("digest"), claimed.alias("claimed"))
    rows = scratch.keep(rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed"))), "leaves")
    placed = place_nodes(rows, ["doc_id", "digest"], scratch)
    extra = F.to_json(F.struct("doc_id", "claimed"))
    trees = Forest(placed.select("tree", "index", "n", "digest", extra.alias("extra")), scratch, fan, levels)

    subroots = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = place_nodes(subroots.withColumn("named", F.to_json(F.struct("source"))), ["source"], scratch)
    top_tree = Forest(subroots.select("tree", "index", "n", "digest", F.col("named").alias("extra")), scratch, fan, levels)
    root = top_tree.tops.select("tree", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("top"), F.col("digest").alias("root"))
    proved = top_tree.proofs(root)
    tops = proved.select(F.from_json("extra", "source string")["source"].alias("tree"), "proof", F.col("digest").alias("top"), "root")
    leaves = trees.proofs(scratch.keep(tops, "tops"))
    own = F.from_json("extra", "doc_id long, claimed string")
    return leaves.select(own["doc_id"].alias("doc_id"), F.col("digest").alias("leaf"), F.coalesce(own["claimed"], "digest").alias("claimed"), F.col("top").alias("subroot"), "root", "proof")
