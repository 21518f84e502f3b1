import hashlib

import pytest
from pyspark.sql import functions as F

from siteledger.llm.merkle import climb, dataset_manifest, descend, folded, height, proof_text


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def text_of(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tiers_of(nodes, fan):
    tiers = [nodes]
    while len(tiers[-1]) > 1:
        tiers.append([H(*tiers[-1][i : i + fan]) for i in range(0, len(tiers[-1]), fan)])
    return tiers


def path(tiers, i, fan):
    out = []
    for tier in tiers[:-1]:
        k = i // fan * fan
        out.append(("".join(tier[k:i]), "".join(tier[i + 1 : k + fan])))
        i //= fan
    return out


def brute(rows, fan):
    leaves = [(*r, H(*(text_of(r[k]) for k in (0, 3, 2, 4, 1)))) for r in rows]
    trees = {}
    for r in sorted(leaves, key=lambda r: (r[0] is not None, r[0] or 0, r[5])):
        trees.setdefault(r[3], []).append(r)
    tiers = {s: tiers_of([r[5] for r in t], fan) for s, t in trees.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    crown = tiers_of([tiers[s][-1][0] for s in order], fan)
    return sorted(
        (str(r[0]), r[5], tiers[s][-1][0], crown[-1][0], "".join(a + b for a, b in path(tiers[s], i, fan) + path(crown, order.index(s), fan)))
        for s, t in trees.items()
        for i, r in enumerate(t)
    )


def rows_of(n, sources=4):
    rows = [(i * 7 % 1000, f"text é {i}\nline", "xx" if i % 5 else None, "hot" if i % 2 else f"s{i % sources}", i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x", None, None, None), (3, "", "", "", 0), (3, "", "", "", 0), (4, "twice", "a", "é", 1), (4, "thrice", "a", "é", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("fan,levels", [(3, 6), (3, 1), (2, 2), (5, 3)])
def test_manifest(spark, fan, levels):
    rows = rows_of(150)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as tree", "'x' as digest", "1 as n", "'x' as root", "'x' as block").repartition(5)
    out = dataset_manifest(df, fan=fan, levels=levels).withColumn("p", proof_text(F.col("proof")))
    got = out.withColumn("f", folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in got) == brute(rows, fan)
    assert all(r.f == r.root and r.claimed == r.leaf for r in got)


def test_claims(spark):
    """A changed value is found, a claim that changes nothing is not."""
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    out = dataset_manifest(df, claim={"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    out = out.withColumn("ok", folded(F.col("claimed"), F.col("proof")) == F.col("root")).collect()
    changed = {r[0] for r in rows_of(60) if r[0] is not None and r[0] % 2 == 0 and "\n" in (r[1] or "")}
    assert all(r.ok == (r.doc_id not in changed) for r in out if r.doc_id != 4)
    assert {r.ok for r in out} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", "x", "s", 1)], [(None, None, None, None, None)], [(1, "a", "x", "s", 1), (2, "b", "x", "t", 1)], [(1, "a" * 3_000_000, "x", "s", 1), (2, "b", "x", "s", 1)]])
def test_small_tables(spark, rows):
    out = dataset_manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("p", proof_text(F.col("proof"))).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in out) == (brute(rows, 3) if rows else [])


def test_queue_in_a_block():
    for n in (1, 2, 3, 4, 9, 10, 27, 28):
        nodes = [f"n{i}" for i in range(n)]
        up = height(n, 3)
        tiers = climb(nodes, up, 3)
        assert tiers == tiers_of(nodes, 3)
        assert descend(tiers, [("l", "r")], 3) == [[*path(tiers, i, 3), ("l", "r")] for i in range(n)]
