import random

import numpy as np
import pytest
import xxhash

from siteledger.llm.common import Scratch
from siteledger.llm.golay import around, nearest
from siteledger.llm.golay_simhash import drop_near_copies, fingerprint_links, fingerprints, keys_of, near_groups, shingle_hashes
from siteledger.llm.graph import components


def reach(fps, distance=3):
    """Smallest member that chains of links reach, by brute force."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def brute_print(text):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    for w, index in zip(words, nearest(words)):
        # Turning up to two bits of a codeword does not change its index.
        assert 0 <= index < 4096
    code, at = around(words, 23)
    assert np.bincount(at).min() >= 1 and np.bincount(at).max() <= 6
    for bit in range(23):
        other = nearest(words ^ np.uint32(1 << bit))
        held = {(int(a), int(c)) for a, c in zip(at, code)}
        assert all((i, int(c)) in held for i, c in enumerate(other))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_keys_meet_within_three_bits(bits):
    rng = random.Random(bits)
    a = [rng.getrandbits(64) for _ in range(1500)]
    b = [x ^ sum(1 << p for p in rng.sample(range(64), bits)) for x in a]
    sets = []
    for values in (a, b):
        keys, at = keys_of(np.array(values, np.uint64))
        own = [set() for _ in values]
        for k, i in zip(keys.tolist(), at.tolist()):
            own[i].add(k)
        sets.append(own)
    assert all(x & y for x, y in zip(*sets))


def test_fingerprint_bits():
    texts = ["", "one", "A b C", "x y z " * 400, "lorem ipsum dolor sit amet " * 3]
    hashes = [shingle_hashes(t) for t in texts]
    got = fingerprints(np.array([h for hs in hashes for h in hs], np.uint64), np.array([len(h) for h in hashes]))
    assert got.tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_links_connect_what_distances_connect(spark, group_rows):
    """With a small limit the large groups of a cluster go through tiles."""
    rng = random.Random(9)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        chain = centre
        for _ in range(25):
            fps.append(centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 3))))
            chain ^= sum(1 << p for p in rng.sample(range(64), 3))
            fps.append(chain)
    fps = sorted(set(fps + [0, 1, 3]))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    scratch = Scratch(spark, "test")
    stars = {r.u: r.v for r in components(fingerprint_links(df, scratch, group_rows=group_rows), scratch).collect()}
    root = [stars.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in fps]
    want = reach(fps)
    assert all((root[i] == root[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(len(fps)))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 800)]
    stars = {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()}
    assert stars == {i: 0 for i in range(1, 201)} | {501: 500, 900: 800}


def test_groups_match_brute_force(spark, table):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        own = rng.choices(words, k=300)
        texts.append(" ".join(own))
        for _ in range(3):
            other = own[:]
            other[rng.randrange(300)] = "changed"
            texts.append(" ".join(other).upper())
    rows = [(i * 3, t) for i, t in enumerate([None, "", " \n", *texts, texts[0], "short", "SHORT"])] + [(None, texts[5]), (3, "short"), (3, "short")]
    got = near_groups(table(rows, clash=True).coalesce(1)).orderBy("row").collect()
    fps = [brute_print(t) for _, t in rows]
    assert [r.fp % (1 << 64) for r in got] == fps
    label = reach(fps)
    for i, r in enumerate(got):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        assert r.component_id == min(ids)
    assert sum(r.kept for r in got) == len(set(label))


def test_dedup_and_empty_table(spark, table):
    df = table(["a b c d", "a b c d", "A B c d", "other words here"], clash=True)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3]
    assert near_groups(table([])).count() == 0
