"""Near copies against brute force over all pairs of texts."""

import importlib.util
import random

import numpy as np
import pytest

from siteledger.llm import similar_texts
from siteledger.llm.golay import nearest
from siteledger.llm.golay_simhash import WIDTHS, index_keys
from siteledger.llm.similar_texts import drop_similar, similar_groups


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return len(a & b) / len(a | b)


def at_similarity(rng, wanted):
    """A text, and a copy edited word by word until just before the similarity would fall below."""
    own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
    copy = own
    while True:
        other = copy[:]
        other[rng.randrange(len(other))] = f"x{rng.randrange(10**9)}"
        if similar(shingles(" ".join(own)), shingles(" ".join(other))) < wanted:
            return " ".join(own), " ".join(copy)
        copy = other


@pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="no pipeline")
def test_recall_of_the_stage(spark, table):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rng = random.Random(3)
    wanted = [s for s in (0.8, 0.9, 0.95) for _ in range(100)]
    pairs = [at_similarity(rng, s) for s in wanted]
    kept = {r.doc_id for r in stage(spark, table([t for p in pairs for t in p]), "").collect()}
    for s in (0.8, 0.9, 0.95):
        assert sum(2 * i + 1 not in kept for i, w in enumerate(wanted) if w == s) >= 98
    assert all(2 * i in kept for i in range(len(pairs)))


@pytest.mark.parametrize("group_rows", [4, 512])
def test_groups_match_brute_force(table, group_rows):
    """With a small limit the hot groups go through chunks and tiles; texts just below the limit stay apart."""
    rng = random.Random(5)
    texts = [None, "", " \n", "short", "SHORT", "a b c d e", "a b c d f"]
    for n in (60, 200):
        own = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(25):
            other = own[:]
            for _ in range(rng.randint(0, n // 25)):
                other[rng.randrange(n)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, "short"), (3, "short")]
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = similar_groups(table(rows, clash=True).coalesce(1), group_rows=group_rows).orderBy("row").collect()
    for i, r in enumerate(got):
        assert r.component_id == min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None)
    assert sum(r.kept for r in got) == len(set(label)) < len(rows)


def test_columns_and_empty_table(table):
    df = table(["a b c d", "A B c d", "other words here"], clash=True)
    kept = drop_similar(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert similar_groups(table([])).count() == 0


def test_keys_are_golay_indices_of_fingerprints(monkeypatch):
    """The key of a fingerprint holds the codewords nearest to its segments, so it stays when a bit turns within their reach."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 4, 300)]
    prints = similar_texts.sample_prints(sets)
    keys = similar_texts.golay_keys(sets)
    assert prints.shape == keys.shape == (3, similar_texts.PRINTS)
    kept = 0
    for fp, key in zip(prints.ravel().tolist(), keys.ravel().tolist()):
        parts, at = [], 0
        for width in WIDTHS:
            parts.append(int(nearest(np.array([fp >> at & (1 << width) - 1]))[0]))
            at += width
        assert key & (1 << 36) - 1 == parts[0] | parts[1] << 12 | parts[2] << 24
        kept += sum(int(index_keys(np.array([fp ^ 1 << b], np.uint64))[0]) == key & (1 << 36) - 1 for b in range(64))
    assert kept > 0
    # Each bit of a fingerprint is the majority of its sample's.
    seen = []
    monkeypatch.setattr(similar_texts, "fingerprints", lambda hashes, counts: seen.append((hashes, counts)) or np.zeros(len(counts), np.uint64))
    similar_texts.sample_prints(sets)
    votes = (seen[0][0].reshape(-1, similar_texts.SAMPLE)[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=1)
    assert np.array_equal(prints.ravel(), ((2 * votes > similar_texts.SAMPLE).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1))


def golay_misses(rng, similarity=0.8):
    """A pair of just that similarity that shares no key of its fingerprints."""
    while True:
        own = [f"w{rng.randrange(5000)}" for _ in range(150)]
        pair = at_similarity_of(own, rng, similarity)
        a, b = (similar_texts.golay_keys([similar_texts.shingle_set(t)])[0] for t in pair)
        if not set(a.tolist()) & set(b.tolist()):
            return pair


def at_similarity_of(own, rng, wanted):
    copy = own
    while True:
        other = copy[:]
        other[rng.randrange(len(other))] = f"x{rng.randrange(10**9)}"
        if similar(shingles(" ".join(own)), shingles(" ".join(other))) < wanted:
            return " ".join(own), " ".join(copy)
        copy = other


def test_links_that_fingerprints_miss(table):
    """Similar texts without a common fingerprint key are one group all the same."""
    rng = random.Random(8)
    texts = [t for _ in range(3) for t in golay_misses(rng)] + ["some other words of a text that is alone here"]
    kept = {r.doc_id for r in drop_similar(table(texts)).collect()}
    assert kept == {0, 2, 4, 6}


@pytest.mark.parametrize("group_rows", [3, 512])
def test_prefixes_alone_find_every_link(table, monkeypatch, group_rows):
    """Without any fingerprint key, with frequent elements and in tiles, groups are those of brute force."""
    from siteledger.llm import set_prefixes

    monkeypatch.setattr(similar_texts, "index_keys", lambda fp: np.arange(fp.size, dtype=np.uint64).reshape(fp.shape) + np.uint64(hash(fp.tobytes()) & 0xFFFFFF) * np.uint64(4096))
    monkeypatch.setattr(set_prefixes, "COMMON_ROWS", 4)
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [None, "", "short", "a b c d e", "a b c d f"]
    for n in (12, 40, 90):
        for _ in range(5):
            own = [f"w{rng.randrange(3000)}" for _ in range(n)]
            for _ in range(6):
                other = own[:]
                for _ in range(rng.randint(0, max(1, n // 20))):
                    other[rng.randrange(n)] = f"x{rng.randrange(10**9)}"
                texts.append(" ".join(other) + (" " + common if rng.random() < 0.5 else ""))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r.doc_id: r.component_id for r in similar_groups(table(texts), group_rows=group_rows).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(label)


def test_rows_of_shared_keys_over_batches():
    """Rows whose key is shared, wherever the batches are cut."""
    import pyarrow as pa

    from siteledger.llm.set_prefixes import KEYS, shared_batches

    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size], pa.int64()), pa.array(range(a, min(a + size, 10)), pa.int64())], schema=KEYS) for a in range(0, 10, size)]
        assert [r for b in shared_batches(iter(batches)) for r in b.column(1).to_pylist()] == [1, 2, 4, 5, 6, 8, 9]
