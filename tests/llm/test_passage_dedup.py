import random
import resource

import numpy as np
import pytest

from siteledger.llm import word_prefixes
from siteledger.llm.passage_dedup import SuffixTree, join_spans, remove_passages
from siteledger.llm.word_prefixes import sampled, word_hashes, words_of

LENGTH = 20


def brute(rows, length=LENGTH):
    """Kept words and number of runs of each row, in order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = b" ".join(w for w, g in zip(words, gone) if not g).decode(), len(words), runs
    return [out[i] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(500)] + [" ", "x y", "\x1c"]
    text = lambda n: rng.choice([" ", "\n", " \t"]).join(rng.choices(words, k=n))
    passage = text(60)
    out = [(i, text(rng.randint(1, 120))) for i in range(25)]
    out += [(100 + i, f"{text(30)} {passage} {text(30)}") for i in range(40)]
    out += [(200, out[3][1]), (3, out[3][1]), (None, passage), (None, None), (300, ""), (301, "a b " * 90), (302, "x " * 19), (303, "x " * 20), (304, "x " * 21), (305, " \n "), (306, text(9000))]
    near = passage.split()
    near[25] = "changed"
    return out + [(400, " ".join(near)), (400, "\n".join(near)), (401, " ".join(passage.split()[:33])), (402, " ".join(passage.split()[-21:])), (403, "y" * 5000 + " " + passage)]


@pytest.mark.parametrize("group", [2, 60, 16_384])
def test_words_left(spark, table, rows, group):
    """Whether groups stay small, are split by longer prefixes, or end as whole windows."""
    got = remove_passages(table(rows, clash=True).coalesce(1), group=group).orderBy("row").collect()
    assert [(r.kept, r.n_words, len(r.spans)) for r in got] == brute(rows)
    assert all(r.n_words == len(r.kept.split(" ") if r.kept else []) + sum(s.end - s.start for s in r.spans) for r in got)


def test_partitions_do_not_matter(spark, table, rows):
    plain = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    want = dict(zip((r[0] for r in plain), brute(plain)))
    got = remove_passages(table(plain).repartition(7)).collect()
    assert {r.doc_id: (r.kept, r.n_words, len(r.spans)) for r in got} == want


@pytest.mark.parametrize("length,prefixes", [(5, (2, 3)), (8, (3,)), (50, (10, 20, 40))])
def test_other_lengths(spark, table, rows, length, prefixes):
    got = remove_passages(table(rows).coalesce(1), length=length, prefixes=prefixes, group=30).orderBy("row").collect()
    assert [(r.kept, r.n_words, len(r.spans)) for r in got] == brute(rows, length)


def test_empty_table_and_names(spark, table):
    before = len(spark.catalog.listTables())
    assert remove_passages(table([])).count() == 0 and remove_passages(table([(1, None), (None, "")])).count() == 2
    assert len(spark.catalog.listTables()) == before
    with pytest.raises(ValueError, match="prefixes"):
        remove_passages(table([]), prefixes=(8, 20))


def test_tree_nodes():
    rng = np.random.default_rng(0)
    suffixes = rng.integers(1, 3, (300, 6)).astype(np.uint32)
    tree = SuffixTree(suffixes)
    ordered = [tuple(x) for x in suffixes[tree.leaves].tolist()]
    assert ordered == sorted(map(tuple, suffixes.tolist()))
    for depth in range(1, 7):
        want = {}
        for i, s in enumerate(ordered):
            want.setdefault(s[:depth], []).append(i)
        assert [(a, b) for a, b in zip(*(x.tolist() for x in tree.deep_nodes(depth)))] == [(w[0], w[-1]) for w in want.values() if len(w) > 1]


def test_join_spans():
    rng = random.Random(1)
    spans = [(rng.randrange(4), a := rng.randrange(60), a + rng.randint(1, 5)) for _ in range(40)]
    got = [np.array(x) for x in zip(*spans)]
    covered = {(r, i) for r, a, b in spans for i in range(a, b)}
    joined = list(zip(*(x.tolist() for x in join_spans(*got))))
    assert {(r, i) for r, a, b in joined for i in range(a, b)} == covered
    assert all((r, b) not in covered and (r, a - 1) not in covered for r, a, b in joined)


def test_blocks_and_memory(monkeypatch):
    """Suffixes of a block border are the same windows; a text of 30 MB needs few times its size."""
    raw = np.frombuffer(b" ".join(b"%d" % x for x in np.random.default_rng(1).integers(0, 300, 5000)), np.uint8)
    bounds = np.array([0, 0, 700, 9000, len(raw)])
    begin, end, of_text = words_of(raw, bounds)
    hashes = word_hashes(raw, begin, end)
    whole = sampled(hashes, of_text, LENGTH, 8)
    monkeypatch.setattr(word_prefixes, "BLOCK_WORDS", 300)
    parts = sampled(hashes, of_text, LENGTH, 8)
    flat = lambda x: sorted((s, k) for a, b, k in zip(*(v.tolist() for v in x[:3])) for s in range(a, b + 1))
    n = np.diff(of_text)
    assert flat(whole) == flat(parts) and len(flat(whole)) == (n[n >= LENGTH] - LENGTH + 1).sum()
    monkeypatch.undo()
    big = np.tile(raw, 30_000_000 // len(raw))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    begin, end, of_text = words_of(big, np.array([0, len(big)]))
    sampled(word_hashes(big, begin, end), of_text, LENGTH, 8)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900 << 10
