import random

import numpy as np
import pytest

from siteledger.llm.repetition import longest_matches, repetition_rules


def brute(text, least=8):
    words = (text or "").encode().split()
    n = len(words)
    match = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            match[i] = max(match[i], k)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = {p for i in range(n) if match[i] >= 3 for p in range(i, i + 3)}
    inside = sorted({p for i in range(n) if match[i] >= least for p in range(i, i + match[i])})
    spans = []
    for p in inside:
        if spans and spans[-1][1] == p:
            spans[-1][1] = p + 1
        else:
            spans.append([p, p + 1])
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(windows), len(inside), max(match, default=0), spans)


def test_matches_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 30, 4)
        words, text = rng.integers(0, 3, sizes.sum()), np.repeat(np.arange(4), sizes)
        want = []
        for d in range(4):
            own = words[text == d].tolist()
            want += [max((next(k for k in range(len(own) + 1) if max(i, j) + k == len(own) or own[i + k] != own[j + k]) for j in range(len(own)) if j != i), default=0) for i in range(len(own))]
        assert longest_matches(words.astype(np.int64), text).tolist() == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    few = [f"w{i}" for i in range(4)]
    many = [f"w{i}" for i in range(300)]
    out = [None, "", " \n\t", "a", "# * $ %% & | < > é", "one line\n\none line\n one line", "a a a a a a a a a a a a"]
    out += [" ".join(rng.choices(few, k=rng.randint(1, 60))) for _ in range(30)]
    out += [" ".join(rng.choices(many, k=120)) for _ in range(10)]
    block = " ".join(rng.choices(many, k=40))
    return out + [f"{out[-1]} {block} {out[-2]} {block}", " ".join(rng.choices(many, k=300) + block.split() * 3), f"{block}\n{block}"]


def test_measures_and_spans(spark, table, texts):
    rows = {r.doc_id: r for r in repetition_rules(table(texts, clash=True)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words, r.longest_repeat, [[s.start, s.end] for s in r.spans])
        assert got == brute(t), (i, t)
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert r.base_failed == failed and r.kept == (not failed and 100 * got[5] <= 30 * got[0] and got[6] <= 100)


def test_verdicts(spark, table):
    rng = random.Random(6)
    clean = " ".join(f"v{rng.randrange(5000)}" for _ in range(600))
    half = clean.split()[:150]
    long_repeat = " ".join(half + clean.split()[200:] + half)
    rows = {r.doc_id: r for r in repetition_rules(table([clean, long_repeat, "spam and eggs " * 60, "too short"])).collect()}
    assert [rows[i].kept for i in range(4)] == [True, False, False, False]
    assert [rows[i].base_failed for i in range(4)] == [False, False, True, True]


def test_long_and_repeated_and_no_rows(spark, table):
    rows = [(1, "ab " * 100_000), (1, "ab " * 100_000), (None, "x y z")]
    got = repetition_rules(table(rows)).collect()
    assert sorted(r.longest_repeat for r in got) == [0, 99_999, 99_999]
    assert repetition_rules(table([])).count() == 0
