import random
from collections import Counter

from siteledger.llm.mixing import mix_sources, repeat_documents


def targets(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(full.values()), sum(weight[n] for n in names if n not in full)
        new = {n: 3 * sizes[n] for n in names if n not in full and rest * weight[n] / w > 3 * sizes[n]}
        if not new:
            return {n: full.get(n, rest * weight[n] / w if w else 0) for n in names}
        full |= new


def rows_of(counts, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randint(0, 60)), "en", s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]


def test_targets_caps_and_closeness(spark, table):
    rows = rows_of({"b": 400, "a": 20, "c": 100, None: 60, "Z": 3, "é": 50})
    got = mix_sources(table(rows, clash=True)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-3
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_bins_do_not_change_the_draw(spark, table):
    rows = rows_of({"a": 200, "b": 50, "c": 30})
    draws = [{(r.doc_id, r.copies) for r in mix_sources(table(rows), bins=b).collect()} for b in (1, 7, 4096)]
    assert draws[0] == draws[1] == draws[2]


def test_short_documents_have_better_odds(spark, table):
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 80)), "en", "abc"[i % 3]) for i in range(1200)]
    got = [r for r in mix_sources(table(rows)).collect() if r.source == "c"]
    share = {n: sum(r.copies for r in got if r.size == n) / sum(r.size == n for r in got) for n in (5, 80)}
    assert share[5] > share[80]


def test_odd_rows(spark, table):
    odd = [(1, None, None, None), (None, "a b", None, "s"), (2, "", None, "s"), (3, "x", None, "t"), (3, "x", None, "t")]
    assert mix_sources(table(odd)).count() == 5
    assert mix_sources(table([])).count() == 0
    assert {r.taken for r in mix_sources(table([(1, None), (2, "")])).collect()} == {0}


def test_mix_repeats_whole_rows(spark, table):
    df = table(rows_of({"a": 60, "b": 300, "c": 90}), clash=True)
    copies = {r.doc_id: r.copies for r in mix_sources(df).collect()}
    out = repeat_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
