import random
import zlib

import numpy as np

from siteledger.llm.hyper_language import DIMENSIONS, Trigrams, _vector, identify_languages, keep_known_languages

SYLLABLES = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["eau", "oi", "que", "ç"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def brute_bundle(text):
    runs, letters = [0], [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    for c in letters[1:]:
        if c or runs[-1]:
            runs.append(c)
    out = np.zeros(DIMENSIONS)
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        out += np.roll(_vector(a), 2).astype(int) * np.roll(_vector(b), 1) * _vector(c)
    return out


def test_bundles_match_brute_force():
    texts = ["Hello, World!", "", "1 2 3", "ÀÇß x  y", "漢字 mixed", "a"]
    got = np.concatenate(list(Trigrams(texts).text_bundles()))
    for t, g in zip(texts, got):
        assert np.array_equal(g, brute_bundle(t)), t


def test_held_out_accuracy_and_inputs(spark, table):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, 40), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    got = {r.doc_id: r for r in identify_languages(table(rows, clash=True)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows are not looked at.
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    assert {(r.doc_id, r.lang_pred) for r in identify_languages(table(other)).collect()} == {(r.doc_id, r.lang_pred) for r in got.values()}


def test_odd_rows(spark, table):
    rng = random.Random(2)
    good = [(i, sentence(rng, "aa", 30), "aa", "s") for i in range(9)]
    odd = [(100, None, "aa", None), (101, "", None, None), (102, "123 !!", "bb", None), (None, "kati moru", None, None), (103, "x" * 300_000, None, None), (103, "ka ti", None, None)]
    got = [(r.doc_id, r.lang_pred) for r in identify_languages(table(good + odd)).collect()]
    assert {d for d, lang in got if lang == "und"} >= {100, 101, 102} and (None, "aa") in got and len(got) == 15
    assert identify_languages(table([])).count() == 0
    assert {r.lang_pred for r in identify_languages(table([(1, "abc", None, None)])).collect()} == {"und"}
    df = table(good + odd, clash=True)
    kept = keep_known_languages(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8, 103, 103]
