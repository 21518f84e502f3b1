import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siteledger.llm import token_alignment
from siteledger.llm.pair_bitmaps import FULL, POSTINGS, either, pack, places, plane_weight, popcount, postings
from siteledger.llm.token_alignment import align_corpus


def brute(texts):
    """Links of each text as (A id, B id), one by one over byte offsets, and the groups' text."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(table[c] for c in a_model.id_to_token(i))) for i in a_model.encode(want.decode(), add_special_tokens=False).ids]
        b = []
        for i in b_model.encode(text or ""):
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            out.append((0, 0, [], ""))
            continue
        byte_a = [k for k, (_, x) in enumerate(a) for _ in x]
        byte_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(byte_a, byte_b)))
        groups, at, end = [([], [])], [0, 0], 0
        stops = {x for x in range(1, len(want) + 1) if (x == len(want) or byte_a[x] != byte_a[x - 1]) and (x == len(want) or byte_b[x] != byte_b[x - 1])}
        for side, ids in enumerate((a, b)):
            end, g = 0, 0
            for i, x in ids:
                while len(groups) <= g:
                    groups.append(([], []))
                groups[g][side].append(str(i))
                end += len(x)
                g += end in stops
        out.append((len(a), len(b), [(a[i][0], b[j][0]) for i, j in links], ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)))
    return out


def expected(rows):
    each = brute([r[1] for r in rows])
    total = Counter(x for e in each for x in e[2])
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, *_), (n_a, n_b, links, text) in zip(rows, each):
        n_groups = text.count(";") + 1 if text else 0
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, total, each


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdehilnorstu", k=rng.randint(1, 11))) for _ in range(300)] + ["don't", "x y", "été", "中文", "12345", "<|endoftext|>", "</s>", "\U0001f600", "á"]
    text = lambda n, s=" ": s.join(rng.choices(words, k=n))
    out = [(i, text(rng.randint(1, 80))) for i in range(40)]
    out += [(50, None), (51, ""), (52, " "), (53, "  two  spaces "), (54, "line\n next\n\nlines \t tab"), (55, "a ▁ b"), (56, "▁"), (57, "tail\n"), (58, "　 wide 　"), (59, "nul \0 end")]
    out += [(60, text(200, "\n")), (61, text(100, "  ")), (62, out[3][1]), (3, out[3][1]), (None, text(9)), (63, "word " * 700), (64, text(6000)), (65, "z" * 3000), (66, "<s> x <unk>"), (67, "\x1c a \x85 b")]
    return out


def test_documents_and_pairs(spark, table, rows):
    want, total, each = expected(rows)
    docs, pairs = align_corpus(table(rows, clash=True).repartition(5))
    got = [tuple(r) for r in docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = Counter(x for e in each for x in set(e[2]))
    assert {(r.a_id, r.b_id): (r.n_links, r.n_docs) for r in pairs.collect()} == {k: (total[k], held[k]) for k in total}


def test_small_flushes(table, rows, monkeypatch):
    """Containers of one chunk from several batches are united."""
    monkeypatch.setattr(token_alignment, "SLICE", 300)
    monkeypatch.setattr(token_alignment, "HELD", 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["row", "doc_id", "text"])
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    parts = [b.select(POSTINGS.names) for b in token_alignment.align_texts(*paths)(iter([batch])) if b.column("pair").null_count == 0]
    assert len(parts) > 20
    whole = pa.Table.from_batches(parts).sort_by([("pair", "ascending"), ("chunk", "ascending"), ("plane", "ascending")]).combine_chunks()
    merged = pa.Table.from_batches(token_alignment.merge_postings(iter(whole.to_batches(max_chunksize=97)))).to_pylist()
    _, total, _ = expected(rows)
    size_b = token_alignment.aligner(*paths).size_b
    assert {divmod(r["pair"], size_b): r["n_links"] for r in merged} == total


def test_containers():
    rng = np.random.default_rng(0)
    for n in (0, 1, FULL // 2 - 1, FULL // 2, 5000, 8 * FULL):
        low = np.sort(rng.choice(8 * FULL, n, replace=False))
        assert (places(pack(low)) == low).all() and popcount(pack(low)) == n and len(pack(low)) <= FULL
        other = np.sort(rng.choice(8 * FULL, 40, replace=False))
        assert (places(either([pack(low), pack(other)])) == np.union1d(low, other)).all()


def test_planes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 3 * 40_000, 9000))
    pair, row, number = keys % 3, keys // 3, rng.geometric(0.2, len(keys))
    back = Counter()
    for batch in postings(pair, row, number):
        for r in batch.to_pylist():
            for low in places(r["bits"]).tolist():
                back[r["pair"], (r["chunk"] << 14) + low] += plane_weight(r["plane"])
    assert back == Counter(dict(zip(zip(pair.tolist(), row.tolist()), number.tolist())))


def test_empty_table(spark, table):
    docs, pairs = align_corpus(table([]))
    assert docs.count() == 0 and pairs.count() == 0
    docs, pairs = align_corpus(table([(1, None), (2, "")]))
    assert [tuple(r)[2:] for r in docs.drop("doc_id", "row").collect()] == [(0, 0, "", 0, 0)] * 2 and pairs.count() == 0
