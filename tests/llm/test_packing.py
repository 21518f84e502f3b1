import random

import numpy as np
import pyarrow as pa
import pytest

from siteledger.llm.best_fit import best_fit, packed_rows, write_packed
from siteledger.llm.binary_pieces import binary_lengths, binary_pieces
from siteledger.llm.tokens import byte_bpe, default_path

TEXTS = ["Hello world", None, "", "  two  spaces ", "naïve　space x", "a<|endoftext|>b", "line\nbreak end\n", "word " * 3000, "x" * 5000, "word " * 3000]


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer_library():
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "12", "<|endoftext|>", "!", "　", "ß", "\x1c", "\x85", "漢", "\r\n", "the", " of"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)] + TEXTS
    ids, bounds = byte_bpe(default_path()).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(t)[:-1], repr(t)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_binary_lengths(n):
    parts = binary_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
    assert parts == sorted(parts, reverse=True) and len(set(p for p in parts if p < 1024)) == sum(p < 1024 for p in parts)


def test_pieces_give_back_every_document(spark, table):
    df = table(TEXTS, clash=True).repartition(3)
    rows = binary_pieces(df, longest=64).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == ids_of(text) and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.bucket for r in order] == sorted(r.bucket for r in rows)
    assert binary_pieces(table([])).count() == 0
    with pytest.raises(ValueError):
        binary_pieces(df, longest=100)


def test_best_fit_takes_the_fullest_row():
    def plain(lengths, capacity):
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(capacity - n)
        return sorted(rooms)

    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 70))]
        rooms = {}
        for n, row in zip(lengths, best_fit(lengths, 50)):
            rooms[row] = rooms.get(row, 50) - n
        assert sorted(rooms.values()) == plain(lengths, 50)


def test_matrix_rows_round_trip(spark, table, tmp_path):
    df = table([*TEXTS, TEXTS[0]], clash=True)
    write_packed(packed_rows(df, capacity=128, pad_id=9, block_tokens=4000), str(tmp_path / "rows"))
    parts = {}
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == 9).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for i, text in enumerate([*TEXTS, TEXTS[0]]):
        assert [x for _, p in sorted(parts[i]) for x in p] == ids_of(text)
    assert len({r.row_id for r in rows}) == len(rows)
    assert packed_rows(table([])).count() == 0
