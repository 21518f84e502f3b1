"""The pipeline against its parts by brute force, stage by stage."""

import importlib.util
import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(table, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("aeioubcdst", k=rng.randint(2, 8))) for _ in range(800)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 200))) for _ in range(60)]
    rows = [(i, t, "xx", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].replace(" ", "  "), "xx", "s1") for i in range(5)]  # the longer copy stays
    rows += [(200 + i, texts[i].upper(), None, "s2") for i in range(20, 25)]  # equal fingerprints
    rows += [(300, None, "xx", "s0"), (301, "123 456", "xx", None), (302, "", None, "s1"), (None, texts[7] + " tail", "xx", None)]
    folder = tmp_path_factory.mktemp("documents")
    table(rows).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def test_stages(spark, documents, tmp_path):
    folder, rows = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == COLUMNS
            kept[name] = docs.collect()
    ids = {n: Counter(r.doc_id for r in v) for n, v in kept.items()}
    assert ids["language_id"] == Counter(r[0] for r in rows if r[1] and re.search("[a-zA-Z]", r[1]))
    gone = set(range(5))
    assert ids["exact_dedup"] == Counter({k: v for k, v in ids["language_id"].items() if k not in gone})
    assert set(range(20, 25)) <= set(ids["near_dedup"]) and not set(range(220, 225)) & set(ids["near_dedup"])
    assert set(ids["source_mix"]) <= set(ids["near_dedup"]) and max(ids["source_mix"].values()) <= 3
    tokens = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert set(tokens) == set(ids["source_mix"])
    total = Counter()
    for r in docs.collect():
        total[r.doc_id] += r.length
    assert all(total[d] == tokens[d] * ids["source_mix"][d] for d in tokens)


def test_run(spark, documents):
    out = corpus_pipeline.run(spark, documents[0])
    assert out.count() > 0 and "ids_crc32" in out.columns and corpus_pipeline.ORACLE_SQL is None
