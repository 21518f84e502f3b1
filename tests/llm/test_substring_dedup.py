import random

import pytest

from siteledger.llm import anchors
from siteledger.llm.lyndon import suffix_array
from siteledger.llm.substring_dedup import remove_repeats

LENGTH = 100


def brute(rows, length=LENGTH):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        out[i] = bytes(b for b, g in zip(raw, gone) if not g), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
    return [out[i] for i in range(len(rows))]


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(600):
        text = [*rng.choices(range(1, rng.choice([2, 3, 6])), k=rng.randint(0, 60)), 0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([5] * 3000 + [0]) == list(range(3000, -1, -1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefg é", k=rng.randint(1, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(40)
    out = [(i, text(rng.randint(1, 80))) for i in range(25)]
    out += [(100 + i, f"{text(20)} {passage} {text(10)}") for i in range(12)]
    out += [(200, out[3][1]), (3, out[3][1]), (None, passage), (None, None), (300, ""), (301, "ab" * 400), (302, "x" * 99), (303, "x" * 100), (304, "x" * 101), (305, "\0" * 150)]
    near = passage.split()
    near[20] = "changed"
    return out + [(400, " ".join(near)), (400, " ".join(near)), (401, passage[:150]), (402, passage[-120:])]


@pytest.mark.parametrize("most", [2, 20_000])
def test_bytes_left(spark, table, rows, most):
    got = remove_repeats(table(rows, clash=True).coalesce(1), group_contexts=most).orderBy("row").collect()
    want = brute(rows)
    assert [(bytes(r.kept), len(r.spans)) for r in got] == want
    assert all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) for r in got)


def test_partitions_do_not_matter(spark, table, rows):
    plain = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    want = dict(zip((r[0] for r in plain), brute(plain)))
    got = remove_repeats(table(plain).repartition(5)).collect()
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in got} == want


def test_long_texts_in_parts(monkeypatch):
    import numpy as np

    data = np.random.default_rng(0).integers(97, 100, 6000).astype(np.uint8)
    bounds = np.array([0, 700, 700, 750, 3000, 6000])
    whole = anchors.runs(data, bounds, LENGTH)
    monkeypatch.setattr(anchors, "BLOCK", 512)
    parts = anchors.runs(data, bounds, LENGTH)
    starts = lambda found: sorted((s, h) for a, b, h in zip(*(x.tolist() for x in found)) for s in range(a, b + 1))
    assert starts(whole) == starts(parts) and len(starts(whole)) == 601 + 2151 + 2901


def test_empty_table(spark, table):
    assert remove_repeats(table([])).count() == 0


_MEASURE = """
import resource, sys
import numpy as np, pyarrow as pa
from siteledger.llm.substring_dedup import find_places
kind = sys.argv[1]
data = b"ab" * (4 << 20) if kind == "period" else np.random.default_rng(0).integers(97, 122, 32 << 20).astype(np.uint8).tobytes()
batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([1], pa.int64()), pa.array([data]).cast(pa.string())], names=["row", "doc_id", "text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(out.num_rows for out in find_places(100)(iter([batch])))
print(rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("kind,most_mb,most_rows", [("period", 300, 200), ("long", 350, 1_200_000)])
def test_memory_of_a_worker(kind, most_mb, most_rows):
    """A text of 32 MB, and 8 MB of one period, in a fresh process; the text itself is held three times."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", _MEASURE, kind], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) < most_rows and int(out[1]) < most_mb, out
