import random
import re

import pytest

from siteledger.llm.block_naming import drop_copies, exact_groups


def brute(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if plain[j] == plain[i]]
        best = min(same, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((doc_id, rows[best][0], len(same), i == best))
    return out


def found(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.orderBy("row").collect()]


ODD = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \n"), (None, "ab  "), (2, "ab"), (2, "ab"), (7, " ab"), (8, "abab" * 40), (9, "abab " * 40), (10, "ab" * 79 + "x")]


def sort_key(r):
    return repr(r)


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_odd_rows(spark, table, block):
    df = table(ODD, clash=True).coalesce(1)
    assert sorted(found(exact_groups(df, block=block)), key=sort_key) == sorted(brute(ODD), key=sort_key)


def test_random_texts_of_many_blocks(spark, table):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab ", k=rng.randint(0, 30)))) for i in range(300)] + [(900 + i, "ab" * 50) for i in range(50)]
    assert sorted(found(exact_groups(table(rows), block=4))) == sorted(brute(rows))


def test_checksum_and_empty_table(spark, table, sha):
    assert exact_groups(table(["x  y\t"])).first().text_sha256 == sha("xy")
    assert exact_groups(table([])).count() == 0
    assert drop_copies(table([])).columns == table([]).columns


def test_rows_that_stay_keep_their_columns(spark, table):
    df = table(ODD, clash=True)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r[3] for r in brute(ODD))
