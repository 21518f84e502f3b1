"""Row numbers do not depend on how a scan is cut."""

import pytest

from siteledger.llm.block_naming import drop_copies
from siteledger.llm.common import Scratch, with_rows
from siteledger.llm.golay_simhash import drop_near_copies
from siteledger.llm.mixing import repeat_documents

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def files(spark, table, tmp_path):
    rows = [(i, f"text {i // 2} " + " ".join(f"w{i // 2 * 7 + k}" for k in range(40)), "xx", f"s{i % 2}") for i in range(64)]
    table(rows, clash=True).repartition(8, "doc_id").write.parquet(str(tmp_path / "d"))
    yield str(tmp_path / "d")
    spark.conf.unset(SPLIT)
    spark.conf.unset(COST)


def cut_apart(spark):
    spark.conf.set(SPLIT, "1k")
    spark.conf.set(COST, "0")


def cut_together(spark):
    spark.conf.set(SPLIT, "128m")
    spark.conf.set(COST, "0")


@pytest.mark.parametrize("operator", [drop_copies, drop_near_copies])
def test_copies_when_splits_change(spark, files, operator):
    """The rows to keep are decided under other splits than those of the scan that takes them."""
    cut_together(spark)
    kept = operator(spark.read.parquet(files))
    cut_apart(spark)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 64, 2))


def test_mix_when_splits_change(spark, files):
    cut_together(spark)
    want = sorted(r.doc_id for r in repeat_documents(spark.read.parquet(files)).collect())
    taken = repeat_documents(spark.read.parquet(files))
    cut_apart(spark)
    assert sorted(r.doc_id for r in taken.collect()) == want


def test_numbers_are_distinct(spark, files):
    """Where a file's row may occur twice, or be drawn anew, rows are written once."""
    docs = spark.read.parquet(files)
    for df in (docs, docs.filter("doc_id % 3 = 0").selectExpr("doc_id", "'x' as _metadata"), spark.read.parquet(files, files), docs.union(docs), docs.crossJoin(spark.range(2)),
               docs.selectExpr("doc_id", "explode(array(1, 2)) as e"), docs.filter("rand() < 0.5")):
        rows, row = with_rows(df, Scratch(spark, "test"))
        cut_apart(spark)
        apart = [tuple(r) for r in rows.select("doc_id", row).collect()]
        cut_together(spark)
        together = [tuple(r) for r in rows.select("doc_id", row).collect()]
        assert rows.columns == [*df.columns, row] and sorted(apart) == sorted(together) and len({r for _, r in apart}) == len(apart)
