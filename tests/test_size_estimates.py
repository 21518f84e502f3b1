"""A small file may hold many rows: joins must not send them through the driver."""

from pyspark.sql import functions as F

from verification.registry import Tables


def test_a_million_rows_in_a_small_file_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    rows = spark.range(0, 1_000_000, numPartitions=1).select("id", F.lit("a text that every row repeats").alias("name"), F.col("id").alias("other"))
    rows.write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet"))
    assert size < 10 << 20  # below the limit for a broadcast, unlike the rows
    part = spark.read.parquet(path)
    plan = part.alias("a").join(part.alias("b"), F.col("a.id") == F.col("b.other"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_costly_rows_of_a_supplied_table_are_dealt_to_all_cores(spark):
    one = spark.range(0, 100, numPartitions=1)
    assert Tables(spark, "").spread(one).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
