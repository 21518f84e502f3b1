"""What a page decides of the scores is worked out per page, and the ranking reads finished rows."""

from siteledger.plans import impact as plan


def _size(df):
    """Bytes of the largest method Spark generates for the plan; above 8 000 the JVM interprets it."""
    session = df.sparkSession
    mode = session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return max(int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:])


def _found(spark):
    pages = spark.range(4).selectExpr(
        "id as page_id", "1 as site_id", "'/a' as path", "10.0D as site_revenue", "2.0D as site_conversions", "id * 100 as clicks", "id * 1000 as impressions", "4.0D as position",
        "id * 50 as sessions", "0.5D as conversions", "2.5D as revenue", "0.4D as engagement_rate",
    )
    findings = spark.range(40).selectExpr("id % 4 as page_id", "'title' as check_type", "'HIGH' as severity", "'rules' as method", "id as issue_id", "'x' as current_state")
    return findings, pages


def test_scoring_a_finding_is_compiled(spark, tmp_path):
    findings, pages = _found(spark)
    path = str(tmp_path / "found")
    findings.join(plan.page_basis(pages), "page_id").write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scores = plan.score_candidates(spark.read.parquet(path)).select("page_id", "issue_id", "overall_priority", "search_impact_score", "user_activity_score", "business_impact_score")
        assert _size(scores) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scores_of_a_finding(spark):
    findings, pages = _found(spark)
    rows = plan.score_candidates(findings.join(plan.page_basis(pages), "page_id")).filter("issue_id in (0, 39)").orderBy("issue_id").collect()
    assert rows[0].reason.startswith("This URL has no search impressions recorded in the current window. Fixing this matters because")
    assert rows[1].reason.startswith("This URL receives 3,000 impressions at average position 4.0. It draws 150 sessions at a 40% engagement rate.")
    assert rows[1].overall_priority > rows[0].overall_priority
    assert not [c for c in rows[0].asDict() if c.startswith("_")]
