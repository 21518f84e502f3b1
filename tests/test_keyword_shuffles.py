"""Keyword rows are worked out once and shuffled once, by page, however many steps follow."""

import re

import pytest
from pyspark.sql import functions as F

from siteledger.plans import intent

QUERIES = [(i % 3, f"part {i // 3} word{i % 5}", i // 3, 1.0 + i % 9, 10 + i) for i in range(60)]
PAGES = [(i, 1, "informational", 0.5, "Part 1 word1", "Notes", "text word2") for i in range(4)]


@pytest.fixture
def inputs(spark):
    queries = spark.createDataFrame(QUERIES, "page_id int, query string, idx int, position double, impressions long")
    none = spark.createDataFrame([], "page_id int, keyword string, idx int, position double, volume double, difficulty double, tier string")
    again = spark.createDataFrame([(0, " Part 1 word3", 0, "primary"), (0, "other", 1, "none"), (3, "lone", 7, "odd")], "page_id int, keyword string, idx int, tier string")
    pages = spark.createDataFrame(PAGES, "page_id int, site_id int, detected_intent string, business_relevance double, title string, h1 string, content string")
    return queries, none, again, pages


def test_one_shuffle_by_page(spark, inputs, monkeypatch):
    """The plan from sources to means: one exchange of keyword rows, the other that of the pages; nothing is written in between."""
    queries, none, again, pages = inputs
    monkeypatch.setattr(intent, "cut", lambda df: pytest.fail("written"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = intent.page_keyword_scores(intent.ranked_keywords(intent.score_keywords(intent.keyword_sources(queries, none, again), pages, batch=4)))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2, plan
    rows = {r.page_id: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[3].primary_keywords == [] and rows[0].primary_keywords == ["part 1 word3", "part 0 word0"]


def test_scores_do_not_depend_on_the_arrays(inputs):
    queries, none, again, pages = inputs
    keywords = intent.keyword_sources(queries, none, again)
    scores = [sorted(intent.score_keywords(keywords, pages, batch=n).collect()) for n in (1, 7, 1000)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 62


def test_means_and_lists_of_one_aggregate(spark):
    rows = [(1, "a", "primary", 90.0, 1), (1, "b", "primary", 80.0, 2), (1, "c", "secondary", 70.0, 1), (1, "d", "other", 60.0, 1), (2, "e", "other", 5.0, 1), (3, "f", "primary", None, 1)]
    capped = spark.createDataFrame(rows, "page_id int, keyword string, keyword_tier string, keyword_opportunity_score double, tier_rank int")
    got = {r.page_id: tuple(r)[1:] for r in intent.page_keyword_scores(capped, {"primary": 1, "secondary": 5}).collect()}
    assert got == {1: (80.0, ["a"], ["c"]), 2: (5.0, None, None), 3: (None, ["f"], [])}


def test_profiles_without_keyword_rows(spark, inputs):
    """Keyword rows that are not kept change no profile."""
    queries, none, again, pages = inputs
    zero = {c: F.lit(0.0) for c in ("sessions", "conversions", "revenue", "engagement_rate", "site_revenue", "site_conversions", "seo_score", "clicks", "impressions", "position")}
    pages = pages.drop("detected_intent", "business_relevance").withColumns({**zero, "url": F.lit("https://a.test/x"), "path": F.lit("/x"), "content_hash": F.lit("h"), "structured_data_types": F.array().cast("array<string>")})
    findings = spark.createDataFrame([], "page_id int, ai_intent string, ai_confidence double")
    ranked = queries.withColumns({"query_rank": F.col("idx") + 1, "clicks": F.lit(1)})
    run = lambda **kw: intent.intent_profiles(pages, ranked, none, findings, again, **kw)
    (both, keywords), (alone, lazy) = run(), run(keep_keywords=False)
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.collect())) and both.count() == 4
    assert sorted(map(str, keywords.collect())) == sorted(map(str, lazy.collect()))
