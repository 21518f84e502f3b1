import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteledger.functions import changes as cx
from siteledger.functions import impact as fx
from siteledger.functions import keywords as kx
from siteledger.functions.priority import expected_ctr_by_rank
from siteledger.operators import facts, metrics, resolve
from siteledger.plans import audit, changes, experiments, intent, roadmap
from siteledger.streaming import deliveries


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_two_ctr_curves_differ_where_they_should(spark):
    row = one(
        spark, a9=expected_ctr_by_rank(F.lit(9.0)), b9=fx.expected_ctr(F.lit(9.0)), a25=expected_ctr_by_rank(F.lit(2.5)), b25=fx.expected_ctr(F.lit(2.5)),
        a30=expected_ctr_by_rank(F.lit(30.0)), b30=fx.expected_ctr(F.lit(30.0)), none=fx.expected_ctr(F.lit(None).cast("double")),
    )
    assert (row.a9, row.b9, row.a25, row.b25, row.a30, row.none) == (0.026, 0.028, 0.15, 0.11, 0.005, 0.0)
    assert row.b30 == pytest.approx(0.25 / 30)


def test_window_bounds(spark):
    day = lambda d: dt.date(2024, 1, d)
    pages = spark.createDataFrame([(1, 1), (2, 1)], "page_id int, site_id int")
    gsc = spark.createDataFrame([(1, day(1), 1, 100, 3.0), (1, day(5), 10, 100, 5.0), (1, day(10), 100, 100, 9.0)], "page_id int, date date, clicks int, impressions int, position double")
    ga4 = spark.createDataFrame([], "page_id int, date date, users int, sessions int, engagement_rate double, average_engagement_time double, conversions double, revenue double")
    sem = spark.createDataFrame([(1, 7, day(12), 4, 1, 1, 1, 1)], "page_id int, snapshot_id int, date date, organic_keywords int, organic_traffic int, striking_distance_keywords int, opportunity_volume int, backlinks int")
    out = {r.page_id: r for r in metrics.page_metrics(pages, gsc, ga4, sem, today="2024-01-10", window_days=5, until="2024-01-10").collect()}
    # 5 January is inside (lower bound inclusive), 10 January is outside; the snapshot ignores the upper bound.
    assert (out[1].clicks, out[1].position, out[1].organic_keywords) == (10, 5.0, 4)
    assert (out[2].clicks, out[2].ctr, out[2].conversions) == (0, None, 0.0)


def test_upsert_is_idempotent_and_null_safe(spark):
    target = spark.createDataFrame([(1, None, 5), (1, 2, 6), (2, None, 7)], "site_id int, page_id int, v int")
    update = spark.createDataFrame([(1, None, 50)], "site_id int, page_id int, v int")
    once = facts.upsert_nullsafe(target, update, ["site_id", "page_id"])
    twice = facts.upsert_nullsafe(once, update, ["site_id", "page_id"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) == sorted([(1, None, 50), (1, 2, 6), (2, None, 7)], key=str)


def test_page_resolution_levels(spark):
    pages = spark.createDataFrame([(1, 1, "https://www.a.test/x", "/x"), (2, 1, "https://www.a.test/Caf%C3%A9", "/Caf%C3%A9")], "page_id int, site_id int, url string, path string")
    sites = spark.createDataFrame([(1, "https://www.a.test/")], "site_id int, base_url string")
    keys = spark.createDataFrame([(1, u) for u in ("https://www.a.test/x/?gclid=1", "http://a.test/X", "x", "/caf%c3%a9/", "/none", "")], "site_id int, raw_url string")
    got = {r.raw_url: (r.page_id, r.matched_by) for r in resolve.resolve_pages(keys, pages, sites).collect()}
    assert got == {
        "https://www.a.test/x/?gclid=1": (1, "url"), "http://a.test/X": (1, "path"), "x": (1, "path"), "/caf%c3%a9/": (2, "path"), "/none": (None, None), "": (None, None),
    }


def test_cannibalization_ladder(spark):
    rows = []
    for keyword, a, b in (("k0", 3.0, 9.0), ("k1", 3.0, 30.0), ("k2", 3.0, None), ("k3", None, None)):
        rows += [(1, 1, keyword, "primary", 50.0, a, "gsc"), (1, 2, keyword, "primary", 60.0, b, "gsc")]
    rows += [(1, 1, "solo", "primary", 9.0, 1.0, "gsc"), (1, 1, "solo", "primary", 8.0, 1.0, "ai"), (1, 1, "tail", "long_tail", 9.0, 1.0, "gsc"), (1, 2, "tail", "long_tail", 9.0, 1.0, "gsc")]
    keywords = spark.createDataFrame(rows, "site_id int, page_id int, keyword string, keyword_tier string, keyword_opportunity_score double, current_position double, source string")
    pages = spark.createDataFrame([(1, "https://a.test/1"), (2, "https://a.test/2")], "page_id int, url string")
    groups, members = intent.cannibalization(keywords, pages)
    got = {r.keyword: (r.severity, r.canonical_page_id, r.page_count) for r in groups.collect()}
    assert got == {"k0": ("P0", 2, 2), "k1": ("P1", 2, 2), "k2": ("P2", 2, 2), "k3": ("P3", 2, 2)}
    assert members.count() == 8


def test_large_cannibalization_group_names_twenty_and_counts_the_rest(spark):
    keywords = spark.range(1, 41).selectExpr(
        "1 as site_id", "cast(id as int) as page_id", "'k' as keyword", "'primary' as keyword_tier", "cast(id as double) as keyword_opportunity_score",
        "cast(null as double) as current_position", "'gsc' as source",
    )
    pages = spark.range(1, 41).selectExpr("cast(id as int) as page_id", "concat('u', id) as url")
    groups, members = intent.cannibalization(keywords, pages)
    row = groups.first()
    assert (row.page_count, row.canonical_page_id, members.count()) == (40, 40, 40)
    assert "u20 and 19 more" in row.explanation


def test_keyword_tiers_and_guess(spark):
    df = spark.createDataFrame([("how to book", 0, "gsc"), ("temple darshan booking", 0, "gsc"), ("a b c", 5, "gsc"), ("plain words", 4, "ai"), ("two words", 4, "gsc")], "k string, i int, s string")
    got = [tuple(r) for r in df.select(kx.assign_tier("k", "i", "s"), kx.intent_guess("k")).collect()]
    assert got == [("question", "informational"), ("primary", "transactional"), ("long_tail", "informational"), ("semantic", "informational"), ("secondary", "informational")]


def test_missing_pages_need_a_full_successful_crawl(spark):
    pages = spark.createDataFrame([(s, f"h{p}", True) for s in (1, 2, 3) for p in (1, 2)], "site_id int, url_hash string, is_active boolean")
    seen = spark.createDataFrame([(1, "h1", 200, None), (2, "h1", 0, "timeout"), (3, "h1", 200, None)], "site_id int, url_hash string, status_code int, crawl_error string")
    runs = spark.createDataFrame([(1, "full"), (2, "full"), (3, "incremental")], "site_id int, mode string")
    assert [tuple(r)[:2] for r in audit.missing_pages(pages, seen, runs).collect()] == [(1, "h2")]


def test_checkpoint_votes(spark):
    base = dict(page_id=1, predicted_impact="mixed")
    rows = [
        dict(base, baseline_impressions=100.0, actual_impressions=106.0, baseline_clicks=19.0, actual_clicks=90.0, baseline_position=5.0, actual_position=4.6),
        dict(base, baseline_impressions=100.0, actual_impressions=106.0, baseline_clicks=20.0, actual_clicks=21.0, baseline_position=5.0, actual_position=5.5),
        dict(base, baseline_impressions=0.0, actual_impressions=6.0, baseline_clicks=0.0, actual_clicks=1.0, baseline_position=None, actual_position=5.5),
    ]
    schema = "page_id int, predicted_impact string, baseline_impressions double, actual_impressions double, baseline_clicks double, actual_clicks double, baseline_position double, actual_position double"
    df = spark.createDataFrame(rows, schema).withColumns({f"{s}_{c}": F.lit(0.0) for s in ("baseline", "actual") for c in ("sessions", "conversions")})
    df = df.withColumns({f"{s}_ctr": F.lit(None).cast("double") for s in ("baseline", "actual")})
    got = [(r.votes, r.actual_impact, r.prediction_matched) for r in experiments.verdict(df).collect()]
    # 6 % on 100 votes, clicks below 20 do not; 0.4 ranks do not vote, 0.5 do; no baseline, no verdict.
    assert got == [([1, 0, 0, 0, 0, 0], "positive", True), ([1, 1, 0, 0, 0, -1], "mixed", True), ([0, 0, 0, 0, 0, 0], "insufficient_data", None)]


def test_risk_and_gate(spark):
    rows = [(1, 1, 0, "robots", "negative", 1.0, "A noindex directive was added"), (2, 1, 0, "title", "positive", 0.95, "t"), (3, 1, 0, "h1", "negative", 0.8, "h"), (3, 1, 1, "h1", "negative", 0.8, "h")]
    df = spark.createDataFrame(rows, "pr_id int, file_id int, pos int, change_type string, direction string, weight double, description string")
    got = {r.pr_id: r for r in changes.predict(df).withColumn("gate", cx.gate_state("block", "risk_level")).collect()}
    assert (got[1].risk_level, got[1].gate) == ("critical", "failure")
    assert (got[2].expected_impact, got[2].positive_confidence, got[2].gate) == ("positive", 0.9, "success")
    assert (got[3].risk_level, got[3].suggested_changes) == ("high", ["Keep the target keyword in the H1 heading."])


def test_roadmap_caps_and_fallback(spark):
    scores = spark.range(1, 15).selectExpr(
        "cast(1 as int) as site_id", "cast(id as int) as page_id", "id as score_id", "'title' as recommendation_type", "'P0' as priority_level", "cast(id as double) as overall_priority",
        "1.0D as search_impact_score", "1.0D as user_activity_score", "1.0D as business_impact_score", "'low' as effort", "'r' as reason", "if(id = 14, 'implemented', 'detected') as status",
    )
    pages = spark.range(1, 30).selectExpr("cast(id as int) as page_id", "cast(if(id < 20, 1, 2) as int) as site_id", "concat('u', id) as url", "'/' as path", "true as is_active", "'HIGH' as highest_severity")
    extra = scores.limit(1).withColumns({"site_id": F.lit(2), "page_id": F.lit(25), "status": F.lit("dismissed"), "score_id": F.lit(99).cast("long")})
    profiles = spark.createDataFrame([], "page_id int, keyword_opportunity_score double")
    matrix = roadmap.priority_matrix(pages, scores.unionByName(extra), profiles)
    weeks = roadmap.roadmap_weeks(scores.unionByName(extra), pages, matrix)
    got = [(r.site_id, r.source, r.n) for r in weeks.groupBy("site_id", "source").agg(F.count(F.lit(1)).alias("n")).orderBy("site_id").collect()]
    assert got == [(1, "recommendation", 10), (2, "matrix", 1)]


def test_resync_rewrites_only_touched_dates(spark, tmp_path):
    path = str(tmp_path / "facts")
    write = deliveries.resync(path)
    schema = "site_id int, page_id int, date date, clicks long, impressions long, position double"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    write(spark.createDataFrame([(1, 1, d1, 1, 10, 2.0), (1, 2, d1, 5, 10, 2.0), (1, 1, d2, 3, 10, 4.0)], schema), 0)
    write(spark.createDataFrame([(1, 1, d1, 7, 20, 1.0)], schema), 1)
    got = sorted((r.page_id, str(r.date), r.clicks) for r in spark.read.parquet(path).collect())
    assert got == [(1, "2024-01-01", 7), (1, "2024-01-02", 3), (2, "2024-01-01", 5)]


def test_headings_change_verdicts_and_caps_are_asked_for(spark):
    """Headings reach targeting and content relevance; keywords are only left out where limits are passed."""
    from siteledger.plans import intent

    queries = spark.createDataFrame([(1, f"buy part {i}", i, i + 1, 5.0, 10) for i in range(30)], "page_id int, query string, idx int, query_rank int, position double, impressions long")
    none = spark.createDataFrame([], "page_id int, keyword string, idx int, position double, volume double, difficulty double, tier string")
    assert intent.keyword_sources(queries, none, none).count() == 30
    assert intent.keyword_sources(queries, none, none, intent.SOURCE_LIMITS).count() == 20
    page = [(1, 1, "informational", 50.0, "Notes", "Notes", "text", ["Buy part 1 now", "Buy part 2 here"])]
    pages = spark.createDataFrame(page, "page_id int, site_id int, detected_intent string, business_relevance double, title string, h1 string, content string, headings array<string>")
    keywords = intent.keyword_sources(queries, none, none)
    score = lambda p: {r.keyword: r.content_relevance_score for r in intent.score_keywords(keywords, p).collect()}
    with_headings, without = score(pages), score(pages.drop("headings"))
    assert with_headings["buy part 1"] > without["buy part 1"]
    assert intent.ranked_keywords(intent.score_keywords(keywords, pages)).count() == 30


def test_best_keyword_row_of_equal_ones(spark):
    """A score of 0 comes before none, then the smallest row id, in whatever order the rows arrive."""
    rows = [(3, None), (9, 0.0), (5, 0.0), (1, None)]
    for turn in (rows, rows[::-1]):
        keywords = spark.createDataFrame(
            [(i, 1, "k", "primary", 7, s, None, "ai") for i, s in turn],
            "row_id long, site_id int, keyword string, keyword_tier string, page_id long, keyword_opportunity_score double, current_position double, source string",
        ).coalesce(1)
        assert [(r.row_id, r.keyword_opportunity_score) for r in intent.best_row_per_page(keywords).collect()] == [(5, 0.0)]


def test_content_relevance_with_words_looked_up_once(spark):
    """Words looked up once for all keywords of a page give what each keyword gives alone; a body may have every word but not the phrase."""
    text = [F.lit(x) for x in ("red shoe shop", "shoe guide", "care tips", "a red shoe and blue laces")]
    rows = spark.createDataFrame([("red shoe",), ("blue shoe",), ("red hat",), ("care",), ("a b",), ("blue laces",)], "k string")
    found = kx.found_terms(F.array(*[F.lit(x) for x in ("red", "shoe", "blue", "hat", "care", "laces")]), *text)
    got = rows.select("k", kx.content_relevance(F.col("k"), *text).alias("alone"), kx.content_relevance(F.col("k"), *text, terms=kx.key_terms(F.col("k")), found=found).alias("shared")).collect()
    want = {"red shoe": 0.4 + 0.35 / 2 + 0.15, "blue shoe": 0.25, "red hat": 0.2, "care": 0.18, "a b": 0.5, "blue laces": 0.1 + 0.15 / 2 + 0.15}
    for r in got:
        assert r.alone == r.shared == pytest.approx(want[r.k]), r.k
