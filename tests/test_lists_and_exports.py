import pytest
from pyspark.sql import functions as F

from siteledger.functions import keywords as kx
from siteledger.operators import exports
from siteledger.plans import audit, changes, intent, reports
from siteledger.session import cut
from siteledger.sources import html, markup


# ── lists apart from numbers ─────────────────────────────────────────────────
def test_a_page_with_very_many_keywords(spark, tasks):
    """200 000 keywords of one page: no array and no task holds them all."""
    n = 200_000
    words = spark.range(n).selectExpr("1 as page_id", "concat('part ', id, ' word', id % 97) as query", "cast(id as int) as idx", "cast(id + 1 as int) as query_rank", "cast(1 + id % 60 as double) as position", "cast(id % 5000 as long) as impressions")
    few = spark.range(20).selectExpr("cast(2 + id % 4 as int) as page_id", "concat('item ', id) as query", "cast(id as int) as idx", "cast(id + 1 as int) as query_rank", "5.0D as position", "10L as impressions")
    none = spark.createDataFrame([], "page_id int, keyword string, idx int, position double, volume double, difficulty double, tier string")
    keywords = cut(intent.keyword_sources(cut(words.unionByName(few).repartition(8)), none, none))
    pages = spark.createDataFrame([(i, 1, "informational", 0.5, f"Part {i} word1", "Notes", "text word2 " * 50) for i in range(1, 7)], "page_id int, site_id int, detected_intent string, business_relevance double, title string, h1 string, content string")
    lists = intent.score_keywords(keywords, pages, batch=1000)
    scored = cut(lists)
    assert scored.count() == n + 20
    plain = {(r.page_id, r.keyword): r.content_relevance_score for r in intent.score_keywords(keywords.filter("page_id > 1 or keyword like '% word5'"), pages, batch=10**9).collect()}
    got = {(r.page_id, r.keyword): r.content_relevance_score for r in scored.filter("page_id > 1 or keyword like '% word5'").collect()}
    assert got == plain
    ranked = cut(intent.ranked_keywords(scored))
    out = {r.page_id: r for r in intent.page_keyword_scores(ranked).collect()}
    assert ranked.count() == n + 20 and len(out[1].primary_keywords) <= kx.TIER_CAPS["primary"] and len(out[1].secondary_keywords or []) <= kx.TIER_CAPS["secondary"]


def test_findings_of_a_large_pull_request(spark, tasks):
    n = 30_000
    rows = cut(spark.range(n).selectExpr(
        "if(id < 9 * 1000 * 3, 1, cast(id as int)) as pr_id", "id as file_id", "0 as pos", "if(id % 3 = 0, 'h1', if(id % 3 = 1, 'title', 'other')) as change_type", "if(id % 2 = 0, 'negative', 'positive') as direction", "0.01D as weight", "concat('d', id) as description",
    ).repartition(8))
    row = changes.predict(rows, listed=3).filter("pr_id = 1").first()
    assert (row.change_count, row.negative_findings, row.positive_findings) == (27_000, ["d0", "d2", "d4"], ["d1", "d3", "d5"])
    assert row.suggested_changes == ["Keep the target keyword in the H1 heading.", "Keep the target keyword in the page title."]
    assert "negative_findings" not in changes.predict(rows).columns
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with tasks() as seen:
            ranked = changes.finding_rows(rows).filter("pr_id = 1 and direction = 'negative'").orderBy("finding_rank").collect()
        assert [r.description for r in ranked[:3]] == ["d0", "d2", "d4"] and ranked[-1].finding_rank == 13_500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_actions_are_rows_and_arrays_on_request(spark):
    pages = spark.createDataFrame([(1, 1, "u1", 50.0), (1, 2, "u2", None)], "site_id int, page_id int, url string, seo_score double")
    metrics = spark.createDataFrame([(1, *[1.0] * 8)], "page_id int, impressions double, clicks double, ctr double, position double, sessions double, engagement_rate double, conversions double, revenue double")
    profiles = spark.createDataFrame([(1, "x", True, "e", ["k"], None, 1.0)], "page_id int, detected_intent string, intent_mismatch boolean, mismatch_explanation string, primary_keywords array<string>, secondary_keywords array<string>, keyword_opportunity_score double")
    scores = spark.createDataFrame([(i, 1, f"t{i}", "P0", None if i == 0 else float(i % 5), "low", "r", "detected") for i in range(12)], "score_id int, page_id int, recommendation_type string, priority_level string, overall_priority double, effort string, reason string, status string")
    competitors = spark.createDataFrame([], "page_id int, analysis_id int, keyword string, median_word_count int")
    out = {r.page_id: r for r in reports.action_plan(pages, metrics, profiles, scores, competitors, listed=3).collect()}
    assert (out[1].action_count, out[1].first_action.score_id, [a.score_id for a in out[1].recommended_actions]) == (12, 4, [4, 9, 3])
    assert (out[2].action_count, out[2].first_action, out[2].recommended_actions) == (0, None, None)
    assert "recommended_actions" not in reports.action_plan(pages, metrics, profiles, scores, competitors).columns
    assert [r.score_id for r in reports.action_rows(scores).orderBy("action_rank").collect()][:4] == [4, 9, 3, 8]


# ── exports ──────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_an_export_comes_back_as_it_was(spark, tmp_path, fmt):
    a = spark.createDataFrame([(1, "x,\"y\"\nz", None, 1.5), (2, "", "n", None), (None, None, "é", 0.1)], "site_id int, text string, other string, v double")
    tables = {"a": a, "empty": a.filter("false"), "nested": a.select(F.array("text").alias("list"), F.create_map("text", "v").alias("map") if fmt == "csv" else F.struct("v").alias("map")).filter("`list`[0] is not null")}
    folder = str(tmp_path)
    name = exports.write_tables(tables, folder, fmt=fmt)
    back = exports.read_tables(spark, folder, name)
    assert set(back) == set(tables) and back["empty"].count() == 0 and back["a"].columns == a.columns
    assert sorted(map(tuple, back["a"].collect()), key=str) == sorted(map(tuple, a.collect()), key=str)


def test_a_broken_export_is_not_read(spark, tmp_path, monkeypatch):
    a = spark.range(5).withColumnRenamed("id", "v")
    folder = str(tmp_path)

    def fail(df):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(exports, "_figures", fail)
        with pytest.raises(OSError, match="disk full"):
            exports.write_tables({"a": a}, folder, export="e1")
    with pytest.raises(exports.IncompleteExport, match="manifest"):
        exports.read_tables(spark, folder, "e1")
    exports.write_tables({"a": a}, folder, export="e1")
    assert exports.read_tables(spark, folder, "e1")["a"].count() == 5
    spark.range(1).withColumnRenamed("id", "v").write.mode("append").parquet(f"{folder}/e1/a")
    with pytest.raises(exports.IncompleteExport, match="not what the manifest says"):
        exports.read_tables(spark, folder, "e1")


# ── a second measurement ─────────────────────────────────────────────────────
def test_two_measurements_of_odd_markup(spark):
    """Both agree where they measure the same thing, on markup that neither was made for."""
    rows = [
        (1, "<html lang=en><title>A &amp; B</title><body><h1>One</h1><h1> </h1><h1>Two <i>x</i></h1><img src=a alt><img src=b alt='t'><img src=c></body></html>"),
        (2, ""), (3, None), (4, "plain text"),
        (5, "<HTML><HEAD><TITLE>Up</TITLE><META NAME='Robots' CONTENT='noindex'><LINK REL='Canonical' HREF='/x'></HEAD><BODY><H2>a</H2><script>'<h2>'</script><!-- <h2> --><H3>b</H3></BODY></HTML>"),
        (6, "<html><head><title>t</title><script type='application/ld+json'>{}</script></head><body><a href='//cdn.test/a' rel='NOFOLLOW'>x</a><a href='https://www.a.test/b'>y</a><a href='c'>z</a><div itemtype=q>i</div></body></html>"),
    ]
    docs = spark.createDataFrame([(i, f"https://a.test/{i}", h, "a.test") for i, h in rows], "page_id int, url string, html string, base_domain string")
    mine, theirs = markup.extracted_signals(html.extract_pages(docs)), markup.markup_signals(docs)
    report = {r.metric: r for r in audit.agreement(mine, theirs, "page_id", list(markup.METRICS)).collect()}
    assert set(report) == set(markup.METRICS)
    same = {m for m, r in report.items() if r.agreed == len(rows)}
    assert set(markup.METRICS) - same <= {*markup.EXPECTED, "h1_text", "img_empty_alt"}
    values = {r.page_id: r for r in theirs.collect()}
    assert (values[1].title, values[1].h1_text, values[1].img_missing_alt, values[1].img_empty_alt, values[1].lang) == ("A & B", "One | Two x", 1, 1, "en")
    assert (values[5].meta_robots, values[5].canonical_href, values[5].h2_count, values[5].h3_count) == ("noindex", "/x", 1, 1)
    assert (values[6].internal_links, values[6].external_links, values[6].nofollow_links, values[6].json_ld, values[6].microdata) == (2, 1, 1, True, True)
