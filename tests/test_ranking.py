from bisect import bisect_left

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteledger.functions.numeric import clamp, rnd
from siteledger.operators import joins, ranking, settings as overlay
from siteledger.plans import audit, priority
from siteledger.session import cut

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400)), min_size=1, max_size=60)


@LOOSE
@given(ROWS)
def test_percent_ranks_match_first_index(spark, rows):
    data = [(i, s, v / 100) for i, (s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, site int, v double")
    got = {r.id: r.p for r in ranking.percent_ranks(df, ["site"], {"v": "p"}, limit=7).collect()}
    for i, site, value in data:
        ordered = sorted(v for _, s, v in data if s == site)
        expected = 0.0 if len(set(ordered)) <= 1 else bisect_left(ordered, value) / (len(ordered) - 1)
        assert abs(got[i] - expected) < 1e-12


@LOOSE
@given(ROWS)
def test_row_numbers_match_sorting(spark, rows):
    data = [(i, s, None if v % 7 == 0 else v / 10) for i, (s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, site int, v double")
    got = {r.id: r.n for r in ranking.row_numbers(df, ["site"], [F.col("v").desc(), F.col("id").asc()], "n").collect()}
    for site in {s for _, s, _ in data}:
        mine = sorted((r for r in data if r[1] == site), key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def bands(spark, scores):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "site_id int, page_id int, score double")
    return {r.score: r.band for r in priority.band_and_rank(df).collect()}


def test_small_site_uses_absolute_bands(spark):
    assert bands(spark, [75.0, 70.0, 69.99, 50.0, 30.0, 29.0, 0.0]) == {75.0: "P0", 70.0: "P0", 69.99: "P1", 50.0: "P1", 30.0: "P2", 29.0: "P3", 0.0: "P3"}


def test_eight_pages_use_relative_bands(spark):
    got = bands(spark, [8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0])
    assert [got[float(x)] for x in (8, 7, 6, 5, 4)] == ["P0", "P2", "P2", "P2", "P3"]


def test_ties_share_the_band(spark):
    assert set(bands(spark, [5.0] * 20).values()) == {"P0"}


def test_weights_overlay_and_redistribution(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site_id int")
    rows = spark.createDataFrame(
        [(None, "priority_weights", {"seo_severity": "0.5", "ga4_activity": "x"}), (2, "priority_weights", {"gsc_search": "-3"}), (3, "priority_weights", {c: "0" for c in priority.COMPONENTS})],
        "site_id int, key string, value map<string,string>",
    )
    sources = spark.createDataFrame([(1, True, False, False), (2, False, False, False)], "site_id int, has_gsc boolean, has_ga4 boolean, has_semrush boolean")
    out = {r.site_id: r for r in priority.site_weights(sites, rows, sources).collect()}
    assert (out[1].ga4_activity, out[1].semrush_opportunity) == (0.0, 0.0)
    assert abs(out[1].seo_severity + out[1].gsc_search - 1.0) < 1e-5
    assert out[2].seo_severity == 1.0
    plain = {r.site_id: r for r in overlay.overlay(sites, rows, "priority_weights", priority.DEFAULT_WEIGHTS).collect()}
    assert (plain[1].seo_severity, plain[1].ga4_activity, plain[2].gsc_search) == (0.5, 0.3, 0.0)


def test_rounding_and_clamping(spark):
    row = spark.range(1).select(
        rnd(F.lit(2.675), 2).alias("a"), rnd(F.lit(0.1) + F.lit(0.2), 1).alias("b"), clamp(F.lit(None).cast("double")).alias("c"), clamp(F.lit(7.0)).alias("d")
    ).first()
    assert (row.a, row.b, row.c, row.d) == (2.68, 0.3, None, 1.0)


# ── one site with 90 % of the rows, hashed ids, continuous scores, a value that half of them share ─────────────────────
@pytest.fixture(scope="module")
def lopsided(spark):
    df = spark.range(40_000).selectExpr(
        "if(id % 10 < 9, 1, cast(id % 7 + 2 as int)) as site_id", "xxhash64(id) as page_id", "if(id % 2 = 0, 0.0D, pmod(xxhash64(id, 7), 1000000007) / 1e9D) as score"
    )
    return cut(df.repartition(8))


def apart(spark):
    """Small range partitions, as a large table has."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture
def many_tasks(spark):
    apart(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_numbers_of_a_large_site(spark, lopsided, many_tasks, tasks):
    with tasks() as seen:
        got = ranking.row_numbers(lopsided, ["site_id"], [F.col("score").desc(), F.col("page_id").asc()], "n", total="t").toPandas()
    want = got.sort_values(["score", "page_id"], ascending=[False, True]).groupby("site_id").cumcount() + 1
    assert (got["n"].sort_index() == want.sort_index()).all() and (got["t"] == got.groupby("site_id")["n"].transform("max")).all()
    assert 0 < seen.most_rows() < 40_000 * 0.12, "a task held a large part of the site"


def test_bands_of_a_large_site(spark, lopsided, many_tasks, tasks):
    with tasks() as seen:
        got = priority.band_and_rank(lopsided).toPandas()
    for _, site in got.groupby("site_id"):
        site = site.sort_values("rank")
        cut_offs = {b: site["score"].iloc[max(1, int(len(site) * s)) - 1] for b, s in priority.BAND_SHARES.items()}
        want = ["P0" if x >= cut_offs["P0"] else "P1" if x >= cut_offs["P1"] else "P2" if x >= cut_offs["P2"] else "P3" for x in site["score"]]
        assert site["band"].tolist() == want and site["rank"].tolist() == list(range(1, len(site) + 1))
    assert 0 < seen.most_rows() < 40_000 * 0.12


def test_percent_ranks_of_a_large_site(spark, lopsided, many_tasks, tasks):
    with tasks() as seen:
        got = ranking.percent_ranks(lopsided, ["site_id"], {"score": "p"}, limit=1000).toPandas()
    first = got.groupby("site_id")["score"].rank(method="min") - 1
    size = got.groupby("site_id")["score"].transform("size") - 1
    assert ((got["p"] - first / size).abs() < 1e-12).all()
    assert 0 < seen.most_rows() < 40_000 * 0.15


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_heavy_join_equals_plain_join(spark, how, limit):
    left = spark.createDataFrame([(i % 3 if i % 5 else None, "x" if i % 4 else None, i) for i in range(120)] + [(9, "x", 500)], "k int, s string, v int")
    right = spark.createDataFrame([(0, "x", "a"), (1, "x", "b"), (1, "x", "c"), (None, "x", "d"), (7, "x", "e")], "k int, s string, w string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(joins.heavy_join(left, right, ["k", "s"], how, limit=limit)) == rows(left.join(right, ["k", "s"], how))
    with pytest.raises(ValueError, match="how"):
        joins.heavy_join(left, right, ["k"], "full")


def test_a_target_linked_from_half_of_all_pages(spark, many_tasks, tasks):
    n = 20_000
    pages = cut(spark.range(n).selectExpr("concat('https://a.test/', id) as url", "concat('https://a.test/', id) as final_url", "if(id = 7, 404, 200) as status_code"))
    edges = cut(spark.range(n).selectExpr("concat('https://a.test/', id) as url", "if(id % 2 = 0, 'https://a.test/7', concat('https://a.test/', id + 1)) as target"))
    with tasks() as seen:
        got = {r.url: r for r in audit.link_counts(edges, pages, limit=500).collect()}
    assert sum(r.broken_link_count for r in got.values()) == n // 2 and got["https://a.test/7"].inbound_internal_links == n // 2
    assert got["https://a.test/8"].broken_link_count == 1 and got["https://a.test/9"].broken_link_count == 0
    assert 0 < seen.most_rows() < n * 0.15
