"""Costly text work is done once per URL or file name, not once per row."""

import hashlib

from pyspark.sql import functions as F

from siteledger.functions import urls
from siteledger.plans import audit, changes, discovery

SITES = "site_id int, base_url string, framework string, path_map map<string,string>"


def test_admission_of_rows_with_equal_urls(spark):
    rules = spark.createDataFrame([("https://a.test", "disallow", "/x", 1)], "origin string, kind string, value string, pos int")
    rows = [(1, "https://a.test/x", "a.test"), (2, "https://a.test/x", "b.test"), (3, "https://a.test/f.pdf", "a.test"), (4, "https://a.test/no/1", "a.test"), (5, "https://a.test/y", "a.test"), (6, None, "a.test")]
    urls = spark.createDataFrame(rows, "id int, url string, base_domain string")
    out = discovery.admission(urls, rules, exclude=["/no/*", "/never"])
    assert "_fault" in out._jdf.queryExecution().analyzed().toString()  # joined by URL
    assert {r.id: r.rejected_by for r in out.collect()} == {1: "robots", 2: "off_domain", 3: "not_a_page", 4: "excluded", 5: None, 6: None}


def test_routes_are_resolved_once_per_file_of_a_site(spark):
    files = spark.range(6).selectExpr("id as pr_id", "cast(1 + id % 1 as int) as site_id", "id as file_id", "concat('pages/about', id % 1, '.tsx') as filename", "'+<title>New</title>' as patch", "1 as additions", "0 as deletions")
    out = changes.pr_changes(files, spark.createDataFrame([(1, "https://a.test/", None, None)], SITES))
    assert "Aggregate [site_id" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.affected_url for r in out.collect()] == ["https://a.test/about0"] * 6


def test_observations_are_sorted_without_hash_and_unused_columns(spark):
    rows = [(1, 1, "https://a.test/x/", 200, "ok", "spare1", "old", 3), (2, 1, "https://a.test/x", 500, "failed", "spare2", "new", 5), (3, 1, "https://a.test/y", 200, "ok", "spare3", "y", 4), (4, 1, None, 200, "ok", "spare4", "z", 4)]
    seen = spark.createDataFrame(rows, "observation_id int, site_id int, url string, status_code int, crawl_quality string, crawl_error string, title string, fetched_at int")
    seen = seen.withColumn("final_url", F.lit(None).cast("string")).withColumn("url_hash", F.lit("stale"))
    newest = audit.collapse_observations(seen)
    assert newest.columns[:2] == ["site_id", "url_hash"] and sorted(newest.columns) == sorted(seen.columns)
    pages = spark.createDataFrame([(1, "https://a.test/x", "/x", 200, "stored", True, 1, 1, 1), (1, "https://a.test/w", "/w", 200, "stays", False, 1, 1, 1)],
        "site_id int, url string, path string, status_code int, title string, is_active boolean, first_seen_at int, last_seen_at int, content_captured_at int")
    out = audit.merge_snapshot(pages.withColumn("url_hash", urls.url_hash("url")), newest, ["title"]).select("url", "url_hash", "path", "status_code", "title", "is_active", "first_seen_at", "last_seen_at", "content_captured_at")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "crawl_error" not in window.split("LogicalRDD")[0] and "sha2(" not in window
    got = {r.url: (r.path, r.status_code, r.title, r.is_active, r.first_seen_at, r.last_seen_at, r.content_captured_at) for r in out.collect()}
    assert got == {
        "https://a.test/x": ("/x", 500, "stored", True, 1, 5, 1), "https://a.test/y": ("/y", 200, "y", True, 4, 4, 4),
        "https://a.test/w": ("/w", 200, "stays", False, 1, 1, 1), None: (None, 200, "z", True, 4, 4, 4),
    }
    assert all(r.url_hash == (r.url and hashlib.sha256(r.url.encode()).hexdigest()) for r in out.collect())
