import random
import re

import pytest
from pyspark.sql import functions as F

from siteledger.plans import audit
from siteledger.session import cut
from siteledger.sources import robots_txt, sitemaps


# ── robots: longest match by prefix ──────────────────────────────────────────
def compiled(rules):
    for kind, value in rules:
        if value:
            pattern = "^" + ".*".join(re.escape(x) for x in value.removesuffix("$").split("*")) + ("$" if value.endswith("$") else "")
            yield kind, len(value), re.compile(pattern, re.S)


def allowed(path, rules):
    best = {"allow": -1, "disallow": -1}
    for kind, size, pattern in rules:
        if size > best[kind] and pattern.search(path):
            best[kind] = size
    return best["disallow"] < 0 or best["allow"] >= best["disallow"]


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_many_rules_of_one_origin(spark, limit):
    rng = random.Random(1)
    part = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    rules = [(rng.choice(["allow", "disallow"]), "/" + "/".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "/", "*", "$", "*/b", "*c$", "?q="])) for _ in range(2000)]
    rules += [("disallow", "*"), ("disallow", "/"), ("allow", "/$"), ("disallow", "/*?"), ("allow", "")][1:]
    paths = ["/", "", "/a", "/a?q=1", "/c/"] + ["/" + "/".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "?q=1", ".b"]) for _ in range(400)]
    urls = spark.createDataFrame([(i, f"https://{'A' if i % 9 == 0 else 'a'}.test{p}") for i, p in enumerate(paths)] + [(-1, "https://b.test/a"), (-2, None), (-3, "https://a.test/a")], "i int, url string")
    table = spark.createDataFrame([("https://a.test", k, v, i) for i, (k, v) in enumerate(rules)], "origin string, kind string, value string, pos int")
    got = {r.i: r.allowed for r in robots_txt.allow_urls(urls, table, limit=limit).collect()}
    known = list(compiled(rules))
    assert got == {i: allowed(p or "/", known) for i, p in enumerate(paths)} | {-1: True, -2: True, -3: allowed("/a", known)}


def test_robots_tasks_stay_even(spark, tasks):
    """One origin with most URLs, most of them under one directory with a rule."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 20_000
        urls = cut(spark.range(n).selectExpr("id as i", "if(id % 20 = 0, concat('https://b', id, '.test/x'), concat('https://a.test/p/', id)) as url"))
        rules = spark.createDataFrame([("https://a.test", "disallow", "/p/", 0), ("https://a.test", "allow", "/p/1", 1), ("https://b0.test", "disallow", "/", 2)], "origin string, kind string, value string, pos int")
        with tasks() as seen:
            got = {r.i: r.allowed for r in robots_txt.allow_urls(urls, rules, limit=500).collect()}
        assert got == {i: (i != 0) if i % 20 == 0 else str(i)[0] == "1" for i in range(n)}
        assert 0 < seen.most_rows() < n * 0.25  # of up to two probes per URL
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ── sitemaps: documents are parsed once ──────────────────────────────────────
def test_walk_parses_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(sitemaps, "COMPACT", 3)
    index = lambda *c: "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.test/{x}</loc></sitemap>" for x in c) + "</sitemapindex>"
    pages = lambda *c: "<urlset>" + "".join(f"<url><loc>https://a.test/{x}</loc></url>" for x in c) + "</urlset>"
    bodies = {f"m{i}": index(f"m{i + 1}", "m0", "gone") for i in range(8)} | {"m8": pages("p1", "p2"), "alone": pages("p3")}
    docs = spark.createDataFrame([(1, f"https://a.test/{k}", v) for k, v in bodies.items()], "site_id int, sitemap_url string, body string").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        reads.add(1)
        return body

    seeds = spark.createDataFrame([(1, "https://a.test/m0"), (1, "https://a.test/none")], "site_id int, sitemap_url string")
    parsed = sitemaps.parse_documents(docs.withColumn("body", counted.asNondeterministic()("body")))
    found, dropped = sitemaps.walk(parsed, seeds)
    got = {r.sitemap_url.rpartition("/")[2]: (r.depth, len(r.entries)) for r in found.collect()}
    assert got == {f"m{i}": (i, 2 if i == 8 else 0) for i in range(9)} and dropped.count() == 0
    assert reads.value == len(bodies)
    limited, dropped = sitemaps.walk(sitemaps.parse_documents(docs), seeds, max_depth=2, max_children=2)
    assert sorted(r.depth for r in limited.collect()) == [0, 1, 2]
    assert sorted((r.reason, r.n) for r in dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()) == [("too_deep", 3), ("too_many", 2)]


# ── duplicates ───────────────────────────────────────────────────────────────
def test_duplicate_groups_of_a_large_site(spark, tasks):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 20_000
        pages = cut(spark.range(n).selectExpr(
            "1 as site_id", "concat('u', lpad(id, 6, '0')) as url", "cast(null as string) as final_url", "if(id % 2 = 0, ' Home ', if(id % 2 = 1 and id < 9, 'home', concat('t', id))) as title",
            "if(id % 10 = 0, '', 'm') as meta_description", "if(id < 3, 60, 10) as word_count", "'c' as content_hash",
        ))
        with tasks() as seen:
            got = {r.url: r for r in audit.annotate(pages, limit=500).collect()}
        assert len(got) == n
        row = got["u000002"]
        assert (row.duplicate_title_count, row.duplicate_title_examples) == (n // 2 + 4, ["u000000", "u000001", "u000003", "u000004", "u000005"])
        assert (row.duplicate_meta_count, row.duplicate_content_count, row.duplicate_content_examples) == (n * 9 // 10, 3, ["u000000", "u000001"])
        row = got["u000011"]
        assert (row.duplicate_title_count, row.duplicate_title_examples, row.duplicate_content_count) == (0, None, 0)
        assert got["u000010"].duplicate_meta_count == 0
        assert 0 < seen.most_rows() < 3 * n * 0.15
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_without_a_site_are_in_no_group(spark):
    rows = [(None, "a", None, "T", None, 0, None), (None, "b", None, "t ", "", 0, None), (1, "c", "d", None, "x", 99, None), (1, "c", "d", None, "x", 99, None), (1, "e", None, None, "x", 99, "h")]
    pages = spark.createDataFrame(rows, "site_id int, url string, final_url string, title string, meta_description string, word_count int, content_hash string")
    got = sorted((r.url, r.duplicate_title_count, r.duplicate_title_examples, r.duplicate_meta_count, r.duplicate_meta_examples) for r in audit.annotate(pages).collect())
    assert got == [("a", 0, None, 0, None), ("b", 0, None, 0, None), ("c", 0, None, 3, ["e"]), ("c", 0, None, 3, ["e"]), ("e", 0, None, 3, ["d", "d"])]


def test_examples_of_a_url_that_pages_share(spark):
    """A page whose url other pages have as well still gets five examples of other urls."""
    urls = ["https://a.test/"] * 3 + [f"https://a.test/{i}" for i in range(6)]
    pages = spark.createDataFrame([(1, i, u, None, "Same", None, None, 0) for i, u in enumerate(urls)], "site_id int, page_id long, url string, final_url string, title string, meta_description string, content_hash string, word_count int")
    got = {r.page_id: r.duplicate_title_examples for r in audit.annotate(pages).collect()}
    assert got[0] == [f"https://a.test/{i}" for i in range(5)] and len(got) == 9
    assert got[8] == ["https://a.test/"] * 3 + ["https://a.test/0", "https://a.test/1"]


def test_a_walk_sends_no_level_to_every_task(spark):
    docs = spark.createDataFrame([(1, "a", "<sitemapindex><sitemap><loc>b</loc></sitemap></sitemapindex>"), (1, "b", "<urlset><url><loc>u</loc></url></urlset>")], "site_id int, sitemap_url string, body string")
    seeds = spark.createDataFrame([(1, "a")], "site_id int, sitemap_url string")
    found = sitemaps.walk(sitemaps.parse_documents(docs), seeds)[0]
    assert sorted((r.sitemap_url, r.depth) for r in found.collect()) == [("a", 0), ("b", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
