import pytest
from pyspark.sql import functions as F

from siteledger.functions import robots, urls


def values(spark, rows, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "HTTPS://WWW.Acme.test:443/A//b/?utm_source=x&b=2&a=1#frag": "https://www.acme.test/A/b?a=1&b=2",
        "http://acme.test:80": "http://acme.test/",
        "https://acme.test/?page=1": "https://acme.test/",
        "https://acme.test/p?page=2&sort=asc": "https://acme.test/p?page=2",
        "https://acme.test/p;v=1?q=a%20b+c": "https://acme.test/p?q=a+b+c",
        "https://acme.test/p?blank=&~x=1*": "https://acme.test/p?blank=&~x=1%2A",
    }
    assert values(spark, list(cases), urls.normalize_url) == list(cases.values())


def test_url_identity_ignores_tracking_only(spark):
    a, b, c = values(spark, ["https://a.test/x?gclid=1", "https://a.test/x/", "https://a.test/x?id=1"], urls.url_hash)
    assert a == b != c


def test_content_hash_collapses_whitespace_and_case(spark):
    a, b, blank = values(spark, ["Hello   World", " hello\nworld ", "  "], urls.content_hash)
    assert a == b and blank is None


def test_resolve_link(spark):
    base = F.lit("https://acme.test/blog/post?x=1")
    hrefs = ["next", "../up/./a", "/root/", "?q=2", "//cdn.test/z", "WWW.other.test/p", "mailto:x@y.z", "#top", "/tel:123", ""]
    assert values(spark, hrefs, lambda c: urls.resolve_link(base, c)) == [
        "https://acme.test/blog/next", "https://acme.test/up/a", "https://acme.test/root", "https://acme.test/blog/post?q=2", "https://cdn.test/z",
        "https://www.other.test/p", None, None, None, None,
    ]


def test_page_admission_predicates(spark):
    paths = ["/blog/blog/x", "/en/en/x", "/a/www.site.com/b", "/api/v1", "/api-docs/", "/x.PDF", "/v1.2/page", "/sign-in"]
    got = values(spark, ["https://a.test" + p for p in paths], urls.is_probably_page)
    assert got == [False, True, False, False, True, False, True, True]


@pytest.mark.parametrize(
    "meta, header, directives",
    [
        ("max-image-preview:none", None, []),
        ("noindex, Follow", None, ["follow", "noindex"]),
        (None, "bingbot: noindex", []),
        (None, "googlebot: noindex\nnoarchive", ["noarchive", "noindex"]),
        ("none", "max-snippet: -1", ["none"]),
    ],
)
def test_robots_directives(spark, meta, header, directives):
    row = spark.createDataFrame([(meta, header)], "m string, h string").select(robots.resolve("m", "h").alias("d")).first()
    assert row.d.directives == directives
