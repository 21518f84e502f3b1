import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from siteledger.operators import rules
from siteledger.plans import audit
from siteledger.sources import markup
from siteledger.sources.html import extract_pages
from verification import q_audit
from verification.compare import compare

PAGE = "https://www.acme.test/shop/item"


def page(spark, html, status=200, headers=None):
    df = spark.createDataFrame(
        [(PAGE, html, "acme.test", status, headers)], "url string, html string, base_domain string, status_code int, headers map<string,string>"
    )
    return extract_pages(df).first()


def doc(head="", body=""):
    return f"<html lang='en'><head>{head}</head><body>{body}</body></html>"


CASES = [
    ("title", doc("<title> A  b </title>"), {"title": "A b", "title_count": 1}),
    ("title twice", doc("<title>One</title><title>Two</title>"), {"title": "One", "title_count": 2}),
    ("svg title is no page title", doc("", "<svg><title>icon</title></svg>"), {"title": None, "title_count": 0}),
    ("description by property", doc("<meta property='Description' content=' d '>"), {"meta_description": "d", "meta_description_count": 1}),
    ("first non-empty description", doc("<meta name=description content=''><meta name=description content=x>"), {"meta_description": "x", "meta_description_count": 2}),
    ("canonical missing", doc(), {"canonical_status": "missing", "canonical_count": 0}),
    ("canonical self", doc(f"<link rel=canonical href='{PAGE}/'>"), {"canonical_status": "self"}),
    ("canonical other", doc("<link rel=canonical href='https://x.test/'>"), {"canonical_status": "other", "canonical_url": "https://x.test/"}),
    ("canonical relative", doc("<link rel=canonical href='/other'>"), {"canonical_status": "relative", "canonical_url": "https://www.acme.test/other"}),
    ("canonical empty", doc("<link rel=canonical href=' '>"), {"canonical_status": "empty"}),
    ("canonical invalid", doc("<link rel=canonical href='mailto:a@b'>"), {"canonical_status": "invalid"}),
    ("canonical twice", doc("<link rel=canonical href=/a><link rel=canonical href=/b>"), {"canonical_status": "multiple", "canonical_count": 2}),
    ("several h1", doc("", "<h1>A</h1><h1>B</h1><h1></h1>"), {"h1": "A | B", "h1_count": 3, "empty_heading_count": 1}),
    ("no h1", doc("", "<h2>x</h2>"), {"h1": None, "h1_count": 0, "h2_count": 1}),
    ("visible heading preferred", doc("", "<div hidden><h1>no</h1></div><h1>yes</h1>"), {"h1": "yes", "h1_count": 1}),
    ("hidden heading as fallback", doc("", "<h1 style='display:none'>only</h1>"), {"h1": "only", "h1_count": 1}),
    ("images", doc("", "<img src=a.png alt=x width=1 height=2><img src=b.png><img src=c.png alt=''>"), {"image_count": 3, "missing_alt_count": 1, "empty_alt_count": 1, "images_without_dimensions": 2}),
    ("tracking pixels", doc("", "<img src=/t.gif width=1 height=1><img src=/pixel/x><img src=/photos/pixelated-art.jpg>"), {"image_count": 1, "tracking_pixel_count": 2}),
    ("links", doc("", "<a href=/a>a</a><a href=/a>b</a><a href=https://x.test rel='nofollow ugc'>c</a><a href=tel:1>t</a>"), {"internal_link_count": 1, "external_link_count": 1, "nofollow_link_count": 1, "ugc_link_count": 1, "non_http_link_count": 1}),
    ("tracked link stays distinct", doc("", "<a href=/a>a</a><a href='/a?utm_source=c'>b</a>"), {"internal_link_count": 2}),
    ("pagination joins links", doc("<link rel=next href=/p2>"), {"pagination_next": "https://www.acme.test/p2", "internal_link_count": 1}),
    ("json-ld", doc('<script type="application/ld+json">{"@type":"Product","o":{"@type":["Offer"]}}</script>'), {"structured_data_types": ["Product", "Offer"], "structured_data_invalid": False}),
    ("broken json-ld", doc('<script type="application/ld+json">{"@type":}</script>'), {"has_structured_data": True, "structured_data_invalid": True}),
    ("microdata and rdfa", doc("", "<p itemtype='https://schema.org/Event/'></p><p typeof='schema:Person'></p>"), {"structured_data_types": ["Event", "Person"], "structured_data_formats": ["microdata", "rdfa"]}),
    ("hidden and script text", doc("", "<p>one two</p><p hidden>three</p><script>x y z</script>"), {"visible_word_count": 2, "raw_word_count": 3, "word_count": 2}),
    ("landmark without chrome", doc("", "<nav>menu here</nav><main>body <nav>inner</nav>text</main>"), {"content": "body text", "content_scope": "main"}),
    ("thin landmark falls back", doc("", "<main>hero</main><section>" + "word " * 400 + "</section>"), {"content_scope": "body", "word_count": 401}),
    ("unclosed markup", "<title>T</title><p>one<p>two<b>three", {"title": "T", "word_count": 3}),
    ("viewport, og, lang", doc("<meta name=Viewport content='width=1'><meta property=og:title content=x>"), {"has_viewport": True, "has_open_graph": True, "lang": "en"}),
    ("feeds are no hreflang", doc("<link rel=alternate hreflang=de href=/de><link rel=alternate type=application/rss+xml hreflang=en href=/f>"), {"hreflang": [("de", "/de")]}),
    ("empty document", "", {"crawl_quality": "partial", "word_count": 0}),
]


def test_fixtures(spark):
    rows = [(name, PAGE, html, "acme.test") for name, html, _ in CASES]
    got = {r.name: r for r in extract_pages(spark.createDataFrame(rows, "name string, url string, html string, base_domain string")).collect()}
    for name, _, expected in CASES:
        for column, value in expected.items():
            actual = got[name][column]
            actual = [tuple(x) if isinstance(x, tuple) else x for x in actual] if isinstance(actual, list) else actual
            assert actual == value, (name, column, actual)


def test_headers_and_failed_fetch(spark):
    row = page(spark, doc(), 0, {"X-Robots-Tag": "noindex", "Content-Type": "text/html; charset=UTF-8"})
    assert (row.x_robots_tag, row.charset, row.crawl_quality) == ("noindex", "utf-8", "failed")


def test_audit_of_two_small_sites(spark):
    body = "<h1>T</h1>" + "<p>" + "word " * 60 + "</p><a href=/b>b</a><a href=/gone>g</a>"
    rows = [
        ("https://a.test/a", doc("<title>Same title</title>", body), "a.test", 200),
        ("https://a.test/b", doc("<title> same TITLE </title>", body), "a.test", 200),
        ("https://a.test/gone", "", "a.test", 404),
        ("https://b.test/", doc("<title>Same title</title>", body), "b.test", 200),
    ]
    pages = extract_pages(spark.createDataFrame(rows, "url string, html string, base_domain string, status_code int")).withColumn("site_id", F.col("base_domain"))
    out = {r.url: r for r in audit.audit_pages(pages).collect()}
    a, b, gone, home = (out[r[0]] for r in rows)
    assert (a.duplicate_title_count, b.duplicate_title_count, home.duplicate_title_count) == (2, 2, 0)
    assert a.duplicate_title_examples == ["https://a.test/b"]
    assert (a.broken_link_count, b.inbound_internal_links, a.inbound_internal_links) == (1, 2, 0)
    assert {c.rule_id for c in gone.checks if c.status != "skipped"} == {"http_status", "redirect_chain"}
    assert gone.highest_severity == "CRITICAL" and gone.seo_score == pytest.approx(100.0 * 4 / 14, abs=0.05)
    assert len(a.checks) == len(rules.REGISTRY) == 29


def test_weights_sum_per_check_type():
    assert rules.registered_weights()["content"] == 20.0
    assert audit.check_weights({"title": 1.0})["title"] == 1.0


def _texts(markup):
    from siteledger.sources.html import _tokenise

    found = _tokenise(markup)
    assert "error" not in found
    return found["visible_text"], {n["tag"]: n["text"] for n in reversed(found["nodes"])}


def test_missing_end_tags_are_supplied():
    assert _texts("<title>Broken<body><h1>Heading<p>Some text here")[1] == {"title": "Broken", "h1": "Heading"}
    assert _texts("<ul><li hidden>a<li>b<li>c</ul>")[0] == "b c"
    assert _texts('<p style="display:none">x<p>y')[0] == "y"
    assert _texts("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>e")[0] == "b d e"
    assert _texts("<dl><dt hidden>t<dd>d</dl>")[0] == "d"
    assert _texts("<select><option hidden>a<option>b</select>")[0] == "b"
    assert _texts("<a href=/1>one<a href=/2>two</a> three")[1]["a"] == "one"
    assert _texts("<h2>one<h2>two<p>three")[1]["h2"] == "one"
    assert _texts("<ul><li>a<ul><li hidden>b</ul>c<li>d</ul>")[0] == "a c d"


def test_many_open_paragraphs_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        _texts("<p>x" * n)
        return time.process_time() - began

    seconds(2000)
    assert seconds(32_000) < 10 * max(seconds(8000), 0.02)


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    from siteledger.sources import html

    monkeypatch.setattr(html, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"html": ["a" * 4, "b" * 4, "c" * 4, None, "d" * 40, "e"]})
    parts = [p.column(0).to_pylist() for p in html._parts(iter([batch]), "html")]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist() and len(parts) == 4


# ── character references ─────────────────────────────────────────────────────
REFERENCES = '<html><head><title>A &quot;b&quot; &amp;lt; c&amp</title></head><body><a href="https://b.test/?x=1&copy=2&amp;y=3" rel="nofollow">l</a><img alt="&copy"><article><h1>d &lt e&amp</h1></article></body></html>'


def test_references_without_semicolon(spark):
    rows = spark.createDataFrame([(1, "https://a.test/", REFERENCES)], "page_id long, url string, html string").withColumn("base_domain", F.lit("a.test"))
    page, second = extract_pages(rows).first(), markup.markup_signals(rows).first()
    for title, h1 in ((page.title, page.h1), (second.title, second.h1_text)):
        assert (title, h1) == ('A "b" &lt; c&', "d < e&")
    assert (second.external_links, second.nofollow_links) == (1, 1)


def test_sql_of_page_texts_reads_references_as_html_does(spark, tmp_path):
    """Texts cut inside a reference, quotes, and tags that are text: the SQL of the extraction gives what the extraction gives."""
    texts = ["x &amp;&amp;&amp", "y &quot;z&quot;", "w &amp;lt;", "v &lt;b&gt; u", "plain"]
    pages = [(i, f"https://a.test/{i}", f'<html lang="en"><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t * 30}</p></article></body></html>') for i, t in enumerate(texts)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for key in ("src01_page_signals", "scl02_hashes", "flt07_render_needed", "flt07_render_needed_by_default"):
        text, ok = compare(spark, con, key, queries()[key], oracle_sql()[key], str(tmp_path))
        assert ok, f"{key}: {text}"
    lengths = dict(con.execute(f"SELECT page_id, length({q_audit._plain(q_audit._ARTICLE)}) FROM pages").fetchall())
    assert lengths == {r.page_id: r.landmark_length for r in extract_pages(rows.withColumn("base_domain", F.lit("a.test"))).collect()}
