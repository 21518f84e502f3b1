"""Recommendation catalogue: what each kind of change can move, and at what effort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, label, search leverage, activity leverage, ceiling, effort, mechanism.
ROWS = (
    ("http_status", "Fix HTTP status", 1.00, 0.85, 1.00, "high", "a URL that does not return 200 cannot rank or convert at all"),
    ("robots", "Fix robots directive", 1.00, 0.30, 1.00, "low", "a noindex directive removes the page from search entirely"),
    ("canonical", "Add canonical URL", 0.80, 0.05, 0.55, "low", "without a canonical, duplicate variants compete for the same rankings"),
    ("canonical_multiple", "Resolve conflicting canonicals", 0.90, 0.05, 0.75, "low", "conflicting canonicals are resolved arbitrarily by search engines"),
    ("canonical_target", "Correct canonical target", 0.90, 0.05, 0.80, "low", "a canonical pointing elsewhere de-indexes this URL in favour of another"),
    ("redirect_chain", "Shorten redirect chain", 0.55, 0.35, 0.40, "medium", "each hop costs crawl budget and a little link equity, and slows the user"),
    ("url_structure", "Improve URL structure", 0.40, 0.15, 0.25, "high", "readable URLs help relevance signals marginally; changing them risks redirects"),
    ("title", "Rewrite title tag", 1.00, 0.20, 0.95, "low", "the title is the strongest on-page relevance signal and the SERP headline"),
    ("title_multiple", "Remove duplicate title tags", 0.70, 0.05, 0.50, "low", "a second title tag makes the displayed headline unpredictable"),
    ("duplicate_title", "Differentiate duplicate titles", 0.85, 0.10, 0.70, "medium", "pages sharing a title compete with each other for the same queries"),
    ("meta_description", "Rewrite meta description", 0.85, 0.25, 0.65, "low", "the description drives SERP click-through without affecting ranking directly"),
    ("meta_description_multiple", "Remove duplicate meta descriptions", 0.50, 0.05, 0.35, "low", "a second description tag makes the displayed snippet unpredictable"),
    ("duplicate_meta_description", "Differentiate duplicate descriptions", 0.55, 0.10, 0.40, "medium", "identical descriptions across pages waste the snippet's differentiating power"),
    ("open_graph", "Add Open Graph metadata", 0.15, 0.55, 0.30, "low", "shared links render as rich cards, lifting referral click-through"),
    ("viewport", "Add mobile viewport", 0.55, 0.85, 0.60, "low", "without a viewport the page renders unusably on mobile, where most traffic is"),
    ("h1", "Fix H1 heading", 0.85, 0.40, 0.80, "low", "the H1 confirms the page's topic to both readers and search engines"),
    ("heading_structure", "Improve subheading structure", 0.55, 0.55, 0.45, "medium", "subheadings carry secondary keywords and make long content scannable"),
    ("heading_depth", "Fix heading hierarchy", 0.30, 0.35, 0.20, "low", "skipped heading levels weaken document structure for assistive tech and parsers"),
    ("empty_headings", "Remove empty headings", 0.20, 0.20, 0.15, "low", "empty headings add structural noise without conveying anything"),
    ("content", "Expand or deepen content", 0.90, 0.80, 0.90, "high", "topical depth drives both ranking breadth and time on page"),
    ("duplicate_content", "Resolve duplicate content", 0.85, 0.20, 0.70, "high", "near-identical pages split ranking signals between themselves"),
    ("internal_links", "Add outgoing internal links", 0.60, 0.55, 0.45, "low", "internal links distribute authority and give readers a next step"),
    ("orphan_page", "Link to this orphan page", 0.85, 0.45, 0.75, "medium", "a page nothing links to is barely crawled and rarely found"),
    ("broken_links", "Fix broken internal links", 0.50, 0.70, 0.45, "low", "broken links waste crawl budget and dead-end the reader"),
    ("external_links", "Review outbound links", 0.20, 0.20, 0.15, "low", "outbound links to quality sources support topical credibility"),
    ("image_alt", "Add image alt text", 0.25, 0.30, 0.30, "low", "alt text serves accessibility and image search, but rarely moves page rankings"),
    ("image_dimensions", "Set image dimensions", 0.20, 0.45, 0.25, "low", "explicit dimensions prevent layout shift, which affects Core Web Vitals"),
    ("structured_data", "Add structured data", 0.60, 0.35, 0.50, "medium", "schema markup enables rich results, which lift SERP click-through"),
    ("hreflang", "Fix hreflang annotations", 0.55, 0.25, 0.35, "medium", "hreflang routes each language's users to the right variant"),
    ("search_intent_mismatch", "Re-align page with its search intent", 0.95, 0.95, 1.00, "high", "a page answering the wrong intent attracts traffic that cannot convert"),
    ("keyword_targeting", "Re-target primary keywords", 0.95, 0.45, 0.85, "medium", "aligning the page with the keywords it can realistically win concentrates its signals"),
    ("ctr_opportunity", "Improve SERP click-through", 1.00, 0.55, 0.85, "low", "impressions already exist; a better snippet converts them into clicks with no ranking change"),
    ("cta_visibility", "Improve call-to-action visibility", 0.10, 1.00, 0.85, "medium", "traffic that already arrives converts more often when the next step is obvious"),
)
DEFAULT_TYPE = ("other", "Other improvement", 0.50, 0.50, 0.50, "medium", "general on-page quality")

SCHEMA = (
    "check_type string, label string, search_leverage double, activity_leverage double, ceiling double, "
    "effort string, mechanism string"
)


def rows() -> list[tuple]:
    return list(ROWS)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def with_catalogue(df: DataFrame, check_type: str = "check_type") -> DataFrame:
    """Attach catalogue columns; unknown types get the neutral default row and type 'other'.

    The catalogue is a literal table of 33 rows, so the broadcast size is fixed.
    """
    lookup = catalogue(df.sparkSession).withColumnRenamed("check_type", check_type)
    joined = df.join(F.broadcast(lookup), check_type, "left")
    key, *defaults = DEFAULT_TYPE
    names = ("label", "search_leverage", "activity_leverage", "ceiling", "effort", "mechanism")
    known = F.col("label").isNotNull()
    return joined.withColumns(
        {
            "recommendation_type": F.when(known, F.col(check_type)).otherwise(F.lit(key)),
            **{n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names, defaults)},
        }
    )
