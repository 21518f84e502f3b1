"""Intent profiles, keyword tiers and keyword cannibalization for all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as ix
from ..functions import keywords as kx
from ..functions.impact import business_relevance, lead_potential, traffic_potential
from ..functions.numeric import lookup, rnd
from ..operators.ranking import first_per_key, top_per_key
from ..session import cut

# Source precedence, share of a page's score.
SOURCES = ("gsc", "semrush", "ai")
#: Entries per source for callers that want short lists; nothing is left out unless such limits are passed.
SOURCE_LIMITS = {"gsc": 20, "semrush": 20, "ai": 25}
BEST_KEYWORDS = 3
TEXTS = ("html", "content", "raw_text", "visible_text")
COMPETING_TIERS = ("primary", "secondary")
LISTED_PAGES = 20


KEYWORD_BATCH = 1000  # keywords of a source of a page that meet its text together


def keyword_sources(queries: DataFrame, snapshot_keywords: DataFrame, suggestions: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row per (page, keyword): search rows win over snapshot rows, these over suggestions.

    Inputs carry ``idx``, the 0-based place in their source list; ``limits`` keeps the first so many of a source. Rows are shuffled once, by page,
    and all that follows for a page (scores, ranks, means) finds them so; they are sorted there, spilled where they are many, and never held together.
    """

    def side(df: DataFrame, source: str, keyword: str, **columns: Column) -> DataFrame:
        null = lambda kind: F.lit(None).cast(kind)
        picks = {
            "position": null("double"),
            "impressions": null("long"),
            "demand_base": null("double"),
            "difficulty": null("double"),
            "given_tier": null("string"),
            **columns,
        }
        within = F.col("idx") < limits[source] if limits else F.lit(True)
        return df.filter(within & (F.trim(keyword) != "")).select(
            "page_id", F.lower(F.trim(keyword)).alias("keyword"), F.lit(source).alias("source"), "idx", *[c.alias(n) for n, c in picks.items()]
        )

    rows = (
        side(
            queries, "gsc", "query", position=F.col("position").cast("double"), impressions=F.col("impressions").cast("long"),
            demand_base=F.col("impressions").cast("double"),
        )
        .unionByName(
            side(
                snapshot_keywords, "semrush", "keyword", position=F.col("position").cast("double"),
                demand_base=F.col("volume") * 30.0, difficulty=F.col("difficulty").cast("double"),
            )
        )
        .unionByName(side(suggestions, "ai", "keyword", given_tier=F.col("tier")))
    )
    order = F.struct(lookup(F.col("source"), {s: i for i, s in enumerate(SOURCES)}, 9).alias("o"), "idx")
    payload = F.struct("source", "idx", "position", "impressions", "demand_base", "difficulty", "given_tier")
    return rows.repartition("page_id").groupBy("page_id", "keyword").agg(F.min_by(payload, order).alias("r")).select("page_id", "keyword", "r.*")


def score_keywords(keywords: DataFrame, pages: DataFrame, *, batch: int = KEYWORD_BATCH) -> DataFrame:
    """Tier and six factors of every keyword of a page.

    ``pages`` has page_id, site_id, detected_intent, business_relevance, the page text and, where known, ``headings``. The
    keywords of a page meet the page row in arrays, one for every ``batch`` places in their source lists, so the text is read once per
    array and not once per keyword, and a page of very many keywords is never gathered. Places tell the arrays apart without a count,
    so ``keywords`` is worked out once.
    """
    entry = F.struct("keyword", "source", "idx", "position", "impressions", "demand_base", "difficulty", "given_tier")
    dealt = keywords.repartition("page_id").withColumn("_part", F.floor(F.col("idx") / batch))
    lists = dealt.groupBy("page_id", "_part").agg(F.collect_list(entry).alias("_ks")).drop("_part")
    lowered = {f"_{c}": F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "h1", "content")}
    lowered["_headings"] = F.lower(F.coalesce(F.array_join("headings", " "), F.lit(""))) if "headings" in pages.columns else F.lit("")
    text = [F.col(f"_{c}") for c in ("title", "h1", "headings", "content")]
    relevant = F.transform(
        "_kts",
        lambda k: F.struct(k["k"].alias("k"), kx.content_relevance(k["k"]["keyword"], *text, terms=k["terms"], found=F.col("_found")).alias("content_relevance_score")),
    )
    rows = (
        pages.withColumns(lowered)
        .join(lists, "page_id")
        .withColumn("_kts", F.transform("_ks", lambda k: F.struct(k.alias("k"), kx.key_terms(k["keyword"]).alias("terms"))))
        .withColumn("_found", kx.found_terms(F.array_distinct(F.flatten("_kts.terms")), *text))
        .select("page_id", "site_id", "detected_intent", "business_relevance", F.explode(relevant).alias("e"))
        .select("page_id", "site_id", "detected_intent", "business_relevance", "e.content_relevance_score", "e.k.*")
    )
    ai = F.col("source") == "ai"
    given = F.replace(F.lower(F.col("given_tier")), F.lit(" "), F.lit("_"))
    # A column of its own: the match names it in every branch, and each would read the keyword again.
    rows = rows.withColumn("_guess", kx.intent_guess("keyword"))
    rows = rows.select(
        "site_id",
        "page_id",
        "keyword",
        "source",
        "idx",
        F.when(ai & given.isin(list(kx.TIER_CAPS)), given).otherwise(kx.assign_tier("keyword", "idx", "source")).alias("keyword_tier"),
        F.when(ai, 0.55).otherwise(kx.demand("demand_base")).alias("demand_score"),
        F.when(ai, 0.65).otherwise(kx.ranking_opportunity("position")).alias("ranking_opportunity_score"),
        kx.intent_match("_guess", "detected_intent").alias("intent_match_score"),
        F.col("business_relevance").alias("business_relevance_score"),
        "content_relevance_score",
        kx.competition_opportunity("position", "difficulty", "impressions").alias("competition_opportunity_score"),
        F.col("position").alias("current_position"),
        F.col("impressions").alias("current_impressions"),
    )
    factors = [c for c in rows.columns if c.endswith("_score")]
    return rows.withColumn("keyword_opportunity_score", kx.composite_score(*factors))


def ranked_keywords(scored: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Keywords of every page with their rank in their tier; with ``caps`` only the best of each tier, up to its cap."""
    source_order = lookup(F.col("source"), {s: i for i, s in enumerate(SOURCES)}, 9)
    order = [F.col("keyword_opportunity_score").desc(), source_order.asc(), F.col("idx").asc()]
    if caps is None:
        return scored.withColumn("tier_rank", F.row_number().over(Window.partitionBy("page_id", "keyword_tier").orderBy(*order)))
    ranked = top_per_key(scored, ["page_id", "keyword_tier"], order, max(caps.values()), "tier_rank")
    return ranked.filter(F.col("tier_rank") <= lookup(F.col("keyword_tier"), caps, 10))


def page_keyword_scores(capped: DataFrame, listed: dict[str, int] | None = None) -> DataFrame:
    """Mean of the best three keywords of each page, with its best keywords per tier.

    Lists hold ``listed`` keywords of a tier (by default the customary ones); all keywords are rows with their rank.
    """
    listed = kx.TIER_CAPS if listed is None else listed
    order = [F.col("keyword_opportunity_score").desc(), F.col("keyword").asc()]
    placed = capped.withColumn("_place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))
    is_listed = F.col("tier_rank") <= lookup(F.col("keyword_tier"), listed, 0)
    entry = F.struct("tier_rank", "keyword")
    # One aggregate for means and lists: the keywords are read once. A page without a listed keyword has no lists.
    out = placed.groupBy("page_id").agg(
        rnd(F.avg(F.when(F.col("_place") <= BEST_KEYWORDS, F.col("keyword_opportunity_score"))), 1).alias("keyword_opportunity_score"),
        F.count(F.when(is_listed, F.lit(1))).alias("_listed"),
        *[
            F.transform(F.array_sort(F.collect_list(F.when(is_listed & (F.col("keyword_tier") == tier), entry))), lambda e: e["keyword"]).alias(f"{tier}_keywords")
            for tier in COMPETING_TIERS
        ],
    )
    return out.withColumns({f"{tier}_keywords": F.when(F.col("_listed") > 0, F.col(f"{tier}_keywords")) for tier in COMPETING_TIERS}).drop("_listed")


def changed_pages(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pages without a profile for their current content hash (a null hash always counts as changed)."""
    known = profiles.filter("content_hash is not null").select("page_id", "content_hash").distinct()
    return pages.join(known, ["page_id", "content_hash"], "left_anti")


def classify(pages: DataFrame, queries: DataFrame, findings: DataFrame) -> DataFrame:
    """Add rule, statistical and final intent, page type and mismatch to every page.

    ``findings`` is (page_id, ai_intent, ai_confidence); ``queries`` as in ``statistical_intents``.
    """
    top = (
        top_per_key(queries, ["page_id"], [F.col("query_rank").asc()], 3, "_n")
        .groupBy("page_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "query"))), lambda e: e["query"]).alias("top_queries"))
    )
    # Verdicts on the page's own fields are computed below the joins, once per page.
    own = pages.withColumns(
        {
            "rule": ix.rule_intent("url", F.col("structured_data_types")),
            "targeting": ix.targeting_intent(F.col("title"), F.col("h1"), F.col("headings") if "headings" in pages.columns else None),
            "_prominent": F.lower(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("h1", F.lit("")))),
            "_body": F.lower(F.coalesce("content", F.lit(""))),
        }
    )
    rows = (
        own.join(ix.statistical_intents(queries), "page_id", "left")
        .join(top, "page_id", "left")
        .join(findings, "page_id", "left")
    )
    rows = rows.withColumn("intent", ix.tiered_intent(F.col("rule"), F.col("statistical"), F.col("ai_intent"), F.col("ai_confidence")))
    commercial, informational = ix.page_type_scores(
        F.col("intent.intent"), F.col("_prominent"), F.col("_body"), F.col("structured_data_types")
    )
    rows = rows.withColumn("business_intent", F.coalesce("rule.intent", "intent.intent"))
    return rows.withColumns(
        {
            "page_type": ix.page_type(commercial, informational),
            "mismatch": ix.mismatch(
                F.col("business_intent"), F.col("statistical"), F.col("targeting"),
                F.col("top_queries"), F.col("title"), F.col("h1"),
            ),
        }
    ).drop("_prominent", "_body", "targeting")


def intent_profiles(
    pages: DataFrame,
    queries: DataFrame,
    snapshot_keywords: DataFrame,
    findings: DataFrame,
    suggestions: DataFrame,
    existing: DataFrame | None = None,
    patterns: tuple[str, ...] = (),
    source_limits: dict[str, int] | None = None,
    tier_caps: dict[str, int] | None = None,
    keep_keywords: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(profiles, keyword rows) of the pages whose content changed; all pages when ``existing`` is None.

    All keywords of all sources are scored and kept, unless ``source_limits`` or ``tier_caps`` ask for fewer.

    ``pages`` carries text, metrics and site totals. Page classification and keyword scoring feed both
    outputs, so each is materialised once, without the text; keyword scoring reads that from ``pages``. Callers that use
    the profiles alone save writing all keyword rows with ``keep_keywords=False``.
    """
    todo = pages if existing is None else changed_pages(pages, existing)
    classified = cut(
        classify(todo, queries, findings).withColumns(
            {
                "detected_intent": F.col("intent.intent"),
                "intent_confidence": F.col("intent.confidence"),
                "business_relevance": business_relevance(patterns=patterns),
            }
        ).drop(*TEXTS)
    )
    sources = keyword_sources(queries, snapshot_keywords, suggestions, source_limits)
    read = todo.select("page_id", "title", "h1", "content", *(["headings"] if "headings" in todo.columns else []))
    judged = read.join(classified.select("page_id", "site_id", "detected_intent", "business_relevance"), "page_id")
    capped = ranked_keywords(score_keywords(sources, judged), tier_caps)
    capped = cut(capped) if keep_keywords else capped
    rows = classified.join(page_keyword_scores(capped), "page_id", "left").fillna({"keyword_opportunity_score": 0.0})
    rows = rows.withColumn("traffic_potential_score", traffic_potential())
    profiles = rows.withColumn("lead_potential_score", lead_potential(patterns=patterns)).select(
        "page_id",
        "site_id",
        "detected_intent",
        "intent_confidence",
        F.col("intent.method").alias("detection_method"),
        "business_intent",
        "page_type",
        "content_hash",
        F.col("mismatch.has_mismatch").alias("intent_mismatch"),
        F.col("mismatch.severity").alias("mismatch_severity"),
        F.col("mismatch.explanation").alias("mismatch_explanation"),
        F.col("mismatch.query_intent").alias("query_intent"),
        "primary_keywords",
        "secondary_keywords",
        "keyword_opportunity_score",
        "traffic_potential_score",
        "lead_potential_score",
    )
    return profiles, capped


def best_row_per_page(keywords: DataFrame) -> DataFrame:
    """The best-scoring row of every (site, keyword, tier, page); of equal ones a scored row, then the smallest ``row_id`` where there is one."""
    order = [F.coalesce("keyword_opportunity_score", F.lit(0.0)).desc(), F.coalesce("current_position", F.lit(9999.0)).asc(), F.col("source").asc()]
    order += [F.col("keyword_opportunity_score").desc_nulls_last(), *[F.col(c).asc() for c in ("row_id",) if c in keywords.columns]]
    return first_per_key(keywords, ["site_id", "keyword", "keyword_tier", "page_id"], order)


def touched_groups(keywords: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Rows of every keyword group that involves one of the given pages (other members kept)."""
    marks = keywords.join(page_ids.select("page_id"), "page_id", "left_semi")
    keys = ["site_id", "keyword", "keyword_tier"]
    return keywords.join(marks.select(*keys).distinct(), keys, "left_semi")


def cannibalization(keywords: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): keywords two or more pages of a site compete for, and the competing pages.

    Groups are aggregates; a group held by very many pages is never collected. The explanation names
    at most twenty competitors and counts the rest, all of them are rows of ``members``.
    """
    keys = ["site_id", "keyword", "keyword_tier"]
    rows = best_row_per_page(keywords.filter(F.col("keyword_tier").isin(*COMPETING_TIERS)))
    rows = cut(rows.join(pages.select("page_id", "url"), "page_id"))
    position, score = F.col("current_position"), F.col("keyword_opportunity_score")
    who = F.struct("page_id", "url")
    groups = (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.count(position).alias("_ranked"),
            F.count_if(position <= 10).alias("_top"),
            F.max(F.coalesce(score, F.lit(0.0))).alias("best_score"),
            F.max_by(who, F.struct(F.coalesce(score, F.lit(-1.0)), -F.coalesce(position, F.lit(9999.0)), -F.col("page_id"))).alias("canonical"),
            F.max_by("url", F.when(position.isNotNull(), -F.col("page_id"))).alias("_visible"),
        )
        .filter("page_count >= 2")
        .withColumn(
            "severity",
            F.when(F.col("_ranked") >= 2, F.when(F.col("_top") >= 2, "P0").otherwise("P1")).when(F.col("_ranked") == 1, "P2").otherwise("P3"),
        )
    )
    members = rows.join(groups.select(*keys, "severity", F.col("canonical.page_id").alias("canonical_page_id")), keys)
    rivals = members.filter(F.col("page_id") != F.col("canonical_page_id"))
    order = [F.coalesce("keyword_opportunity_score", F.lit(0.0)).desc(), F.col("page_id").asc()]
    listed = (
        top_per_key(rivals, keys, order, LISTED_PAGES, "_n")
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda e: e["url"]), ", ").alias("_others"))
    )
    groups = groups.join(listed, keys)
    return groups.select(
        *keys,
        "severity",
        "page_count",
        "best_score",
        F.col("canonical.page_id").alias("canonical_page_id"),
        F.col("canonical.url").alias("canonical_url"),
        _explanation().alias("explanation"),
    ), members


# The sentences of this function are results that must match.
def _explanation() -> Column:
    tier, own = F.col("keyword_tier"), F.col("canonical.url")
    more = F.col("page_count") - 1 - LISTED_PAGES
    others = F.concat("_others", F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    detail = (
        F.when(
            F.col("severity") == "P0",
            "Both pages currently rank in the top 10 for this term, which means Google is actively splitting authority "
            "between them and can swap which one it shows on any given crawl.",
        )
        .when(
            F.col("severity") == "P1",
            "Both pages currently rank for this term, diluting the ranking signal that would otherwise concentrate on a "
            "single page.",
        )
        .when(
            F.col("severity") == "P2",
            F.concat(
                "_visible",
                F.lit(
                    " already ranks for this term; the other page targets the same keyword without yet showing up in search, "
                    "so it is a duplicate target rather than a proven competitor — fix it before it starts competing for real."
                ),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Neither page currently ranks for this term, but both are written to target it as a "), tier,
                F.lit(" keyword — worth resolving before either one starts ranking and the two begin competing."),
            )
        )
    )
    return F.concat(
        F.lit('"'), F.col("keyword"), F.lit('" is targeted as a '), tier, F.lit(" keyword by "), F.col("page_count").cast("string"),
        F.lit(" pages on this site ("), own, F.lit(" and "), others, F.lit("). "), detail,
        F.lit(" Recommended fix: consolidate on "), own,
        F.lit(
            " as the canonical target — update its content to fully cover the term, and either 301-redirect, canonicalise, or "
            "re-target the competing page(s) to a different keyword."
        ),
    )


def merge_mismatch_findings(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Put each page's mismatch into the findings array of its newest recommendation.

    An existing mismatch entry keeps its place and takes the new explanation and priority; otherwise
    a new entry goes first. Page-level flags follow. ``findings`` has page_id and
    ``findings array<struct<issue,explanation,why_it_matters,recommended_fix,priority,effort,confidence,expected_impact>>``.
    """
    found = profiles.filter("intent_mismatch").select(
        "page_id", "mismatch_severity", "mismatch_explanation", "business_intent", "query_intent", "query_intent_confidence"
    )
    level = lookup(F.coalesce("mismatch_severity", F.lit("P1")), {"P0": "critical", "P1": "high", "P2": "medium", "P3": "low"}, "high")
    same = lambda f: f["issue"] == "search_intent_mismatch"
    entry = F.struct(
        F.lit("search_intent_mismatch").alias("issue"),
        F.col("mismatch_explanation").alias("explanation"),
        F.concat(
            F.lit("This page's business intent ("), F.col("business_intent"), F.lit(") conflicts with the dominant query intent reaching it ("),
            F.col("query_intent"),
            F.lit("). This misalignment suppresses conversions and can cause Google to re-classify the page, harming rankings."),
        ).alias("why_it_matters"),
        F.lit(
            "Re-align <title>, <h1>, and opening content to match the page's business intent. Update internal anchor text "
            "pointing to this page to use high-intent anchor text. Add a prominent CTA if transactional."
        ).alias("recommended_fix"),
        level.alias("priority"),
        F.lit("medium").alias("effort"),
        rnd("query_intent_confidence", 2).alias("confidence"),
        F.lit(
            "Aligning page intent with content and internal linking typically lifts conversion rates and improves topical "
            "relevance signals to search engines."
        ).alias("expected_impact"),
    )
    updated = F.transform(
        "findings",
        lambda f: F.when(
            same(f), f.withField("explanation", F.col("mismatch_explanation")).withField("priority", level)
        ).otherwise(f),
    )
    merged = F.when(F.exists("findings", same), updated).otherwise(F.concat(F.array(entry), F.col("findings")))
    return findings.join(found, "page_id", "left").select(
        *[c for c in findings.columns if c != "findings"],
        F.when(F.col("mismatch_explanation").isNotNull(), merged).otherwise(F.col("findings")).alias("findings"),
        F.col("mismatch_explanation").isNotNull().alias("intent_mismatch"),
        "mismatch_severity",
        "mismatch_explanation",
    )
