"""Search intent, page type and intent mismatch as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keywords import intent_guess, words
from .numeric import col, lookup, rnd

# Confidence gate, URL pattern banks in evaluation order, schema types.
CONFIDENT = 0.75
URL_BANKS = (
    (
        "transactional",
        0.88,
        r"/(checkout|cart|basket|order|book(ing)?|purchase|buy|pay(ment)?|reservation|reserve|subscribe|signup|sign-up|"
        r"register|enroll|apply|appointment|schedule|ticket|tickets|donate|quote-request)",
    ),
    (
        "local",
        0.82,
        r"/(location|directions?|map|near-me|local|city|region|state|address|store|branch|dealer|showroom|outlet|nearme)",
    ),
    (
        "navigational",
        0.86,
        r"/(login|log-in|logout|sign-in|signout|account|profile|dashboard|admin|sitemap|robots\.txt|terms|privacy|cookie|"
        r"contact|about|team|careers|press|legal)",
    ),
    (
        "informational",
        0.84,
        r"/(blog|article|news|post|guide|tutorial|how-to|howto|tips|learn|education|resource|glossary|definition|wiki|"
        r"what-is|why-is|faq|help|support|introduction|overview|history|explained?|understanding|insight|timings?|hours)",
    ),
    (
        "commercial",
        0.82,
        r"/(compare|comparison|review|rating|ranking|best-|vs\.?-|versus|top-\d+|price|pricing|cost|alternative|option|"
        r"feature|plan|package|quote|estimate|deal|offer|discount)",
    ),
)
SCHEMA_INTENTS = (
    (("offer",), "transactional", 0.90),
    (("article", "newsarticle", "blogposting"), "informational", 0.90),
    (("localbusiness", "restaurant", "hotel"), "local", 0.90),
    (("faqpage",), "informational", 0.85),
)
# Query words and phrases per intent; the order breaks ties.
QUERY_BANKS = {
    "transactional": (
        (
            "buy", "book", "booking", "order", "purchase", "reserve", "booked", "hire", "rent", "download", "subscribe",
            "register", "apply", "price", "prices", "pricing", "cost", "cheap", "discount", "offer", "deal", "tickets", "ticket",
            "checkout",
        ),
        ("sign up", "best price", "book online", "buy online", "order online", "book now"),
    ),
    "commercial": (
        (
            "best", "top", "review", "reviews", "compare", "comparison", "vs", "versus", "alternative", "alternatives",
            "recommended", "rating", "ranking", "list",
        ),
        ("best of", "vs.", "compared to"),
    ),
    "local": (
        (
            "near", "nearby", "directions", "address", "location", "map", "local", "around",
        ),
        ("near me", "close to me", "in my area", "opening hours"),
    ),
    "informational": (
        (
            "how", "what", "when", "where", "why", "who", "which", "guide", "tutorial", "learn", "understand", "explain",
            "definition", "meaning", "history", "about", "timings", "hours", "schedule",
        ),
        ("how to", "what is", "why is", "how do", "how much time"),
    ),
    "navigational": (
        (
            "login", "account", "website", "official", "site", "portal", "contact",
        ),
        ("sign in", "log in", "customer portal"),
    ),
}
# Page-type vocabulary.
COMMERCIAL_STEMS = [
    "buy", "order", "book", "pric", "cost", "checkout", "cart", "subscrib", "trial", "demo", "quot", "purchas", "reserv", "ticket", "plan",
    "packag", "discount", "shop",
]
COMMERCIAL_PHRASES = ("add to cart", "get started", "sign up", "buy now", "book now")
INFORMATIONAL_STEMS = [
    "what", "why", "how", "guid", "learn", "histor", "explain", "overview", "introduc", "tip", "example", "mean", "defin", "faq",
    "question", "understand",
]
INFORMATIONAL_PHRASES = ("how to", "what is", "a guide to", "everything you need")
COMMERCIAL_SCHEMA = ["product", "offer", "aggregateoffer", "service", "event"]
INFORMATIONAL_SCHEMA = ["article", "blogposting", "newsarticle", "faqpage", "howto"]
# Fixed values: (business intent, observed intent) pairs that conflict.
MISMATCH = {
    ("transactional", "informational"): "P0",
    ("transactional", "navigational"): "P1",
    ("commercial", "informational"): "P1",
    ("informational", "transactional"): "P1",
    ("local", "informational"): "P2",
    ("local", "commercial"): "P2",
    ("navigational", "commercial"): "P2",
    ("navigational", "transactional"): "P2",
}
# Explanation templates; {b} business, {q} observed intent, {s} subject, {e} evidence.
EXPLANATIONS = {
    ("transactional", "informational"): (
        "This page is designed for {b} actions (booking / purchase), but {s} — {e} — are informational in nature. "
        "Visitors arrive seeking information, not to complete a transaction, which depresses conversion rates. "
        "Recommended fix: re-align <title>, <h1>, and opening copy to high-intent transactional keywords; add prominent "
        "CTAs above the fold."
    ),
    ("transactional", "navigational"): (
        "The page handles {b} actions but is primarily reached via navigational signals ({e}). This points at a specific "
        "brand or site rather than intending to complete a transaction. Add transactional keywords to the title and meta "
        "description to capture users with purchase intent."
    ),
    ("commercial", "informational"): (
        "This comparison / commercial page is framed informationally by {s} ({e}). Users want general information rather "
        "than to evaluate purchase options. Add a decision-focused CTA section and strengthen commercial signals in the "
        "<h1> and meta description."
    ),
    ("informational", "transactional"): (
        "This informational page carries transactional signals in {s} ({e}). Users ready to buy or book are landing on "
        "content that doesn't fulfil that intent. Add a clear conversion path (CTA / link to booking) to capture this "
        "high-intent traffic."
    ),
}
DEFAULT_EXPLANATION = (
    "Business intent ({b}) conflicts with the dominant query intent ({q}). Evidence from {s}: {e}. Review <title>, <h1>, "
    "and content framing to better align with the page's primary purpose."
)
NO_EVIDENCE = "Neither search queries nor page copy gave a strong enough intent signal to judge alignment."

VERDICT = "struct<intent:string,confidence:double,method:string>"


def verdict(intent: Column | str, confidence: Column | float, method: str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(intent).alias("intent"), as_col(confidence).cast("double").alias("confidence"), F.lit(method).alias("method")
    )


def rule_intent(url: Column | str, schema_types: Column | None = None) -> Column:
    """Intent from declared schema types, then URL banks in fixed order, then the home page; else null."""
    u = F.lower(col(url))
    out = F.when(F.lit(False), F.lit(None).cast(VERDICT))
    if schema_types is not None:
        lowered = F.transform(F.coalesce(schema_types, F.array().cast("array<string>")), F.lower)
        for types, intent, confidence in SCHEMA_INTENTS:
            hit = F.arrays_overlap(lowered, F.array(*[F.lit(t) for t in types]))
            out = out.when(hit, verdict(intent, confidence, "rules"))
    for intent, confidence, pattern in URL_BANKS:
        out = out.when(u.rlike(pattern), verdict(intent, confidence, "rules"))
    home = F.regexp_replace(F.regexp_replace(u, r"https?://[^/]+", ""), "/+$", "") == ""
    return out.when(home, verdict("navigational", 0.80, "rules"))


def query_signal(query: Column | str, intent: str) -> Column:
    """Whether a query carries a token or phrase of the intent's bank."""
    q = F.lower(col(query))
    tokens, phrases = QUERY_BANKS[intent]
    hit = F.arrays_overlap(words(q), F.array(*[F.lit(t) for t in tokens]))
    for phrase in phrases:
        hit = hit | q.contains(phrase)
    return hit


def statistical_intents(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Per page, the intent carrying most impression weight over its queries, or the first ``limit``.

    ``queries`` is (page_id, query, impressions, query_rank from 1). Pages without a signal are absent.
    """
    weight = F.when(F.coalesce("impressions", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("impressions"))
    sums = (
        queries.filter(F.lit(True) if limit is None else F.col("query_rank") <= limit)
        .groupBy("page_id")
        .agg(
            F.sum(weight).alias("_total"),
            *[F.sum(F.when(query_signal("query", i), weight).otherwise(F.lit(0))).alias(f"_{i}") for i in QUERY_BANKS],
        )
    )
    best = F.greatest(*[F.col(f"_{i}") for i in QUERY_BANKS])
    name = lookup_first({i: F.col(f"_{i}") == best for i in QUERY_BANKS})
    confidence = rnd(F.least(F.lit(0.92), 0.5 + best / F.col("_total") * 0.6), 3)
    return sums.filter(best > 0).select("page_id", verdict(name, confidence, "statistical").alias("statistical"))


def lookup_first(conditions: dict[str, Column]) -> Column:
    out = None
    for name, condition in conditions.items():
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out


def tiered_intent(rules: Column, statistical: Column, ai_intent: Column, ai_confidence: Column) -> Column:
    """First confident tier, then the model label, then whatever is known, then the default."""
    confident = lambda v: F.when(v["confidence"] >= CONFIDENT, v)
    labelled = F.when(ai_intent.isNotNull() & (ai_intent != ""), verdict(ai_intent, F.coalesce(F.nullif(ai_confidence, F.lit(0.0)), F.lit(0.70)), "ai"))
    return F.coalesce(
        confident(rules), confident(statistical), labelled, rules, statistical, verdict("informational", 0.40, "rules")
    )


def page_type_scores(intent: Column, prominent: Column, body: Column, schema_types: Column | None) -> tuple[Column, Column]:
    """(commercial, informational) evidence; every stem and phrase counts once, headings over body.

    ``prominent`` (title and h1) and ``body`` are lower-case text columns; the whole body is read.
    """

    def weigh(stems: list[str], phrases: tuple[str, ...], schema: list[str], priors: dict[str, float]) -> Column:
        total = lookup(intent, priors, 0.0)
        if schema_types is not None:
            types = F.transform(F.coalesce(schema_types, F.array().cast("array<string>")), F.lower)
            total = total + F.when(F.arrays_overlap(types, F.array(*[F.lit(s) for s in schema])), 2.0).otherwise(0.0)
        total = total + stem_points(prominent, body, stems)
        for phrase in phrases:
            total = total + F.when(prominent.contains(phrase), 1.0).when(body.contains(phrase), 0.2).otherwise(0.0)
        return total

    commercial = weigh(
        COMMERCIAL_STEMS, COMMERCIAL_PHRASES, COMMERCIAL_SCHEMA, {"transactional": 2.0, "commercial": 2.0, "local": 1.0}
    )
    informational = weigh(INFORMATIONAL_STEMS, INFORMATIONAL_PHRASES, INFORMATIONAL_SCHEMA, {"informational": 2.0})
    return commercial, informational


def stem_points(prominent: Column, body: Column, stems: list[str]) -> Column:
    """1.5 for every stem that starts a word of the headings, else 0.25 for one of the body.

    One regular-expression pass per text collects the stems present. A stem that is a prefix of no
    other stem cannot hide one, so alternation finds them all.
    """
    pattern = F.lit("(?:^|[^a-z])(" + "|".join(stems) + ")")
    top = F.array_distinct(F.regexp_extract_all(prominent, pattern, 1))
    low = F.array_except(F.regexp_extract_all(body, pattern, 1), top)
    return 1.5 * F.size(top) + 0.25 * F.size(low)


def page_type(commercial: Column, informational: Column) -> Column:
    ratio = commercial / (commercial + informational)
    return (
        F.when(commercial + informational <= 0, "informational")
        .when(ratio >= 0.65, "commercial")
        .when(ratio <= 0.35, "informational")
        .otherwise("hybrid")
    )


def targeting_intent(title: Column, h1: Column, headings: Column | None = None) -> Column:
    """Intent the page's own headings are written around; null without any text."""
    none = F.array().cast("array<string>")
    extra = none if headings is None else F.coalesce(headings, none)
    fragments = F.filter(F.concat(F.array(title, h1), extra), lambda f: f.isNotNull() & (f != ""))
    votes = F.transform(
        fragments,
        lambda f, i: F.struct(intent_guess(f).alias("k"), F.when(i == 0, 3.0).when(i == 1, 2.0).otherwise(1.0).alias("w"), i.alias("i")),
    )

    def tally(intent: str) -> Column:
        mine = F.filter(votes, lambda v: v["k"] == intent)
        total = F.aggregate(mine, F.lit(0.0), lambda acc, v: acc + v["w"])
        return F.struct(total.alias("w"), (-F.coalesce(F.get(mine, F.lit(0))["i"], F.lit(9999))).alias("i"), F.lit(intent).alias("k"))

    # The heaviest intent wins; on a tie the one named first on the page.
    best = F.array_max(F.array(*[tally(i) for i in ("informational", "local", "transactional", "commercial")]))
    total = F.aggregate(votes, F.lit(0.0), lambda acc, v: acc + v["w"])
    confidence = rnd(F.least(F.lit(0.80), 0.45 + best["w"] / total * 0.45), 3)
    return F.when(F.size(fragments) > 0, verdict(best["k"], confidence, "rules"))


def mismatch(business: Column, statistical: Column, targeting: Column, top_queries: Column, title: Column, h1: Column) -> Column:
    """Struct(has_mismatch, severity, query_intent, confidence, evidence_source, explanation)."""
    from_queries = F.when(statistical["confidence"] >= 0.55, statistical)
    from_copy = F.when(targeting["confidence"] >= 0.55, targeting)
    observed = F.coalesce(from_queries, from_copy)
    source = F.when(from_queries.isNotNull(), "gsc_queries").when(from_copy.isNotNull(), "page_targeting").otherwise("none")
    o = observed["intent"]
    severity = lookup(F.concat(business, F.lit(">"), o), {f"{b}>{q}": v for (b, q), v in MISMATCH.items()}, None)

    quoted = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    own = F.filter(F.array(F.substring(title, 1, 70), F.substring(h1, 1, 70)), lambda f: f.isNotNull() & (f != ""))
    own_text = F.when(F.size(own) > 0, quoted(own)).otherwise(F.lit("its current title and headings"))
    shown = F.filter(F.slice(F.coalesce(top_queries, F.array().cast("array<string>")), 1, 3), lambda x: x != "")
    evidence = F.when(source == "gsc_queries", quoted(shown)).otherwise(own_text)
    subject = F.when(source == "gsc_queries", "the top queries reaching it").otherwise("its own title and headings")

    def fill(template: str) -> Column:
        text = F.lit(template)
        for mark, value in (("{b}", business), ("{q}", o), ("{s}", subject), ("{e}", evidence)):
            text = F.replace(text, F.lit(mark), value)
        return text

    explanation = F.when(o.isNull(), F.lit(NO_EVIDENCE)).when(
        severity.isNull(),
        F.concat(F.lit("Business intent ("), business, F.lit(") aligns with observed intent ("), o, F.lit(").")),
    )
    for (b, q), template in EXPLANATIONS.items():
        explanation = explanation.when((business == b) & (o == q), fill(template))
    return F.struct(
        severity.isNotNull().alias("has_mismatch"),
        severity.alias("severity"),
        o.alias("query_intent"),
        F.coalesce(observed["confidence"], F.lit(0.0)).alias("confidence"),
        source.alias("evidence_source"),
        explanation.otherwise(fill(DEFAULT_EXPLANATION)).alias("explanation"),
    )
