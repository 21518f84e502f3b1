"""Keyword factors, tiers and intent guess as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, dbl, lookup, rnd

# Question openers, word stems, tiers and their caps, adjacent intents.
QUESTION_WORDS = [
    "how", "what", "when", "where", "why", "who", "which", "can", "is", "are", "does", "do", "should", "will", "has", "have",
]
TRANSACTIONAL_STEMS = [
    "buy", "order", "book", "purchase", "hire", "rent", "price", "pricing", "cost", "checkout", "reserv", "subscrib", "ticket", "deal",
    "discount", "quote", "signup",
]
COMMERCIAL_STEMS = ["best", "review", "compar", "versus", "top", "alternativ", "rating", "rank", "cheapest"]
LOCAL_STEMS = ["near", "nearby", "direction", "address", "location", "local"]
TIER_CAPS = {"primary": 3, "secondary": 5, "long_tail": 8, "semantic": 8, "question": 6}
ADJACENT_INTENTS = {
    ("informational", "commercial"): 0.60,
    ("transactional", "commercial"): 0.80,
    ("transactional", "local"): 0.70,
    ("commercial", "local"): 0.65,
    ("informational", "local"): 0.50,
    ("informational", "transactional"): 0.35,
    ("navigational", "informational"): 0.50,
    ("navigational", "transactional"): 0.45,
    ("navigational", "commercial"): 0.45,
}
UNRELATED_INTENTS = 0.30


def words(text: Column | str) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def any_word_starts(text: Column, stems: list[str]) -> Column:
    return text.rlike(r"(?U)(^|\s)(" + "|".join(stems) + ")")


def intent_guess(keyword: Column | str) -> Column:
    """Intent suggested by the words of one keyword."""
    k = F.lower(col(keyword))
    question = F.coalesce(F.get(words(k), F.lit(0)).isin(QUESTION_WORDS), F.lit(False))
    return (
        F.when(question, "informational")
        .when(k.contains("near me") | any_word_starts(k, LOCAL_STEMS), "local")
        .when(any_word_starts(k, TRANSACTIONAL_STEMS), "transactional")
        .when(any_word_starts(k, COMMERCIAL_STEMS), "commercial")
        .otherwise("informational")
    )


def intent_match(guess: Column | str, page_intent: Column | str) -> Column:
    g, p = col(guess), col(page_intent)
    pair = F.concat(F.least(g, p), F.lit("+"), F.greatest(g, p))
    table = {"+".join(sorted(k)): v for k, v in ADJACENT_INTENTS.items()}
    return F.when(g == p, F.lit(1.0)).otherwise(lookup(pair, table, UNRELATED_INTENTS))


def ranking_opportunity(position: Column | str) -> Column:
    p = dbl(position)
    return (
        F.when(p.isNull(), 0.5)
        .when(p <= 3, 0.10)
        .when(p <= 10, 0.70 + (10.0 - p) * 0.03)
        .when(p <= 20, 0.55 + (20.0 - p) * 0.015)
        .when(p <= 50, 0.30 + (50.0 - p) * 0.005)
        .otherwise(0.15)
    )


def demand(impressions: Column | str) -> Column:
    i = F.coalesce(dbl(impressions), F.lit(0.0))
    return F.when(i <= 0, F.lit(0.30)).otherwise(F.least(F.lit(1.0), F.log10(i + 1.0) / 4.0))


def competition_opportunity(position: Column | str, difficulty: Column | str, impressions: Column | str) -> Column:
    p, d = dbl(position), dbl(difficulty)
    return (
        F.when(d.isNotNull(), clamp(1.0 - d / 100.0, 0.05, 1.0))
        .when(p.between(1e-9, 10), 0.85)
        .when((p > 0) & (p <= 30), 0.65)
        .when(p > 0, 0.45)
        .when(dbl(impressions) > 0, 0.55)
        .otherwise(0.40)
    )


def key_terms(keyword: Column) -> Column:
    """Words of a keyword that its coverage is judged by."""
    return F.filter(words(keyword), lambda w: F.length(w) > 2)


def found_terms(terms: Column, title: Column, h1: Column, headings: Column, body: Column) -> Column:
    """Per distinct term its prominence in the page and whether the body has it; arguments as in :func:`content_relevance`."""

    def judged(term: Column) -> Column:
        prominence = (
            F.when(title.contains(term), 0.40)
            .when(h1.contains(term), 0.30)
            .when(headings.contains(term), 0.18)
            .when(body.contains(term), 0.10)
            .otherwise(0.0)
        )
        return F.struct(prominence.alias("prominence"), body.contains(term).alias("in_body"))

    return F.map_from_arrays(terms, F.transform(terms, judged))


def content_relevance(keyword: Column, title: Column, h1: Column, headings: Column, body: Column, *, terms: Column | None = None, found: Column | None = None) -> Column:
    """Coverage of one keyword by the page; arguments are lower-case text, empty when missing.

    Keywords of a page share most words: ``terms`` (``key_terms`` of the keyword) and ``found`` (``found_terms`` of all keywords of the
    page), where they are known, save reading the text once per keyword and word. A body without one of the words has not the keyword.
    """
    terms = key_terms(keyword) if terms is None else terms
    found = found_terms(F.array_distinct(terms), title, h1, headings, body) if found is None else found
    in_title = title.contains(keyword) | h1.contains(keyword)

    def score(elsewhere: float, more: float) -> Column:
        phrase = F.when(in_title, 0.35).otherwise(elsewhere)
        total = F.aggregate(terms, phrase.cast("double"), lambda acc, t: acc + found[t]["prominence"])
        return clamp(total / F.size(terms) + more, 0.05, 1.0)

    in_body = F.forall(terms, lambda t: found[t]["in_body"]) & body.contains(keyword)
    return F.when(F.size(terms) == 0, F.lit(0.50)).when(in_body, score(0.15, 0.15)).otherwise(score(0.0, 0.0))


def composite_score(*factors: Column | str) -> Column:
    """Sixth root of the product of the six factors, scaled to 100."""
    product = F.lit(1.0)
    for f in factors:
        product = product * dbl(f)
    return rnd(F.least(F.lit(100.0), F.pow(product, F.lit(1.0 / len(factors))) * 100.0), 1)


def assign_tier(keyword: Column | str, index: Column | str, source: Column | str) -> Column:
    """Question first, then rank in the source list, then shape."""
    w, i, s = words(F.lower(col(keyword))), col(index), col(source)
    return (
        F.when(F.coalesce(F.get(w, F.lit(0)).isin(QUESTION_WORDS), F.lit(False)), "question")
        .when((s.isin("gsc", "semrush") & (i < 2)) | ((s == "ai") & (i == 0)), "primary")
        .when(F.size(w) >= 3, "long_tail")
        .when(s == "ai", "semantic")
        .otherwise("secondary")
    )
