"""Code-change operators: file to route, diff signals and their weight, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogue

from .urls import let

# Files that touch every page, files that touch none, route extensions, index names.
GLOBAL_IMPACT = "(?i)" + "|".join(
    [
        r"(^|/)(_app|_document|_layout|layout|template|root)\.[jt]sx?$",
        r"(^|/)layouts?/",
        r"(^|/)components?/",
        r"(^|/)partials?/",
        r"(^|/)includes?/",
        r"(^|/)theme/",
        r"(^|/)(head|seo|meta|metadata|sitemap|robots)\.[jt]sx?$",
        r"(^|/)(next|nuxt|astro|gatsby|svelte|vite|remix)\.config\.[jtm]?s$",
        r"(^|/)(config|_config)\.(ya?ml|toml|json|js|ts)$",
        r"(^|/)(tailwind|postcss)\.config\.[jtm]?s$",
        r"(^|/)package\.json$",
        r"\.(css|scss|sass|less)$",
        r"(^|/)middleware\.[jt]s$",
        r"(^|/)robots\.txt$",
        r"(^|/)sitemap\.xml$",
        r"(^|/)\.htaccess$",
        r"(^|/)(netlify|vercel)\.toml$",
        r"(^|/)nginx\.conf$",
    ]
)
IGNORABLE = "(?i)" + "|".join(
    [
        r"^\.github/",
        r"(^|/)(tests?|__tests__|spec|e2e|cypress)/",
        r"\.(test|spec)\.[jt]sx?$",
        r"^docs?/",
        r"^(README|CHANGELOG|CONTRIBUTING|LICENSE|CODE_OF_CONDUCT|SECURITY|AUTHORS)(\.[a-z]+)?$",
        r"(^|/)(\.gitignore|\.editorconfig|\.prettierrc|\.eslintrc|\.dockerignore)",
        r"(^|/)(Dockerfile|docker-compose\.ya?ml)$",
        r"\.(lock|log)$",
        r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$",
        r"(^|/)(migrations?|alembic)/",
    ]
)
ROUTE_ENDINGS = ("tsx", "jsx", "ts", "js", "vue", "svelte", "astro", "html", "htm", "md", "mdx", "markdown", "php", "liquid", "njk", "hbs")
ROUTE_EXTENSIONS = rf"(?i)\.({'|'.join(ROUTE_ENDINGS)})$"
INDEX_NAMES = ("index", "page", "_index", "home", "default")
OUTPUT_FOLDERS = ("public", "dist", "build", "static", "www", "src", "site", "_site")


def is_ignorable(path: Column) -> Column:
    return path.rlike(IGNORABLE)


def has_global_impact(path: Column) -> Column:
    return path.rlike(GLOBAL_IMPACT)


# ── routes ───────────────────────────────────────────────────────────────────
def _strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, ROUTE_EXTENSIONS, "")


def _normal(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("\\"), F.lit("/"))


def clean_route(segments: Column) -> Column:
    """URL path of route segments: groups skipped, cut at the first dynamic one, private gives null."""
    named = F.filter(segments, lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))

    def build(parts: Column) -> Column:
        dynamic = F.transform(parts, lambda s: s.rlike(r"^([\[{].*[\]}]$|[:$])"))
        cut = F.array_position(dynamic, True).cast("int")
        kept = F.when(cut > 0, F.slice(parts, 1, cut - 1)).otherwise(parts)
        private = F.exists(kept, lambda s: s.startswith("_") & ~F.regexp_replace(s, "^_+|_+$", "").isin(*INDEX_NAMES))
        return F.when(~private, F.concat(F.lit("/"), F.array_join(kept, "/")))

    return let(named, build)


def _body(segments: Column) -> Column:
    """Segments without extension, SvelteKit marker and trailing index name."""
    name = F.regexp_replace(_strip_extension(F.element_at(segments, -1)), r"^\++", "")
    folders = F.slice(segments, 1, F.size(segments) - 1)
    return F.when(F.lower(name).isin(*INDEX_NAMES), folders).otherwise(F.array_append(folders, name))


def under_roots(*roots: str) -> Callable[[Column], Column]:
    def resolve(path: Column) -> Column:
        def split(parts: Column) -> Column:
            hits = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.lower(p).isin(*roots))
            at = F.array_position(hits, True).cast("int")
            return F.when(at > 0, clean_route(_body(F.slice(parts, at + 1, F.size(parts) - at))))

        return let(F.split(_normal(path), "/"), split)

    return resolve


def flat_routes(path: Column) -> Column:
    """Remix: dots of the file name separate the segments."""
    name = _strip_extension(F.substring_index(_normal(path), "/", -1))
    route = F.when(F.lower(name).isin(*INDEX_NAMES), F.lit("/")).otherwise(clean_route(F.split(name, r"\.")))
    return F.when(_normal(path).contains("routes/"), route)


def jekyll(path: Column) -> Column:
    slug = F.regexp_replace(_strip_extension(F.substring_index(_normal(path), "/", -1)), r"^\d{4}-\d{2}-\d{2}-", "")
    post = F.when(slug != "", F.concat(F.lit("/"), slug))
    return F.when(_normal(path).contains("_posts/"), post).otherwise(under_roots("pages", "_pages")(path))


def static_site(path: Column) -> Column:
    def strip(parts: Column) -> Column:
        inner = F.when(F.lower(parts[0]).isin(*OUTPUT_FOLDERS) & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts)
        return clean_route(_body(inner))

    return F.when(F.lower(_normal(path)).rlike(r"\.html?$"), let(F.split(_normal(path), "/"), strip))


next_router = under_roots("pages", "app")
pages_router = under_roots("pages")
svelte_routes = under_roots("routes")
content_tree = under_roots("content")

RESOLVERS: dict[str, Callable[[Column], Column]] = {
    "next": next_router,
    "nextjs": next_router,
    "nuxt": pages_router,
    "astro": pages_router,
    "sveltekit": svelte_routes,
    "svelte": svelte_routes,
    "remix": flat_routes,
    "hugo": content_tree,
    "jekyll": jekyll,
    "gatsby": pages_router,
    "static": static_site,
    "html": static_site,
}
GENERIC_ORDER = (next_router, svelte_routes, pages_router, content_tree, jekyll, flat_routes, static_site)


def register_resolver(framework: str, resolver: Callable[[Column], Column]) -> None:
    """Add or replace the route convention of a framework."""
    RESOLVERS[framework.strip().lower()] = resolver


def route_of(path: Column, framework: Column | None = None) -> Column:
    """URL path a changed file renders, by declared framework, else the first convention that fits."""
    generic = F.coalesce(*[resolver(path) for resolver in GENERIC_ORDER])
    if framework is None:
        return generic
    name = F.lower(F.trim(F.coalesce(framework, F.lit(""))))
    by_convention: dict[int, tuple[Callable, list[str]]] = {}
    for key, resolver in RESOLVERS.items():
        by_convention.setdefault(id(resolver), (resolver, []))[1].append(key)
    out = None
    for resolver, names in by_convention.values():
        out = F.when(name.isin(*names), resolver(path)) if out is None else out.when(name.isin(*names), resolver(path))
    return out.otherwise(generic)


# ── diffs ────────────────────────────────────────────────────────────────────
# Patterns of the tags a diff is read for.
TITLE = r"(?i)<title[^>]*>\s*(.*?)\s*</title>|(?<![-\w])title\s*:\s*[\"'`]([^\"'`]{1,300})[\"'`]"
H1 = r"(?is)<h1[^>]*>\s*(.*?)\s*</h1>"
CANONICAL = (
    r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']"
    r"|<link[^>]+href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"']"
    r"|canonical\s*:\s*[\"'`]([^\"'`]{1,500})[\"'`]"
)
ROBOTS_META = (
    r"(?i)<meta[^>]+name=[\"']robots[\"'][^>]*content=[\"']([^\"']+)[\"']"
    r"|<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*name=[\"']robots[\"']"
)
SCHEMA_TYPE = r"\"@type\"\s*:\s*\"([^\"]+)\""
INTERNAL_HREF = r"(?i)href=[\"']/(?!/)[^\"']*[\"']"

CHANGE = "struct<change_type:string,before:string,after:string,direction:string,weight:double,description:string>"


def ceiling(check_type: str) -> float:
    return {row[0]: row[4] for row in catalogue.rows()}[check_type]


def patch_lines(patch: Column, sign: str) -> Column:
    """Added (+) or removed (-) text of a unified diff, file headers excluded."""
    mark = "\\" + sign
    return F.array_join(F.regexp_extract_all(patch, F.lit(rf"(?m)^{mark}(?!{mark}{mark})(.*)$"), 1), "\n")


def first_match(text: Column, pattern: str, groups: int) -> Column:
    """First non-empty group of the first match, whitespace collapsed; null without one."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)])
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def change(kind: str, before, after, direction: str | Column, weight: Column | float, description: Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("change_type"), before.cast("string").alias("before"), after.cast("string").alias("after"),
        as_col(direction).alias("direction"), as_col(weight).cast("double").alias("weight"), description.alias("description"),
    )


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# The descriptions that the detectors below give are results that must match.
def tag_change(kind: str, added: Column, removed: Column, pattern: str, groups: int) -> Column:
    """Title, H1 or canonical: removed is negative, added positive, rewritten neutral at 40 % weight."""
    label, weight = kind.replace("_", " ").title(), ceiling(kind)
    found = F.struct(first_match(removed, pattern, groups).alias("b"), first_match(added, pattern, groups).alias("a"))

    def judge(x: Column) -> Column:
        b, a = x["b"], x["a"]
        gone = change(kind, b, a, "negative", weight, _cat(f'{label} removed: was "', F.substring(b, 1, 120), '".'))
        new = change(kind, b, a, "positive", weight, _cat(f'{label} added: "', F.substring(a, 1, 120), '".'))
        edited = change(
            kind, b, a, "neutral", weight * 0.4, _cat(f'{label} changed from "', F.substring(b, 1, 80), '" to "', F.substring(a, 1, 80), '".')
        )
        return F.when(F.equal_null(a, b), F.lit(None)).when(a.isNull(), gone).when(b.isNull(), new).otherwise(edited)

    return let(found, judge)


def robots_change(added: Column, removed: Column) -> Column:
    found = F.struct(first_match(removed, ROBOTS_META, 2).alias("b"), first_match(added, ROBOTS_META, 2).alias("a"))

    def judge(x: Column) -> Column:
        b, a, weight = x["b"], x["a"], ceiling("robots")
        had = F.coalesce(b.rlike(r"(?i)\bnoindex\b"), F.lit(False))
        has = F.coalesce(a.rlike(r"(?i)\bnoindex\b"), F.lit(False))
        text = lambda c: F.coalesce(c, F.lit("None"))
        return (
            F.when(has & ~had, change("robots", b, a, "negative", weight, F.lit("A noindex directive was added — this page would be removed from search results.")))
            .when(had & ~has, change("robots", b, a, "positive", weight, F.lit("A noindex directive was removed — this page becomes indexable again.")))
            .when(~F.equal_null(a, b), change("robots", b, a, "neutral", weight * 0.3, _cat('Robots meta content changed from "', text(b), '" to "', text(a), '".')))
        )

    return let(found, judge)


def schema_change(added: Column, removed: Column) -> Column:
    types = lambda text: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(SCHEMA_TYPE), 1)))
    block = lambda text: text.rlike(r"(?i)application/ld\+json")
    found = F.struct(types(removed).alias("b"), types(added).alias("a"), block(removed).alias("had"), block(added).alias("has"))

    def judge(x: Column) -> Column:
        weight = ceiling("structured_data")
        joined = lambda xs: F.array_join(xs, ", ")
        named = lambda xs, other: F.when(F.size(xs) > 0, joined(xs)).otherwise(other)
        gone, new = F.array_except(x["b"], x["a"]), F.array_except(x["a"], x["b"])
        listed = lambda xs: F.when(F.size(xs) > 0, _cat("['", F.array_join(xs, "', '"), "']")).otherwise("none")
        worse = (F.size(gone) > 0) & (F.size(new) == 0)
        none = F.lit(None).cast("string")
        return (
            F.when(
                x["has"] & ~x["had"],
                change("schema", none, named(x["a"], "structured data"), "positive", weight, _cat("Structured data added (", named(x["a"], "JSON-LD block"), ").")),
            )
            .when(
                x["had"] & ~x["has"],
                change("schema", named(x["b"], "structured data"), none, "negative", weight, _cat("Structured data removed (", named(x["b"], "JSON-LD block"), ").")),
            )
            .when(
                x["a"] != x["b"],
                change(
                    "schema", joined(x["b"]), joined(x["a"]), F.when(worse, "negative").otherwise("neutral"), F.when(worse, weight).otherwise(weight * 0.3),
                    _cat("Structured data types changed: removed ", listed(gone), ", added ", listed(new), "."),
                ),
            )
        )

    return let(found, judge)


def content_reduction(additions: Column, deletions: Column) -> Column:
    total, weight = additions + deletions, ceiling("content")
    ratio = deletions / total
    text = _cat(
        "Content reduced substantially: ", deletions.cast("string"), " lines removed, ", additions.cast("string"), " added (net ",
        F.format_string("%+d", (additions - deletions).cast("int")), ").",
    )
    count = lambda c: _cat(c.cast("string"), " lines")
    return F.when(
        (total >= 10) & (deletions >= 15) & (ratio >= 0.6),
        change("content_length", count(deletions), count(additions), "negative", weight * F.least(F.lit(1.0), ratio), text),
    )


def internal_link_delta(added: Column, removed: Column) -> Column:
    count = lambda text: F.size(F.regexp_extract_all(text, F.lit(INTERNAL_HREF), 0))
    found = F.struct(count(removed).alias("b"), count(added).alias("a"))

    def judge(x: Column) -> Column:
        delta = x["a"] - x["b"]
        size, less = F.abs(delta), delta < 0
        text = _cat(
            "Internal links ", F.when(less, "decreased").otherwise("increased"), " by ", size.cast("string"), " (", x["b"].cast("string"), " -> ", x["a"].cast("string"), ").",
        )
        return F.when(
            size >= 2,
            change(
                "internal_links", x["b"], x["a"], F.when(less, "negative").otherwise("positive"),
                ceiling("internal_links") * F.least(F.lit(1.0), size / 5.0), text,
            ),
        )

    return let(found, judge)


def file_changes(patch: Column, additions: Column, deletions: Column) -> Column:
    """Every change a patch shows, in fixed order."""
    sides = F.struct(patch_lines(patch, "+").alias("added"), patch_lines(patch, "-").alias("removed"))
    # A cheap look at the patch decides which analyses can find anything at all.
    if_any = lambda words, found: F.when(patch.rlike("(?i)" + words), found)

    def collect(s: Column) -> Column:
        added, removed = s["added"], s["removed"]
        found = [
            if_any("title", tag_change("title", added, removed, TITLE, 2)),
            if_any("<h1", tag_change("h1", added, removed, H1, 1)),
            if_any("canonical", tag_change("canonical", added, removed, CANONICAL, 3)),
            if_any("robots", robots_change(added, removed)),
            if_any(r"ld\+json|@type", schema_change(added, removed)),
            content_reduction(additions, deletions),
            if_any("href", internal_link_delta(added, removed)),
        ]
        return F.array_compact(F.array(*[f.cast(CHANGE) for f in found]))

    return let(sides, collect)


def refine_with_keywords(c: Column, keywords: Column) -> Column:
    """A neutral title or H1 rewrite turns negative or positive when a target keyword left or arrived."""
    known = F.coalesce(keywords, F.array().cast("array<string>"))
    held = lambda text: F.exists(known, lambda k: F.lower(F.coalesce(text, F.lit(""))).contains(k))
    open_ = c["change_type"].isin("title", "h1") & (c["direction"] == "neutral") & (F.size(known) > 0)

    def turned(direction: str, factor: float, note: Column) -> Column:
        return (
            c.withField("direction", F.lit(direction)).withField("weight", c["weight"] * factor).withField("description", F.concat(c["description"], note))
        )

    lost = _cat(
        " The target keyword present in the previous ", c["change_type"],
        " is no longer present — this weakens topical relevance for the keyword this page was ranking for.",
    )
    gained = _cat(" The new ", c["change_type"], " now includes the page's target keyword, which the previous version did not.")
    return (
        F.when(open_ & held(c["before"]) & ~held(c["after"]), turned("negative", 1.6, lost))
        .when(open_ & held(c["after"]) & ~held(c["before"]), turned("positive", 1.3, gained))
        .otherwise(c)
    )


# What to do about each kind of negative change, risk thresholds.
SUGGESTIONS = {
    "robots": "Remove the added noindex directive if this page should be indexed.",
    "canonical": "Restore the canonical tag pointing at this page's preferred URL.",
    "h1": "Keep the target keyword in the H1 heading.",
    "title": "Keep the target keyword in the page title.",
    "schema": "Restore the removed structured data block.",
    "content_length": "Verify the content reduction was intentional; restore relevant sections if not.",
    "internal_links": "Preserve internal links removed from this page.",
}
RISK = {"critical": 2.2, "high": 1.2, "medium": 0.5}


def gate_state(mode: Column | str, risk: Column | str) -> Column:
    m = F.lit(mode) if isinstance(mode, str) else mode
    r = F.col(risk) if isinstance(risk, str) else risk
    return F.when(m == "off", F.lit(None)).when((m == "block") & r.isin("high", "critical"), "failure").otherwise("success")
