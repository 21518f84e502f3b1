"""URL identity and admission as Column expressions (no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Query parameters that never change the document.
NON_CONTENT_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
    "_ga", "_gl", "ref", "ref_src", "yclid", "igshid", "vero_id", "wickedid", "hsa_acc", "hsa_cam", "fb_action_ids", "fb_action_types",
    "fb_source", "action_object_map", "s_kwcid", "dclid", "session", "sessionid", "sid", "phpsessid", "jsessionid", "asp.net_sessionid",
    "auth", "authtoken", "token", "access_token", "key", "apikey", "nonce", "_t", "redirect", "redirect_to", "redirect_uri", "next",
    "return", "return_to", "return_url", "dest", "destination", "target", "goto", "continue", "forward", "back", "view", "mode", "layout",
    "display", "theme", "style", "format", "output", "preview", "tab", "popup", "modal", "print", "export", "device", "lang_choice", "sort",
    "order", "orderby", "dir", "direction", "sort_by", "sort_order", "sortby", "sortorder", "action", "do", "add-to-cart", "replytocom",
    "share", "social", "download", "_", "cb", "v", "ver", "version", "cache", "nc", "rnd", "t", "timestamp",
]
PAGE_PARAMS = ("page", "p", "pg")
FIRST_PAGE = ("0", "1")

# File extensions and path segments that are not pages, segments allowed to repeat.
ASSET_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "svg", "webp", "avif", "ico", "bmp", "tiff", "pdf", "zip", "gz", "tar", "rar", "7z", "dmg", "exe", "msi",
    "apk", "mp3", "mp4", "avi", "mov", "wmv", "webm", "ogg", "wav", "m4a", "flv", "css", "js", "mjs", "map", "json", "xml", "rss", "atom",
    "txt", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "woff", "woff2", "ttf", "eot",
]
BLOCKED_SEGMENTS = [
    "wp-json", "wp-admin", "feed", "cdn-cgi", "api", "xmlrpc.php", "login", "signup", "register", "logout", "auth", "cart", "checkout",
]
REPEATABLE_SEGMENTS = ["page", "p", "category", "tag", "index", "en", "us", "uk", "de", "fr", "in", "co", "the"]
HOST_LIKE_SEGMENT = r"^(www\..*\..*|.*\.(com|org|net|io|gov|edu|info|biz|mobi|name|co\.uk|co\.in|com\.au))$"

_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def scheme_of(url: Column | str) -> Column:
    return F.lower(_part(col(url), 1))


def raw_path(url: Column | str) -> Column:
    """Path as written, without ``;parameters`` of the last segment."""
    return F.regexp_replace(_part(col(url), 3), r";[^/]*$", "")


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    # The JVM encoder keeps '*' and escapes '~'; form encoding does the reverse.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column, strip: bool) -> Column:
    def pair(item: Column) -> Column:
        return F.struct(
            _decode(F.regexp_extract(item, r"(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(item, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        )

    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)
    if strip:
        pairs = F.filter(
            pairs,
            lambda p: ~F.lower(p["k"]).isin(NON_CONTENT_PARAMS)
            & ~(F.lower(p["k"]).isin(*PAGE_PARAMS) & p["v"].isin(*FIRST_PAGE)),
        )
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; nested text surgery would otherwise repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_url(url: Column | str, *, strip_tracking: bool = True) -> Column:
    """Stable page key: lower scheme and host, no default port, fragment or noise parameters, sorted query."""
    u = col(url)
    parts = F.struct(
        scheme_of(u).alias("scheme"), F.lower(_part(u, 2)).alias("host"), raw_path(u).alias("path"), _part(u, 4).alias("query")
    )

    def assemble(p: Column) -> Column:
        scheme = F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"])
        host = F.regexp_replace(
            p["host"], F.when(p["scheme"] == "http", F.lit(":80$")).otherwise(F.lit(":443$")), F.lit("")
        )
        path = F.regexp_replace(F.regexp_replace(p["path"], "/{2,}", "/"), "(?<=.)/$", "")
        path = F.when(p["path"] == "", F.lit("/")).otherwise(path)
        query = F.when(p["query"] == "", F.lit("")).otherwise(_clean_query(p["query"], strip_tracking))
        return F.concat(scheme, F.lit("://"), host, path, let(query, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q))))

    return F.when(u.isNotNull(), let(parts, assemble))


def url_hash(url: Column | str) -> Column:
    return F.sha2(normalize_url(url), 256)


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the whitespace-collapsed lower-case text; null for blank text."""
    collapsed = F.lower(F.trim(F.regexp_replace(col(text), r"(?U)\s+", " ")))
    return F.when(collapsed != "", F.sha2(collapsed, 256))


def url_path(url: Column | str) -> Column:
    """Path plus query of the normalised URL."""
    return F.regexp_replace(normalize_url(url), r"^[^:]+://[^/]*", "")


def domain_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_part(col(url), 2), r"^([^:]*)", 1))


def registrable_domain(url_or_host: Column | str) -> Column:
    u = col(url_or_host)
    host = F.when(F.contains(u, F.lit("://")), domain_of(u)).otherwise(F.lower(u))
    return F.regexp_replace(host, r"^www\.", "")


def provider_path(path: Column | str) -> Column:
    """Path form used to match provider rows: no query or fragment, decoded, lower case, no trailing slash."""
    bare = F.regexp_extract(col(path), r"(?s)^([^?#]*)", 1)
    # Percent-decoding must leave a literal plus sign alone.
    decoded = F.trim(_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))))
    rooted = F.when(decoded.startswith("/"), decoded).otherwise(F.concat(F.lit("/"), decoded))
    return F.lower(F.regexp_replace(rooted, r"(?<=.)/+$", ""))


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(raw_path(url)), "/"), lambda s: s != "")


def has_recursive_path_loop(url: Column | str) -> Column:
    """A repeated path segment (outside the allow list) or a host name inside the path."""
    return let(_segments(col(url)), _has_loop)


def _has_loop(segments: Column) -> Column:
    guarded = F.filter(segments, lambda s: ~s.isin(REPEATABLE_SEGMENTS))
    return F.exists(segments, lambda s: s.rlike(HOST_LIKE_SEGMENT)) | (
        F.size(guarded) > F.size(F.array_distinct(guarded))
    )


def is_probably_page(url: Column | str) -> Column:
    def page(path: Column) -> Column:
        extension = F.regexp_extract(path, r"\.([^./]*)$", 1)

        def passed(segments: Column) -> Column:
            blocked = F.arrays_overlap(segments, F.array(*[F.lit(s) for s in BLOCKED_SEGMENTS]))
            return ~_has_loop(segments) & ~blocked & ~extension.isin(ASSET_EXTENSIONS)

        return let(F.filter(F.split(path, "/"), lambda s: s != ""), passed)

    return let(F.lower(raw_path(col(url))), page)


def glob_to_regex(pattern: str) -> str:
    return "^" + ".*".join(re.escape(part) for part in pattern.split("*")) + "$"


def matches_any(url: Column | str, patterns: list[str] | None) -> Column:
    """Glob match (``*`` only) against the normalised path or the URL itself; all patterns are one expression."""
    u = col(url)
    if not patterns:
        return F.lit(False)
    regex = "|".join(glob_to_regex(pattern) for pattern in patterns)
    return u.rlike(regex) | url_path(u).rlike(regex)


def resolve_link(base: Column | str, href: Column | str, *, strip_tracking: bool = True) -> Column:
    """Absolute normalised form of ``href`` on page ``base``; null when it is not navigable."""
    b, raw = col(base), F.trim(col(href))
    dead = (
        raw.isNull()
        | (raw == "")
        | raw.rlike(r"^(#|mailto:|tel:|javascript:|data:|sms:)")
        | raw.rlike(r"(?i)^/(mailto|tel|javascript):")
    )
    parts = F.struct(
        F.when(raw.rlike("(?i)^www\\."), F.concat(F.lit("https://"), raw)).otherwise(raw).alias("h"),
        scheme_of(b).alias("scheme"),
        _part(b, 2).alias("host"),
        F.when(_part(b, 3) == "", F.lit("/")).otherwise(_part(b, 3)).alias("path"),
        F.regexp_extract(b, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
    )

    def join(p: Column) -> Column:
        pieces = F.struct(
            scheme_of(p["h"]).alias("s"), _part(p["h"], 3).alias("path"), F.regexp_extract(p["h"], r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query")
        )

        def absolute(h: Column) -> Column:
            folder = F.regexp_extract(p["path"], r"(?s)^(.*/)", 1)
            merged = (
                F.when(h["path"] == "", p["path"]).when(h["path"].startswith("/"), h["path"]).otherwise(F.concat(folder, h["path"]))
            )
            query = F.when((h["path"] == "") & (h["query"] == ""), p["query"]).otherwise(h["query"])
            return (
                F.when(h["s"] != "", p["h"])
                .when(p["h"].startswith("//"), F.concat(p["scheme"], F.lit(":"), p["h"]))
                .otherwise(F.concat(p["scheme"], F.lit("://"), p["host"], let(merged, _drop_dots), query))
            )

        return let(pieces, absolute)

    absolute_url = let(parts, join)
    return F.when(
        ~dead,
        let(
            absolute_url,
            lambda a: F.when(scheme_of(a).isin("http", "https"), normalize_url(a, strip_tracking=strip_tracking)),
        ),
    )


def _drop_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    folder_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(folder_end, "/").otherwise(""))).otherwise(path)
