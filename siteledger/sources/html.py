"""HTML documents to page signals.

Python only tokenises: one small ``html.parser`` pass per document turns markup into an array of
element records and four text measures. Every signal is then a Column expression over that array, so
selection, counting, URL work and hashing stay in the JVM and Spark prunes what a query does not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import content_hash, is_probably_page, normalize_url, registrable_domain, resolve_link

# Elements that never render, site chrome, void elements, hidden ids, classes and styles.
NON_RENDERING = {"script", "style", "template", "svg", "iframe", "noscript"}
CHROME = {"nav", "header", "footer", "aside", "form", "figcaption", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD_ONLY = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KEPT = {"title", "meta", "link", "html", "img", "a", "script", *HEADINGS}
HIDDEN_IDS = {"seo-fallback", "sr-only"}
HIDDEN_CLASSES = {"sr-only", "visually-hidden"}
HIDDEN_STYLE = re.compile(
    r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0)\s*(?:;|$)"
    r"|clip\s*:\s*rect\s*\(\s*0|clip-path\s*:\s*inset\s*\(\s*100%|(?:width|height)\s*:\s*(?:0|1)px",
    re.IGNORECASE,
)
# How a tracking pixel is recognised, when a landmark is only a fragment of the page.
PIXEL_NAME = r"(?i)(?:^|[/_-])(?:pixel|beacon|spacer|blank|clear|1x1|px)(?:[._-]|$)"
BEACON_PATH = (
    r"(?i)/(?:__utm\.gif|pixel(?=[./?_-]|$)|beacon(?=[./?_-]|$)|track(?:ing)?/|collect\?|b/ss/|p\.gif|noscript\.gif)"
)
LANDMARK_MIN_CHARS = 300
LANDMARK_FALLBACK_RATIO = 3
RENDER_MIN_CHARS = 400
BATCH_BYTES = 32 << 20  # markup tokenised together

_NODE = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("head", T.StringType()),  # 'direct', 'nested' or null outside the head
    ]
)
_MEASURES = ("raw_text", "visible_text", "chrome_free_text", "main_text", "article_text")
_ARROW_NODE = pa.struct(
    [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("hidden", pa.bool_()), ("head", pa.string())]
)


# What a start tag ends: open elements of these names, up to the nearest of the scopes (none: any).
_BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "nav",
    "ol", "p", "pre", "section", "table", "ul", *HEADINGS,
)
_SCOPES = frozenset(("table", "td", "th", "caption", "button", "template", "body", "html"))
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset(("p",)), _SCOPES) for t in _BLOCKS},
    **{t: (frozenset(("p", *HEADINGS)), _SCOPES) for t in ("p", *HEADINGS)},
    "li": (frozenset(("li",)), _SCOPES | {"ul", "ol", "menu"}),
    "dt": (frozenset(("dt", "dd")), _SCOPES | {"dl"}),
    "dd": (frozenset(("dt", "dd")), _SCOPES | {"dl"}),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "template"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table", "template"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table", "template"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "a": (frozenset(("a",)), _SCOPES),
}
_TEXT_ONLY = "title"  # ends at its own end tag; where that is missing, at the next tag


class _Tokenizer(HTMLParser):
    """Element records and text measures of one document, in time linear in its length.

    End tags that authors leave out are supplied: a paragraph ends at the next block, a list item, cell, option, link or
    heading at the next of its kind, the title at any tag, the head at the body or at content. Whether the parser stands inside
    something hidden, chrome or not rendered is kept in counters that change when an element opens or closes.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # (tag, hidden by itself)
        self.places: dict[str, list[int]] = {}  # depths at which a tag is open
        self.count = {"hidden": 0, "hidden_inside": 0, "unrendered": 0, "chrome": 0}
        self.nodes: list[dict] = []
        self.pieces: list[str] = []  # all text, and where each record's part of it begins
        self.code: list[str] = []
        self.open: list[tuple[int, dict, int, int]] = []  # records still collecting text
        self.in_body = False
        self.landmark: dict[str, tuple[int, int] | None] = {"main": None, "article": None}  # depth, chrome around it
        self.text: dict[str, list[str] | None] = {m: [] for m in _MEASURES}
        self.text["main_text"] = self.text["article_text"] = None

    def _hidden(self, tag: str, attrs: dict) -> bool:
        return (
            "hidden" in attrs
            or (attrs.get("aria-hidden") or "").strip().lower() == "true"
            or (attrs.get("id") or "").strip().lower() in HIDDEN_IDS
            or not HIDDEN_CLASSES.isdisjoint((attrs.get("class") or "").split())
            or bool(HIDDEN_STYLE.search(attrs.get("style") or ""))
        )

    def _is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _tally(self, tag: str, hidden: bool, step: int) -> None:
        self.count["hidden"] += step * hidden
        self.count["hidden_inside"] += step * (hidden and tag not in ("html", "body"))
        self.count["unrendered"] += step * (tag in NON_RENDERING)
        self.count["chrome"] += step * (tag in CHROME)

    def _supply_ends(self, tag: str) -> None:
        if self.stack and self.stack[-1][0] == _TEXT_ONLY and not self._is_open("svg"):
            self._close(len(self.stack) - 1)
        if tag == "body" or (tag not in HEAD_ONLY and not self._is_open("noscript")):
            head = self.places.get("head")
            if head and not self._is_open("svg"):
                self._close(head[-1])
        ends, scopes = _ENDS.get(tag, (None, None))
        if ends is None:
            return
        edge = max((self.places[s][-1] for s in scopes if self.places.get(s)), default=-1)
        inner = [self.places[t][-1] for t in ends if self.places.get(t) and self.places[t][-1] > edge]
        if tag in HEADINGS:  # a heading ends a heading that is directly open, and a paragraph anywhere in scope
            inner = [d for d in inner if self.stack[d][0] == "p" or d == len(self.stack) - 1]
        if inner:
            self._close(min(inner))

    def handle_starttag(self, tag: str, attributes) -> None:
        attrs = {}
        for name, value in attributes:
            attrs.setdefault(name, value or "")
        self._supply_ends(tag)
        in_svg = self._is_open("svg")
        if tag == "body" or (tag not in HEAD_ONLY and not in_svg):
            self.in_body = True
        hidden = self._hidden(tag, attrs)
        structured = "itemtype" in attrs or "typeof" in attrs
        if tag in KEPT or structured:
            head = None
            if not self.in_body and not in_svg:
                head = "direct" if not self.stack or self.stack[-1][0] in ("head", "html") else "nested"
            shown = hidden or self.count["hidden_inside"] > 0
            node = {"tag": tag, "attrs": attrs, "text": None, "hidden": shown, "head": head}
            self.nodes.append(node)
            if tag not in VOID and tag != "html":
                self.open.append((len(self.stack), node, len(self.pieces), len(self.code)))
        if tag in VOID:
            return
        for name, mark in self.landmark.items():
            unseen = mark is None and self.text[f"{name}_text"] is None
            if tag == name and unseen and not hidden and not self.count["unrendered"] and not self.count["hidden"]:
                self.landmark[name] = (len(self.stack), self.count["chrome"])
                self.text[f"{name}_text"] = []
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hidden))
        self._tally(tag, hidden, 1)

    def handle_startendtag(self, tag: str, attributes) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._is_open(tag):
            self._close(self.places[tag][-1])

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, hidden = self.stack.pop()
            self.places[tag].pop()
            self._tally(tag, hidden, -1)
        while self.open and self.open[-1][0] >= depth:
            _, node, first, first_code = self.open.pop()
            # Code is text of its own element only.
            own = self.code[first_code:] if node["tag"] in ("script", "style") else self.pieces[first:]
            node["text"] = " ".join(own)
        for name, mark in self.landmark.items():
            if mark is not None and mark[0] >= depth:
                self.landmark[name] = None

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if not piece:
            return
        inline = self.stack[-1][0] if self.stack and self.stack[-1][0] in ("script", "style") else None
        (self.pieces if inline is None else self.code).append(piece)
        if self.count["unrendered"]:
            return
        if not self.in_body and not (self._is_open("head") or self._is_open("title")):
            self.in_body = True
        if not self.in_body:
            return
        self.text["raw_text"].append(piece)
        if self.count["hidden"]:
            return
        self.text["visible_text"].append(piece)
        if not self.count["chrome"]:
            self.text["chrome_free_text"].append(piece)
        for name, mark in self.landmark.items():
            if mark is not None and self.count["chrome"] == mark[1]:
                self.text[f"{name}_text"].append(piece)

    def finish(self) -> dict:
        self.close()
        self._close(0)
        collapse = lambda pieces: None if pieces is None else " ".join(" ".join(pieces).split())
        return {"nodes": self.nodes, **{m: collapse(t) for m, t in self.text.items()}}


def _tokenise(html: str | None) -> dict:
    parser = _Tokenizer()
    try:
        parser.feed(html or "")
        return parser.finish()
    except Exception as exc:  # a broken document must not fail the task
        return {"nodes": [], **{m: None for m in _MEASURES}, "error": f"{type(exc).__name__}: {exc}"[:200]}


def _parts(batches: Iterator[pa.RecordBatch], html: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_BYTES`` of markup, which bounds what a worker holds and emits at once."""
    for batch in batches:
        first, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()):
            if held and held + size > BATCH_BYTES:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def tokenise(documents: DataFrame, html: str = "html") -> DataFrame:
    """Replace column ``html`` by ``nodes``, the text measures and ``extraction_error``."""
    keep = [c for c in documents.columns if c != html]
    schema = T.StructType(
        [documents.schema[c] for c in keep]
        + [T.StructField("nodes", T.ArrayType(_NODE))]
        + [T.StructField(m, T.StringType()) for m in (*_MEASURES, "extraction_error")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, html):
            rows = [_tokenise(v.as_py()) for v in batch.column(html)]
            nodes = pa.array([[{**n, "attrs": list(n["attrs"].items())} for n in r["nodes"]] for r in rows], pa.list_(_ARROW_NODE))
            texts = [pa.array([r[m] for r in rows], pa.string()) for m in _MEASURES]
            errors = pa.array([r.get("error") for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), nodes, *texts, errors], names=[*keep, "nodes", *_MEASURES, "extraction_error"]
            )

    return documents.select(*keep, html).mapInArrow(run, schema)


# ── selections over the element array ────────────────────────────────────────
def _attr(node: Column, name: str) -> Column:
    return F.trim(F.coalesce(node["attrs"][name], F.lit("")))


def _tags(*names: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*names))


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _metas(name: str) -> Column:
    return F.filter(
        "nodes", lambda n: (n["tag"] == "meta") & ((F.lower(_attr(n, "name")) == name) | (F.lower(_attr(n, "property")) == name))
    )


def _first_content(name: str) -> Column:
    values = F.transform(_metas(name), lambda n: _collapse(_attr(n, "content")))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def _rel(node: Column) -> Column:
    return F.split(F.lower(_attr(node, "rel")), r"\s+")


def _links_with_rel(value: str) -> Column:
    return F.filter("nodes", lambda n: (n["tag"] == "link") & F.array_contains(_rel(n), value))


def _nonempty(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _head_columns() -> dict[str, Column]:
    titles = F.filter("nodes", lambda n: (n["tag"] == "title") & n["head"].isNotNull())
    direct = F.filter(titles, lambda n: n["head"] == "direct")
    chosen = F.when(F.size(direct) > 0, direct).otherwise(titles)
    html_tag = F.get(_tags("html"), F.lit(0))
    alternates = F.filter(
        _links_with_rel("alternate"),
        lambda n: (_attr(n, "hreflang") != "") & ~F.lower(_attr(n, "type")).rlike("rss|atom|xml"),
    )
    og = F.exists(
        "nodes",
        lambda n: (n["tag"] == "meta")
        & F.lower(F.when(_attr(n, "property") != "", _attr(n, "property")).otherwise(_attr(n, "name"))).startswith("og:"),
    )
    return {
        "title_count": F.size(chosen),
        "title": F.nullif(_collapse(F.get(chosen, F.lit(0))["text"]), F.lit("")),
        "meta_description_count": F.size(_metas("description")),
        "meta_description": _first_content("description"),
        "meta_robots_count": F.size(_metas("robots")),
        "meta_robots": _first_content("robots"),
        "lang": F.nullif(_attr(html_tag, "lang"), F.lit("")),
        "hreflang": F.transform(alternates, lambda n: F.struct(_attr(n, "hreflang").alias("lang"), _attr(n, "href").alias("href"))),
        "has_viewport": F.coalesce(_attr(F.get(_metas("viewport"), F.lit(0)), "content") != "", F.lit(False)),
        "has_open_graph": og,
        "has_twitter_card": _first_content("twitter:card").isNotNull(),
    }


def _canonical_columns() -> dict[str, Column]:
    tags = _links_with_rel("canonical")
    href = _attr(F.get(tags, F.lit(0)), "href")
    resolved = resolve_link("url", href)
    status = (
        F.when(F.size(tags) == 0, "missing")
        .when(F.size(tags) > 1, "multiple")
        .when(href == "", "empty")
        .when(F.col("canonical_url").isNull(), "invalid")
        .when(F.col("canonical_url") == normalize_url("url"), "self")
        .when(~F.lower(href).rlike("^https?://"), "relative")
        .otherwise("other")
    )
    first = {"canonical_count": F.size(tags), "canonical_raw": F.nullif(href, F.lit("")), "canonical_url": resolved}
    return first, {"canonical_status": status}


def _structured_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    scripts = F.filter("nodes", lambda n: (n["tag"] == "script") & F.lower(_attr(n, "type")).contains("ld+json"))
    blocks = _nonempty(F.transform(scripts, lambda n: F.trim(n["text"])))
    micro = F.filter("nodes", lambda n: n["attrs"]["itemtype"].isNotNull())
    rdfa = F.filter("nodes", lambda n: n["attrs"]["typeof"].isNotNull())
    tail = lambda x: F.substring_index(F.regexp_replace(x, "/+$", ""), "/", -1)
    valid = F.filter("_ld_blocks", lambda b: F.try_parse_json(b).isNotNull())
    named = F.flatten(
        F.transform(valid, lambda b: F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*(\[[^\]]*\]|"(?:[^"\\]|\\.)*")'), 1))
    )
    ld_types = F.flatten(F.transform(named, lambda v: F.regexp_extract_all(v, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)))
    micro_types = F.transform(micro, lambda n: tail(_attr(n, "itemtype")))
    rdfa_types = F.transform(
        F.flatten(F.transform(rdfa, lambda n: F.split(_attr(n, "typeof"), r"\s+"))), lambda t: F.substring_index(tail(t), ":", -1)
    )
    formats = F.array_compact(
        F.array(
            F.when(F.size(scripts) > 0, "json-ld"), F.when(F.size(micro) > 0, "microdata"), F.when(F.size(rdfa) > 0, "rdfa")
        )
    )
    return {"_ld_blocks": blocks}, {
        "structured_data_formats": formats,
        "has_structured_data": F.size(formats) > 0,
        "structured_data_types": F.array_distinct(_nonempty(F.concat(ld_types, micro_types, rdfa_types))),
        "structured_data_invalid": F.size(valid) < F.size("_ld_blocks"),
    }


def _heading_columns() -> dict[str, Column]:
    def active(level: str) -> Column:
        every = _tags(level)
        shown = F.filter(every, lambda n: ~n["hidden"])
        chosen = F.when(F.size(shown) > 0, shown).otherwise(every)
        return F.transform(chosen, lambda n: F.struct(n["tag"].alias("level"), _collapse(n["text"]).alias("text")))

    records = F.flatten(F.array(*[active(level) for level in HEADINGS]))
    return {"_headings": records}


def _heading_counts() -> dict[str, Column]:
    at = lambda level: F.filter("_headings", lambda h: h["level"] == level)
    filled = F.filter("_headings", lambda h: h["text"] != "")
    h1 = F.transform(F.filter(filled, lambda h: h["level"] == "h1"), lambda h: h["text"])
    return {
        **{f"{level}_count": F.size(at(level)) for level in HEADINGS},
        "empty_heading_count": F.size("_headings") - F.size(filled),
        "headings": filled,
        "h1": F.nullif(F.array_join(h1, " | "), F.lit("")),
    }


def is_tracking_pixel(node: Column) -> Column:
    """Declared 1x1 images and unambiguous beacon names or paths."""
    side = lambda name: _attr(node, name).try_cast("int").between(1, 1)
    src = F.when(_attr(node, "src") != "", _attr(node, "src")).otherwise(_attr(node, "data-src"))
    stem = F.regexp_replace(F.substring_index(F.substring_index(src, "?", 1), "/", -1), r"\.[^.]*$", "")
    tiny = F.coalesce(side("width") & side("height"), F.lit(False))
    return tiny | ((src != "") & (src.rlike(BEACON_PATH) | F.concat(F.lit("/"), stem).rlike(PIXEL_NAME)))


def _image_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    record = lambda n: F.struct(
        F.when(_attr(n, "src") != "", _attr(n, "src")).otherwise(_attr(n, "data-src")).alias("src"),
        n["attrs"]["alt"].alias("alt"),
        F.nullif(_attr(n, "width"), F.lit("")).alias("width"),
        F.nullif(_attr(n, "height"), F.lit("")).alias("height"),
        F.nullif(_attr(n, "loading"), F.lit("")).alias("loading"),
        (_attr(n, "srcset") != "").alias("has_srcset"),
        is_tracking_pixel(n).alias("is_tracking_pixel"),
    )
    images = F.filter("_images", lambda i: ~i["is_tracking_pixel"])
    count = lambda test: F.size(F.filter(images, test))
    return {"_images": F.transform(_tags("img"), record)}, {
        "image_count": F.size(images),
        "missing_alt_count": count(lambda i: i["alt"].isNull()),
        "empty_alt_count": count(lambda i: F.trim(i["alt"]) == ""),
        "images_without_dimensions": count(lambda i: i["width"].isNull() | i["height"].isNull()),
        "tracking_pixel_count": F.size("_images") - F.size(images),
        "images": images,
    }


def _link_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())
    base = registrable_domain("base_domain")
    record = lambda n: F.struct(
        resolve_link("url", n["attrs"]["href"], strip_tracking=False).alias("url"), _collapse(n["text"]).alias("anchor_text"), _rel(n).alias("rel")
    )
    placed = F.transform(
        F.filter("_anchors", lambda a: a["url"].isNotNull()),
        lambda a: F.struct(
            a["url"].alias("url"),
            a["anchor_text"].alias("anchor_text"),
            (registrable_domain(a["url"]) == base).alias("is_internal"),
            F.array_contains(a["rel"], "nofollow").alias("nofollow"),
            F.array_contains(a["rel"], "sponsored").alias("sponsored"),
            F.array_contains(a["rel"], "ugc").alias("ugc"),
        ),
    )
    return {"_anchors": F.transform(anchors, record)}, {"links": placed}


def _link_counts() -> dict[str, Column]:
    flagged = lambda name: F.size(F.filter("links", lambda x: x[name]))
    urls = lambda test: F.array_distinct(F.transform(F.filter("links", test), lambda x: x["url"]))

    def page_link(rel: str) -> Column:
        hits = F.filter("nodes", lambda n: (n["tag"] == "link") & F.array_contains(_rel(n), rel))
        return F.get(F.filter(F.transform(hits, lambda n: resolve_link("url", n["attrs"]["href"])), lambda u: u.isNotNull()), F.lit(0))

    return {
        "_internal": urls(lambda x: x["is_internal"]),
        "external_links": urls(lambda x: ~x["is_internal"]),
        "nofollow_link_count": flagged("nofollow"),
        "sponsored_link_count": flagged("sponsored"),
        "ugc_link_count": flagged("ugc"),
        "non_http_link_count": F.size("_anchors") - F.size("links"),
        "pagination_next": page_link("next"),
        "pagination_prev": page_link("prev"),
    }


def _text_columns() -> dict[str, Column]:
    landmark = F.coalesce("main_text", "article_text")
    tag = F.when(F.col("main_text").isNotNull(), "main").otherwise("article")
    rest = F.coalesce("chrome_free_text", F.lit(""))
    fragment = (F.length(landmark) < LANDMARK_MIN_CHARS) & (
        F.length(rest) >= LANDMARK_FALLBACK_RATIO * F.greatest(F.length(landmark), F.lit(1))
    )
    trusted = landmark.isNotNull() & ~fragment
    return {
        "content_scope": F.when(trusted, tag).otherwise("body"),
        "content": F.when(trusted, landmark).otherwise(rest),
        "landmark_length": F.length(F.coalesce(landmark, rest)),
    }


def word_count(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.coalesce(F.length(F.trim(t)), F.lit(0)) == 0, 0).otherwise(F.size(F.split(F.trim(t), r"(?U)\s+")))


def extract_pages(documents: DataFrame) -> DataFrame:
    """Page signals of every document.

    ``documents`` has url, html, base_domain and optionally status_code and headers
    ``map<string,string>``; other columns pass through. Texts, links and images are kept whole.
    """
    rows = documents
    if "status_code" not in rows.columns:
        rows = rows.withColumn("status_code", F.lit(200))
    if "headers" not in rows.columns:
        rows = rows.withColumn("headers", F.lit(None).cast("map<string,string>"))
    out = tokenise(rows)
    canonical, status = _canonical_columns()
    blocks, structured = _structured_columns()
    raw_images, images = _image_columns()
    anchors, links = _link_columns()
    header = lambda name: F.get(
        F.transform(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), F.lit(0)
    )
    # Each step reads arrays bound by the previous one, so no selection is evaluated twice.
    out = out.withColumns({**_head_columns(), **canonical, **blocks, **_heading_columns(), **raw_images, **anchors, **_text_columns()})
    out = out.withColumns({**status, **structured, **_heading_counts(), **images, **links})
    out = out.withColumns({**_link_counts(), "content_type": header("content-type"), "x_robots_tag": header("x-robots-tag")})
    same_site = lambda u: registrable_domain(u) == registrable_domain("base_domain")
    paging = F.filter(F.array("pagination_next", "pagination_prev"), lambda u: u.isNotNull() & same_site(u))
    out = out.withColumns(
        {
            "internal_links": F.array_union("_internal", paging),
            "word_count": word_count("content"),
            "raw_word_count": word_count("raw_text"),
            "visible_word_count": word_count("visible_text"),
            "content_hash": content_hash("content"),
            "charset": F.nullif(F.regexp_extract(F.lower("content_type"), r"charset=\s*([^;\s]+)", 1), F.lit("")),
            "crawl_quality": F.when(F.col("status_code") == 0, "failed").when(F.col("nodes").isNull() | (F.size("nodes") == 0), "partial").otherwise("ok"),
        }
    )
    out = out.withColumns({"internal_link_count": F.size("internal_links"), "external_link_count": F.size("external_links")})
    return out.drop("nodes", "_ld_blocks", "_headings", "_images", "_anchors", "_internal", *_MEASURES)


def has_document(status: Column | str = "status_code", quality: Column | str = "crawl_quality") -> Column:
    """A 2xx response with a parsed document."""
    s, q = (F.col(x) if isinstance(x, str) else x for x in (status, quality))
    return F.coalesce(s.between(200, 299) & q.isin("ok", "render_failed"), F.lit(False))


def is_usable(status: Column | str = "status_code", quality: Column | str = "crawl_quality") -> Column:
    s, q = (F.col(x) if isinstance(x, str) else x for x in (status, quality))
    return F.coalesce((q != "failed") & (s != 0), F.lit(False))


def needs_rendering(mode: str = "auto", minimum: int = RENDER_MIN_CHARS) -> Column:
    """Whether the main content is too thin to trust without a browser."""
    if mode in ("always", "never"):
        return F.lit(mode == "always")
    return F.coalesce(F.col("landmark_length"), F.lit(0)) < minimum


def discovered_urls(pages: DataFrame) -> DataFrame:
    """Candidate URLs of extracted pages: canonical, hreflang, internal links, redirect hops."""
    base = F.coalesce("final_url", "url")
    alternates = F.transform("hreflang", lambda h: resolve_link(base, h["href"]))
    links = F.transform("internal_links", lambda u: normalize_url(u))
    hops = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    every = F.concat(F.array(normalize_url("canonical_url")), alternates, links, hops)
    return pages.select("base_domain", F.explode(F.array_distinct(F.array_compact(every))).alias("url")).distinct()


def admissible(url: Column | str = "url", base: Column | str = "base_domain") -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return (registrable_domain(u) == registrable_domain(base)) & is_probably_page(u)
