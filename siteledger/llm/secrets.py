"""Secret scans: three patterns, and windows of high Shannon entropy per character class, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # whole runs of 24 or more, as a run is taken from its start
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

SCALE = 1 << 32  # n * log2(n) is kept as an integer, so that steps add up exactly
PREFIX_BLOCK = 512


@dataclass(frozen=True)
class CharacterClass:
    """Strings of one alphabet: the window slides over ``width`` characters and needs ``bits`` of entropy per character."""

    kind: str
    letters: str
    pattern: str
    width: int
    bits: float

    @property
    def terms(self) -> list[int]:
        return [round(n * math.log2(n) * SCALE) if n else 0 for n in range(self.width + 1)]

    @property
    def most(self) -> int:
        """Greatest sum of n * log2(n) over the letters of a window that still has the entropy."""
        return math.floor(self.width * (math.log2(self.width) - self.bits) * SCALE)


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharacterClass("entropy", _UPPER + _LOWER + _DIGITS + "+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.75),
    CharacterClass("entropy_hex", _DIGITS + "ABCDEFabcdef", r"[0-9A-Fa-f]{24,}", 24, 3.0),
)
#: Stretches of fixed length that are no secrets; they part a candidate, so that what stands beside them is still judged.
HARMLESS = (
    (r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", 36),
    (r"(?i)abcdefghijklmnop|0123456789abcdef", 16),
    (r"(?i)placeholder", 11),
    (r"(?i)changeme", 8),
    (r"(?i)example", 7),
    (r"(?i)sample", 6),
    (r"(?i)dummy", 5),
    (r"(?i)xxxx", 4),
)
#: Names before a value: lower-case path segments and keys.
LEADING = r"^/?(?:[a-z_-]+[0-9]{0,4}[/=]+)+"
#: What is left of a candidate is no secret without a digit, without a letter, or where all of it is a file path.
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^/?(?:[a-z_-]+[0-9]{0,4}/)*[a-z_-]+[0-9]{0,4}/?$")


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts: running sums in blocks, so that a text with very many matches stays far from quadratic."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("own")))
    steps = F.filter(steps, lambda s: s["own"].isNotNull())
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(matches) - 1) / PREFIX_BLOCK).cast("int"))),
        lambda b: F.slice(steps, b * PREFIX_BLOCK + 1, PREFIX_BLOCK),
    )
    none = F.array().cast("array<int>")
    within = F.transform(
        blocks,
        lambda block: F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["gap"] + s["own"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["gap"])).alias("out")),
        ),
    )
    return F.aggregate(
        within,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, block: F.struct(
            (acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.transform(block["out"], lambda x: x + acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start``, ``match`` and ``value`` (the group) of all leftmost matches that do not overlap, by code points."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1 if group else 0))
    starts = _starts(F.split(text, pattern, -1), found)
    empty = F.array().cast("array<struct<start:int,match:string,value:string>>")
    rows = F.transform(F.arrays_zip(starts.alias("a"), found.alias("b"), value.alias("c")), lambda x: F.struct(x["a"].alias("start"), x["b"].alias("match"), x["c"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(empty)


def _spans(rows: Column, order: int, kind: str, least: int) -> Column:
    kept = F.filter(rows, lambda x: F.char_length(x["value"]) >= least)
    return F.transform(kept, lambda x: _span(x["start"], x["start"] + F.char_length(x["match"]), order, kind))


def _span(start: Column, end: Column, order: int, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _dense_part(string: Column, c: CharacterClass) -> Column:
    """First and last end of a window with enough entropy, -1 if none; one step per character over a count for each letter.

    A step adds the letter that enters the window and takes away the one that leaves it, and moves the sum of n * log2(n)
    by the change of those two counts.
    """
    terms = F.array(*[F.lit(t).cast("long") for t in c.terms])
    index = F.transform(F.split(string, ""), lambda ch: F.instr(F.lit(c.letters), ch))
    # Element i: the letter that enters, and the one that entered a window before (0 for none).
    steps = F.filter(F.arrays_zip(index.alias("a"), F.concat(F.array_repeat(F.lit(0), c.width), index).alias("b")), lambda s: s["a"].isNotNull())
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.letters)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def change(before: Column, after: Column) -> Column:
        return F.element_at(terms, after + 1) - F.element_at(terms, before + 1)

    def step(acc: Column, s: Column) -> Column:
        enters, leaves = s["a"], s["b"]
        n_in = F.element_at(acc["n"], enters)
        n_out = F.when(leaves > 0, F.element_at(acc["n"], F.greatest(leaves, F.lit(1)))).otherwise(0)
        total = F.when(enters == leaves, acc["sum"]).otherwise(
            acc["sum"] + change(n_in, n_in + 1) + F.when(leaves > 0, change(F.greatest(n_out, F.lit(1)), F.greatest(n_out, F.lit(1)) - 1)).otherwise(0)
        )
        counts = F.transform(acc["n"], lambda v, i: v + (i + 1 == enters).cast("int") - (i + 1 == leaves).cast("int"))
        at = acc["at"] + 1
        high = (at >= c.width) & (total <= c.most)
        return F.struct(
            counts.alias("n"),
            total.alias("sum"),
            at.alias("at"),
            F.when(high & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"),
            F.when(high, at).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column, c: CharacterClass, order: int, allowed: tuple[str, ...]) -> Column:
    rest = _matches(text, c.pattern)
    lead = lambda x: F.char_length(F.regexp_extract(x["match"], LEADING, 0))
    rest = F.transform(rest, lambda x: F.struct((x["start"] + lead(x)).alias("start"), F.substring(x["match"], lead(x) + 1, F.char_length(x["match"])).alias("match")))
    rest = F.filter(rest, lambda x: F.char_length(x["match"]) >= c.width)
    allow = "|".join(f"(?:{p})" for p in allowed)
    rest = F.filter(rest, lambda x: ~F.regexp_like(x["match"], F.lit(allow))) if allowed else rest
    dense = F.transform(rest, lambda x: F.struct(x["start"].alias("start"), _dense_part(x["match"], c).alias("part")))
    dense = F.filter(dense, lambda x: x["part"]["first"] > 0)
    return F.transform(dense, lambda x: _span(x["start"] + x["part"]["first"] - c.width, x["start"] + x["part"]["last"], order, c.kind))


def _parted(text: Column, harmless: tuple[tuple[str, int], ...]) -> Column:
    """The text with spaces in place of the harmless stretches, so that positions stay."""
    for pattern, length in harmless:
        text = F.regexp_replace(text, pattern, " " * length)
    return text


def find_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED,
    harmless: tuple[tuple[str, int], ...] = HARMLESS,
) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: arrays of spans (``start``, ``order``, ``end``, ``kind``) in order of start, then kind.

    ``base`` holds the matches of the three patterns; ``added`` holds, for each candidate string of a class, the stretch from its first
    to its last window of enough entropy. The allow-list parts a candidate at harmless stretches, takes names in front away and
    judges what is left, so a key beside a placeholder or below a path is found. Positions are code points, ends
    exclusive. Null is empty text and has no spans; every row is judged alone, so repeated rows and ids get a row each. There
    is no shuffle and no Python: texts without a match of a pattern cost one search for it.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = F.concat(
        _spans(_matches(text, ASSIGN, 2), 0, "assign", ASSIGN_LEAST),
        _spans(_matches(text, ACCESS), 1, "access", ACCESS_LEAST),
        _spans(_matches(text, HEX), 2, "hex", 0),
    )
    parted = lambda c: F.when(F.regexp_like(text, F.lit(c.pattern)), _parted(text, harmless)).otherwise("")
    added = F.concat(*[_entropy_spans(parted(c), c, 3 + i, allowed) for i, c in enumerate(classes)])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.array_sort(base).alias("base"), F.array_sort(added).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
