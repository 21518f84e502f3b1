"""Repetition inside a text by a suffix array over its words: intervals of common prefixes give the repeated stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 3  # words of the base rule
MIN_WORDS = 50
MAX_WINDOW_PERCENT = 50
REPEAT_WORDS = 8  # words from which a repeated stretch counts
MAX_COVERED_PERCENT = 30
MAX_REPEAT_WORDS = 100
SLICE_BYTES = 4 << 20

RULES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
     ("n_repeat_words", pa.int64()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_SPARK = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, "
    "longest_repeat long, spans array<struct<start:bigint,end:bigint>>"
)


def longest_matches(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every word, how many words from it on occur again elsewhere in the same text.

    Suffixes are sorted by doubling: ranks by 1, 2, 4 ... words, where only suffixes that still tie are sorted again. The
    common prefix of neighbours in the suffix array follows from the ranks of each level, longest first; the greater of
    a suffix's two neighbours is its deepest interval.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    end = np.searchsorted(text, text, "right")  # where the text of each word ends
    order = np.argsort(text.astype(np.int64) << 32 | words, kind="stable")
    key = (text.astype(np.int64) << 32 | words)[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    levels, step = [rank.copy()], 1
    while True:
        tied = ~(new & np.append(new[1:], True))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        after = at + step
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)], 0)
        sub = np.lexsort((second, rank[at]))
        at, second = at[sub], second[sub]
        first = rank[at]
        order[slots] = at
        differs = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[slots] = differs
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(differs, slots, 0)) + 1
        step *= 2
        levels.append(rank)
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero((levels[0][a] == levels[0][b]))
    a, b = a[pair], b[pair]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << level
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(match: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Words inside a repeated stretch of at least ``least`` words: whole stretches, or their first ``length`` words."""
    at = np.flatnonzero(match >= least)
    change = np.zeros(len(match) + 1, np.int64)
    change[at] += 1
    np.add.at(change, at + (match[at] if length is None else length), -1)
    return np.cumsum(change[:-1]) > 0


def measure(repeat_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            words: list[bytes] = []
            counts, symbols, dup_lines = [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                own = raw.split()
                words += own
                counts.append(len(own))
                symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
                lines = [x for x in raw.split(b"\n") if x.strip()]
                dup_lines.append(len(lines) - len(set(lines)))
            coded = pa.array(words, pa.binary()).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            width = np.array([len(w.decode()) for w in coded.dictionary.to_pylist()], np.int64)
            counts = np.array(counts, np.int64)
            match = longest_matches(code, np.repeat(np.arange(len(counts)), counts))
            ends = np.cumsum(counts)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])
            per = lambda x: (u := upto(x))[ends] - u[ends - counts]
            inside = covered(match, repeat_words)
            longest = np.zeros(len(counts), np.int64)
            np.maximum.at(longest, np.repeat(np.arange(len(counts)), counts), match)
            starts = ends - counts
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
            spans: list[list[dict]] = [[] for _ in counts]
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                doc = int(np.searchsorted(ends, a, "right"))
                while a < b:  # neighbours in two texts are two spans
                    stop = min(b, int(ends[doc]))
                    if stop > a:
                        spans[doc].append({"start": a - int(starts[doc]), "end": stop - int(starts[doc])})
                    a, doc = max(a, stop), doc + 1
            columns_ = [counts, per(width[code] if len(code) else code), symbols, dup_lines, per(covered(match, WINDOW, WINDOW)), per(inside), longest, spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns_, list(RULES)[1:]))], schema=RULES)

    return run


def repetition_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_window_percent: int = MAX_WINDOW_PERCENT,
    repeat_words: int = REPEAT_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_repeat_words: int = MAX_REPEAT_WORDS,
) -> DataFrame:
    """Measures and verdict of every row, in one pass without a shuffle.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (words in three-word windows found twice)
    are the base; ``spans`` is the union of all maximal repeated stretches of ``repeat_words`` words or more, in word positions,
    ``n_covered_words`` their length, ``longest_repeat`` the longest stretch of words that occurs twice (the two may overlap).
    ``kept`` needs ``min_words``, at most ``max_window_percent`` of words in repeated windows, at most ``max_covered_percent``
    covered and no repeat above ``max_repeat_words``. Null and empty texts have no words and fail. Each text is judged alone,
    so repeated rows and ids get a row each; a very long text is one suffix array of its own words.
    """
    bounded_batches(docs.sparkSession)
    source = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = source.mapInArrow(measure(repeat_words), _SPARK)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    good = (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat_words)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
