"""Language by hyperdimensional profiles: letters are random vectors, n-grams bind them, texts and languages bundle n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, slices, spare_name

DIMENSIONS = 512
SEED = 20240229
UNKNOWN = "und"
COUNT_CELLS = 1_000_000  # counts (texts times n-grams) held at once
SLICE_BYTES = 1 << 20  # text looked at together; the arrays of a slice take some forty times as much
NGRAM_ROWS = 8192  # n-gram vectors made at once
DENSE_CODES = 1 << 24

BUNDLES = pa.schema([("lang", pa.string()), ("profile", pa.list_(pa.float64()))])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 16)
def _vector(code: int) -> np.ndarray:
    """The random +1/-1 vector of a letter; code 0 is the gap between words."""
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


class Trigrams:
    """Letter trigrams of a list of texts, word gaps included: their codes, which of them occur, and where texts start."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.array([len(t) for t in lowered]))
        letter = _letters()[points]
        # A run of other characters is one gap.
        keep = letter | np.concatenate([[True], letter[:-1]])
        first = np.concatenate([[0], ends[:-1]])
        keep[first] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        points = np.where(letter, points, 0)[keep]
        self.n_letters = np.add.reduceat(letter, first) if len(texts) else np.zeros(0, int)
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        self.alphabet = np.flatnonzero(seen | (np.arange(0x110000) == 0))
        index = np.zeros(0x110000, np.int64)
        index[self.alphabet] = np.arange(len(self.alphabet))
        small, a = index[points], len(self.alphabet)
        codes = (small[:-2] * a + small[1:-1]) * a + small[2:]
        # A trigram belongs to the text it begins in, and does not run into the next.
        begin, end = upto[first], upto[ends]
        inside = np.ones(len(codes), bool)
        for cut in (end[:-1] - 1, end[:-1] - 2):
            inside[cut[(cut >= 0) & (cut < len(codes))]] = False
        total = np.concatenate([[0], np.cumsum(inside)])
        self.starts = total[np.minimum(begin, len(codes))]
        self.ends = total[np.minimum(end, len(codes))]
        codes = codes[inside]
        if a**3 <= DENSE_CODES:
            here = np.bincount(codes, minlength=1) > 0
            self.used = np.flatnonzero(here)
            self.codes = (np.cumsum(here) - 1)[codes]
        else:
            self.used, self.codes = np.unique(codes, return_inverse=True)

    def vectors(self, rows: slice) -> np.ndarray:
        """Bound vectors of some of the trigrams: the first letter permuted twice, the second once, all multiplied."""
        a = len(self.alphabet)
        letters = np.stack([_vector(int(c)) for c in self.alphabet])
        code = self.used[rows]
        one, two, three = code // (a * a), code // a % a, code % a
        return (np.roll(letters, 2, axis=1)[one] * np.roll(letters, 1, axis=1)[two] * letters[three]).astype(np.float32)

    def bundle(self, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of counted trigrams, one row per row of counts."""
        out = np.zeros((len(counts), DIMENSIONS), np.float64)
        for a in range(0, len(self.used), NGRAM_ROWS):
            rows = slice(a, a + NGRAM_ROWS)
            out += counts[:, rows].astype(np.float32) @ self._cached(a, rows)
        return out

    def _cached(self, a: int, rows: slice) -> np.ndarray:
        if len(self.used) > 4 * NGRAM_ROWS:
            return self.vectors(rows)
        self.__dict__.setdefault("made", {})
        if a not in self.made:
            self.made[a] = self.vectors(rows)
        return self.made[a]

    def text_bundles(self) -> Iterator[np.ndarray]:
        """Bundles of the texts in order, in chunks."""
        n, width = len(self.starts), max(1, len(self.used))
        step = max(1, COUNT_CELLS // width)
        for a in range(0, n, step):
            b = min(n, a + step)
            lo, hi = self.starts[a], self.ends[b - 1]
            text = np.repeat(np.arange(b - a), (self.ends - self.starts)[a:b])
            yield self.bundle(np.bincount(text * width + self.codes[lo:hi], minlength=(b - a) * width).reshape(b - a, width))


def language_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of n-gram vectors per language and batch; exact integers, so the order of adding does not matter."""
    for batch in slices(batches, 0, SLICE_BYTES):
        texts, langs = ([x for x in c.to_pylist()] for c in batch.columns)
        grams = Trigrams(texts)
        names, of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        text = np.repeat(of, grams.ends - grams.starts)
        width = max(1, len(grams.used))
        counts = np.stack([np.bincount(grams.codes[text == i], minlength=width) for i in range(len(names))])
        profiles = _exact(grams, counts)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(profiles.tolist(), pa.list_(pa.float64()))], schema=BUNDLES)


def _exact(grams: Trigrams, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), DIMENSIONS))
    for a in range(0, len(grams.used), NGRAM_ROWS):
        rows = slice(a, a + NGRAM_ROWS)
        out += counts[:, rows].astype(np.float64) @ grams.vectors(rows).astype(np.float64)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


class Prototypes:
    """Languages as unit vectors around their mean, which holds what all of them share."""

    def __init__(self, profiles: dict[str, list[float]]) -> None:
        self.names = sorted(profiles, key=lambda n: n.encode())
        unit = _unit(np.array([profiles[n] for n in self.names])) if profiles else np.zeros((0, DIMENSIONS))
        self.mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIMENSIONS)
        self.unit = _unit(unit - self.mean)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        grams = Trigrams(texts)
        names, scores = [], []
        for bundle in grams.text_bundles():
            cosine = _unit(_unit(bundle) - self.mean) @ self.unit.T
            best = cosine.argmax(axis=1) if self.names else np.zeros(len(bundle), int)
            names += [self.names[i] if self.names else UNKNOWN for i in best]
            top = cosine[np.arange(len(best)), best] if self.names else np.zeros(len(best))
            scores += np.clip((1 + top) / 2, 0, 1).round(9).tolist()
        for i in np.flatnonzero(grams.n_letters == 0):
            names[i], scores[i] = UNKNOWN, 0.0
        if not self.names:
            scores = [0.0] * len(names)
        return names, scores


def fit_prototypes(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Prototypes:
    """One prototype per label from every labelled text.

    What reaches the driver is one vector per label. Labels are the languages of the corpus; text does not add to them.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    sums = rows.filter("lang is not null").mapInArrow(language_bundles, "lang string, profile array<double>")
    sums = sums.select("lang", F.posexplode("profile")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    per_lang = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("profile"))
    return Prototypes({r.lang: r.profile for r in per_lang.toLocalIterator()})


def predict_language(docs: DataFrame, prototypes: Prototypes, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows with ``pred_col`` and ``score_col`` added; only the text is looked at.

    The score is (1 + cosine) / 2 with the nearest prototype, both taken around the mean of the prototypes. A text that is null
    or has no letter is ``und`` with score 0, as is every text where no language was learned. Ties go to the first name.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, SLICE_BYTES):
            names, scores = prototypes.predict([x or "" for x in batch.column(at).to_pylist()])
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, pred_col, score_col])

    schema = docs.withColumns({pred_col: F.lit("").cast("string"), score_col: F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def split_column(id_col: str, modulus: int, chosen: int):
    """Whether the checksum of the id as text falls on ``chosen``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus == chosen


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; learns from the labelled rows that are not held out."""
    source = columns(docs, id_col, text_col, lang_col)
    prototypes = fit_prototypes(source.filter(~split_column(id_col, modulus, held)), text_col=text_col, lang_col=lang_col)
    rows = source.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), split_column(id_col, modulus, held).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return predict_language(rows, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_known_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose text has a language, with all their columns; rejected are texts that are null or have no letter."""
    source = columns(docs, id_col, text_col, lang_col)
    prototypes = fit_prototypes(source.filter(~split_column(id_col, 3, 1)), text_col=text_col, lang_col=lang_col)
    pred, score = spare_name(docs, "lang_pred"), spare_name(docs, "lang_score")
    found = predict_language(docs, prototypes, text_col=text_col, pred_col=pred, score_col=score)
    return found.filter(F.col(pred) != UNKNOWN).drop(pred, score)
