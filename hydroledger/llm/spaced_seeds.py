"""Benchmark decontamination by spaced-seed hashing.

A mask looks at 7 of 13 neighbouring words and ignores the rest.  Whichever two of 13
words were replaced, one of the masks ignores both, so every window of 13 words that
differs from a benchmark item in at most two words shares a masked hash with it.  Hits
are verified word by word along their diagonal.  Items of 5 to 12 words match as a
whole and without replacement; shorter items say too little and match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash64

SPAN = 13
#: Words of a window that must be equal: 11 of 13 is a similarity of 0.85.
EQUAL = 11
SHORTEST = 5
#: Words of benchmark text that one pass over the documents compares.
SLICE_WORDS = 2_000_000
# Fixed masks: '#' is compared, '.' is ignored; every pair of positions is ignored by one.
MASKS = (
    "######......#",
    "#.....#####.#",
    ".###..###..#.",
    ".#..###..###.",
    "#.##.....####",
    "#...##.##..##",
    "..####.###...",
)
#: Words that are compared together, so that their hashes stay in the processor's cache.
GROUP_WORDS = 16_384
SPANS_SCHEMA = (
    "item_id long, doc_start int, item_start int, n_words int, n_equal int, similarity double"
)
_PUNCTUATION = ".,;:!?\"'()[]{}|*_#"
_FILTER_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends; bare punctuation is no word."""
    stripped = [w.strip(_PUNCTUATION) for w in (text or "").lower().split()]
    return [w for w in stripped if w]


def _coefficients(mask: int, count: int) -> np.ndarray:
    """Odd multipliers; each mask and length has its own, so that their hashes don't mix."""
    rng = np.random.default_rng([mask, count])
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass(frozen=True)
class Seed:
    """Positions compared from a start, and their multipliers."""

    at: tuple[int, ...]
    by: np.ndarray
    span: int

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Hash at each start, from 32-bit words."""
        count = len(words) - self.span + 1
        if count <= 0:
            return np.zeros(0, np.uint32)
        total = words[self.at[0] : self.at[0] + count] * self.by[0]
        for at, by in zip(self.at[1:], self.by[1:]):
            total += words[at : at + count] * by
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x9E3779B1)
        return total


def seeds_for(lengths: set[int]) -> list[Seed]:
    """The masks, and one gapless seed for each length of a short item."""
    found = []
    for i, mask in enumerate(MASKS):
        at = tuple(k for k, x in enumerate(mask) if x == "#")
        found.append(Seed(at, _coefficients(i, len(at)), SPAN))
    for n in sorted(n for n in lengths if SHORTEST <= n < SPAN):
        found.append(Seed(tuple(range(n)), _coefficients(100 + n, n), n))
    return found


class Index:
    """Masked hashes of a slice of benchmark items, sorted, with their places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [
            np.array([hash64(w) for w in words_of(text)], np.uint64) for _, text in items
        ]
        self.seeds = seeds_for({len(w) for w in self.words})
        hashes, numbers, places = [], [], []
        for seed in self.seeds:
            for k, words in enumerate(self.words):
                if (len(words) < SPAN) != (seed.span < SPAN) or (
                    seed.span < SPAN and len(words) != seed.span
                ):
                    continue
                found = seed.hashes(words.astype(np.uint32))
                hashes.append(found)
                numbers.append(np.full(len(found), k, np.int64))
                places.append(np.arange(len(found)))
        empty = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes or [empty.astype(np.uint32)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.numbers = np.concatenate(numbers or [empty])[order]
        self.places = np.concatenate(places or [empty])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._bucket(self.hashes)] = True

    @staticmethod
    def _bucket(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint32(32 - _FILTER_BITS)

    def diagonals(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item number, document start minus item start) of all seed hits.

        ``bounds`` are the documents' starts in ``words`` and its end.
        """
        found, short = [], words.astype(np.uint32)
        for seed in self.seeds:
            hashes = seed.hashes(short)
            at = np.flatnonzero(self.filter[self._bucket(hashes)])
            if not len(at):
                continue
            low = np.searchsorted(self.hashes, hashes[at], "left")
            count = np.searchsorted(self.hashes, hashes[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            if not len(at):
                continue
            hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            doc = np.searchsorted(bounds, at, "right") - 1
            shift = at - bounds[doc] - self.places[hit]
            found.append(np.unique(np.stack((doc, self.numbers[hit], shift), 1), axis=0))
        if not found:
            return []
        return [tuple(x) for x in np.unique(np.concatenate(found), axis=0).tolist()]

    def overlaps(self, documents: list[np.ndarray]) -> list[tuple]:
        """(document, rows of SPANS_SCHEMA): maximal stretches of passing windows per diagonal."""
        rows = []
        bounds = np.cumsum([0] + [len(d) for d in documents])
        together = np.concatenate(documents or [np.zeros(0, np.uint64)])
        for doc, number, shift in self.diagonals(together, bounds):
            item, words = self.words[number], documents[doc]
            first = max(0, -shift)
            last = min(len(item), len(words) - shift)
            equal = item[first:last] == words[first + shift : last + shift]
            short = len(item) < SPAN
            span, need = (len(item), len(item)) if short else (SPAN, EQUAL)
            if len(equal) < span:
                continue
            sums = np.concatenate(([0], np.cumsum(equal)))
            good = np.flatnonzero(sums[span:] - sums[:-span] >= need)
            if not len(good):
                continue
            for run in np.split(good, np.flatnonzero(np.diff(good) > span) + 1):
                a, b = int(run[0]), int(run[-1]) + span
                same = int(sums[b] - sums[a])
                place = (first + shift + a, first + a, b - a, same, same / (b - a))
                rows.append((doc, self.ids[number], *place))
        return rows

    def scan(self, texts: list[str | None], cache: WordHashes) -> list[tuple]:
        """(number of the text, rows of SPANS_SCHEMA) of all texts, compared in groups."""
        rows, group, first, held = [], [], 0, 0
        for number, text in enumerate(texts):
            group.append(_document(cache, text))
            held += len(group[-1])
            if held >= GROUP_WORDS or number == len(texts) - 1:
                rows += [(first + doc, *row) for doc, *row in self.overlaps(group)]
                group, first, held = [], number + 1, 0
        return rows


def _slices(benchmark: DataFrame, slice_words: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in slices of bounded size, each read by itself."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    count = max(1, math.ceil(words / slice_words))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k)
        if found := sorted({(r[0], r[1]) for r in part.collect()}, key=str):
            yield found


def overlaps(
    docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """doc_id and SPANS_SCHEMA: stretches of a document that repeat a benchmark item.

    Starts and lengths count words.  Every whole text is read; a benchmark too large to
    travel with the tasks is compared in slices, one pass over the documents each.
    Missing or empty texts and an empty benchmark give no rows; repeated documents and
    items each give theirs; ties don't occur, as all stretches are returned.
    """
    spark, found = docs.sparkSession, None
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    for items in _slices(benchmark, slice_words):

        def run(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            index, cache = Index(items), WordHashes(_token)
            for batch in batches:
                ids = batch["doc_id"].tolist()
                found = index.scan(batch["text"].tolist(), cache)
                yield _frame([(ids[number], *row) for number, *row in found])

        part = thin.mapInPandas(run, f"doc_id long, {SPANS_SCHEMA}")
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], f"doc_id long, {SPANS_SCHEMA}")


def _token(word: str) -> int:
    """Hash of a bare word, zero for bare punctuation."""
    bare = word.strip(_PUNCTUATION)
    return hash64(bare) or 1 if bare else 0


def _document(cache: WordHashes, text: str | None) -> np.ndarray:
    found = cache.array((text or "").lower().split())
    return found[found != 0]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", *(x.split()[0] for x in SPANS_SCHEMA.split(", "))]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"doc_id": "Int64", "item_id": "Int64", "similarity": "float64"})


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, with all their columns.

    Missing and empty texts stay; repeated rows stay or go together; an empty table stays
    empty, and an empty benchmark drops nothing.
    """
    kept = docs
    for items in _slices(benchmark, slice_words):
        kept = kept.where(_clean(items)(F.col("text").cast("string")))
    return kept


def _clean(items: list[tuple[int, str]]):
    """A column function: whether a text repeats none of ``items``."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, cache = Index(items), WordHashes(_token)
        for texts in batches:
            passing = np.ones(len(texts), bool)
            passing[[number for number, *_ in index.scan(texts.tolist(), cache)]] = False
            yield pd.Series(passing)

    return clean
