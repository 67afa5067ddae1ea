"""Ranked lexical search with hashed max-sketches.

A document's terms are hashed to coordinates, and each coordinate keeps the largest
impact that falls on it.  A query looks its terms up there: the weighted sum of what it
finds is at least the document's score, since a collision can only raise a coordinate.
All queries are looked up in a block of sketches at once.  Per query the block's
documents are then scored exactly from their own terms, the highest bound first, until the
next bound is below the k-th best score so far; a task carries that threshold from block to
block.  Bounds and scores are whole numbers below 2**53, so the doubles that hold the
bounds are exact and nothing is lost to rounding.

Documents are never shuffled: each task returns its k best per query, and those meet in one
ranking.  Queries run in slices of ``SLICE_TERMS`` terms, so the driver and the tasks hold
one slice at a time; each slice's result is written before the next begins.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, new_folder, starts_in_order

K = 10
#: Coordinates of a sketch: the power of two from this many per distinct term on.
SPREAD = 16
LEAST_SIZE, LARGEST_SIZE = 1 << 6, 1 << 20
#: Query terms compared with the documents at a time, and with the rest of the last query.
SLICE_TERMS = 200_000
#: Documents, bytes of text, and cells of sketches held together; a longer document stands alone.
BLOCK_DOCS = 1024
BLOCK_BYTES = 8_000_000
BLOCK_CELLS = 4_000_000
#: Cells gathered at a time while bounds are added up.
GATHERED_CELLS = 2_000_000

# Fixed values of the score: weight scale, impact scale, saturation, length share in per cent.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TF_SCALE = 1000
LENGTH_SCALE = 8
LENGTH_SHARE = 75

#: Bytes that separate terms, as blanks; A-Z become a-z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a whole UTF-8 text in order; a missing text has none."""
    return (text or b"").translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight, from the number of documents and of those that hold it."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: int, documents: int, total: int) -> int:
    """A document's length against the mean, in per cent, by ``LENGTH_SHARE``."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total


def impact(tf, norm):
    """What ``tf`` occurrences add to a score per unit of weight; grows with ``tf``."""
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * norm)


class Queries:
    """A slice's queries: their weighted terms, ready to be looked up and to score."""

    def __init__(self, texts: dict[int, bytes], holding: dict[bytes, int], documents: int, total: int):
        self.documents, self.total = documents, total
        self.ids, self.weighted = [], []
        for number, text in texts.items():
            found = [
                (term, times * weight(documents, holding[term]))
                for term, times in Counter(terms(text)).items()
                if term in holding
            ]
            found = [(term, w) for term, w in found if w]
            if found:  # others score above zero nowhere
                self.ids.append(number)
                self.weighted.append(found)
        flat = [pair for found in self.weighted for pair in found]
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t, _ in flat], np.uint64)
        self.weights = np.array([w for _, w in flat], np.float64)
        sizes = [len(found) for found in self.weighted]
        self.starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds, queries x documents, from sketches of one size (coordinates x documents)."""
        size, docs = sketches.shape
        at = (self.hashes & np.uint64(size - 1)).astype(np.int64)
        out = np.empty((len(self.ids), docs))
        step = max(1, GATHERED_CELLS // max(1, len(at)))
        for low in range(0, docs, step):
            seen = sketches[:, low : low + step].take(at, axis=0)
            seen *= self.weights[:, None]
            np.add.reduceat(seen, self.starts, axis=0, out=out[:, low : low + step])
        return out

    def score(self, query: int, counts: dict[bytes, int], norm: int) -> int:
        """Exact score of a document for the query at this place."""
        total = 0
        for term, w in self.weighted[query]:
            tf = counts.get(term)
            if tf:
                total += w * impact(tf, norm)
        return total


def sketch(counts: list[dict], norms: list[int], size: int, hashes: WordHashes) -> np.ndarray:
    """Coordinatewise maxima of the documents' impacts, coordinates x documents."""
    sizes = [len(c) for c in counts]
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.concatenate([hashes.array(c) for c in counts]) & np.uint64(size - 1)
    tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])
    impacts = impact(tf, np.repeat(np.array(norms, np.int64), sizes)).astype(np.float64)
    cells = np.zeros(size * len(counts))
    np.maximum.at(cells, at.astype(np.int64) * len(counts) + doc, impacts)
    return cells.reshape(size, len(counts))


def sketch_size(distinct: int) -> int:
    """Coordinates for a document of so many distinct terms; fewer only loosen its bound."""
    return min(LARGEST_SIZE, max(LEAST_SIZE, 1 << (SPREAD * distinct - 1).bit_length()))


class Best:
    """The k best documents of one query so far: highest score, then smallest id, missing last."""

    __slots__ = ("k", "found")

    def __init__(self, k: int):
        self.k, self.found = k, []

    def least(self) -> int:
        """The score from which on a document may enter."""
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        if score >= self.least():
            insort(self.found, (-score, doc_id is None, doc_id or 0))
            del self.found[self.k :]


class Searcher:
    """Takes documents in blocks and keeps the k best per query."""

    def __init__(self, queries: Queries, k: int):
        self.queries = queries
        self.hashes = WordHashes(xxhash.xxh64_intdigest)
        self.best = [Best(k) for _ in queries.ids]
        self.scored = 0

    def add(self, block: list[tuple[int | None, bytes | None]]) -> None:
        """Documents (doc_id, text in UTF-8), at most ``BLOCK_DOCS``."""
        of_size: dict[int, list] = {}
        for doc_id, text in block:
            words = terms(text)
            if words:
                counts = Counter(words)
                norm = length_norm(len(words), self.queries.documents, self.queries.total)
                of_size.setdefault(sketch_size(len(counts)), []).append((doc_id, counts, norm))
        for size, docs in of_size.items():
            step = max(1, BLOCK_CELLS // size)
            for at in range(0, len(docs), step):
                self._rank(size, docs[at : at + step])

    def _rank(self, size: int, docs: list[tuple]) -> None:
        ids, counts, norms = zip(*docs)
        bounds = self.queries.bounds(sketch(list(counts), list(norms), size, self.hashes))
        least = np.array([b.least() for b in self.best])
        for query in np.flatnonzero(bounds.max(axis=1) >= least).tolist():
            best, row = self.best[query], bounds[query]
            near = np.flatnonzero(row >= best.least())
            near = near[np.argsort(-row[near], kind="stable")]
            for doc, bound in zip(near.tolist(), row[near].tolist()):
                if bound < best.least():
                    break
                self.scored += 1
                score = self.queries.score(query, counts[doc], norms[doc])
                if score:
                    best.add(score, ids[doc])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    block, held = [], 0
    for batch in batches:
        for doc_id, text in zip(*batch.columns):
            block.append((doc_id.as_py(), text.as_py()))
            held += len(block[-1][1] or b"")
            if held >= BLOCK_BYTES or len(block) >= BLOCK_DOCS:
                yield block
                block, held = [], 0
    yield block


def _statistics(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict, int, int]:
    """Documents per term of ``vocabulary``, documents with terms, all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, total = Counter(), 0, 0
        for block in _blocks(batches):
            for _, text in block:
                words = terms(text)
                documents += bool(words)
                total += len(words)
                holding.update(vocabulary.intersection(words))
        rows = [(t, n, None) for t, n in holding.items()] + [(None, documents, total)]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "documents", "total"])

    # As many rows as the slice has terms, and one.
    found = (
        docs.mapInArrow(run, "term binary, documents long, total long")
        .groupBy("term")
        .agg(F.sum("documents").alias("documents"), F.sum("total").alias("total"))
        .collect()
    )
    holding = {bytes(r.term): r.documents for r in found if r.term is not None}
    documents, total = next(((r.documents, r.total) for r in found if r.term is None), (0, 0))
    return holding, documents, total


def _slice_best(docs: DataFrame, texts: dict[int, bytes], k: int) -> DataFrame | None:
    """query, doc_id and score of the k best documents of each task; None where nothing can score."""
    vocabulary = frozenset(t for text in texts.values() for t in terms(text))
    holding, documents, total = _statistics(docs, vocabulary)
    queries = Queries(texts, holding, documents, total) if total else None
    if queries is None or not queries.ids:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries, k)
        for block in _blocks(batches):
            searcher.add(block)
        for number, best in zip(queries.ids, searcher.best):
            if best.found:
                scores, missing, ids = zip(*best.found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(ids), pa.int64()),
                        pa.array([None if gone else i for gone, i in zip(missing, ids)], pa.int64()),
                        pa.array([-s for s in scores], pa.int64()),
                    ],
                    ["query", "doc_id", "score"],
                )

    return docs.mapInArrow(run, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, scores above zero only.

    Every row of ``docs`` is a document, repeated rows too; every distinct (item_id, text)
    is an item, so repeated items are answered once.  Equal scores rank by ascending
    doc_id, missing ids last.  Missing, empty and unmatched items give no rows, nor do empty
    tables; missing and empty texts are documents without terms, which count nowhere.
    Texts of any length are searched whole.  Extra columns are left out whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary")
    )
    wanted = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    sized = (
        wanted.select("text")
        .distinct()
        .withColumn("size", F.regexp_count("text", F.lit(_TERM)).cast("long"))
        .where("size > 0")
    )
    queries = checkpointed(
        starts_in_order(sized, [], ["text"], "size", "start").select(
            "text",
            F.expr(f"start div {SLICE_TERMS}").alias("slice"),
            F.monotonically_increasing_id().alias("query"),
        )
    )
    folder = new_folder(spark, "ranked")
    schema = "query long, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    slices = sorted(r.slice for r in queries.select("slice").distinct().toLocalIterator())
    for number in slices:
        texts = {
            r.query: r.text.encode("utf-8", "replace")
            for r in queries.where(F.col("slice") == number).select("query", "text").collect()
        }
        best = _slice_best(rows, texts, k)
        if best is not None:
            best.write.mode("append").parquet(folder)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (
        spark.read.schema(schema)
        .parquet(folder)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return (
        wanted.join(queries.select("text", "query"), "text")
        .join(ranked, "query")
        .select("item_id", "rank", "doc_id", "score")
    )
