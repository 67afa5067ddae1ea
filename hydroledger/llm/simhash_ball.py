"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two differing bits have a common neighbour within one bit of
both.  So every distinct fingerprint emits itself and its 64 one-bit variants, the
variants are shuffled, and fingerprints that meet on one are within two bits of each
other.  A variant is shared by at most 65 distinct fingerprints; chaining them in order
links all of them with one row each, without their pairs.  Copies fold into one
fingerprint before anything is emitted, so their number never matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 64
SHINGLE = 3
SEED = 42
# Names of the columns that ``keep_one`` adds meanwhile.
_KEY, _FP, _ROW = "_simhash_key", "_simhash_fp", "_simhash_row"

# One row per byte value: its bits, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_CHUNK = 1 << 20


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero without words.

    Words are separated by ASCII white space and lower-cased in A-Z; shingles count as
    often as they occur.  Fewer words than a shingle form one shingle together.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1))
    counts = np.zeros(BITS, np.int64)
    total = len(starts)
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[size - 1 :][at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        seen = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ _BYTE_BITS).ravel()
    bits = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(text: str | None) -> int:
    """SimHash as a signed 64-bit number."""
    value = simhash(text)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signed 64-bit ``fp`` of every row; a missing text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return thin.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Verified links ``a`` < ``b`` that connect all fingerprints within two bits.

    Not every pair: those that meet on a variant are chained in order.
    """
    variants = distinct.select("fp").select(
        "fp",
        F.explode(
            F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
        ).alias("variant"),
    )
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        variants.select(before.alias("a"), F.col("fp").alias("b"))
        .where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest ``root`` it is connected to, for every node of an edge.

    Alternates the large-star and small-star steps of distributed connected components
    (Kiveris et al., 2014) until the edges stop changing.  The minimum of each node
    is written before it is joined back, so that Spark may split a hot node's rows.
    """

    def star(directed: DataFrame) -> DataFrame:
        least = directed.groupBy("u").agg(F.min("v").alias("m"))
        return checkpointed(least.withColumn("m", F.least("u", "m")))

    def state(df: DataFrame) -> tuple:
        marks = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        return tuple(df.agg(F.count("*"), marks).first())

    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    last = state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(star(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = checkpointed(large)
        least = star(large)
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = checkpointed(small)
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most two bits; component_id
    is the smallest doc_id that can be reached.  Equal texts, texts without words and
    repeated rows share a fingerprint and so a component.  A missing doc_id is returned
    as such and is never a component's name unless nothing else is; extra columns are
    left out; an empty table gives no rows.
    """
    marked, classes = _classes(docs)
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and fp of every row; fp, root and component_id of every distinct fp; both written.

    ``root`` tells components apart even where a doc_id with several texts names two of them.
    """
    marked = checkpointed(fingerprints(docs))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = checkpointed(
        distinct.join(
            components(links(distinct)).withColumnRenamed("node", "fp"), "fp", "left"
        ).withColumn("root", F.coalesce("root", "fp"))
    )
    names = checkpointed(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return marked, checkpointed(rooted.join(names, "root").select("fp", "root", "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group stays, whole.

    It is the row with the smallest doc_id.  A doc_id that comes with several texts is no
    single document: of its rows in a group the one with the smallest fingerprint stays, of
    equal fingerprints the one with the smallest hash of its text, so reruns agree.
    Rows without a doc_id cannot be named and are kept.  All columns stay, whatever
    their names; an empty table stays empty.
    """
    marked, classes = _classes(docs)
    best = F.min(F.struct("doc_id", "fp")).alias("best")
    named = marked.where(F.col("doc_id").isNotNull())
    times = named.groupBy("doc_id").agg(F.count("*").alias("rows"))
    keep = checkpointed(
        named.distinct()
        .join(classes, "fp")
        .groupBy("root")
        .agg(best)
        .select("best.*")
        .join(times, "doc_id")
    )
    unnamed = docs.where(F.col("doc_id").isNull())
    once = keep.where("rows = 1").select(F.col("doc_id").alias(_KEY))
    kept = docs.join(once, docs["doc_id"] == F.col(_KEY), "left_semi").union(unnamed)
    several = keep.where("rows > 1").select(F.col("doc_id").alias(_KEY), F.col("fp").alias(_FP))
    if several.isEmpty():
        return kept
    own = F.pandas_udf(lambda x: pd.Series([_signed(t) for t in x], dtype="int64"), "long")
    first = Window.partitionBy(_KEY, _FP).orderBy(F.xxhash64(F.col("text").cast("string")))
    ids = several.select(_KEY).distinct()
    chosen = (
        docs.join(ids, docs["doc_id"] == F.col(_KEY))
        .withColumn(_FP, own(F.col("text").cast("string")))
        .join(several, [_KEY, _FP], "left_semi")
        .withColumn(_ROW, F.row_number().over(first))
        .where(F.col(_ROW) == 1)
    )
    return kept.union(chosen.select(*[F.col(f"`{c}`") for c in docs.columns]))
