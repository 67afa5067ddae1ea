"""Mixing sources to target weights, in fixed-length blocks of words.

Per source the words of its documents, in ascending doc_id order, are packed into blocks
of BLOCK_WORDS words.  Every output shard draws how many of its slots each source gets:
the whole part of its expectation, and the remainder by a multinomial draw conditioned on
what remains, so that the shards' counts sum to the source's slots.  A slot of a source is mapped to a block by a pseudorandom permutation of the source's block
numbers, a new one for each epoch, so blocks are taken evenly, and slots and blocks
are joined by source and number.  No table of a permutation is ever kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, starts_in_order, unused_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Size of the mix, and of what one source may give, as multiples of their sizes.
TOTAL = 1.5
LIMIT = 2
BLOCK_WORDS = 32
SHARD_SLOTS = 65_536
#: Shards whose slots one task lays out.
SHARDS_PER_TASK = 16
SEED = 20_240_917
_ROUNDS = 4


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 per (size, key), evaluated at ``index``.

    A Feistel network on the smallest even number of bits that holds ``size``; values
    outside are encrypted again until they fall inside (cycle walking).
    """
    bits = np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64)
    half = (bits + bits % np.uint64(2)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    limit, key = size.astype(np.uint64), key.astype(np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(_ROUNDS):
            step = np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (right + k + step) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _row_key() -> Column:
    """A number for doc_id, source and text, which is never missing."""
    return F.xxhash64(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    )


def _copy_number(key: str) -> Column:
    """Tells rows apart that repeat doc_id, source and text."""
    return F.row_number().over(Window.partitionBy(key).orderBy(key))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, source, _key, _copy, size and ``start``: words of its source before each row."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        _row_key().alias("_key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0))
        .cast("long")
        .alias("size"),
    ).withColumn("_copy", _copy_number("_key"))
    placed = starts_in_order(sized, ["source"], ["doc_id", "_key", "_copy"], "size", "start")
    return checkpointed(placed)


def targets(placed: DataFrame) -> DataFrame:
    """source, source_size, target, and ``n_blocks`` and ``slots`` of each source.

    Sources in code-point order, the missing one last, weigh 3, 1, 2, repeating.  Sorted by
    limit per weight, a source is at its limit when the level that remains for it and all
    later ones reaches that; the others share what is left by weight.
    """
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((number - 1) % 3 + 1).cast("int"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * LIMIT)
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(TOTAL))
        .withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_used")) / F.sum("_weight").over(after))
        .withColumn("_full", F.col("_cap") / F.col("_weight") <= F.col("_level"))
    )
    level = (F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(~F.col("_full"), F.col("_weight"))
    ).over(everything)
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    return checkpointed(
        ranked.withColumn(
            "target", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_weight"))
        )
        .withColumn("n_blocks", blocks)
        .withColumn(
            "slots",
            F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * blocks))
            .otherwise(0)
            .cast("long"),
        )
        .select("source", "source_size", "target", "n_blocks", "slots")
    )


def dealt(rests: np.ndarray, shard: int, shards: int, seed: int = SEED) -> np.ndarray:
    """What a shard draws of ``rests``, the slots of each source that go beyond whole parts.

    The shards are halved again and again; what a half holds is split between its halves by
    a multivariate hypergeometric draw, whose seed is the half's bounds.  So every shard
    finds its own part alone, all parts sum to ``rests``, and shards get equally many.
    """
    total, low, high = int(rests.sum()), 0, shards
    end = lambda at: total * at // shards
    while high - low > 1 and len(rests):
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = end(middle) - end(low)
        taken = np.zeros_like(rests)
        # One source after the other, each from what the later ones leave.
        behind = int(rests.sum())
        for i in np.flatnonzero(rests):
            behind -= int(rests[i])
            taken[i] = rng.hypergeometric(int(rests[i]), behind, left) if left else 0
            left -= int(taken[i])
        if shard < middle:
            rests, high = taken, middle
        else:
            rests, low = rests - taken, middle
    return rests


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """source, n_blocks, shard, ``first`` and ``count``: the slots of a source in a shard.

    Each shard draws for itself, from its number, so a repeated task draws the same; a
    source's counts sum to its slots.
    """
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_slots))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        whole, rests = np.divmod(pdf["slots"].to_numpy(np.int64), shards)
        pdf["count"] = whole + dealt(rests, int(pdf["shard"].iloc[0]), shards, seed)
        return pdf[["source", "n_blocks", "shard", "count"]]

    each = (
        sources.where("slots > 0")
        .select("source", "n_blocks", "slots", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        .groupBy("shard")
        .applyInPandas(draw, "source string, n_blocks long, shard int, count long")
    )
    # One row per shard in each source's window.
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = each.withColumn(
        "first", F.coalesce(F.sum("count").over(earlier), F.lit(0)).cast("long")
    )
    # These few rows become all slots, so their tasks are numbered by slots, not by bytes.
    return counted.repartition(-(-shards // SHARDS_PER_TASK), "source", "shard")


def slots(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, source, slot, epoch and block of every slot."""

    @F.pandas_udf("long")
    def block_of(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        for index, size, key in batches:
            yield pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))

    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot")
    return (
        counts.where("count > 0")
        .select("shard", "source", "n_blocks", slot)
        .withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")).cast("int"))
        .withColumn(
            "block",
            block_of(
                F.col("slot") % F.col("n_blocks"),
                F.col("n_blocks"),
                F.xxhash64(F.lit(seed), "source", "epoch"),
            ),
        )
        .select("shard", "source", "slot", "epoch", "block")
    )


def pieces(placed: DataFrame) -> DataFrame:
    """The parts of documents in each block: source, block, doc_id, keys, from_word, n_words."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor(
        (F.col("start") + F.col("size") - 1) / BLOCK_WORDS
    )
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "source",
            "block",
            "doc_id",
            "start",
            (begin - F.col("start")).alias("from_word"),
            (end - begin).alias("n_words"),
        )
    )


def mix(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix: shard, slot, source, epoch, block, and the doc_id, start, words of its pieces."""
    wanted = slots(shard_counts(sources)).withColumn("_source", F.struct("source")).drop("source")
    held = pieces(placed).withColumn("_source", F.struct("source"))
    # Before they are exploded, the slots look small enough to broadcast; they aren't.
    return held.join(wanted.hint("merge"), ["_source", "block"]).drop("_source")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row of ``docs``.

    ``taken`` counts the words that the mix takes, repeats included; it is at most
    LIMIT times the size.  Rows without words, a missing text among them, take part with
    size 0; a missing source is a source of its own; repeated rows and equal ids are
    packed one after the other; other columns are ignored; an empty table gives no rows.
    """
    placed = packed(docs)
    sources = targets(placed)
    used = (
        mix(placed, sources)
        .groupBy(F.struct("source").alias("_source"), "start")
        .agg(F.sum("n_words").alias("taken"))
    )
    per_source = sources.withColumn("_source", F.struct("source")).drop("source")
    return (
        placed.withColumn("_source", F.struct("source"))
        .withColumn("_start", F.when(F.col("size") > 0, F.col("start")))
        .join(used.withColumnRenamed("start", "_start"), ["_source", "_start"], "left")
        .join(per_source, "_source")
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def _cut(text: str, runs: list) -> str:
    """The words of ``runs`` [(first word, words)]; whole stretches keep their white space."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    stretches: list[list[int]] = []
    for first, count in sorted(runs):
        if stretches and stretches[-1][1] == first:
            stretches[-1][1] += count
        else:
            stretches.append([first, first + count])
    if stretches == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in stretches)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and epoch, with the words taken in it.

    All columns of ``docs`` stay; ``text`` holds the words taken (the whole text when all
    are), ``n_chars`` its length where that column exists.  A document may come twice, with
    its own doc_id; one of which nothing is taken does not come, as those without words.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    key, number, parts = (unused_name(docs, f"_mix_{c}") for c in ("key", "number", "runs"))
    placed = packed(docs)
    taken = (
        mix(placed, targets(placed))
        .groupBy(F.struct("source").alias("_source"), "start", "epoch")
        .agg(F.collect_list(F.struct("from_word", "n_words")).alias("_runs"))
    )
    named = (
        placed.where("size > 0")
        .withColumn("_source", F.struct("source"))
        .join(taken, ["_source", "start"])
        .select(
            F.col("_key").alias(key), F.col("_copy").alias(number), F.col("_runs").alias(parts)
        )
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series(
            [_cut(t, [(int(x["from_word"]), int(x["n_words"])) for x in r]) for t, r in zip(texts, runs)],
            dtype=object,
        )

    # Both columns are keys, so that repeated rows meet one by one.
    keyed = docs.withColumn(key, _row_key()).withColumn(number, _copy_number(key))
    mixed = keyed.join(named, [key, number])
    mixed = mixed.withColumn("text", cut(F.col("text").cast("string"), parts))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(docs.columns)
