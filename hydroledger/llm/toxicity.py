"""Toxicity scores from FTRL-proximal logistic regression.

Features are hashed words, word stems, word pairs and pairs that skip one word, each
counted once per document.  Per-coordinate learning rates and the L1 term leave a few
thousand weights, which travel with the scoring tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held_out, labelled_sample, unused_name

HASH_BITS = 20
STEM = 6
#: At most so many labelled documents are learned from.
TRAIN_ROWS = 12_000
FOLDS = 5
EPOCHS = 6
_PUNCTUATION = ".,;:!?\"'()[]{}|*_#"


def _pack(word: str) -> int:
    """crc32 of the word in the upper half, of its stem in the lower half."""
    bare = word.strip(_PUNCTUATION) or word
    stem = zlib.crc32(bare[:STEM].encode("utf-8", "replace"))
    return zlib.crc32(bare.encode("utf-8", "replace")) << 32 | stem


def _slots(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(
        64 - HASH_BITS
    )


def feature_slots(text: str | None, words: WordHashes) -> np.ndarray:
    """Hash slots of all features of a whole text, repeats included."""
    packed = words.array((text or "").lower().split())
    word, stem = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    return _slots(
        np.concatenate(
            (
                word,
                stem + np.uint64(1 << 33),
                word[:-1] * np.uint64(0x100000001B3) + word[1:] + np.uint64(1 << 34),
                word[:-2] * np.uint64(0x1000193) * np.uint64(31) + word[2:] + np.uint64(1 << 35),
            )
        )
    )


@dataclass(frozen=True)
class Model:
    """Sparse weights: sorted slots, their values, and the intercept."""

    slots: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        weights = np.zeros(1 << HASH_BITS, np.float32)
        weights[self.slots] = self.values
        return weights


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(
    examples: list[tuple[np.ndarray, int]],
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 1.0,
    epochs: int = EPOCHS,
) -> Model:
    """FTRL-proximal over examples (slots, label); the order is shuffled with a fixed seed."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    positive = sum(y for _, y in examples)
    bias = float(np.log((positive + 0.1) / (len(examples) - positive + 0.9)))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, label = examples[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + root) / alpha + l2)
            g = _sigmoid(bias + w.sum()) - label
            more = np.sqrt(ni + g * g)
            z[at] = zi + g - (more - root) / alpha * w
            n[at] = ni + g * g
            bias -= 0.01 * g
    weights = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    slots = np.flatnonzero(weights)
    return Model(slots.astype(np.int32), weights[slots].astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    Their features are made where the documents are; one task learns from this bounded
    set.  Without labels every text scores near 0.1.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes(_pack)
        for batch in batches:
            slots = [np.unique(feature_slots(x, words)).astype("<i4") for x in batch["text"]]
            yield pd.DataFrame({"slots": [x.tobytes() for x in slots], "label": batch["_label"]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slots")
        model = train([(np.frombuffer(s, "<i4"), y) for s, y in zip(pdf["slots"], pdf["label"])])
        return pd.DataFrame(
            {
                "slots": [model.slots.tobytes()],
                "data": [model.values.tobytes()],
                "bias": [model.bias],
            }
        )

    sample = labelled_sample(docs, labels, "toxic", folds, rows)
    found = (
        sample.mapInPandas(features, "slots binary, label int")
        .groupBy()
        .applyInPandas(learn, "slots binary, data binary, bias double")
        .collect()
    )
    if not found:
        return train([])
    row = found[0]
    return Model(np.frombuffer(row[0], np.int32), np.frombuffer(row[1], np.float32), row[2])


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add the probability of toxicity of each whole text; all columns stay."""
    slots, values, bias = model.slots, model.values, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, words = Model(slots, values, bias).dense(), WordHashes(_pack)

        def one(text: str | None) -> float:
            at = feature_slots(text, words)
            hit = np.unique(at[weights[at] != 0])
            return _sigmoid(bias + float(weights[hit].sum(dtype=np.float64)))

        for texts in batches:
            yield pd.Series([one(x) for x in texts], dtype="float64")

    return docs.withColumn(out, score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row of ``docs``.

    Missing and empty texts have no features and get the intercept's score; ties and
    repeated rows score alike; other columns are ignored, also in ``labels``.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id", FOLDS).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns, whatever their names.

    Missing and empty texts get the intercept's score, which is low unless most labels are
    toxic; repeated rows stay or go together; an empty table stays empty.
    """
    mark = unused_name(docs, "_toxicity_score")
    return with_score(docs, fit(docs, labels), mark).where(F.col(mark) < 0.5).drop(mark)
