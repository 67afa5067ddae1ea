"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  A passage is encoded from hashed word
shapes and a few measures of its surface; gated attention (Ilse et al., 2018), learned
from document labels alone, weighs the passages, and the weighted encoding is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held_out, labelled_sample

PASSAGE = 64
BUCKETS = 96
MEASURES = 14
WIDTH = BUCKETS + MEASURES
HIDDEN = 24
GATE = 12
#: At most so many labelled documents are learned from.
TRAIN_ROWS = 8_000
#: In training a passage set is cut into bags of at most so many passages; each has the label.
BAG = 64
FOLDS = 5
EPOCHS = 12
CUTOFF = 0.3
_ENDS = ".,;:!?"


def _shape(word: str) -> int:
    """A word's bucket and surface, packed: bucket, letters, digits, capitals, marks, length."""
    length = min(len(word), 255)
    plain, lower = word.isalpha(), word.islower()
    letters = length if plain else min(sum(map(str.isalpha, word)), 255)
    digits = 0 if plain else min(sum(map(str.isdigit, word)), 255)
    capitals = 0 if lower else min(sum(map(str.isupper, word)), 255)
    ends = int(word[-1] in _ENDS)
    bare = word.strip(_ENDS).lower()
    key = bare if len(bare) < 5 else "".join(sorted({c for c in bare if not c.isalnum()})) or "w"
    bucket = zlib.crc32(key.encode("utf-8", "replace")) % BUCKETS
    unique = zlib.crc32(word.encode("utf-8", "replace")) & 0xFFFF
    return unique << 48 | bucket << 40 | ends << 32 | capitals << 24 | digits << 16 | letters << 8 | length


def encode(text: str | None, words: WordHashes) -> np.ndarray:
    """One row of WIDTH features per passage; a text without words has one row of zeros."""
    text = text or ""
    packed = words.array(text.split())
    if not len(packed):
        return np.zeros((1, WIDTH), np.float32)
    n = len(packed)
    rows = -(-n // PASSAGE)
    at = np.arange(n) // PASSAGE
    size = np.bincount(at, minlength=rows).astype(np.float64)

    def field(shift: int) -> np.ndarray:
        return ((packed >> np.uint64(shift)) & np.uint64(255)).astype(np.float64)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x, rows)

    length, letters, digits, capitals = field(0), field(8), field(16), field(24)
    bucket = field(40).astype(np.int64)
    counts = np.bincount(at * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    order = np.lexsort((packed, at))
    fresh = np.concatenate(([True], (packed[order][1:] != packed[order][:-1]) | (np.diff(at[order]) > 0)))
    distinct = np.bincount(at[order], fresh, rows)
    repeats = np.concatenate(([False], packed[1:] == packed[:-1]))
    chars = np.maximum(total(length), 1)
    other = chars - total(letters) - total(digits)
    whole = len(np.unique(packed)) / n
    first = np.zeros(rows)
    first[0] = 1
    measures = np.stack(
        (
            chars / size / 10,
            total(letters) / chars,
            total(digits) / chars * 3,
            total(capitals) / size,
            other / chars * 3,
            total(field(32)) / size * 2,
            distinct / size,
            total(repeats) / size * 2,
            np.log1p(size) / 4,
            np.full(rows, np.log1p(n) / 8),
            np.full(rows, whole),
            total(letters == 0) / size * 2,
            np.full(rows, text.count("\n") / n * 3),
            first,
        ),
        1,
    )
    return np.concatenate((np.sqrt(counts / size[:, None]), measures), 1).astype(np.float32)


Weights = dict[str, np.ndarray]


def start_weights(seed: int = 3) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return {
        "W": normal(WIDTH, HIDDEN),
        "w0": np.zeros(HIDDEN),
        "V": normal(HIDDEN, GATE),
        "U": normal(HIDDEN, GATE),
        "a": normal(GATE),
        "c": np.zeros(HIDDEN),
        "b": np.zeros(1),
    }


def _softmax_by(score: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(score - np.maximum.reduceat(score, starts)[bag])
    return e / np.add.reduceat(e, starts)[bag]


def forward(p: Weights, x: np.ndarray, starts: np.ndarray) -> tuple:
    """Logit of each bag; ``starts`` are the first rows of the bags in ``x``."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ p["W"] + p["w0"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    attention = _softmax_by((t * s) @ p["a"], starts, bag)
    z = np.add.reduceat(attention[:, None] * h, starts)
    return z @ p["c"] + p["b"][0], (bag, h, t, s, attention, z)


def gradients(p: Weights, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Weights:
    """Gradient of the mean logistic loss."""
    logit, (bag, h, t, s, attention, z) = forward(p, x, starts)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    dz = d[:, None] * p["c"]
    along = (h * dz[bag]).sum(1)
    dscore = attention * (along - np.add.reduceat(attention * along, starts)[bag])
    dt, ds = dscore[:, None] * p["a"] * s * (1 - t * t), dscore[:, None] * p["a"] * t * s * (1 - s)
    dh = attention[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
    dx = dh * (1 - h * h)
    return {
        "W": x.T @ dx,
        "w0": dx.sum(0),
        "V": h.T @ dt,
        "U": h.T @ ds,
        "a": (t * s).T @ dscore,
        "c": z.T @ d,
        "b": np.array([d.sum()]),
    }


def train(bags: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 3) -> Weights:
    """Adam over minibatches of 64 bags; without bags the score is the start's."""
    p = start_weights(seed)
    positive = sum(y for _, y in bags)
    p["b"][0] = np.log((positive + 1) / (len(bags) - positive + 0.5))
    split = [(x[i : i + BAG], y) for x, y in bags for i in range(0, len(x), BAG)]
    moment = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(split))
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(order), 64):
            chosen = [split[i] for i in order[at : at + 64]]
            x = np.concatenate([c[0] for c in chosen]).astype(np.float64)
            starts = np.cumsum([0] + [len(c[0]) for c in chosen[:-1]])
            step += 1
            for k, g in gradients(p, x, starts, np.array([c[1] for c in chosen])).items():
                g = g + 1e-4 * p[k]
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.001 * (g * g - square[k])
                p[k] = p[k] - rate * (moment[k] / (1 - 0.9**step)) / (
                    np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8
                )
    return p


def _flat(p: Weights) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).tobytes()


def _shaped(data: bytes) -> Weights:
    flat, shape, at = np.frombuffer(data), start_weights(), 0
    for k in sorted(shape):
        size = shape[k].size
        shape[k] = flat[at : at + size].reshape(shape[k].shape)
        at += size
    return shape


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS) -> bytes:
    """Weights learned from at most ``rows`` labelled documents outside the held-out fold.

    Passages are encoded where the documents are; one task learns from this bounded set.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes(_shape)
        for batch in batches:
            found = [encode(x, words).astype("<f2").tobytes() for x in batch["text"]]
            yield pd.DataFrame({"passages": found, "label": batch["_label"]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("passages")
        bags = [
            (np.frombuffer(x, "<f2").reshape(-1, WIDTH), y)
            for x, y in zip(pdf["passages"], pdf["label"])
        ]
        return pd.DataFrame({"data": [_flat(train(bags))]})

    sample = labelled_sample(docs, labels, "quality", folds, rows)
    found = (
        sample.mapInPandas(features, "passages binary, label int")
        .groupBy()
        .applyInPandas(learn, "data binary")
        .collect()
    )
    return bytes(found[0][0]) if found else _flat(train([]))


def _scores(p: Weights, bags: list[np.ndarray]) -> list[float]:
    """Scores of bags, in groups of some thousand passages."""
    found: list[float] = []
    group, held = [], 0
    for i, bag in enumerate(bags):
        group.append(bag)
        held += len(bag)
        if held >= 4096 or i == len(bags) - 1:
            starts = np.cumsum([0] + [len(x) for x in group[:-1]])
            logit, _ = forward(p, np.concatenate(group).astype(np.float64), starts)
            found += (1 / (1 + np.exp(-np.clip(logit, -35, 35)))).tolist()
            group, held = [], 0
    return found


def with_score(docs: DataFrame, weights: bytes, out: str = "score") -> DataFrame:
    """Add the probability of good quality of each whole text; all columns stay."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p, words = _shaped(weights), WordHashes(_shape)
        for texts in batches:
            yield pd.Series(_scores(p, [encode(x, words) for x in texts]), dtype="float64")

    return docs.withColumn(out, score(F.col("text").cast("string")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on) of every row of ``docs``.

    Missing and empty texts are one passage of zeros; a text of any length is one bag;
    ties and repeated rows score alike; other columns are ignored, also in ``labels``.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id", FOLDS).alias("held_out"),
        "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )
