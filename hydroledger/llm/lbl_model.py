"""Language-model scores from a log-bilinear neural model.

Words fall into classes: the end of a text, the most frequent words, and buckets of the
other words by their first two letters.  A log-bilinear model (Mnih and Hinton, 2007),
trained with noise-contrastive estimation on every training token, predicts the class of
a token from the classes before it; batched matrix products give the whole normalised
distribution.  Inside a bucket words follow their smoothed counts over all training
documents, with room for an unknown word, so all tokens' probabilities add up to one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, new_folder

FOLDS = 10
SMOOTH = 0.1
#: Words with a class of their own; with the end and the buckets there are 256 classes.
SHORTLIST = 191
BUCKETS = 64
CLASSES = 1 + SHORTLIST + BUCKETS
CONTEXT = 4
DIM = 16
NOISE = 32
MINIBATCH = 2048
#: A task with fewer training tokens reads them again until it has seen so many.
LEAST_TOKENS = 400_000
#: Words whose counts travel with the scoring tasks; rarer ones are joined.
KNOWN_WORDS = 150_000
#: Entries of a task's word counter before it hands them on.
COUNTER_WORDS = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased in A-Z, in UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def bucket(word: bytes) -> int:
    """Class of a word that has none of its own, by its first two letters."""
    return 1 + SHORTLIST + zlib.crc32(word.decode("utf-8")[:2].encode("utf-8")) % BUCKETS


def word_counts(training: DataFrame) -> DataFrame:
    """word and n over all training texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter: Counter = Counter()

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"word": list(counter), "n": list(counter.values())})

        for batch in batches:
            for text in batch["text"]:
                counter.update(tokens(text))
                if len(counter) > COUNTER_WORDS:
                    yield frame()
                    counter.clear()
        yield frame()

    return training.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


@dataclass
class Vocabulary:
    """Counts that scoring needs: totals, known words, and per bucket its mass."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    ends: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray

    @property
    def base(self) -> float:
        """log10 of the base model's denominator."""
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))

    def class_counts(self) -> np.ndarray:
        """Training tokens of each class."""
        out = np.zeros(CLASSES)
        out[0] = self.ends
        size = min(SHORTLIST, len(self.words))
        out[1 : 1 + size] = self.counts[:size]
        out[1 + SHORTLIST :] = self.bucket_tokens
        return out

    def bucket_mass(self) -> np.ndarray:
        """log10 of each bucket's smoothed mass, an unknown word included."""
        return np.log10(self.bucket_tokens + SMOOTH * (self.bucket_words + 1))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Collect the bounded part of the counts: at most KNOWN_WORDS words, and totals.

    The least count of a known word follows from how many words have each count.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc())
    total = distinct = 0
    least, room = None, KNOWN_WORDS
    for n, words in ((r[0], r[1]) for r in sizes.toLocalIterator()):
        total, distinct = total + n * words, distinct + words
        if words <= room:
            least, room = n, room - words
        else:
            room = -1
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    known = sorted(((r.n, bytes(r.word)) for r in rows), key=lambda x: (-x[0], x[1]))
    short = [w for _, w in known[:SHORTLIST]]
    letters = F.substring(F.col("word").cast("string"), 1, 2).cast("binary")
    mass = (
        counts.where(~F.col("word").isin(short)) if short else counts
    ).groupBy((F.crc32(letters) % BUCKETS).cast("int").alias("bucket")).agg(
        F.sum("n"), F.count("*")
    )
    bucket_tokens, bucket_words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at, n, words in mass.collect():
        bucket_tokens[at], bucket_words[at] = n, words
    return Vocabulary(
        total + ends,
        distinct + (ends > 0),
        [w for _, w in known],
        np.array([n for n, _ in known], np.float64),
        ends,
        bucket_tokens,
        bucket_words,
    )


class Classes(dict):
    """Class of a word; words outside the shortlist are kept for reuse, up to a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.short = {w: 1 + i for i, w in enumerate(words[:SHORTLIST])}
        self.update(self.short)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = bucket(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        """Classes of the words and of the end."""
        if len(self) > COUNTER_WORDS:
            self.clear()
            self.update(self.short)
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


class Numbers(dict):
    """Number of a known word; the end follows them, and then all other words together."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self[None] = len(words)
        self.other = len(words) + 1

    def __missing__(self, word: bytes) -> int:
        return self.other


Weights = dict[str, np.ndarray]
# Before the first token there is one more class.
_PAD = CLASSES


def start_weights(class_counts: np.ndarray) -> Weights:
    rng = np.random.default_rng(17)
    share = (class_counts + SMOOTH) / (class_counts + SMOOTH).sum()
    return {
        "r": rng.normal(0, 0.1, (CLASSES + 1, DIM)),
        "q": rng.normal(0, 0.1, (CLASSES, DIM)),
        "c": np.full((CONTEXT, DIM), 1 / CONTEXT) * (1.0 + 0.5 * rng.normal(0, 1, (CONTEXT, DIM))),
        "b": np.log(share),
    }


def contexts(classes: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token of one text, nearest first."""
    padded = np.concatenate((np.full(CONTEXT, _PAD), classes))
    return np.stack(
        [padded[CONTEXT - 1 - k : CONTEXT - 1 - k + len(classes)] for k in range(CONTEXT)], 1
    )


def predicted(p: Weights, context: np.ndarray) -> np.ndarray:
    """The predicted vector of each context."""
    out = p["r"][context[:, 0]] * p["c"][0]
    for k in range(1, CONTEXT):
        out += p["r"][context[:, k]] * p["c"][k]
    return out


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values by row: rows are sorted, and their runs added up."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    out = np.zeros((size, values.shape[1]), np.float32)
    out[ranked[first]] = np.add.reduceat(values[order], first)
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce_step(
    p: Weights, square: Weights, context: np.ndarray, target: np.ndarray, noise: np.ndarray,
    log_noise: np.ndarray, rate: float,
) -> None:
    """One AdaGrad step of noise-contrastive estimation; the noise is shared by the batch.

    All in single precision.  ``log_noise`` holds the log of the expected number of times
    that each class is among the noise.
    """
    size = len(target)
    hidden = predicted(p, context)
    q_t, q_n = p["q"][target], p["q"][noise]
    offset = p["b"] - log_noise
    d_true = _logistic(np.einsum("ij,ij->i", hidden, q_t) + offset[target]) - 1
    d_false = _logistic(hidden @ q_n.T + offset[noise])
    d_hidden = d_true[:, None] * q_t + d_false @ q_n
    grads = {
        "q": _scatter(target, d_true[:, None] * hidden, CLASSES)
        + _scatter(noise, d_false.T @ hidden, CLASSES),
        "b": np.bincount(target, d_true, CLASSES) + np.bincount(noise, d_false.sum(0), CLASSES),
        "r": _scatter(
            context.T.ravel(),
            np.concatenate([d_hidden * p["c"][k] for k in range(CONTEXT)]),
            CLASSES + 1,
        ),
        "c": np.stack(
            [np.einsum("ij,ij->j", d_hidden, p["r"][context[:, k]]) for k in range(CONTEXT)]
        ),
    }
    for name, g in grads.items():
        g = (g / size).astype(np.float32)
        square[name] += g * g
        p[name] -= np.float32(rate) * g / (np.sqrt(square[name]) + np.float32(1e-6))


def fit(training: DataFrame, words: Vocabulary) -> Weights:
    """Train on all training texts: each task makes a pass over its own from the same start,
    and their weights are averaged by tokens, first some tasks', then all.
    """
    start = start_weights(words.class_counts())
    short, names = words.words[:SHORTLIST], sorted(start)
    share = np.exp(start["b"])
    log_noise = np.log(share / share.sum() * NOISE).astype(np.float32)

    def flat(p: Weights) -> np.ndarray:
        return np.concatenate([p[n].ravel() for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        classes, rng = Classes(short), np.random.default_rng(23)
        p = {n: v.astype(np.float32) for n, v in start.items()}
        square = {n: np.full_like(v, 1e-6) for n, v in p.items()}
        cut = np.cumsum(share / share.sum())
        seen = 0

        def learn(group: list[np.ndarray]) -> None:
            context = np.concatenate([contexts(x) for x in group])
            target = np.concatenate(group)
            order = rng.permutation(len(target))
            for at in range(0, len(order), MINIBATCH):
                i = order[at : at + MINIBATCH]
                drawn = np.minimum(np.searchsorted(cut, rng.random(NOISE)), CLASSES - 1)
                nce_step(p, square, context[i], target[i], drawn, log_noise, 0.1)

        group, held, first = [], 0, []
        for batch in batches:
            for text in batch["text"]:
                group.append(classes.array(tokens(text)))
                held += len(group[-1])
                if held >= 65_536:
                    learn(group)
                    if seen < LEAST_TOKENS:
                        first.append(group)
                    seen, group, held = seen + held, [], 0
        if group:
            learn(group)
            first.append(group)
            seen += held
        read = seen
        while seen and read < LEAST_TOKENS:
            for again in first:
                learn(again)
            read += seen
        if seen:
            part = TaskContext.get().partitionId() % 64
            yield pd.DataFrame({"part": [part], "n": [seen], "data": [flat(p).astype("f8").tobytes()]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("data")
        total = sum(n * np.frombuffer(x) for n, x in zip(pdf["n"], pdf["data"]))
        n = int(pdf["n"].sum())
        return pd.DataFrame({"part": [0], "n": [n], "data": [(total / n).tobytes()]})

    schema = "part int, n long, data binary"
    found = (
        training.select("text")
        .mapInPandas(run, schema)
        .groupBy("part")
        .applyInPandas(average, schema)
        .groupBy()
        .applyInPandas(average, schema)
        .collect()
    )
    if not found:
        return start
    data, at = np.frombuffer(found[0].data), 0
    for name in names:
        size = start[name].size
        start[name] = data[at : at + size].reshape(start[name].shape)
        at += size
    return start


def class_log10(p: Weights, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 probability of each target class, normalised over all classes.

    Logits follow log frequencies and small vectors, so they stay far from the limits of
    single precision; they are clipped to be sure.
    """
    out = np.empty(len(target))
    p = {n: v.astype(np.float32) for n, v in p.items()}
    weights, ones = np.ascontiguousarray(p["q"].T), np.ones(CLASSES, np.float32)
    for at in range(0, len(target), 2048):
        rows = slice(at, at + 2048)
        logits = predicted(p, context[rows]) @ weights
        logits += p["b"]
        np.clip(logits, -60, 60, out=logits)
        right = logits[np.arange(len(logits)), target[rows]]
        np.exp(logits, out=logits)
        out[rows] = right - np.log(logits @ ones)
    return out / np.log(10)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the documents whose crc32 of the id leaves a remainder by FOLDS.  Scores are
    log10 probabilities of the whole text with its end.  A missing text is empty, so its
    only token is the end; repeated rows score alike and each count in training; a missing
    doc_id is held out; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        held_out("doc_id", FOLDS).alias("held_out"),
    )
    training = thin.where(~F.col("held_out"))
    folder = new_folder(spark, "word-counts")
    word_counts(training).write.parquet(folder)
    counts = spark.read.parquet(folder)
    words = vocabulary(counts, training.count())
    p = fit(training, words)
    known, known_counts = words.words, words.counts
    ends, mass = words.ends, words.bucket_mass()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rare_class = Numbers(known), Classes([])
        # Known words first, then the end, then words that are joined.
        log_count = np.log10(np.concatenate((known_counts, [ends])) + SMOOTH)
        log_count = np.append(log_count, 0.0)
        seen = np.append(np.ones(len(known)), [float(ends > 0), 0.0])
        class_of = np.append(Classes(known).array(known), 0)
        for batch in batches:
            ids, held = batch["doc_id"], batch["held_out"]
            for at in range(0, len(batch), 256):
                group = [tokens(x) for x in batch["text"].iloc[at : at + 256]]
                sizes = np.array([len(x) + 1 for x in group])
                starts = np.cumsum(sizes) - sizes
                flat = [w for x in group for w in (*x, None)]
                numbers = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
                target = class_of[numbers]
                rare: list[Counter] = [Counter() for _ in group]
                text_of = np.repeat(np.arange(len(group)), sizes)
                others = np.flatnonzero(numbers == number.other)
                for i, k in zip(others.tolist(), text_of[others].tolist()):
                    rare[k][flat[i]] += 1
                target[others] = rare_class.array([flat[i] for i in others])[:-1]
                each = np.split(target, starts[1:])
                log_class = class_log10(p, np.concatenate([contexts(x) for x in each]), target)
                inside = np.where(
                    target > SHORTLIST,
                    log_count[numbers] - mass[np.maximum(target - 1 - SHORTLIST, 0)],
                    0.0,
                )
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[at : at + 256],
                        "held_out": held.iloc[at : at + 256],
                        "n_tokens": sizes,
                        "n_known": np.add.reduceat(seen[numbers], starts).astype(np.int64),
                        "base": np.add.reduceat(log_count[numbers], starts),
                        "model": np.add.reduceat(log_class + inside, starts),
                        "rare": [list(x) for x in rare],
                        "times": [list(x.values()) for x in rare],
                    }
                )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, "
        "rare array<binary>, times array<int>"
    )
    folder = new_folder(spark, "scored")
    thin.mapInPandas(run, schema).withColumn("rare", F.transform("rare", lambda w: F.xxhash64(w))).withColumn(
        "row", F.monotonically_increasing_id()
    ).write.parquet(folder)
    scored = spark.read.parquet(folder)
    least = int(known_counts.min()) if len(known) else None
    rest = counts.where(F.col("n") < least) if least is not None else counts
    joined = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
        .join(rest.select(F.xxhash64("word").alias("hash"), "n"), "hash", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(words.base)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
