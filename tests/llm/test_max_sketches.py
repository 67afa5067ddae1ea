"""Ranked search: brute force over small tables, bounds, ties, odd rows, slices."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroledger.llm import max_sketches

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(TERM, low)


def brute(docs, items, k=10):
    parsed = [(i, split(t)) for i, t in docs]
    parsed = [(i, t) for i, t in parsed if t]
    n_docs, total = len(parsed), sum(len(t) for _, t in parsed)
    df = Counter(t for _, ts in parsed for t in set(ts))
    out = []
    for item, text in set(items):
        scores = []
        for doc_id, ts in parsed:
            tf, m = Counter(ts), 25 + (75 * len(ts) * n_docs) // total
            score = 0
            for t in split(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (s, gone, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if gone else i, -s))
    return sorted(out, key=repr)


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["É", "é", "ß", "日本", "x_y", "a-b", "A1"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 80)))) for i in range(n)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]  # ties by copies
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (600, None), (601, ""), (602, "\x00.;-")]
    docs += [(603, " ".join(rng.choices(pool, k=30_000))), (604, "W1" * 5000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(25, docs[7][1]), (26, None), (27, ""), (28, "nowhere else"), (29, "w1 W1 w1"), (3, items[3][1])]
    items += [(4, "other text, same id w2"), (None, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("slice_terms", [40, max_sketches.SLICE_TERMS])
def test_ranking_matches_brute_force(spark, monkeypatch, slice_terms):
    monkeypatch.setattr(max_sketches, "SLICE_TERMS", slice_terms)
    docs, items = corpus()
    clash = {c: F.lit(0) for c in ("score", "rank", "query", "slice", "size", "start", "term")}
    df = spark.createDataFrame(docs, DOCS).withColumns(clash).repartition(5)
    asked = spark.createDataFrame(items, ITEMS).withColumns(clash)
    found = max_sketches.search(df, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)


def test_fewer_documents_than_asked_for(spark):
    docs, items = [(2, "a b"), (1, "a b"), (5, "c")], [(1, "a c"), (2, "z")]
    found = max_sketches.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=7)
    assert sorted(map(tuple, found.collect())) == brute(docs, items, 7)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert max_sketches.search(none, some).count() == 0
    assert max_sketches.search(spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert max_sketches.search(none, spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("size", [1, 8, 64, 4096])
def test_bounds_are_never_below_scores(size):
    docs, items = corpus(seed=11, n=60)
    texts = {i: (t or "").encode() for i, (_, t) in enumerate(items)}
    counts = [Counter(max_sketches.terms((t or "").encode())) for _, t in docs]
    counts = [c for c in counts if c]
    total = sum(sum(c.values()) for c in counts)
    holding = Counter(t for c in counts for t in c)
    queries = max_sketches.Queries(texts, holding, len(counts), total)
    norms = [max_sketches.length_norm(sum(c.values()), len(counts), total) for c in counts]
    hashes = max_sketches.WordHashes(max_sketches.xxhash.xxh64_intdigest)
    bounds = queries.bounds(max_sketches.sketch(counts, norms, size, hashes))
    scores = np.array([[queries.score(q, c, m) for c, m in zip(counts, norms)] for q in range(len(queries.ids))])
    assert (bounds >= scores).all() and (bounds == np.rint(bounds)).all()
    if size == 4096:  # short documents in a large sketch: hardly any collisions
        assert (bounds == scores).mean() > 0.9


def test_few_documents_are_scored_exactly():
    docs, items = corpus(seed=17, n=3000)
    texts = {i: (t or "").encode() for i, (_, t) in enumerate(items)}
    raw = [(i, (t or "").encode()) for i, t in docs]
    counts = [max_sketches.terms(t) for _, t in raw]
    holding = Counter(t for c in counts for t in set(c))
    queries = max_sketches.Queries(texts, holding, sum(map(bool, counts)), sum(map(len, counts)))
    searcher = max_sketches.Searcher(queries, 10)
    for at in range(0, len(raw), 500):
        searcher.add(raw[at : at + 500])
    assert searcher.scored < 0.3 * len(raw) * len(queries.ids)
