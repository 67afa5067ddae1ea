"""Corpus operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hydroledger.llm import (
    common,
    html_blocks,
    lbl_model,
    license_scan,
    mil_quality,
    mixing,
    packed_ids,
    permutation_index,
    simhash_ball,
    spaced_seeds,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with the names that operators use inside.
CLASHES = ("_toxicity_score", "_mix_key", "_mix_number", "_mix_runs", "score", "fp", "start", "size", "slots", "row", "part", "word", "label", "block", "_key", "root")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(n=60, seed=4):
    """Copies, near copies, missing and empty texts, repeated rows, one long text, a hot source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.randint(5, 120))
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", None])
        rows.append((i, text, "en", source, len(text)))
    rows += [(100 + i, rows[0][1], "en", "hot", len(rows[0][1])) for i in range(12)]
    rows += [(150, rows[5][1] + " tail", "en", "a", 9), (151, None, "en", "a", None), (152, "", None, "a", 0)]
    rows += [(153, " \t\n ", "en", None, 4), (154, words(rng, 30_000, 5000), "en", "a", 1)]
    rows += [(155, "One", "en", "B", 3), (155, "One", "en", "B", 3), (None, "No id here", "en", "a", 5)]
    return rows


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    return df.withColumns({c: F.lit(-7.5) for c in CLASHES}).repartition(4)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def labels(spark):
    rows = [(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(60)]
    rows += [(3, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def benchmark(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 25, 10_000)) for i in range(6)] + [(6, None), (7, ""), (8, "a b c d e f")]
    return spark.createDataFrame(rows, "item_id long, text string")


# --- every operator on odd and on empty tables -------------------------------


def test_document_operators_answer_for_odd_rows(spark, docs, labels, benchmark, tmp_path):
    n = docs.count()
    per_row = {
        "near": simhash_ball.near_duplicates(docs),
        "toxic": toxicity.toxicity(docs, labels),
        "quality": mil_quality.quality(docs, labels),
        "mix": mixing.mixture(docs),
        "ids": packed_ids.encode_documents(docs, f"{tmp_path}/ids"),
        "lm": lbl_model.score(docs),
    }
    ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
    for name, df in per_row.items():
        got = df.collect()
        assert len(got) == n, name
        assert sorted((r.doc_id for r in got), key=str) == ids, name
    assert license_scan.scan(docs).count() == 0
    assert spaced_seeds.overlaps(docs, benchmark).count() == 0
    for kept in (simhash_ball.keep_one(docs), spaced_seeds.drop_contaminated(docs, benchmark)):
        assert kept.columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_document_operators_answer_for_empty_tables(spark, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        simhash_ball.near_duplicates(nothing),
        simhash_ball.keep_one(nothing),
        toxicity.toxicity(nothing, labels),
        mil_quality.quality(nothing, labels),
        mixing.mixture(nothing),
        mixing.mixed_documents(nothing),
        packed_ids.encode_documents(nothing, f"{tmp_path}/ids"),
        lbl_model.score(nothing),
        license_scan.scan(nothing),
        spaced_seeds.overlaps(nothing, items),
        spaced_seeds.drop_contaminated(nothing, items),
        html_blocks.extract(pages),
        permutation_index.nearest(vectors, vectors),
    ):
        assert df.count() == 0


def test_without_labels_nothing_is_toxic(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}


# --- 1 license scan -----------------------------------------------------------


def shingles(text, n=5):
    w = [x.strip(".,;:!?\"'()[]{}|*_#<>") for x in text.lower().split()]
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_license_scan_finds_all_that_contain_a_template(spark):
    rng = random.Random(2)
    rows = []
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        around = words(rng, 300).split()
        for j, at in enumerate((0, 17, 150, 300)):
            rows.append((100 * i + j, " ".join(around[:at]) + " " + text + " " + " ".join(around[at:])))
    rows += [(9000 + k, words(rng, 200)) for k in range(20)]
    got = defaultdict(set)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
        assert r.containment >= 0.8 and r.matched_text in dict(rows)[r.doc_id]
    for doc_id, text in rows:
        have = shingles(text)
        want = {
            n for n, t in license_scan.TEMPLATES.items()
            if len(shingles(t) & have) >= 0.8 * len(shingles(t)) > 0
        }
        assert got[doc_id] == want


def test_license_band_settings():
    assert license_scan.collision_probability(0.5) > 0.99999


def test_license_scan_with_changed_words():
    text = license_scan.TEMPLATES["MIT permission"].split()
    few = " ".join(text[:30] + ["changed"] + text[31:])
    many = " ".join(w if i % 4 else "changed" for i, w in enumerate(text))
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    assert [h[1] for h in scanner.scan([few])] == ["MIT permission"]
    assert list(scanner.scan([many, None, "", "one two"])) == []


# --- 2 permutation index ------------------------------------------------------


def test_permutation_index_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype("f4")
    x[200:500] = x[200]  # a fifth of the rows are copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (None, [1.0] * 16)]
    rows += [(5150, [None] * 16), (5200, [float("inf")] + [1.0] * 15), (5250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    found = permutation_index.nearest(df, df.where("vec_id % 50 = 0"))
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(score, 12)))[:5]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 5
        assert all(abs(s - score[v]) < 1e-12 for v, s in got[q])
    assert hits >= 0.9 * 5 * 30
    assert set(got) == set(range(0, 1500, 50))
    assert [v for v, _ in got[300]] == [200, 201, 202, 203, 204]


def test_permutation_index_with_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]


# --- 3 mixing -----------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mixture_meets_its_targets(spark, docs):
    got = mixing.mixture(docs).collect()
    size = {}
    for r in docs.collect():
        size.setdefault(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    per_source = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id]
        assert 0 <= r.taken <= 2 * r["size"]
        per_source[r.source] += r["size"]
    want = brute_targets(per_source)
    taken = Counter()
    for r in got:
        assert r.source_size == per_source[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS + 0.02 * want[s]
    again = mixing.mixture(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(out) == list(range(n))
    big = np.arange(1000)
    a = mixing.permuted(big, np.full(1000, 1000), np.full(1000, 1))
    b = mixing.permuted(big, np.full(1000, 1000), np.full(1000, 2))
    assert (a != b).any() and (a != big).any()


def test_shards_draw_about_their_share(spark):
    sources = spark.createDataFrame([("a", 50, 1000), ("b", 7, 301), (None, 3, 5)], "source string, n_blocks long, slots long")
    got = mixing.shard_counts(sources, shard_slots=100).collect()
    assert len({r.shard for r in got}) == 14
    total = Counter()
    for r in got:
        total[r.source] += r["count"]
    assert abs(total["a"] - 1000) <= 14 and abs(total["b"] - 301) <= 14 and total[None] <= 14


def test_small_sources_get_all_their_slots(spark):
    rows = [("hot", 5000, 9001)] + [(f"s{i:02}", 1 + i % 10, 2 * (1 + i % 10)) for i in range(60)]
    sources = spark.createDataFrame(rows, "source string, n_blocks long, slots long")
    counts = mixing.shard_counts(sources, shard_slots=100).cache()
    got, per_shard = Counter(), Counter()
    for r in counts.collect():
        assert r["count"] >= 0
        got[r.source] += r["count"]
        per_shard[r.shard] += r["count"]
    assert got == {name: n for name, _, n in rows}
    assert len(per_shard) == 97 and max(per_shard.values()) - min(per_shard.values()) <= 1
    taken = Counter((r.source, r.block) for r in mixing.slots(counts).collect())
    # At its limit a source gives each block twice.
    assert all(taken[name, b] == 2 for name, n, _ in rows[1:] for b in range(n))
    shards = [mixing.dealt(np.array([1] * 50), k, 50) for k in range(50)]
    assert sum(shards).tolist() == [1] * 50 and len({int(x.argmax()) for x in shards}) == 50


def test_mixed_documents_hold_the_words_taken(spark, docs):
    taken = Counter()
    for r in mixing.mixture(docs).collect():
        taken[r.doc_id] += r.taken
    given = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.mixed_documents(docs).collect():
        found = r.text.split()
        given[r.doc_id] += len(found)
        assert r.n_chars == len(r.text) and {r[c] for c in CLASHES} == {-7.5}
        assert not Counter(found) - Counter((texts[r.doc_id] or "").split())
    assert given == Counter({k: v for k, v in taken.items() if v})


# --- 4 SimHash ----------------------------------------------------------------


def brute_simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, edge):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if edge(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_duplicates_match_brute_force(spark, docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_ball.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_simhash(r.text) for r in docs.collect() if r.doc_id is not None}
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {g for g in got if g[0] is not None} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_join_chains_over_all_bits(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for start in prints[:8]:  # chains of steps of one or two bits, and stars around a point
        at = start
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randint(1, 2)):
                at ^= 1 << bit
            prints.append(at)
    prints += [prints[0] ^ (1 << b) for b in range(64)] + [0, (1 << 64) - 1]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash_ball.components(simhash_ball.links(df)).collect()}
    nodes = [s[0] for s in signed]
    want = brute_components(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: roots.get(n, n) for n in nodes} == want


def test_one_of_each_group_stays(spark, docs):
    near = simhash_ball.near_duplicates(docs).where("doc_id is not null").collect()
    kept = simhash_ball.keep_one(docs).collect()
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(named) == sorted({r.component_id for r in near})
    assert sum(r.doc_id is None for r in kept) == 1


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(31)
    a, b, c = (words(rng, 80, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, c.upper()), (4, ""), (5, None), (None, c)]
    rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)] * 2
    seen = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        kept = simhash_ball.keep_one(df)
        assert kept.columns == df.columns
        seen.append(sorted(((r.doc_id, r.text) for r in kept.collect()), key=str))
    # One row of each group: of a's, of b's, of c's, of those without words; unnamed rows stay.
    named = [(i, simhash_ball.simhash(t)) for i, t in seen[0] if i is not None]
    assert sorted(named) == sorted((i, simhash_ball.simhash(t)) for i, t in [(1, a), (1, b), (3, c), (4, "")])
    assert sum(i is None for i, _ in seen[0]) == 2
    assert seen[0] == seen[1]


# --- 5 and 10 classifiers -----------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = words(rng, rng.randint(20, 60)).split()
        if toxic:
            for bad in rng.sample(["vile1", "vile2", "vile3", "vile4"], 2):
                text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text)))
        marks.append((i, None, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted != (r.doc_id % 6 == 0) for r in held) <= 0.02 * len(held)
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(2), labels).collect()} == {
        r.doc_id: r.score for r in got
    }


def test_quality_on_held_out_documents(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(800):
        good = i % 5 != 0
        text = words(rng, rng.randint(80, 300)) + "."
        if not good:
            text = " | ".join(text.split()) if i % 2 else " ".join(x + "###" for x in text.split())
        rows.append((i, text))
        marks.append((i, int(good), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = [r for r in mil_quality.quality(docs, labels).collect() if r.held_out]
    assert sum(r.predicted != (r.doc_id % 5 != 0) for r in held) <= 0.03 * len(held)


def test_quality_gradients_are_right():
    rng = np.random.default_rng(1)
    p = mil_quality.start_weights()
    p["c"] = rng.normal(size=mil_quality.HIDDEN)
    x = rng.normal(size=(7, mil_quality.WIDTH))
    starts, y = np.array([0, 3, 4]), np.array([1, 0, 1])

    def loss():
        logit, _ = mil_quality.forward(p, x, starts)
        return np.mean(np.log1p(np.exp(-np.where(y, 1, -1) * logit)))

    got = mil_quality.gradients(p, x, starts, y)
    for name, index in (("W", (2, 3)), ("V", (1, 2)), ("U", (4, 5)), ("a", (3,)), ("c", (1,)), ("b", (0,))):
        old = p[name][index]
        p[name][index] = old + 1e-5
        high = loss()
        p[name][index] = old - 1e-5
        low = loss()
        p[name][index] = old
        assert got[name][index] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-8)


# --- 6 language model ---------------------------------------------------------


def test_language_model_base_counts_and_gain(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):  # two languages, so that the words before a word tell much about it
        vocabulary = [f"{'ab'[i % 2]}{k}" for k in range(60)]
        text = " ".join(rng.choice(vocabulary) for _ in range(60))
        rows.append((i, f"Rare{i} {text}", "extra"))
    df = spark.createDataFrame(rows + [(900, None, ""), (901, "", "")], "doc_id long, text string, word string")
    got = {r.doc_id: r for r in lbl_model.score(df.repartition(3)).collect()}
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    counts = Counter()
    for i, text, _ in rows + [(900, None, ""), (901, "", "")]:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(token(text))
    total, distinct = sum(counts.values()), len(counts)
    for i, text, _ in rows:
        each = token(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in each)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known) == (len(each), sum(counts[w] > 0 for w in each))
        assert got[i].train_tokens == total
    held = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_class_probabilities_are_normalised():
    p = lbl_model.start_weights(np.arange(lbl_model.CLASSES) + 1.0)
    context = np.tile(lbl_model.contexts(np.array([3, 200, 7]))[2], (lbl_model.CLASSES, 1))
    assert list(context[0]) == [200, 3, lbl_model.CLASSES, lbl_model.CLASSES]
    log = lbl_model.class_log10(p, context, np.arange(lbl_model.CLASSES))
    assert np.sum(10**log) == pytest.approx(1, rel=1e-5)


# --- 7 packed ids -------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (packed_ids.unpack(data, bits, 0, 1001) == ids).all()
    assert (packed_ids.unpack(data, bits, 333, 350) == ids[333:350]).all()
    assert packed_ids.bits_for(49_408) == 16


def test_written_ids_are_the_tokenizers(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packed_ids.tokenizer_path())
    folder = f"{tmp_path}/ids"
    packed_ids.write(docs, folder, packed_ids.tokenizer_path(), block_ids=500)
    got = packed_ids.documents(spark, folder).orderBy("start").collect()
    texts = sorted(
        ((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda x: x[:2]
    )
    assert [r.doc_id for r in got] == [None if m else i for m, i, _ in texts]
    start = 0
    for r, (_, _, text) in zip(got, texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    block = spark.read.parquet(folder).orderBy("part", "block").first()
    whole = packed_ids.unpack(block.payload, block.bits, 0, block.n_ids)
    part = packed_ids.read_range(spark, folder, block.part, 3, 40)
    assert (part[: len(whole) - 3] == whole[3:40]).all()


def test_texts_of_words_with_odd_white_space_and_marks():
    from tokenizers import Tokenizer

    path = packed_ids.tokenizer_path()
    encoder, tokenizer = packed_ids.Encoder(path), Tokenizer.from_file(path)
    for text in ("a b c", "It's NOT  a\ttest\x1cok", "é ́x Σας", "x<|endoftext|>y", "日本 🙂", "a\x00b \x00 c", "İstanbul Ǆ ŉa ſt ªº",
                 "Öl, été; ÇA!? don't. end... ,x x,y ?", "क़ Å K Straße"):
        want = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert encoder.ids(pa.array([text]))[0].tolist() == want


# --- 8 pages ------------------------------------------------------------------


def test_blocks_of_broken_pages():
    reader = html_blocks.Reader()
    page = (
        "<!-- x --><body><nav><ul><li><a href='/a'>Home</a><li>More</ul></nav><article><h1>A &amp; B</h1>"
        "<p><b>one<br>two<p>th<i>re</i>e&nbsp;x<script>var t='</p>';</script><div>four\n  five</div>"
    )
    assert [b.text for b in reader.blocks(page)] == ["Home", "More", "A & B", "one two", "three x", "four five"]
    for odd in (None, "", "<", "<p", "text", "<!-- never closed", "</div></p>", "<script>x"):
        assert [b.text for b in reader.blocks(odd)] == ({"text": ["text"], "<": ["<"], "<p": ["<p"]}.get(odd, []))


def test_extraction_of_layouts_not_seen_in_training(spark):
    rng = np.random.default_rng(77)
    pool = [f"word{k}" for k in range(3000)]
    rows, truth = [], {}
    for i in range(120):
        page, marks = html_blocks.sample_layout(rng, pool)
        found = html_blocks.Reader().blocks(page)
        assert len(found) == len(marks)
        rows.append((i, f"u{i}", page))
        truth[i] = (found, marks)
    rows += [(500, None, None), (501, "u", ""), (502, "u", "<p>"), (0, "u0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    wrong = total = 0
    got = html_blocks.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in truth:
            lines = set(r.text.split("\n"))
            for block, mark in zip(*truth[r.page_id]):
                total += 1
                wrong += (block.text in lines) != mark
        else:
            assert r.text == ""
    assert wrong <= 0.02 * total


def test_lstm_gradients_are_right():
    rng = np.random.default_rng(5)
    p = html_blocks.start_weights()
    reader = html_blocks.Reader()
    pages, marks = [], []
    for _ in range(2):
        page, label = html_blocks.sample_layout(rng, [f"w{k}" for k in range(900)])
        pages.append(reader.blocks(page))
        marks += label
    y = np.array(marks, float)

    def loss():
        logit, _ = html_blocks._logits(p, pages)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * logit)))

    got = html_blocks._gradients(p, pages, y)
    slot = pages[0][0].path[0]
    for name, index in (("path", (slot, 2)), ("xf", (3, 5)), ("hb", (2, 40)), ("zf", (7,)), ("o", (4,)), ("o0", (0,))):
        old = p[name][index]
        p[name][index] = old + 1e-5
        high = loss()
        p[name][index] = old - 1e-5
        low = loss()
        p[name][index] = old
        assert got[name][index] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-8)


# --- 9 decontamination --------------------------------------------------------


def test_masks_avoid_every_pair_of_positions():
    for a, b in itertools.combinations(range(spaced_seeds.SPAN), 2):
        assert any(m[a] == "." and m[b] == "." for m in spaced_seeds.MASKS)
    assert {len(m) for m in spaced_seeds.MASKS} == {spaced_seeds.SPAN}


def brute_overlap(doc, item):
    doc, item = spaced_seeds.words_of(doc), spaced_seeds.words_of(item)
    n = len(item)
    span, need = (n, n) if n < 13 else (13, 11)
    if n < 5:
        return False
    return any(
        sum(x == y for x, y in zip(doc[i : i + span], item[j : j + span])) >= need
        for i in range(len(doc) - span + 1)
        for j in range(n - span + 1)
    )


@pytest.mark.parametrize("slice_words", [40, 2_000_000])
def test_overlaps_match_brute_force(spark, slice_words):
    rng = random.Random(12)
    items = [(i, words(rng, n, 3000)) for i, n in enumerate((4, 5, 9, 13, 14, 30, 30))]
    items += [(7, "the " * 20), (7, "the " * 20), (8, None)]
    rows = []
    for k in range(140):
        text = words(rng, 60, 3000).split()
        passage = (rng.choice(items[:7])[1]).split()
        start = rng.randrange(max(1, len(passage) - 12)) if k % 3 else 0
        passage = passage[start:]
        for at in rng.sample(range(len(passage)), min(len(passage), rng.choice((0, 0, 1, 2, 3, 5)))):
            passage[at] = "changed"
        at = rng.choice((0, 30, 60))
        rows.append((k, " ".join(text[:at] + passage + text[at:])))
    rows += [(500, "the " * 100), (501, None), (502, ""), (503, " ".join(f"z{i}" for i in range(40)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    found = spaced_seeds.overlaps(docs, benchmark, slice_words).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = {(d, i) for d, t in rows for i, x in items if x and t and brute_overlap(t, x)}
    assert got == want
    assert all(r.similarity == r.n_equal / r.n_words and r.similarity >= 0.8 for r in found)
    kept = {r.doc_id for r in spaced_seeds.drop_contaminated(docs, benchmark, slice_words).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


# --- helpers ------------------------------------------------------------------


def test_starts_in_order_cross_parts(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else rng.choice(["a", None]), i, rng.randrange(9)) for i in range(800)]
    df = spark.createDataFrame(data, "g string, i long, v long").repartition(6)
    got = {(r.g, r.i): r.s for r in common.starts_in_order(df, ["g"], ["i"], "v", "s").collect()}
    total = Counter()
    for g, i, v in data:
        assert got[g, i] == total[g]
        total[g] += v
