"""Streaming BPE: the library's ids and texts, stability by brute force, odd rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models

from hydroledger.llm import bpe_stream, packed_ids

DOCS = "doc_id long, text string"
PATH = packed_ids.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.Encoder(PATH)


def odd_texts():
    out = [None, "", " ", "a", "it's don't we'll 'sand --'s x'", "\x1c\x1d a\x1fb\x00c", "á é ́x Å"]
    out += ["<|startoftext|>hi<|endoftext|><|endoftext|> <|end", "<|ENDOFTEXT|> a<|endoftext|>b", "日本語。テスト1234"]
    out += ["İstanbul ΑΣ Σ", "ﬁ ² ½ x²", "\x85a\xa0b c", "한국어 각", "\U0001f600\U0001f468‍\U0001f469"]
    out += ["ǅ ß ẞ", "a" * 1000, "ab" * 3000 + "!" * 3000, "x'" * 500, "É" * 700 + "'s" + "é" * 400, "क्षि" * 300]
    out += ["<" * 300 + "|endoftext|>" + "<|endoftext|>" * 30 + "a" * 300, "\U0001d400" * 400, "が" * 300]
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    mixed = "abcdeth in'ré́Σσß日本1٣.,-!  \n\x1f\U0001f600İ"
    out = ["".join(rng.choices(mixed, k=rng.randint(1, 300))) for _ in range(n)]
    out += ["".join(rng.choices("thinaeorslé'", k=rng.randint(200, 6000))) for _ in range(n // 4)]
    return out + ["".join(rng.choices(["in", "g", "th", "e", "a", "ing", "the"], k=9000)) for _ in range(3)]


def test_ids_are_the_librarys(encoder, library):
    texts = odd_texts() + random_texts(2, 200)
    found = encoder.batch([None if t is None else t.encode() for t in texts])
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_long_words_in_small_slices(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe_stream.slices, "__defaults__", (37,))
    for text in random_texts(3, 60) + [t for t in odd_texts() if t]:
        for word in text.split():
            if "<|" not in word and "|>" not in word:
                want = library.encode(word, add_special_tokens=False).ids
                assert np.frombuffer(encoder._stream(word.encode()), "<u4").tolist() == want


def test_caches_may_forget(library):
    small = bpe_stream.Encoder(PATH)
    small.words.size = small.pieces.size = 5
    for text in random_texts(4, 30) * 2:
        ids = np.frombuffer(small.batch([text.encode()])[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def proper_rules(rng, n):
    """Random merges over a and b, each part made before, no token made twice."""
    known, rules = ["a", "b"], []
    while len(rules) < n:
        u, v = rng.choice(known), rng.choice(known)
        if len(u + v) <= 6 and u + v not in known:
            known.append(u + v)
            rules.append((u, v))
    return rules


def spec(rules):
    letters = [*bpe_stream.byte_letters().values()]
    vocabulary = {t: i for i, t in enumerate(letters + [u + v for u, v in rules])}
    return {"model": {"type": "BPE", "vocab": vocabulary, "merges": rules}}


@pytest.mark.parametrize("seed", range(12))
def test_tokens_are_stable_beyond_the_lookahead(seed):
    rng = random.Random(seed)
    merges = bpe_stream.Merges(spec(proper_rules(rng, rng.randint(1, 12))))
    texts = ["".join(t) for n in (9, 10) for t in itertools.product("ab", repeat=n)]
    tokens = {t: merges.run(merges.inside[np.frombuffer(t.encode(), np.uint8)].tolist()) for t in texts}
    for short in texts[:512]:
        ids, places = tokens[short]
        for more in "ab":  # one more symbol at a time reaches every longer text
            later, at = tokens[short + more]
            for i, place in enumerate([*places[1:], len(short)]):
                if place <= len(short) - merges.lookahead:
                    assert later[i] == ids[i] and [*at, 10][i + 1] == place


@pytest.mark.parametrize("seed", range(6))
def test_streamed_pieces_equal_whole_ones(seed):
    rng = random.Random(seed)
    rules = proper_rules(rng, 15)
    merges = bpe_stream.Merges(spec(rules))
    model = models.BPE(spec(rules)["model"]["vocab"], rules)
    transducer = bpe_stream.Transducer(merges)
    transducer.window = merges.lookahead + 3
    pieces = ["".join(rng.choices("ab", k=rng.randint(1, 300))) for _ in range(40)] + ["a" * 200, "ab" * 90]
    for piece in pieces:
        want = [t.id for t in model.tokenize(piece)]
        got, at = [], 0
        while at < len(piece):
            step = rng.randint(1, 40)
            got.extend(transducer.push(piece[at : at + step].encode()))
            assert len(transducer.held) < transducer.window + merges.lookahead
            at += step
        assert got + list(transducer.end()) == want
    many = merges.many([p.encode() for p in pieces])
    assert [np.frombuffer(m, "<u4").tolist() for m in many] == [[t.id for t in model.tokenize(p)] for p in pieces]


def test_state_stays_small_on_a_long_piece(encoder, library):
    transducer = bpe_stream.Transducer(encoder.merges)
    word, got = "thinganoreration" * 4000, []
    for at in range(0, len(word), 1000):
        got.extend(transducer.push(word[at : at + 1000].encode()))
        assert len(transducer.held) <= transducer.window + 1000
    got.extend(transducer.end())
    assert got == library.encode(word, add_special_tokens=False).ids


def test_improper_lists_are_refused():
    for rules in ([("a", "bc")], [("ab", "c"), ("a", "b")], [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")]):
        with pytest.raises(ValueError):
            bpe_stream.sufficient_lookahead(rules, len)
    assert bpe_stream.sufficient_lookahead([], len) == 0
    assert bpe_stream.sufficient_lookahead([("a", "b")], len) == 1
    # a|b may undo what ends in a; c|ab may then undo the c before it.
    assert bpe_stream.sufficient_lookahead([("a", "b"), ("c", "ab"), ("d", "cab")], len) == 3


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_decoding_in_parts(library, step, tmp_path):
    byte_level = Tokenizer.from_file(PATH)
    byte_level.decoder = decoders.ByteLevel()
    byte_level.save(f"{tmp_path}/bytes.json")
    rng = random.Random(6)
    for path, reference in ((PATH, library), (f"{tmp_path}/bytes.json", byte_level)):
        decoder = bpe_stream.Decoder(path)
        lists = [[], [49406], [49407, 10**6, 5], [*range(0, 512)], rng.choices(range(49408), k=400)]
        lists += [library.encode(t or "", add_special_tokens=False).ids for t in odd_texts()]
        for ids in lists:
            parts = [decoder.push(ids[at : at + step]) for at in range(0, len(ids), step)]
            assert "".join((*parts, decoder.end())) == reference.decode(ids, skip_special_tokens=False)


def test_query_columns(spark, library):
    texts = odd_texts() + random_texts(8, 20)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("ids", "tokens")}).repartition(4)
    both = bpe_stream.decode(bpe_stream.encode(df))
    assert both.columns == ["doc_id", "ids", "text"]
    got = both.select("doc_id", F.sha2("ids", 256), F.sha2("text", 256)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        data = np.array(ids, "<u4").tobytes()
        want.append((i, hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe_stream.decode(bpe_stream.encode(spark.createDataFrame([], DOCS))).count() == 0
