"""BPE encoding and decoding by streaming transducers of bounded lookahead.

Encoding.  Merges run by rank.  Take two texts that share a prefix and let both run at once:
the place up to which their tokens agree moves left only when a merge joins the last
agreed token ``u`` with what follows it in one of the texts, and then by the length of
``u``.  The next such merge has a later rank, and its right part starts where ``u`` started:
``u`` is on its left spine (itself, its left part, that one's left part, ...).  So the
longest chain of rules, later and later, each with the former's left part on the left spine
of its right part, bounds how far the end of a text can reach back: the sum of the chain's left parts
is a *sufficient lookahead*, computed once from the merge list.  A token that ends at least
that far before the end of what was read is stable.  :class:`Transducer` reads a piece of any
length, emits tokens as they become stable and holds a window of fixed size.

That is sound for a proper merge list, in which both parts of a rule are single symbols or
made by an earlier rule, and a token is made by one rule only; others are refused.

Most pieces are short and end at once, so they are run many at a time in numpy, one merge of
lowest rank per piece and round, and their ids are kept for reuse.

Decoding.  :class:`Decoder` maps ids to bytes and reads the bytes with a UTF-8 state
machine, which keeps at most three bytes of an unfinished character between calls.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker
from .packed_ids import tokenizer_path

#: Words and pieces of one generation of a worker process's caches; they only save time.
KEPT_WORDS, KEPT_PIECES = 300_000, 100_000
#: Bytes from which a piece is streamed, and a word's pieces are found slice by slice.
LONG = 256
#: Texts encoded together, characters of a long word per slice, ids decoded at a time.
GROUP_TEXTS, SLICE_CHARS, GROUP_IDS = 256, 1 << 16, 1 << 16
_NONE = np.iinfo(np.int32).max
#: Characters whose words need no library to be normalised: printable ASCII and Latin letters
#: and signs up to U+024F, without U+0130, whose lower case is two characters.
_PLAIN = regex.compile("[\x21-\x7e\xa1-įı-ɏ]+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


def sufficient_lookahead(rules: list[tuple[str, str]], length) -> int:
    """How many symbols before the end of what was read a token must end to be stable.

    ``rules`` are the merges by rank, ``length`` gives a token's symbols.  Raises
    ValueError for a list that is not proper.
    """
    left: dict[str, str] = {}
    reach: dict[str, int] = {}
    parts = {p for rule in rules for p in rule}
    most = 0
    for u, v in rules:
        token = u + v
        if token in left:
            raise ValueError(f"two rules make {token!r}")
        if any(length(p) > 1 and p not in left for p in (u, v)):
            raise ValueError(f"a part of {u!r} + {v!r} is made later or never")
        chain, at = 0, v
        while at is not None:
            chain = max(chain, reach.get(at, 0))
            at = left.get(at)
        here = chain + length(u)
        reach[u] = max(reach.get(u, 0), here)
        left[token] = u
        most = max(most, here)
    if any(length(p) > 1 and p not in left for p in parts):
        raise ValueError("a part is never made")
    return most


class Generations(dict):
    """A cache of two generations: what is used again moves to the newer one."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def renew(self) -> None:
        """Start a new generation when this one is full."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()

    def unknown(self, keys: set) -> list:
        """Those of ``keys``, none of which is in the newer generation, in neither of them."""
        kept = self.older.keys() & keys
        self.update({k: self.older[k] for k in kept})
        return list(keys - kept)


class Merges:
    """The merge list of a byte-level BPE file as tables over ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        if model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level BPE model")
        suffix = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(
            rules, lambda token: len(token.removesuffix(suffix)) if suffix else len(token)
        )
        letters = byte_letters()
        self.inside = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        ids = np.array([(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in rules], np.int64)
        ids = ids.reshape(-1, 3)
        self.span = max(vocabulary.values()) + 1
        keys = ids[:, 0] * self.span + ids[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = ids[:, 2]
        self.rank_of = {key: rank for rank, key in enumerate(keys.tolist())}
        self.made_list = self.made.tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring ids; a pair without a rule has the largest number."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of whole pieces, none empty, as little-endian 32-bit numbers."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.inside[flat]
        ends = np.cumsum(sizes) - 1
        token[ends] = self.last[flat[ends]]
        own = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(token), _NONE, np.int32)
        rank[:-1] = self.rank(token[:-1], token[1:])
        rank[ends] = _NONE
        done_own, done_token = [], []
        while len(token):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sizes = np.diff(first, append=len(own))
            least = np.minimum.reduceat(rank, first)
            finished = np.repeat(least == _NONE, sizes)
            done_own.append(own[finished])
            done_token.append(token[finished])
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & ~finished)
            at = at[np.concatenate(([True], own[at[1:]] != own[at[:-1]]))] if len(at) else at
            # The pair's left place takes the new id, its right place goes.
            token[at] = self.made[rank[at]]
            keep = ~finished
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            rank[at] = rank[at + 1]  # ends a piece where the right place did
            ended = rank[at] == _NONE
            at = place[at]
            token, own, rank = token[keep], own[keep], rank[keep]
            if not len(token):
                break
            self._renew(token, own, rank, at)
            self._renew(token, own, rank, at - 1)
        token, own = np.concatenate(done_token), np.concatenate(done_own)
        token = token[np.argsort(own, kind="stable")].astype("<u4")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(pieces))))) * 4
        data = token.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _renew(self, token, own, rank, at) -> None:
        """Look the ranks at ``at`` up again, where the next place is of the same piece."""
        at = at[(at >= 0) & (at + 1 < len(token))]
        within = own[at] == own[at + 1]
        rank[at] = np.where(within, self.rank(token[at], token[at + 1]), _NONE)

    def run(self, token: list[int]) -> tuple[list[int], list[int]]:
        """Ids of one run of symbols, and where each begins."""
        n, span, rank_of = len(token), self.span, self.rank_of
        token = list(token)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = rank_of.get(token[i] * span + token[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or token[i] != left or j >= n or token[j] != right:
                continue
            token[i] = self.made_list[rank]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        places = [i for i in range(n) if alive[i]]
        return [token[i] for i in places], places


class Transducer:
    """Reads one piece in parts and emits its ids as they become stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = max(4 * merges.lookahead, 2048)
        self.held: list[int] = []  # symbols without a stable token
        self.byte: int | None = None  # the last byte read: it may be the piece's end

    def push(self, part: bytes) -> Iterator[int]:
        """Read more bytes of the piece."""
        merges = self.merges
        for at in range(0, len(part), self.window):
            more = part[at : at + self.window]
            if self.byte is not None:
                more = bytes((self.byte,)) + more
            self.byte = more[-1]
            self.held.extend(merges.inside[np.frombuffer(more, np.uint8)[:-1]].tolist())
            if len(self.held) >= self.window:
                ids, places = merges.run(self.held)
                places.append(len(self.held))
                stable = len(self.held) - merges.lookahead
                count = 0
                while count < len(ids) and places[count + 1] <= stable:
                    count += 1
                yield from ids[:count]
                del self.held[: places[count]]

    def end(self) -> Iterator[int]:
        """The piece is over: emit the rest and be ready for another."""
        if self.byte is not None:
            yield from self.merges.run([*self.held, int(self.merges.last[self.byte])])[0]
        self.held, self.byte = [], None


class Encoder:
    """Texts to ids, as the tokenizers library gives them for a file of byte-level BPE.

    The file's first steps must drop white space and lower-case letters (``word_bpe_49k``
    does): then a text's ids are those of its words, one after the other.
    """

    # The first steps of the supported file.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    STEPS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != self.STEPS or splits[0].get("pattern", {}).get("Regex") != self.SPLIT:
            raise ValueError("the file's first steps are not those of word_bpe_49k.json")
        self.library = Tokenizer.from_file(path)  # normalises and splits words of other scripts
        self.merges = Merges(spec)
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        marks = sorted(map(regex.escape, added), key=len, reverse=True)
        self.mark = regex.compile(b"(" + b"|".join(marks) + b")") if marks else None
        self.split = regex.compile(self.SPLIT)
        self.words, self.pieces = Generations(KEPT_WORDS), Generations(KEPT_PIECES)
        self.raw = {ord(letter): byte for byte, letter in byte_letters().items()}

    def _pieces(self, word: str) -> list[bytes]:
        """A word's pieces in UTF-8, in lower case."""
        if _PLAIN.fullmatch(word):
            if word.isalpha():
                return [word.lower().encode()]
            return [p.encode() for p in self.split.findall(word.lower())]
        whole = self.library.normalizer.normalize_str(word)
        found = self.library.pre_tokenizer.pre_tokenize_str(whole)
        return [p.translate(self.raw).encode("latin-1") for p, _ in found]

    def _learn(self, words: list[bytes]) -> None:
        """Find and keep the ids of words, none of which is long."""
        cut = [[w.lower()] if w.isalpha() else self._pieces(w.decode("utf-8")) for w in words]
        self.pieces.renew()
        missing = {p for pieces in cut for p in pieces if p not in self.pieces}
        fresh = self.pieces.unknown(missing)
        self.pieces.update(zip(fresh, self.merges.many(fresh)))
        get = self.pieces.__getitem__
        self.words.update({w: b"".join(map(get, pieces)) for w, pieces in zip(words, cut)})

    def _stream(self, word: bytes) -> bytes:
        """Ids of a long word, its pieces streamed."""
        out, transducer, after = [], Transducer(self.merges), False
        for part, goes_on in slices(word.decode("utf-8")):
            pieces = self._pieces(part)
            for i, piece in enumerate(pieces):
                if i or not after:
                    out.extend(transducer.end())
                out.extend(transducer.push(piece))
            after = goes_on
        out.extend(transducer.end())
        return np.array(out, "<u4").tobytes()

    def batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of whole texts in UTF-8 as little-endian 32-bit numbers; a missing text has none."""
        self.words.renew()
        get = self.words.get
        split = [self._words(text or b"") for text in texts]
        found = [list(map(get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        missing = {words[i] for words, at in zip(split, gaps) for i in at}
        # Neither added tokens nor long words are kept: they are looked up where they stand.
        short = {w for w in missing if len(w) <= LONG and w not in self.added}
        fresh = self.words.unknown(short)
        self._learn(fresh)
        for words, ids, at in zip(split, found, gaps):
            for i in at:
                word = words[i]
                ids[i] = get(word) or self.added.get(word)
                if ids[i] is None:
                    ids[i] = b"" if len(word) <= LONG else self._stream(word)
        return [b"".join(ids) for ids in found]

    def _words(self, text: bytes) -> list[bytes]:
        """White-space-separated words; the strings of added tokens stand alone."""
        if self.mark is None or b"<" not in text:
            return text.split()
        return [w for part in self.mark.split(text) for w in part.split()]


def slices(word: str, size: int = SLICE_CHARS) -> Iterator[tuple[str, bool]]:
    """Slices of a long word that can be normalised and split alone.

    With each: whether its last piece goes on in the next.  A slice ends between two
    letters, after three more of them: letters neither compose with the letter before them
    nor, that far from an apostrophe, belong to a clitic.  Where no such place comes,
    the slice goes on.
    """

    def letter(c: str) -> bool:
        return c.isalpha() and c < "\U00010000" and not "ᄀ" <= c <= "ᇿ"

    start, at = 0, size
    while at < len(word):
        if all(map(letter, word[at - 4 : at + 1])) and unicodedata.combining(word[at]) == 0:
            yield word[start:at], True
            start, at = at, at + size
        else:
            at += 1
    yield word[start:], False


class Decoder:
    """Ids to text, part by part; equals decoding all ids at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        kind = (spec["decoder"] or {"type": None})["type"]
        if kind is None:  # tokens as they are, blanks between them
            self.between = b" "
            self.table = {i: t.encode() for i, t in names.items()}
        elif kind == "ByteLevel":
            self.between = b""
            raw = {letter: byte for byte, letter in byte_letters().items()}
            self.table = {
                i: bytes(map(raw.get, t)) if all(c in raw for c in t) else t.encode()
                for i, t in names.items()
            }
        else:
            raise ValueError(f"decoder {kind} is not supported")
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def push(self, ids: Iterable[int]) -> str:
        """Text of more ids, as far as its characters are complete; unknown ids are left out."""
        found = [t for t in map(self.table.get, ids) if t is not None]
        if not found:
            return ""
        data = self.between.join(found)
        if self.started:
            data = self.between + data
        self.started = True
        return self.machine.decode(data)

    def end(self) -> str:
        """What is left; ready for another text."""
        rest = self.machine.decode(b"", True)
        self.reset()
        return rest

    def whole(self, ids: np.ndarray) -> str:
        """Text of all ids of a document, a group at a time."""
        parts = [
            self.push(ids[at : at + GROUP_IDS].tolist()) for at in range(0, len(ids), GROUP_IDS)
        ]
        return "".join((*parts, self.end()))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per input row: doc_id and ``ids``, little-endian unsigned 32-bit numbers.

    The ids are those of the whole text, special tokens' strings in it included, nothing
    added.  A missing or empty text has no ids; repeated rows repeat; extra columns are left
    out whatever their names; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_in_worker(("bpe_stream", path), lambda: Encoder(path)) as encoder:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP_TEXTS):
                    part = batch.slice(at, GROUP_TEXTS)
                    ids = pa.array(encoder.batch(part.column(1).to_pylist()), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary")
    )
    return thin.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and ``text`` of rows as :func:`encode` gives them.

    No ids, or missing ones, give an empty text; special tokens come as their strings.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_in_worker(("bpe_stream decoder", path), lambda: Decoder(path)) as decoder:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP_TEXTS):
                    part = batch.slice(at, GROUP_TEXTS)
                    ids = part.column(1).to_pylist()
                    texts = [decoder.whole(np.frombuffer(x or b"", "<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(texts, pa.string())],
                        ["doc_id", "ids", "text"],
                    )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
