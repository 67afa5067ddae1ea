"""Token ids in fixed-width bit-packed blocks.

File format: a Parquet folder with one row per block, written and committed by Spark,
so a lost executor's tasks are simply run again.  Columns: ``part`` (ordered range of
documents) and ``block`` inside it, ``start`` (ids before the block in its part),
``n_ids``, ``bits`` per id, ``payload`` (ids of ``bits`` bits each, lowest bit first, no
gaps), ``doc_ids`` and ``offsets`` (where each document begins in the block, with the
block's end).  A block holds whole documents: it closes with the first document that
fills it.  So any block, and any document of it, is read without the others, and numpy
unpacks all its ids at once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, kept_in_worker

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids after which a block closes with its document.
BLOCK_IDS = 65_536
#: Words of one generation of a worker process's cache; it only saves time.
KEPT_WORDS = 600_000
#: Write tasks up to which the ids before each are broadcast: 16 bytes a row, 16 MB.
BROADCAST_PARTS = 1_000_000
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x00"
#: Bytes of texts that are encoded together.
GROUP_BYTES = 32 << 20
FILE_SCHEMA = (
    "part int, block int, start long, n_ids long, bits int, payload binary, "
    "doc_ids array<long>, offsets array<long>"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a payload; reads only their bytes."""
    if bits in (8, 16, 32):
        size = bits // 8
        return np.frombuffer(payload, f"<u{size}", last - first, first * size).astype("<u4")
    low, high = first * bits // 8, -(-last * bits // 8)
    stream = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    skip = first * bits - low * 8
    each = stream[skip : skip + (last - first) * bits].reshape(-1, bits)
    full = np.zeros((len(each), 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Ids of words as little-endian 32-bit numbers.

    Two generations: what is used again moves to the newer one, the older one is
    dropped when the newer is full.
    """

    def __init__(self, size: int = KEPT_WORDS):
        super().__init__({b"": b""})
        self.size = size
        self.older: dict[bytes, bytes] = {}

    def renew(self) -> None:
        """Start a new generation when this one is full."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
            self[b""] = b""

    def unlearned(self, words: set[bytes]) -> list[bytes]:
        """Those of ``words``, none of which is in the newer generation, not known at all."""
        kept = self.older.keys() & words
        self.update({w: self.older[w] for w in kept})
        return list(words - kept)


class Encoder:
    """Encodes texts by their white-space-separated words, whose ids are kept for reuse.

    The tokenizer drops white space and never joins what it separates, so the ids of a
    text are those of its words, one after the other.  New words of Latin letters go to the
    tokenizer's model directly, as its first steps leave them whole; others are encoded
    together, as one text, with a mark between them that stands for one id.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.known = Known(kept_words)
        (self.mark,) = np.frombuffer(self._one(MARK), "<u4")
        self.model, self.alphabet = self.tokenizer.model, _byte_letters()
        vocabulary = self.tokenizer.get_vocab_size()
        self.as_bytes = [i.to_bytes(4, "little") for i in range(vocabulary)]
        self.tails: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters, by the tokenizer's model alone.

        Such a word is one piece whatever stands around it, and neither composes with its
        neighbours nor changes its length in lower case.
        """
        if word.isascii():
            if word and not word.isalpha():
                return None
            piece = word.lower().decode("ascii")
        else:
            text = word.decode("utf-8")
            if not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text:
                return None
            piece = text.lower().encode("utf-8").decode("latin-1").translate(self.alphabet)
        as_bytes = self.as_bytes
        return b"".join([as_bytes[t.id] for t in self.model.tokenize(piece)])

    def _tail(self, marks: str) -> bytes:
        """Ids of the punctuation after a word."""
        found = self.tails.get(marks)
        if found is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            found = self.tails[marks] = self._one(marks) if marks else b""
        return found

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        for word in words:
            bare = word.rstrip(b".,;:!?")
            tail = word[len(bare) :].decode("ascii")
            ids = self.known.get(bare) if tail else None
            if ids is None:
                ids = self._letters(bare)
                if ids is None:
                    rest.append((word, word.decode("utf-8")))
                    continue
                if tail:
                    self.known[bare] = ids
            self.known[word] = ids + self._tail(tail)
        if rest:
            self._learn_together(*zip(*rest))

    def _learn_together(self, words: tuple[bytes, ...], texts: tuple[str, ...]) -> None:
        if any(MARK in t for t in texts):
            self.known.update((w, self._one(t)) for w, t in zip(words, texts))
            return
        text = f" {MARK} ".join(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark).tolist()
        data = ids.tobytes()
        for word, low, high in zip(words, [-1, *cuts], [*cuts, len(ids)]):
            self.known[word] = data[4 * low + 4 : 4 * high]

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each followed by the end id, and where each text's ids end.

        A missing text is empty.  Words are counted off by Arrow, so that each distinct
        word of the group is looked up once.
        """
        self.known.renew()
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        del words
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, distinct))
        gaps = [i for i, x in enumerate(found) if x is None]
        fresh = self.known.unlearned({distinct[i] for i in gaps})
        for at in range(0, len(fresh), 2000):
            self._learn(fresh[at : at + 2000])
        for i in gaps:
            found[i] = self.known[distinct[i]]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        each = sizes[word]
        upto = np.concatenate(([0], np.cumsum(each)))
        ends = upto[offsets[1:] - offsets[0]] + np.arange(1, len(texts) + 1)
        # A word's place in the pool less its place in the output, then one step per id.
        first = ((np.cumsum(sizes) - sizes)[word] - upto[:-1]).astype(np.int32)
        place = np.repeat(first, each)
        place += np.arange(len(place), dtype=np.int32)
        inside = np.ones(len(place) + len(texts), bool)
        inside[ends - 1] = False
        out = np.full(len(inside), END_ID, "<u4")
        out[inside] = pool[place]
        return out, ends


def groups(batch: pa.RecordBatch, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of at most ``most`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if batch.num_rows:
        yield batch.slice(start)


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    block_ids: int = BLOCK_IDS,
    kept_words: int = KEPT_WORDS,
    group_bytes: int = GROUP_BYTES,
) -> None:
    """Write the ids of all texts to ``folder`` in ascending doc_id order.

    Missing ids come last, equal ids in the order of their text's hash.  Documents are
    dealt by ranges of (doc_id, hash), so no id gathers in one task.
    """
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    key = ("packed_ids", tokenizer, kept_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Its tasks share the words that a worker process has learned.
        with kept_in_worker(key, lambda: Encoder(tokenizer, kept_words)) as encoder:
            yield from pack_all(batches, encoder)

    def pack_all(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, start, ids, names = 0, 0, [], []

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            row = {
                "part": part,
                "block": block,
                "start": start,
                "n_ids": int(ends[-1]),
                "bits": bits,
                "payload": pack(np.concatenate(ids), bits),
                "doc_ids": list(names),
                "offsets": [0, *ends.tolist()],
            }
            return pa.RecordBatch.from_pylist([row], schema)

        held = 0
        for batch in batches:
            for group in groups(batch, group_bytes):
                flat, ends = encoder.ids(group.column(1))
                low = 0
                for doc_id, high in zip(group.column(0).to_pylist(), ends.tolist()):
                    ids.append(flat[low:high])
                    names.append(doc_id)
                    held, low = held + high - low, high
                    if held >= block_ids:
                        yield close()
                        block, start, held, ids, names = block + 1, start + held, 0, [], []
        if ids:
            yield close()

    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("block", pa.int32()),
            ("start", pa.int64()),
            ("n_ids", pa.int64()),
            ("bits", pa.int32()),
            ("payload", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("offsets", pa.list_(pa.int64())),
        ]
    )
    packed = ranged.mapInArrow(run, FILE_SCHEMA)
    packed.write.option("compression", "zstd").parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a written folder, with ``base``: ids of all earlier parts."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, of which there are as many as write tasks.
    bases = (
        rows.groupBy("part")
        .agg(F.sum("n_ids").alias("_ids"))
        .select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("base"))
    )
    bases = checkpointed(bases)
    few = bases.count() <= BROADCAST_PARTS
    return rows.join(F.broadcast(bases) if few else bases, "part")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = unpack(row.payload, row.bits, 0, row.n_ids)
                ends = np.asarray(row.offsets)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(row.doc_ids, "Int64"),
                        "start": row.base + row.start + ends[:-1],
                        "n_tokens": np.diff(ends),
                        "ids_crc32": [
                            zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])
                        ],
                    }
                )

    return blocks(spark, folder).mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_range(spark: SparkSession, folder: str, part: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a part: only the blocks that hold them are read."""
    rows = (
        spark.read.schema(FILE_SCHEMA)
        .parquet(folder)
        .where((F.col("part") == part) & (F.col("start") < last))
        .where(F.col("start") + F.col("n_ids") > first)
        .select("start", "n_ids", "bits", "payload")
        .orderBy("start")
    )
    found = [
        unpack(r.payload, r.bits, max(0, first - r.start), min(r.n_ids, last - r.start))
        for r in rows.toLocalIterator()
    ]
    return np.concatenate(found) if found else np.zeros(0, "<u4")


def encode_documents(
    docs: DataFrame, folder: str, tokenizer: str | None = None, **memory: int
) -> DataFrame:
    """Write ``docs`` to ``folder`` and return doc_id, start, n_tokens, ids_crc32 from it.

    Every row gets its ids and the end id, a missing or empty text only the latter;
    repeated rows are written as often as they come; extra columns are left out; an
    empty table gives an empty folder and no rows.  ``memory`` may lower ``kept_words`` and
    ``group_bytes``, which trade a worker's memory for time and change no result.
    """
    write(docs, folder, tokenizer or tokenizer_path(), **memory)
    return documents(docs.sparkSession, folder)
