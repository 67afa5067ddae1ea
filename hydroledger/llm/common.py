"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds after which an idle worker process lets go of what its tasks share.
IDLE_SECONDS = 3.0
#: Entries of a task's word cache before it starts anew; it only saves time.
CACHE_WORDS = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    local = context.master.split("[")[0] in ("local", "local-cluster")
    if folder:
        if not local and folder.startswith("file:"):
            raise ValueError(f"spark.checkpoint.dir names a folder of one machine: {folder}")
        return folder
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpus-")
    context.setCheckpointDir(folder)
    return folder


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def held_out(doc_id: str | Column, folds: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a missing id counts as held out."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, rows: int
) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents outside the held-out fold.

    The ids come in the order of their hash, so reruns take the same ones.  A document
    with several labels counts with the larger one, an id with several rows with one of
    them: that whose text has the smallest hash, a missing text after all others.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out("doc_id", folds))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    text = F.col("text").cast("string")
    order = F.struct(text.isNull(), F.xxhash64(text))
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min_by("text", order).alias("text"), F.max("_label").alias("_label"))
        .drop("doc_id")
    )


@contextmanager
def kept_in_worker(key: tuple, build: Callable[[], object]) -> Iterator[object]:
    """What ``build`` makes, shared by the tasks that one worker process runs for a stage.

    A task takes it out while it works and puts it back when it ends well.  A worker that
    has not asked for it for ``IDLE_SECONDS`` lets it go, so that later stages have the memory.
    """
    home = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker"))
    kept = vars(home).setdefault("kept", {})
    value = kept.pop(key, None) or build()
    yield value
    pa.default_memory_pool().release_unused()
    kept[key] = value

    def let_go() -> None:
        if kept.get(key) is value:
            kept.pop(key, None)
            pa.default_memory_pool().release_unused()

    timer = threading.Timer(IDLE_SECONDS, let_go)
    timer.daemon = True
    timer.start()


class WordHashes(dict):
    """Cache from a word to a 64-bit number, made by ``of`` on first sight."""

    def __init__(self, of: Callable[[str], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        value = self[word] = self.of(word)
        return value

    def array(self, words: list) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hash64(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def starts_in_order(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add to each row the total of ``value`` over the earlier rows of its group.

    Rows are cut by range, so that a hot group spreads over many tasks; a row's start
    is the total of the group's earlier parts plus the running total inside the part.
    """
    parts = checkpointed(
        df.repartitionByRange(
            *[F.col(c).asc_nulls_last() for c in (*keys, *order)]
        ).withColumn("_part", F.spark_partition_id())
    )
    group = F.struct(*keys) if keys else F.lit(0)
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        parts.withColumn("_group", group)
        .groupBy("_group", "_part")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy("_group", "_part")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        parts.withColumn("_group", group)
        .join(bases, ["_group", "_part"])
        .withColumn(out, (F.col("_base") + F.sum(value).over(inside) - F.col(value)).cast("long"))
        .drop("_group", "_part", "_base")
    )
