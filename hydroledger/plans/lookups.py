"""Small-side joins with a stated size bound, and key checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
#: Most bytes in memory of a side that is broadcast by its stored size.
BROADCAST_BYTES = 256 << 20
#: How many times larger than stored a table may be in memory.
GROWTH = 4


def lookup(df: DataFrame, at_most: int | None) -> DataFrame:
    """Broadcast ``df`` when its rows are bounded by ``at_most`` and few.

    The bound comes from parameters (years x blocs x products), so it does not
    grow with the data.  Without one, Spark's own size check picks the join.
    """
    if at_most is not None and at_most <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table, from the file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(hadoop_path).getLength()


def broadcast_if_small(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Broadcast ``df`` when the tables it looks rows up in are small, stored and in memory.

    Spark multiplies the sizes of joined tables in its estimate, so it would miss a
    small table that was itself joined to smaller ones.  Stored bytes times GROWTH, an
    allowance for compression, are held against the session's own broadcast threshold
    and against BROADCAST_BYTES, whatever the session allows; above it Spark chooses.
    """
    spark = df.sparkSession
    limit = min(_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")), BROADCAST_BYTES)
    if GROWTH * sum(stored_bytes(spark, path) for path in paths) <= limit:
        return F.broadcast(df)
    return df


def _bytes(text: str) -> int:
    """A size setting in bytes, such as 10485760b, 10MB or -1."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)(?:i?b)?", text.strip().lower()).groups()
    return int(number) * 1024 ** ("bkmgtp".index(unit) if unit else 0)


def bound(*choices: Sequence | None) -> int | None:
    """Number of combinations of the listed values; unknown if a list is open."""
    rows = 1
    for values in choices:
        if values is None:
            return None
        rows *= len(values)
    return rows


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``, so that a join on them cannot multiply rows.

    The check is part of the plan: a key that repeats fails the job that reads it.
    """
    rest = [c for c in df.columns if c not in keys]
    repeats = F.raise_error(F.concat(F.lit(f"keys {list(keys)} repeat: "), F.to_json(F.struct(*keys))))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in rest])
        .where(F.when(F.col("_rows") > 1, repeats.cast("boolean")).otherwise(True))
        .select(*df.columns)
    )
