"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  It is posted in the
inverted files of its POST nearest pivots; a query opens the files of its PROBE nearest
ones.  There the postings are ranked by the footrule distance between the two pivot
orders, the nearest share of them (with all ties) is reranked by exact cosine, and the
best of all files are merged.  Files are cut into blocks of bounded size and compared
with blocks of queries, so a pivot that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TOP = 5
#: Pivots are chosen from at most so many distinct vectors.
PIVOT_SAMPLE = 4096
PIVOTS = 64
PREFIX = 20
POST = 8
PROBE = 20
#: Share of a block's candidates that is reranked, by footrule, ties included.
RERANK = 0.7
BLOCK = 4096
QUERY_BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) and dim of the rows that take part.

    Out are missing ids and vectors, empty and zero vectors, and those with a missing
    or non-finite component.
    """
    x = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(
            F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        )
        .where(F.exists("vector", lambda v: v != 0))
        .withColumn("dim", F.size("vector"))
    )


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit pivots per dimension: a few rounds of spherical k-means on a bounded sample.

    The sample has one vector per residue of the vectors' hash, so copies count once.
    """
    key = F.xxhash64("vector")
    sample = (
        vectors.groupBy(F.pmod(key, F.lit(PIVOT_SAMPLE)).alias("slot"))
        .agg(F.min_by("vector", key).alias("vector"))
        .collect()
    )
    found: dict[int, list] = {}
    for row in sorted(sample, key=lambda r: r.slot):
        found.setdefault(len(row.vector), []).append(row.vector)
    chosen = {}
    for dim, rows in found.items():
        x = _unit(np.array(rows))
        rng = np.random.default_rng(7)
        centres = x[rng.permutation(len(x))[:pivots]]
        for _ in range(5):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            full = np.sqrt((sums * sums).sum(axis=1)) > 1e-9
            centres = np.where(full[:, None], _unit(np.where(full[:, None], sums, 1.0)), centres)
        chosen[dim] = centres
    return chosen


def with_order(vectors: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """Add ``pivots``: the numbers of the ``prefix`` nearest pivots, nearest first."""

    @F.pandas_udf("array<int>")
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.empty(len(batch), object)
            sizes = batch.map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                centres = pivots.get(int(dim))
                if centres is None:
                    centres = np.zeros((1, int(dim)))
                far = -(_unit(np.stack(batch.iloc[at].to_list())) @ centres.T)
                near = np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                for k, row in zip(at, near):
                    out[k] = row
            yield pd.Series(out)

    return vectors.withColumn("pivots", order("vector"))


def _ranks(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Position of each pivot in each order; those left out share the place after the last."""
    out = np.full((len(orders), pivots), orders.shape[1], np.int16)
    np.put_along_axis(out, orders, np.arange(orders.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def _search_block(postings: pd.DataFrame, queries: pd.DataFrame, pivot: int, top: int) -> pd.DataFrame:
    """Best postings of a block for each query of a block, both of one pivot's file."""
    order_v, order_q = np.stack(postings["pivots"].to_list()), np.stack(queries["pivots"].to_list())
    many = int(max(order_v.max(), order_q.max())) + 1
    rank_v, rank_q = _ranks(order_v, many), _ranks(order_q, many)
    post, probe = min(POST, order_v.shape[1]), min(PROBE, order_q.shape[1])
    vector_v = np.stack(postings["vector"].to_list())
    ids_v = postings["vec_id"].to_numpy()
    unit_v = _unit(vector_v)
    unit_q = _unit(np.stack(queries["vector"].to_list()))
    ids_q = queries["vec_id"].to_numpy()
    out = []
    for k in range(len(queries)):
        # A pair that meets in several files counts in that of the query's nearest pivot.
        earlier = order_q[k][: min(rank_q[k, pivot], probe)]
        mine = np.flatnonzero(~(rank_v[:, earlier] < post).any(axis=1) & (ids_v != ids_q[k]))
        if not len(mine):
            continue
        foot = np.abs(rank_v[mine] - rank_q[k]).sum(axis=1)
        keep = max(top, int(np.ceil(RERANK * len(mine))))
        if keep < len(mine):
            mine = mine[foot <= np.partition(foot, keep - 1)[keep - 1]]
        score = (unit_v[mine] * unit_q[k]).sum(axis=1)
        if len(mine) > top:
            high = np.flatnonzero(score >= np.partition(score, -top)[-top])
            mine, score = mine[high], score[high]
        best = np.lexsort((ids_v[mine], -score))[:top]
        out.append((np.full(len(best), ids_q[k]), ids_v[mine[best]], score[best]))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
    q, v, s = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest vectors found for each query.

    ``queries`` and ``vectors`` have vec_id and embedding; a query is not compared with
    its own id.  Score is the cosine in double precision; ties go to the smaller vec_id.
    Vectors that :func:`usable` leaves out take no part; vectors are only compared with
    those of their length; a vec_id that comes twice counts once, with its best score;
    extra columns are ignored; without vectors there are no rows.
    """
    vectors, queries = usable(vectors), usable(queries)
    pivots = choose_pivots(vectors)
    by = ["dim", "pivot"]

    def posted(df: DataFrame, count: int) -> DataFrame:
        first = F.slice("pivots", 1, count)
        return with_order(df, pivots, PREFIX).withColumn("pivot", F.explode(first))

    postings, asked = checkpointed(posted(vectors, POST)), checkpointed(posted(queries, PROBE))

    def blocks(df: DataFrame, size: int, out: str) -> DataFrame:
        # One row per file; a file is a pivot of the bounded set.
        return df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(out))

    files = blocks(postings, BLOCK, "_v").join(blocks(asked, QUERY_BLOCK, "_q"), by)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.col(f"_{own}")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1))
        return (
            df.join(F.broadcast(files), by)
            .withColumn(f"part{own}", part)
            .withColumn(f"part{other}", others)
            .select(*by, "partv", "partq", "vec_id", "vector", "pivots")
        )

    keys = [*by, "partv", "partq"]

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return _search_block(left, right, int(key[1]), top)

    found = (
        dealt(postings, "v", "q")
        .groupBy(*keys)
        .cogroup(dealt(asked, "q", "v").groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
