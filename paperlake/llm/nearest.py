"""Exact nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks by a hash of their id and each pair of blocks
is one tile task.  Inside a tile, int8 products give every inner product within a proven
quantisation error; only pairs whose upper bound reaches the query's running k-th best are
recomputed in double precision and pushed onto that query's heap.  The tiles' heaps are
merged at the end, k rows per query and tile.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite
component take no part; a query is compared with vectors of its own dimension only; rows
sharing the query's id are its own, and a query id with several vectors uses the least of
them; ties go to the smaller id; fewer candidates than k give fewer rows; repeated candidate
rows count once per row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a query block and of a candidate block: the memory bound of one tile task.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
_SUB_Q, _SUB_C = 256, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>, dim) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(fine).withColumn("dim", F.size("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as exact float32), scales, norms of the decoded vectors, error norms."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    scale = np.maximum(scale, np.finfo(np.float64).tiny)
    code = np.rint(x / scale[:, None])
    err = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))
    return code.astype(np.int8).astype(np.float32), scale, np.sqrt(((code * scale[:, None]) ** 2).sum(axis=1)), err


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double, summed in component order."""
    acc = np.zeros(len(q))
    for d in range(q.shape[1]):
        acc += q[:, d] * x[:, d]
    return acc


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Each query's k best of the tile as (-score, id), found through the int8 bounds."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    q8, qs, qn, qe = quantise(q)
    c8, cs, _, ce = quantise(c)
    cn = np.sqrt((c**2).sum(axis=1))
    exact_in_float32 = q.shape[1] * 127 * 127 < 1 << 24
    for a in range(0, len(q), _SUB_Q):
        b = slice(a, a + _SUB_Q)
        heaps: list[list[tuple[float, int]]] = [[] for _ in qid[b]]
        floor = np.full(len(heaps), -np.inf)
        for s in range(0, len(c), _SUB_C):
            t = slice(s, s + _SUB_C)
            dots = q8[b] @ c8[t].T if exact_in_float32 else q8[b].astype(np.float64) @ c8[t].T.astype(np.float64)
            near = dots * qs[b][:, None] * cs[t][None, :]
            bound = qn[b][:, None] * ce[t][None, :] + qe[b][:, None] * cn[t][None, :]
            bound += 1e-9 * (np.abs(near) + bound) + 1e-300
            own = qid[b][:, None] == cid[t][None, :]
            low = np.where(own, -np.inf, near - bound)
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            qi, ci = np.nonzero((near + bound >= floor[:, None]) & ~own)
            score = exact(q[b][qi], c[t][ci])
            starts = np.searchsorted(qi, np.arange(len(heaps) + 1))
            for i in range(len(heaps)):
                lo, hi = starts[i], starts[i + 1]
                if lo == hi:
                    continue
                pool = zip((-score[lo:hi]).tolist(), cid[t][ci[lo:hi]].tolist(), strict=True)
                heaps[i] = heapq.nsmallest(k, [*heaps[i], *pool])
                if len(heaps[i]) == k:
                    floor[i] = max(floor[i], -heaps[i][-1][0])
        yield from zip(qid[b].tolist(), heaps, strict=True)


def _block(n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by inner product.

    The number of blocks follows the row counts, so a tile's memory does not grow; a
    candidate is sent once per query block, which is the cost of the block join.
    """
    rows = usable(vectors, id_col, vec_col)
    queries = usable(vectors.filter(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_q, n_c = queries.count(), rows.count()
    qbs, cbs = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_c / candidate_block))
    left = queries.withColumn("qb", _block(qbs, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cbs - 1))))
    right = rows.withColumn("cb", _block(cbs, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qbs - 1))))

    def run(key: tuple, ql: pd.DataFrame, cl: pd.DataFrame) -> pd.DataFrame:
        if not len(ql) or not len(cl):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, c = (np.array(x["v"].tolist(), np.float64) for x in (ql, cl))
        found = [(i, j, -s) for i, best in tile(ql["id"].to_numpy(), q, cl["id"].to_numpy(), c, k) for s, j in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_query(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return search(embeddings, F.col("vec_id") % 20 == 0).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
