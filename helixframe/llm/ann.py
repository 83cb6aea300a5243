"""Nearest neighbours by inner product, as a block matrix join.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is a tile. In a tile, the product
of vectors quantised to int8 estimates all inner products: sums of EXACT products of codes are integers below 2**24, so
exact in float32, and longer vectors are summed in slices of so many components. With e(v) the quantisation error of v, |q.c - q'.c'| <= |e(q)||c| + |q'||e(c)| bounds each one. Pairs whose upper bound is below the
query's k-th largest lower bound can't be among its nearest. The others are recomputed in double precision, a heap keeps
k of them, and the heaps of all tiles are merged. So the result is exact.

Scores are summed from the first component to the last. Each candidate is sent once for each block of queries, and each
query once for each block of candidates, so blocks are as large as a task's memory allows.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths never meet; ties go to the smaller id; rows that repeat an id are each a
candidate, save for queries with that id, and the query is the smallest of the id's vectors (the shortest first, then by
components); fewer candidates than k: all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

QUERY_BLOCK, BLOCK = 8192, 4096
#: Components whose products of codes, 127 * 127 each at most, sum to less than 2**24.
EXACT = 1040


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), scales, norms of the original and of the errors."""
    scale = np.abs(v).max(1) / 127
    scale[scale == 0] = 1
    code = np.rint(v / scale[:, None]).astype(np.int8)
    return code.astype(np.float32), scale, np.linalg.norm(v, axis=1), np.linalg.norm(v - code * scale[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of codes, exactly."""
    out = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], EXACT):
        out += a[:, j : j + EXACT] @ b[:, j : j + EXACT].T
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(np.float64).reshape(len(column), -1)


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's ``k`` nearest in one tile."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    qc, qs, qn, qe = _quantised(q)
    cc, cs, cn, ce = _quantised(c)
    out = []
    q_len = np.linalg.norm(qc * qs[:, None], axis=1)
    for lo in range(0, len(q), 256):
        hi = min(lo + 256, len(q))
        about = _products(qc[lo:hi], cc) * qs[lo:hi, None] * cs
        bound = (qe[lo:hi, None] * cn + q_len[lo:hi, None] * ce) * (1 + 1e-9) + 1e-12 * qn[lo:hi, None] * cn
        same = q_ids[lo:hi, None] == c_ids
        lower = np.where(same, -np.inf, about - bound)
        n = min(k, len(c))
        floor = np.partition(lower, len(c) - n, axis=1)[:, len(c) - n]
        live = (about + bound >= floor[:, None]) & ~same
        for i in range(hi - lo):
            at = np.flatnonzero(live[i])
            score = np.cumsum(c[at] * q[lo + i], 1)[:, -1]
            best = heapq.nsmallest(k, zip(-score, c_ids[at]))
            out += [(int(q_ids[lo + i]), int(x), -float(s)) for s, x in best]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest of each row whose id ``every`` divides."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast(kind).alias("v")).filter("id is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(fine).withColumn("dim", F.size("v"))
    sizes = v.groupBy("dim").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("id") % every == 0).alias("q"))
    blocks = [F.ceil(F.col("c") / BLOCK).cast("long").alias("cbs"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERY_BLOCK)).cast("long").alias("qbs")]
    sizes = sizes.select("dim", *blocks)
    v = v.join(stash(sizes, "sizes"), "dim")
    h = F.xxhash64("id")
    one = v.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v", "qbs", "cbs")).alias("x")).select("id", "x.*")
    blocks = F.explode(F.expr("sequence(0L, cbs - 1)")).alias("cb")
    query = one.select(F.col("dim").alias("qdim"), F.pmod(h, "qbs").alias("qb"), blocks, F.col("id").alias("qid"), F.col("v").alias("qv"))
    blocks = F.explode(F.expr("sequence(0L, qbs - 1)")).alias("qb")
    other = v.select("dim", blocks, F.pmod(F.xxhash64("id", "v"), "cbs").alias("cb"), "id", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = tile(a["qid"].to_numpy(), _matrix(a["qv"]), b["id"].to_numpy(), _matrix(b["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    tiles = query.groupBy("qdim", "qb", "cb").cogroup(other.groupBy("dim", "qb", "cb"))
    found = tiles.applyInPandas(run, "query_id long, vec_id long, score double")
    # the heaps' merge: Spark limits each task's share of a query to k rows before the shuffle, too
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, arg_min(v, (len(v), v)) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
