"""Exact inner-product top-k by bounds of several resolutions.

Each vector is cut into 1, 4 and 16 segments. From a segment's mean and deviation alone the distance of two vectors is
bounded from below, ``len * ((mean - mean')**2 + (dev - dev')**2)``; with the norms known that is an upper bound of the
inner product, ``len * (mean * mean' + dev * dev')``. Pairs go from coarse to fine; who stays above the k-th best exact
score found so far is scored exactly.

Queries and candidates meet in cells of bounded size (a block of queries and a chunk of candidates), so no task holds
more than one of each; every cell gives its k best for each of its queries and a window ranks those.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate;
vectors of another length than the query's are not its candidates; an empty table gives an empty result; a repeated
vec_id with an equal vector is one query, and candidates with the query's vec_id are left out; ties go to the smaller
vec_id; all-equal vectors tie throughout. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import lean_group, read

LEVELS = (1, 4, 16)
CANDIDATES_A_CELL, QUERIES_A_CELL = 4096, 2048
#: Rows of the query block that are bounded at a time.
QUERIES_AT_ONCE = 128


def scaled(vectors: DataFrame, factor: int = 1024) -> DataFrame:
    """vec_id and the integer vector floor(factor * x), without vectors that can't be scored."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & ~bad)
    return kept.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(factor))).alias("vector")).where(F.col("vec_id").isNotNull())


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner product with another vector's bounds the vectors' inner product from above."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        w, mean = math.sqrt(part.shape[1]), part.mean(axis=1)
        out += [w * mean, np.sqrt(np.maximum((part * part).sum(axis=1) - part.shape[1] * mean * mean, 0))]
    return np.stack(out, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, told: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the places in x of its k best rows with another id, and their scores. x, q: int64. told: gets the number of pairs that each level left."""
    if not len(x) or not len(q):
        return
    dims = x.shape[1]
    if not dims:
        x, q, dims = np.zeros((len(x), 1), np.int64), np.zeros((len(q), 1), np.int64), 1
    wide = float(np.abs(x).max()) * float(np.abs(q).max()) * dims >= 2**52
    xf = x.astype(np.float64)
    of_x = [features(xf, n) for n in LEVELS]
    largest_x = math.sqrt(float((xf * xf).sum(axis=1).max()))
    for at in range(0, len(q), QUERIES_AT_ONCE):
        qs, own = q[at : at + QUERIES_AT_ONCE], query_ids[at : at + QUERIES_AT_ONCE]
        qf = qs.astype(np.float64)
        slack = 1e-9 * (1 + largest_x * np.sqrt((qf * qf).sum(axis=1)))[:, None]
        allowed = ids[None, :] != own[:, None]
        least = np.full((len(qs), 1), -np.inf)
        alive = None
        for level, fx in enumerate(of_x):
            bound = features(qf, LEVELS[level]) @ fx.T + slack
            bound[~allowed if alive is None else ~alive] = -np.inf
            if bound.shape[1] > k:  # the k rows that promise most are scored, and the k-th of their scores is the least that counts
                first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                scores = np.einsum("qd,qkd->qk", qf, xf[first])
                scores[np.take_along_axis(bound, first, 1) == -np.inf] = -np.inf
                least = np.maximum(least, scores.min(axis=1, keepdims=True) - slack)
            alive = bound >= np.maximum(least, np.finfo(float).min)
            if told is not None:
                told[LEVELS[level]] = told.get(LEVELS[level], 0) + int(alive.sum())
        if not wide and alive.mean() > 0.05:
            dense = np.rint(qf @ xf.T).astype(np.int64)
        else:
            dense = None
        for i in range(len(qs)):
            left = np.flatnonzero(alive[i])
            scores = dense[i, left] if dense is not None else (x[left] * qs[i]).sum(axis=1)
            if len(left) > k:
                kth = np.partition(-scores, k - 1)[k - 1]
                keep = -scores <= kth
                left, scores = left[keep], scores[keep]
            order = np.lexsort((ids[left], -scores))[:k]
            yield at + i, left[order], scores[order]


def cell_search(k: int):
    def search(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        is_query = table["_query"].to_numpy()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), np.int64)
        a, b, c = [], [], []
        cand = ids[~is_query]
        query = ids[is_query]
        for i, rows, scores in best(cand, x[~is_query], query, x[is_query], k):
            a.append(np.full(len(rows), query[i]))
            b.append(cand[rows])
            c.append(scores)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.table({"query_id": join(a), "vec_id": join(b), "score": join(c)})

    return search


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; both inputs: vec_id, vector (integers)."""
    rows, asked = candidates.count(), queries.count()
    chunks, blocks = max(1, math.ceil(rows / CANDIDATES_A_CELL)), max(1, math.ceil(asked / QUERIES_A_CELL))
    x = candidates.select("vec_id", "vector", F.lit(False).alias("_query"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("_chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    q = queries.dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", F.lit(True).alias("_query"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block"))
    cells = x.unionByName(q).withColumn("_dims", F.size("vector"))
    found = cells.groupBy("_chunk", "_block", "_dims").applyInArrow(lean_group(cell_search(k)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = scaled(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
