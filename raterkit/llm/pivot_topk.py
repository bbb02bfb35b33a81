"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers floor(256 x). For each one, its distances to a fixed number of pivots
(data vectors) are computed once. With the triangle inequality they give, for a query and a
candidate, a lower bound of their distance (the largest over the pivots) and from it an upper
bound of their inner product. Queries meet candidates block by block through an equal block
key; within a block a query's candidates are evaluated in the order of their bounds and the
search stops exactly, when no bound reaches the k-th score any more. That score starts from the
pivots themselves, so all blocks share a threshold. The k best of each block are merged.

Vectors that are null or hold null or non-finite components take no part. Every other row is a
candidate, and a query if its id says so, of its own, also where ids are repeated or null (2**63 - 1
stands for null). Shorter vectors count as padded with zeros. Ties go to the smaller id, null last;
with fewer candidates than k, all are returned. Scores are exact below 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from raterkit.llm.tables import table
from raterkit.llm.vectors import lists, matrix
from raterkit.session import cut_lineage

PIVOTS = 32
BLOCK = 4096
QUERY_BLOCK = 512
CHUNK = 128
NO_ID = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``row`` (a number), ``vec_id`` (null: ``NO_ID``), ``is_query``, ``q`` (integer components) of the
    rows ``vec_id, embedding, is_query`` that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    able = vectors.where(F.col("embedding").isNotNull() & finite)
    own = F.coalesce(F.col("is_query"), F.lit(False)).alias("is_query")
    return able.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), own, q.alias("q"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def search_block(q_rows, q, q_table, rows, ids, x, x_table, floor_scores, k):
    """The best k candidates of one block for each query: (query row, candidate id, score) arrays,
    and how many candidates were evaluated."""
    q_norm, x_norm = (q * q).sum(1), (x * x).sum(1)
    out, evaluated = [], 0
    for i in range(len(q_rows)):
        low = np.abs(x_table - q_table[i]).max(axis=1) if x_table.shape[1] else np.zeros(len(ids))
        low = np.maximum(low - 1e-9 * (1.0 + low + math.sqrt(q_norm[i])), 0.0)
        bound = (q_norm[i] + x_norm - low * low) / 2.0
        bound += 1e-9 * (1.0 + np.abs(bound) + x_norm)
        able = np.flatnonzero((bound >= floor_scores[i]) & (rows != q_rows[i]))
        able = able[np.argsort(-bound[able], kind="stable")]
        best_s, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        at = 0
        while at < len(able):
            if len(best_s) == k and bound[able[at]] < best_s[-1]:
                break
            part = able[at : at + CHUNK]
            s = np.concatenate((best_s, x[part] @ q[i]))
            c = np.concatenate((best_i, ids[part]))
            order = np.lexsort((c, -s))[:k]
            best_s, best_i = s[order], c[order]
            at += CHUNK
        evaluated += min(at, len(able))
        out.append((np.full(len(best_i), q_rows[i]), best_i, best_s))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3, evaluated


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` its k best others."""
    base = cut_lineage(quantised(vectors.select("vec_id", "embedding", is_query.alias("is_query"))), "vectors")
    n, n_queries, dims = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("q"))).head()
    dims = dims or 0
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).toArrow()
    pivot_rows, pivot = chosen.column("row").to_numpy(), matrix(chosen.column("q"), dims)

    def with_distances(batches):
        for b in batches:
            d = _distances(matrix(b.column("q"), dims), pivot)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(d)], names=[*b.schema.names, "d"])

    held = base.mapInArrow(with_distances, "row long, vec_id long, is_query boolean, q array<bigint>, d array<double>")
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n_queries / query_block))
    cell = lambda count: F.pmod(F.xxhash64("row", F.lit(7)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = held.drop("is_query").select("*", cell(blocks).alias("b")).select("*", every(query_blocks).alias("qb"))
    # columns of its own: both sides come from one table
    own = [F.col(c).alias(f"query_{c}") for c in ("row", "vec_id", "q", "d")]
    queries = held.where("is_query").select(*own, cell(query_blocks).alias("qb")).select("*", every(blocks).alias("b"))

    result = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # an empty side has no columns
            return result.empty_table()
        q, x = matrix(right.column("query_q"), dims), matrix(left.column("q"), dims)
        q_rows, q_ids = right.column("query_row").to_numpy(), right.column("query_vec_id").to_numpy()
        rows, ids = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
        scores = np.where(q_rows[:, None] == pivot_rows[None, :], -np.inf, q @ pivot.T)
        floors = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q_rows), -np.inf)
        (a, b, s), _ = search_block(
            q_rows, q, matrix(right.column("query_d"), pivot.shape[0]), rows, ids, x, matrix(left.column("d"), pivot.shape[0]), floors, k
        )
        order = np.argsort(q_rows)
        of = q_ids[order[np.searchsorted(q_rows, a, sorter=order)]] if len(a) else np.zeros(0)
        return pa.table([pa.array(c.astype(np.int64)) for c in (a, of, b, s)], schema=result)

    found = candidates.groupBy("b", "qb").cogroup(queries.groupBy("b", "qb")).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
