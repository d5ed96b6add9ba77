"""Operator 5: exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and each segment has its own hash table. If every code within radius r of each
query segment has been looked at, no code left out is nearer than segments * (r + 1). A query therefore raises r until
its kth verified distance is at most segments * (r + 1) - 1, and is then finished, whatever the data.

Rows are dealt to shards by a hash of the id; query blocks meet every shard, each pair gives at most k rows a query,
and the best k of all shards follow by an aggregation.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Codes in one shard's tables and queries in one block: about 10 MB and 1 MB.
SHARD_ROWS, BLOCK_ROWS = 250_000, 50_000


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit j is set where component j of the first 64 is above 0. Null ids and vectors have no code."""
    bits = F.transform(F.slice(vector, F.lit(1), F.lit(BITS)), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.expr("0L"), lambda a, x: a.bitwiseOR(x))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), code.alias("code"))


_MASKS = [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], np.int64) for r in range(WIDTH + 1)]


class MultiIndex:
    """Segment tables over codes; rows of one segment value are order[s][starts[s][v]:starts[s][v + 1]]."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[by], codes[by]
        self.order, self.starts = [], []
        for s in range(SEGMENTS):
            value = self._segment(self.codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(value, minlength=1 << WIDTH))])

    @staticmethod
    def _segment(code, s: int):
        return (code >> np.uint64(s * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, code: np.uint64, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances, final radius) of the k nearest codes, nearest first, smallest id first among equals."""
        seen = np.zeros(len(self.ids), bool)
        if skip is not None:
            seen[np.searchsorted(self.ids, skip) : np.searchsorted(self.ids, skip, "right")] = True
        at, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = [int(self._segment(code, s)) for s in range(SEGMENTS)]
        for radius in range(WIDTH + 1):
            new = []
            for s in range(SEGMENTS):
                values = _MASKS[radius] ^ own[s]
                first, last = self.starts[s][values], self.starts[s][values + 1]
                size = last - first
                full = size > 0
                first, size = first[full], size[full]
                if len(size):
                    jump = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
                    rows = self.order[s][jump]
                    rows = rows[~seen[rows]]
                    seen[rows] = True
                    new.append(rows)
            rows = np.concatenate(new) if new else at[:0]
            at, far = np.r_[at, rows], np.r_[far, np.bitwise_count(self.codes[rows] ^ code).astype(np.int64)]
            best = np.lexsort((at, far))[:k]  # rows are in id order
            at, far = at[best], far[best]
            if len(at) == k and far[-1] <= SEGMENTS * (radius + 1) - 1:
                break
        return self.ids[at], far, radius


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest codes(id, code) of each of queries(id, code) by Hamming distance.

    A row with the query's own id is no neighbour of it. Ties go to the smaller id; a repeated id counts once per
    distinct code for neighbours, and once as a query (its smallest code). Fewer than k rows come back only if there
    are no more.
    """
    codes = written(codes.distinct(), "codes")
    queries = written(queries.groupBy("id").agg(F.min("code").alias("code")), "queries")
    shards = max(8, ceil(codes.count() / shard_rows))
    blocks = max(1, ceil(queries.count() / block_rows))
    n, m = F.lit(shards).cast("long"), F.lit(blocks).cast("long")
    left = codes.select(F.pmod(F.xxhash64("id"), n).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("block"), "id", "code")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), m).alias("block"), "id", "code")

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(asked):
            index = MultiIndex(base["id"].to_numpy(), base["code"].to_numpy().view(np.uint64))
            for q, c in zip(asked["id"].to_numpy(), asked["code"].to_numpy().view(np.uint64), strict=True):
                ids, far, _ = index.search(c, k, q)
                out.append(pd.DataFrame({"query_id": q, "neighbor_id": ids, "distance": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []}, dtype="int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, neighbor_id long, distance long")
    # At most k rows of each shard meet per query.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("hit.neighbor_id").alias("neighbor_id"), F.col("hit.distance").alias("distance"))


def op5_hamming_topk(spark, sf_dir: str) -> DataFrame:
    """Queries: every embedding whose id is divisible by 50; against all embeddings; k = 10."""
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(codes, codes.where("id % 50 = 0"), 10)


SQL = """
WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT DISTINCT id, list_aggregate(list_transform(range(1, least(len(v), 64) + 1), lambda i: CASE WHEN v[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), 'bit_or') AS code FROM e),
p AS (SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c q JOIN c ON q.id <> c.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
