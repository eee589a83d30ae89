"""Exact top-k inner products by an impact-ordered index that is read score at a time.

A dimension is two terms: how far a component is above the shard's least, for queries with a positive weight, and how far
below its greatest, for those with a negative one. So all impacts and weights are at least 0. Impacts are quantised, and a
posting segment is the vectors of one impact of one term. A block of queries takes segments by descending impact, some
levels at a time, into accumulators for a whole shard, and stops once what is unread cannot lift a vector that is not yet
a possible member into any query's best k. Possible members are then scored again in integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import written

#: Vectors in a shard and queries in a block (on average), blocks that go to a shard together, impacts, and the share
#: of all postings that has been read when the stop is tested.
SHARD, QUERIES, WAVE, LEVELS = 6000, 200, 32, 256
TESTS = (0.5, 0.75, 0.88, 0.95, 1.0)
INDEX = "shard long, dims int, step double, ids binary, ints binary, posting_order binary, up_ends binary, down_ends binary"


def padded(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:dims]
    return out


def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The index of one shard. Vectors of different lengths are filled up with zeros.

    posting_order has each dimension's vectors by descending component: read forwards it has the segments of the upper
    term, backwards those of the lower one; *_ends has where the segments of each impact end."""
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    dims = max((len(v) for v in pdf["v"]), default=0)
    x = padded(list(pdf["v"]), dims)
    low, high = x.min(0, initial=0), x.max(0, initial=0)
    step = max(1, int((high - low).max(initial=0)) // LEVELS + 1)
    order = np.argsort(-x, axis=0, kind="stable").astype(np.int32)
    ends = []
    for impact in (x - low, high - x):
        level = -(-impact // step)
        ends.append(np.stack([(level >= k).sum(0) for k in range(LEVELS + 1)], 1).astype(np.int32))
    return pd.DataFrame({"shard": [key[0]], "dims": [dims], "step": [float(step)], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "ints": [x.tobytes()], "posting_order": [order.T.tobytes()], "up_ends": [ends[0].tobytes()], "down_ends": [ends[1].tobytes()]})


def pack_queries(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    dims = max((len(v) for v in pdf["v"]), default=0)
    return pd.DataFrame({"block": [key[0]], "query_dims": [dims], "query_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "query_ints": [padded(list(pdf["v"]), dims).tobytes()]})


class Shard:
    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, np.int64)
        n, d = len(self.ids), row.dims
        self.n, self.dims, self.step = n, d, int(row.step)
        self.x = np.frombuffer(row.ints, np.int64).reshape(n, d)
        order = np.frombuffer(row.posting_order, np.int32).reshape(d, n)
        self.order = np.concatenate([order, order[:, ::-1]])
        self.ends = np.concatenate([np.frombuffer(e, np.int32).reshape(d, LEVELS + 1) for e in (row.up_ends, row.down_ends)])
        self.low, self.high = self.x.min(0, initial=0), self.x.max(0, initial=0)
        # from which impact down the tests are due
        read = self.ends.sum(0) / max(1, 2 * d * n)
        self.stops = sorted({int(np.flatnonzero(read >= min(t, read[0]))[-1]) for t in TESTS} | {0}, reverse=True)

    def segments(self, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of impacts top > i >= bottom: quantised impacts, and 1 where there is one; terms by vectors."""
        value, there = np.zeros((2 * self.dims, self.n)), np.zeros((2 * self.dims, self.n))
        for t in range(2 * self.dims):
            a = self.ends[t, top] if top <= LEVELS else 0
            ends = self.ends[t, bottom : min(top, LEVELS + 1)][::-1]  # of the highest impact first
            at = self.order[t, a : ends[-1]]
            value[t, at] = np.repeat(np.arange(min(top, LEVELS + 1) - 1, bottom - 1, -1), np.diff(np.concatenate(([a], ends)))) * self.step
            there[t, at] = 1.0
        return value, there

    def exact(self, q: np.ndarray, which: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Integer scores of pairs of a query and a vector."""
        out = np.empty(len(which), np.int64)
        for a in range(0, len(which), 100_000):
            s = slice(a, a + 100_000)
            out[s] = (q[which[s]] * self.x[vector[s]]).sum(1)
        return out

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, row of the vector and score of each query's k best here (ties to the smaller id)."""
        d = max(self.dims, q.shape[1])
        q = np.pad(q, ((0, 0), (0, d - q.shape[1])))[:, : self.dims]
        w = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], 1).astype(np.float64)
        base = (np.maximum(q, 0) @ self.low + np.minimum(q, 0) @ self.high).astype(np.float64)[:, None]
        total = w.sum(1, keepdims=True)
        acc, seen = np.zeros((len(q), self.n)), np.zeros((len(q), self.n))
        own = query_ids[:, None] == self.ids[None, :]
        least = np.full((len(q), 1), -np.inf)  # of the k-th best score
        top, may = LEVELS + 1, ~own
        for number, bottom in enumerate(self.stops):
            value, there = self.segments(top, bottom)
            acc += w @ value
            seen += w @ there
            top = bottom
            if number == 0 and self.n > 4 * k:  # score some likely members, for a first bound
                likely = np.argpartition(np.where(own, -np.inf, acc), self.n - 3 * k, 1)[:, -3 * k :]
                s = self.exact(q, np.repeat(np.arange(len(q)), 3 * k), likely.ravel()).reshape(likely.shape).astype(np.float64)
                s[np.take_along_axis(own, likely, 1)] = -np.inf
                least = np.sort(s, 1)[:, -k][:, None]
            most = base + acc + (total - seen) * (max(0, bottom - 1) * self.step)
            may = (most >= least) & ~own
            if may.sum() <= 8 * k * len(q) or bottom == 0:
                break
        which, vector = np.nonzero(may)
        score = self.exact(q, which, vector)
        order = np.lexsort((self.ids[vector], -score, which))
        which, vector, score = which[order], vector[order], score[order]
        begin = np.searchsorted(which, which)
        best = np.arange(len(which)) - begin < k
        return which[best], vector[best], score[best]


def searcher(k: int):
    def search(index: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index):
            shard = Shard(index.iloc[0])
            for b in blocks.itertuples():
                ids = np.frombuffer(b.query_ids, np.int64)
                which, vector, score = shard.search(ids, np.frombuffer(b.query_ints, np.int64).reshape(len(ids), b.query_dims), k)
                out.append(pd.DataFrame({"query_id": ids[which], "vec_id": shard.ids[vector], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return search


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of each component; rows that are null or hold a null or non-finite component are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the k highest inner products with other vec_ids.

    vectors: vec_id, embedding; others ignored. Null ids and vectors that are null or hold a null or non-finite component
    take no part. Equal rows count once; of different vectors with one id each is a candidate for other ids, and the
    smallest asks. Of vectors of different lengths the shorter is filled up with zeros. Scores are exact while they and
    their sums fit a long. Ties go to the smaller vec_id. An empty table gives an empty result."""
    rows = written(integer_vectors(vectors).distinct(), "vectors")
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    index = written(rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")).applyInPandas(build, INDEX), "index")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    number = max(1, -(-queries.count() // QUERIES))
    blocks = queries.groupBy(F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(number)).alias("block"))
    blocks = written(blocks.applyInPandas(pack_queries, "block long, query_dims int, query_ids binary, query_ints binary"), "queries")
    # a query block meets every shard, a shard every wave of blocks: the pairs of the stated query set, by block
    waves = -(-number // WAVE)
    left = index.withColumn("wave", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(waves - 1).cast("long"))))
    right = blocks.withColumn("wave", F.floor(F.col("block") / WAVE)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = left.groupBy("shard", "wave").cogroup(right.groupBy("shard", "wave")).applyInPandas(searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
