"""Nearest neighbours by a permutation index.

Pivots are spread over a sample of the table (at most `sample` rows by a hash of the id, each next pivot the farthest
from those before it). A vector is represented by the order of its `prefix` nearest pivots and
posted, with its position, in the inverted file of each of them. A query reads the files of its own nearest pivots
and adds up, per posted vector, what the two orders have in common: prefix minus the difference of positions. That ranks all
vectors of a block by the footrule distance of the prefixes (a missing pivot counts as position `prefix`). The best
`share` of the distinct vectors of each block, `least` at least, are reranked by the exact distance on the vectors, and as
many more as long as these bring a neighbour: in a dense cluster the orders differ too little to rank its members.

The index is dealt into blocks by a hash of the id, the queries into blocks of `query_block`; every pair of blocks is a task of
bounded size, however skewed the vectors are, and returns its best k rows per query, which are merged by query. Equal vectors of a block
are indexed once and stand for their k + 1 smallest ids, so copies do not crowd out other neighbours.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
most of the table. Equal distances are ranked by the smaller id. A repeated id counts once. With fewer candidates
than k all of them are returned. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS, PREFIX = 128, 64


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its nearest pivots, nearest first."""
    d = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


def spread_pivots(x: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first traversal from the first vector; fewer where vectors repeat."""
    chosen, far = [0] if len(x) else [], ((x - x[:1]) ** 2).sum(axis=1)
    while chosen and len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class InvertedFiles:
    """By pivot: the vectors that have it in their prefix, and its position there."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        n, self.prefix = order.shape
        at = np.argsort(order.ravel(), kind="stable")
        cuts = np.searchsorted(order.ravel()[at], np.arange(n_pivots + 1))
        self.size = n
        self.files = [(at[a:b] // self.prefix, (at[a:b] % self.prefix).astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])]

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """The footrule distance of a query's prefix to every vector's, but for a constant of the query."""
        common = np.zeros(self.size, np.int32)
        for position, pivot in enumerate(query):
            rows, positions = self.files[pivot]
            # both have it: |p - q| instead of (prefix - p) + (prefix - q)
            common[rows] += np.abs(positions - position) - (self.prefix - positions) - (self.prefix - position)
        return common


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, prefix: int, share: float, least: int) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    once = np.r_[True, ids[1:] != ids[:-1]]
    ids, x = ids[once], x[once]
    distinct, group = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    distinct = distinct.view(x.dtype).reshape(len(distinct), -1)
    members = np.argsort(group, kind="stable")  # ids of a group in order
    starts = np.searchsorted(group[members], np.arange(len(distinct) + 1))
    prefix = min(prefix, len(pivots))
    files = InvertedFiles(orders(distinct, pivots, prefix), len(pivots))
    many = min(len(distinct), max(least, int(share * len(distinct))))
    out = []
    for q_id, vector, own in zip(q_ids, q, orders(q, pivots, prefix)):
        far = files.footrule(own)
        ranked, done, cut = np.argsort(far, kind="stable"), 0, np.inf
        best, distance = np.empty(0, np.int64), np.empty(0)
        while done < len(ranked):  # another round as long as the last one brought a neighbour
            batch = ranked[done : done + many]
            new = np.sqrt(((distinct[batch] - vector) ** 2).sum(axis=1))
            best, distance = np.append(best, batch), np.append(distance, new)
            if done and new.min() > cut:
                break
            done += many
            cut = np.partition(distance, min(k, len(distance) - 1))[min(k, len(distance) - 1)]
        near = np.argsort(distance, kind="stable")  # at least k + 1 distinct vectors, and all that tie with the last
        rows = []
        near = near[distance[near] <= cut * (1 + 1e-12)]
        exact = np.sqrt(np.cumsum((distinct[best[near]] - vector) ** 2, axis=1)[:, -1])  # added one by one: the same on every machine
        for j, score in zip(near, exact):
            g = best[j]
            rows += [(score, i) for i in ids[members[starts[g] : min(starts[g + 1], starts[g] + k + 1)]] if i != q_id]
        out += [(q_id, i, d) for d, i in sorted(rows)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = 0.1, least: int = 512, block: int = 8192, query_block: int = 16_384, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of (vec_id, embedding) by Euclidean distance for the rows where `queries` holds."""
    clean = vectors.where("vec_id IS NOT NULL").where(valid(F.col("embedding"))).select("vec_id", "embedding")
    sizes = clean.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).orderBy(F.desc("n"), "width").first()
    width, n, n_queries = (sizes["width"], sizes["n"], sizes["q"]) if sizes else (0, 0, 0)
    clean = clean.where(F.size("embedding") == width)
    drawn = clean.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).collect()
    centres = spread_pivots(np.array([r["embedding"] for r in drawn], float).reshape(len(drawn), width), pivots)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    deal = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(many)).cast("int")
    index = clean.withColumn("i", deal(blocks, 1)).withColumn("j", spread(query_blocks)).groupBy("i", "j")
    asked = clean.where(queries).dropDuplicates(["vec_id"]).withColumn("j", deal(query_blocks, 2)).withColumn("i", spread(blocks)).groupBy("i", "j")

    def search(vecs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if vecs.empty or qs.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(vecs["vec_id"].to_numpy(), np.stack(vecs["embedding"]).astype(float), qs["vec_id"].to_numpy(), np.stack(qs["embedding"]).astype(float), centres, k, prefix, share, least)

    found = index.cogroup(asked).applyInPandas(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
