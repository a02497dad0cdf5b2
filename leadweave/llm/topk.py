"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are cut into blocks; each task holds one block of candidates and one block of queries.
Inside a block every dimension has its candidates sorted by component. All queries of the block
read these lists together: in round r they are read to depth d_r from both ends, whatever comes up
for the first time is scored exactly for all queries that are still open, and a query stops as soon
as the threshold, the best score that an unseen candidate could have, is below its k-th result so
far. (On a tie the query goes on, because an unseen candidate with a smaller id could take the place.)
The best of all blocks are merged per query; each query has at most k rows from each block.

Components become integers, floor(scale * x), so scores are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import stage

FIRST_DEPTH = 16


def quantized(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``_id, _query, _vec``: vectors of integers. Vectors that are null or empty, hold a null or a non-finite component, or have no id are left out."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(F.exists(vector_col, bad), F.lit(False))
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(is_query, F.lit(False)).alias("_query"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("_vec"))


class Block:
    """Candidates of one block and their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable").T  # for each dimension, ascending

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, candidate id, score) of up to ``k`` best candidates for each query, ties to the smaller id."""
        count = len(self.ids)
        seen, depth, before = np.zeros(count, bool), FIRST_DEPTH, 0
        open_ = np.arange(len(queries))
        # Integer vectors keep integer scores; the least integer then stands for "nothing yet".
        whole = self.vectors.dtype.kind == "i"
        self.nothing = np.iinfo(np.int64).min if whole else -np.inf
        kept_scores, kept_at = np.full((len(queries), k), self.nothing, np.int64 if whole else np.float64), np.full((len(queries), k), -1, np.int64)
        while len(open_):
            depth = min(depth, count)
            touched = np.unique(np.concatenate([self.lists[:, before:depth].ravel(), self.lists[:, count - depth : count - before].ravel()]))
            new = touched[~seen[touched]]
            seen[new] = True
            if len(new):
                self._merge(query_ids, queries, open_, new, k, kept_scores, kept_at)
            if depth >= count or seen.all():
                break
            # The best an unseen candidate could still have in each dimension: the next value down, or up for negative weights.
            high = self.vectors[self.lists[:, count - depth], np.arange(self.vectors.shape[1])]
            low = self.vectors[self.lists[:, depth - 1], np.arange(self.vectors.shape[1])]
            bound = np.maximum(queries[open_], 0) @ high + np.minimum(queries[open_], 0) @ low
            open_ = open_[bound >= kept_scores[open_, k - 1]]
            before, depth = depth, depth * 4
        row, column = np.nonzero(kept_at >= 0)
        return row, self.ids[kept_at[row, column]], kept_scores[row, column]

    def _merge(self, query_ids: np.ndarray, queries: np.ndarray, open_: np.ndarray, new: np.ndarray, k: int, kept_scores: np.ndarray, kept_at: np.ndarray) -> None:
        for begin in range(0, len(open_), 512):
            part = open_[begin : begin + 512]
            found = (queries[part] @ self.vectors[new].T).astype(kept_scores.dtype)
            found[self.ids[new][None, :] == query_ids[part][:, None]] = self.nothing
            both = np.concatenate([kept_scores[part], found], axis=1)
            at = np.concatenate([kept_at[part], np.broadcast_to(new, found.shape)], axis=1)
            if both.shape[1] > 4 * k:
                # All that reach the k-th largest value, so that ties are decided by id and not by place.
                least = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
                keep = both >= least[:, None]
                width = int(keep.sum(axis=1).max())
                order = np.argsort(~keep, axis=1, kind="stable")[:, :width] if width < both.shape[1] // 2 else np.broadcast_to(np.arange(both.shape[1]), both.shape)
                both, at = np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)
            id_ = np.where(at >= 0, self.ids[at], np.iinfo(np.int64).max)
            order = np.lexsort((id_, ~both if both.dtype.kind == "i" else -both), axis=1)[:, :k]
            kept_scores[part] = np.take_along_axis(both, order, 1)
            kept_at[part] = np.where(kept_scores[part] == self.nothing, -1, np.take_along_axis(at, order, 1))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = 8192, query_block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` best other rows by integer inner product.

    * Vectors that are null or empty or hold a null or non-finite component take no part, nor do rows
      without an id. Vectors of different lengths are searched apart, so only equal lengths meet.
    * Ties go to the smaller id. A row is never its own result; rows that share its id aren't either,
      and rows repeated in full count once.
    * Scores are exact up to 2^63; vectors whose scores might pass it are refused.
    * With fewer than ``k`` candidates all are returned. An empty table gives an empty result.
    """
    rows = stage(quantized(vectors, is_query, id_col, vector_col, scale).withColumn("_size", F.size("_vec")), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("_query").alias("q")).first()
    parts, query_parts = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))
    deal = lambda salt, count: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.withColumn("_part", deal("part", parts)).withColumn("_qpart", every(query_parts)).withColumn("_asks", F.lit(False))
    asking = rows.where("_query").withColumn("_qpart", deal("query", query_parts)).withColumn("_part", every(parts)).withColumn("_asks", F.lit(True))
    columns = ["_size", "_part", "_qpart", "_asks", "_id", "_vec"]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        stack = lambda rows: np.array(rows["_vec"].tolist(), np.int64)
        largest = lambda values: max(int(values.max()), -int(values.min()))
        own, asks = group[~group["_asks"]], group[group["_asks"]]
        if not len(own) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        # Products of integers are exact in float32 below 2^24 and in float64 below 2^53; larger ones stay integers.
        left, right = stack(asks), stack(own)
        limit = largest(left) * largest(right) * left.shape[1]
        if limit >= 2**63:
            raise ValueError("scores of these vectors may not fit 64-bit integers: use a smaller scale")
        kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64
        ids, query_ids = own["_id"].to_numpy(), asks["_id"].to_numpy()
        row, found, score = Block(ids, right.astype(kind)).search(query_ids, left.astype(kind), k)
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": found, "score": score.astype(np.int64)})

    found = candidates.select(columns).unionByName(asking.select(columns)).groupBy("_size", "_part", "_qpart").applyInPandas(
        search, "query_id long, vec_id long, score long").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
