"""Exact top-k search by MaxScore over vectors whose components are term weights.

A dimension is a term. Its posting list in a shard is the column of that shard's matrix, its impact the component there (0 where
a row has none); impacts may be negative. A query's score bound for a term is the largest contribution that any row of the
shard can get from it. Terms in order of their bounds: the longest prefix whose bounds together stay below the query's
threshold (its k-th best score so far) is non-essential, for a row gains less than the threshold there. The essential
terms' postings are traversed for all rows; only rows whose partial score can still reach the threshold are looked up in the
non-essential terms, the largest bounds first, and leave as soon as they can't.
Shards are searched independently and their answers merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import vectors as V

SCALE = 64
#: Queries of a block, and of the piece of it that one matrix of partial scores holds.
BLOCK_ROWS, PIECE_ROWS = 4096, 512
#: Non-essential terms that are looked up at a time.
PROBES = 8
FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


class Search:
    """The k best rows of each query of a block over the shards added so far."""

    def __init__(self, queries: V.Rows, k: int) -> None:
        self.q, self.k = queries, k
        n = len(queries)
        self.owner = np.zeros(0, np.int64)
        self.score, self.rows, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.floor = np.full(n, -np.inf)  # the k-th best score, once there are k
        self.traversed = self.probed = 0  # contributions summed up in each of the two ways

    def add(self, shard: V.Rows) -> None:
        q, m = V.common(self.q.m, shard.m)
        own = {r: i for i, r in enumerate(shard.rows.tolist())}
        mine = np.array([own.get(r, -1) for r in self.q.rows.tolist()])
        high, low = m.max(0, initial=0), m.min(0, initial=0)
        for start in range(0, len(q), PIECE_ROWS):
            piece = slice(start, start + PIECE_ROWS)
            self._piece(start, q[piece], m, mine[piece], np.maximum(q[piece] * high, q[piece] * low), shard)

    def _piece(self, start: int, q: np.ndarray, m: np.ndarray, mine: np.ndarray, bounds: np.ndarray, shard: V.Rows) -> None:
        floor = self.floor[start : start + len(q)]
        if q.dtype == np.int64:  # sums beyond 2^53 are rounded when they are compared
            floor = floor - np.abs(bounds.astype(np.float64)).sum(1) * 2.0**-40
        order = np.argsort(bounds, axis=1, kind="stable")
        ranked = np.take_along_axis(bounds, order, 1).astype(np.float64)
        total = np.cumsum(ranked, axis=1)
        spare = (total < floor[:, None]).sum(1)  # non-essential terms: a prefix of the order
        rest = np.where(spare > 0, total[np.arange(len(q)), np.maximum(spare - 1, 0)], 0.0)
        essential = np.ones(q.shape, bool)
        np.put_along_axis(essential, order, np.arange(q.shape[1]) >= spare[:, None], 1)
        partial = (q * essential) @ m.T
        self.traversed += int(essential.sum()) * len(m)
        hit = np.flatnonzero(mine >= 0)
        alive = partial + rest[:, None] >= floor[:, None]
        alive[hit, mine[hit]] = False
        exact = np.flatnonzero(spare == 0)
        if len(exact) and self.k < len(m):  # these scores are whole: their own k-th best is a threshold too
            whole = partial[exact].astype(np.float64) if partial.dtype != np.int64 else partial[exact]
            whole = np.where(alive[exact], whole, -np.inf)
            alive[exact] &= whole >= np.partition(whole, len(m) - self.k, axis=1)[:, len(m) - self.k, None]
        i, j = np.nonzero(alive)
        score, left, at = partial[i, j], rest[i], spare[i]
        while len(i):
            probing = at > 0
            if not probing.any():
                break
            place = at[:, None] - 1 - np.arange(PROBES)
            term = order[i[:, None], np.maximum(place, 0)]
            some = np.where(place >= 0, q[i[:, None], term] * m[j[:, None], term], 0)
            self.probed += int((place >= 0).sum())
            score = score + some.sum(1)
            at = np.maximum(at - PROBES, 0)
            left = np.where(at > 0, total[i, np.maximum(at - 1, 0)], 0.0)
            keep = score + left >= floor[i]
            i, j, score, left, at = i[keep], j[keep], score[keep], left[keep], at[keep]
        self._take(i + start, j, score, shard)

    def _take(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, shard: V.Rows) -> None:
        touched = np.unique(i)
        old = np.isin(self.owner, touched)
        owner, whole = np.concatenate([self.owner[old], i]), np.concatenate([self.score[old], score.astype(np.int64)])
        rows, ids, known = (np.concatenate([a[old], b[j]]) for a, b in ((self.rows, shard.rows), (self.ids, shard.ids), (self.known, shard.known)))
        best = V.firsts(owner, whole, known, ids, rows, self.k)
        new = [x[best] for x in (owner, whole, rows, ids, known)]
        self.owner, self.score, self.rows, self.ids, self.known = (np.concatenate([a[~old], b]) for a, b in zip((self.owner, self.score, self.rows, self.ids, self.known), new, strict=True))
        owner, whole = new[:2]
        ends = np.flatnonzero(np.diff(owner, append=-1))
        full = np.bincount(owner, minlength=len(self.q))[owner[ends]] == self.k
        self.floor[owner[ends][full]] = whole[ends][full]

    def result(self) -> pa.RecordBatch:
        q = self.q
        ids = pa.array(self.ids, mask=~self.known)
        return pa.RecordBatch.from_arrays([pa.array(q.rows[self.owner]), pa.array(q.ids[self.owner]), pa.array(self.rows), ids, pa.array(self.score)], [c.split()[0] for c in FOUND.split(", ")])


def top_k(table: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest integer inner product with each query, all if fewer; ties by smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own. Components become
    floor(scale * x). Rows whose vector is null or has a null or non-finite component take no part; an empty vector scores 0; a
    row without vec_id is a candidate (null, last among ties) but no query. Repeated rows are rows of their own: each is a query
    and each a candidate of the others. Other columns are ignored; an empty table gives an empty result. Inner products that
    don't fit in 64 bits are an error.
    """
    rows = V.quantized(table.select("vec_id", "embedding"), scale)
    shards, n_shards = V.packed(rows, V.SHARD_ROWS, "shards")
    blocks, n_blocks = V.packed(rows.filter(F.col("vec_id") % every == 0), BLOCK_ROWS, "queries")
    found = V.meet(blocks, n_blocks, shards, n_shards, lambda block: Search(block, k), FOUND)
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
