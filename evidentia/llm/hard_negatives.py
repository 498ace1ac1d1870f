"""Hard negatives of anchors, with score bounds along a spanning tree of the anchors.

The anchors of a block form a minimum spanning tree by their distances. For a row v and an anchor c with parent p,
|<c, v> - <p, v>| <= |c - p| * |v|: what is known of the parent's scores, exact values or intervals, bounds the child's.
The tree is walked level by level; a row's score with an anchor is computed only where its interval overlaps the windows in
which the anchor still looks for rows, and stays an interval elsewhere. Rows among themselves alike are thereby scored
once for a whole branch; where anchors are far apart the bounds exclude little and nearly all is rescored.

Two passes over the shards: the best rows of the anchor's label (its positives, window: from the n-th best so far), then, for
each positive, the best rows of other labels in the window below its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import vectors as V
from evidentia.plans.scratch import written

SCALE = 256
BLOCK_ROWS = 512
#: Share of a level's scores to be computed from which they come from one matrix product, below from the pairs alone.
DENSE = 0.05
FOUND = "anchor_row long, anchor_id long, slot int, slot_id long, slot_score long, vec_row long, vec_id long, score long"


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Parents (-1 for the root, row 0), lengths of the edges to them, and the rows by level, of a minimum spanning tree of the rows (Prim)."""
    n = len(m)
    m = m.astype(np.float64)
    parent, edge, depth = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    near, via, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        out[now] = False
        d = np.sqrt(((m - m[now]) ** 2).sum(1))
        better = out & (d < near)
        near[better], via[better] = d[better], now
        now = int(np.where(out, near, np.inf).argmin())
        parent[now], edge[now], depth[now] = via[now], near[now], depth[via[now]] + 1
    return parent, edge, [np.flatnonzero(depth == k) for k in range(depth.max(initial=0) + 1)] if n else []


class Mining:
    """The best ``n`` rows of each window of each anchor of a block over the shards added so far.

    Without slots there is one open window an anchor, for rows of its own label; with ``slots`` (whether the id is known, id and score of each of an anchor's
    positives) one window below each, for rows of other labels: least * score <= 100 * row's score <= 100 * score.
    """

    def __init__(self, anchors: V.Rows, n: int, negatives: bool, least: int = 80) -> None:
        self.a, self.n, self.negatives, self.least = anchors, n, negatives, least
        self.parent, self.edge, self.levels = spanning_tree(anchors.m)
        count = max([1, *(len(s) // 3 for s in anchors.slots)]) if negatives else 1
        self.slot_id, self.top, self.floor = np.zeros((len(anchors), count), np.int64), np.full((len(anchors), count), -np.inf), np.full((len(anchors), count), np.inf)
        self.slot_known = np.zeros((len(anchors), count), bool)
        self.slot_score = np.zeros((len(anchors), count), np.int64)
        if not negatives:
            self.top[:], self.floor[:] = np.inf, -np.inf
        for i, s in enumerate(anchors.slots if negatives else ()):
            for j, (known, slot_id, score) in enumerate(np.reshape(s, (-1, 3)).tolist()):
                self.slot_known[i, j], self.slot_id[i, j], self.slot_score[i, j] = bool(known), slot_id, score
                self.top[i, j], self.floor[i, j] = score, least * score / 100
        self.owner = np.zeros(0, np.int64)  # anchor * windows + window
        self.score, self.rows, self.ids, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.rescored = self.seen = 0

    def add(self, shard: V.Rows) -> None:
        a, m = V.common(self.a.m, shard.m)
        norms = np.sqrt((m.astype(np.float64) ** 2).sum(1))
        own = {r: i for i, r in enumerate(shard.rows.tolist())}
        low, high = np.zeros((len(a), len(m))), np.zeros((len(a), len(m)))
        found = []
        for k, level in enumerate(self.levels):
            if k == 0:
                span_low, span_high = np.full((len(level), len(m)), -np.inf), np.full((len(level), len(m)), np.inf)
            else:
                reach = np.ceil(self.edge[level][:, None] * norms * (1 + 1e-9)) + 1
                span_low, span_high = low[self.parent[level]] - reach, high[self.parent[level]] + reach
            wanted = (self.a.labels[level][:, None] == shard.labels) ^ self.negatives
            for at, anchor in enumerate(level):
                if (j := own.get(int(self.a.rows[anchor]))) is not None:
                    wanted[at, j] = False
            if k == 0:
                again = np.ones(wanted.shape, bool)  # the root is scored whole: all bounds start from it
            else:
                again = np.zeros(wanted.shape, bool)
                for w in range(self.top.shape[1]):
                    again |= (span_high >= self.floor[level, w][:, None]) & (span_low <= self.top[level, w][:, None])
                again &= wanted
            i, j = np.nonzero(again)
            self.rescored += len(i)
            self.seen += again.size
            if len(i) >= DENSE * again.size:
                scores = (a[level] @ m.T)[i, j]
            else:
                scores = np.einsum("nd,nd->n", a[level[i]], m[j]) if len(i) else np.zeros(0, a.dtype)
            span_low[i, j] = span_high[i, j] = scores
            low[level], high[level] = span_low, span_high
            ok = wanted[i, j]
            found.append((level[i[ok]], j[ok], scores[ok].astype(np.int64)))
        if found:
            self._take(*(np.concatenate(x) for x in zip(*found, strict=True)), shard)

    def _take(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, shard: V.Rows) -> None:
        windows = self.top.shape[1]
        for w in range(windows):
            inside = score >= self.floor[i, w]
            if self.negatives:
                bound = self.slot_score[i, w]
                inside &= np.isfinite(self.top[i, w]) & (self.least * bound <= 100 * score) & (score <= bound)
            at, where, what = i[inside], j[inside], score[inside]
            owner = at * windows + w
            old = np.isin(self.owner, np.unique(owner))
            both = [np.concatenate([x[old], y]) for x, y in ((self.owner, owner), (self.score, what), (self.rows, shard.rows[where]), (self.ids, shard.ids[where]), (self.known, shard.known[where]))]
            best = V.firsts(both[0], both[1], both[4], both[3], both[2], self.n)
            new = [x[best] for x in both]
            self.owner, self.score, self.rows, self.ids, self.known = (np.concatenate([x[~old], y]) for x, y in zip((self.owner, self.score, self.rows, self.ids, self.known), new, strict=True))
            ends = np.flatnonzero(np.diff(new[0], append=-1))
            full = np.bincount(new[0] // windows, minlength=len(self.a))[new[0][ends] // windows] == self.n
            self.floor[new[0][ends][full] // windows, w] = new[1][ends][full]

    def result(self) -> pa.RecordBatch:
        windows = self.top.shape[1]
        i, w = self.owner // windows, self.owner % windows
        slot_id = pa.array(self.slot_id[i, w], mask=~self.slot_known[i, w])
        cells = [pa.array(self.a.rows[i]), pa.array(self.a.ids[i]), pa.array(w.astype(np.int32)), slot_id, pa.array(self.slot_score[i, w]), pa.array(self.rows), pa.array(self.ids, mask=~self.known), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in FOUND.split(", ")])


def _best(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, shifted: int = 7, labels: int = 10, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose vec_id is divisible by ``every``. Scores are integer inner products of floor(scale * x). An anchor's
    positives are its ``positives`` best other rows of its label (all if fewer; ties by smaller vec_id). For each, the first
    ``negatives`` rows of other labels whose score is from ``least`` percent of the positive's score up to that score. The label of rows whose vec_id is divisible by
    ``shifted`` is first moved on by one, modulo ``labels``.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null vec_id makes no anchor, keeps its
    label, and comes last among ties. Repeated rows are rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = V.quantized(table.select("vec_id", "embedding", label.alias("label")), scale, labelled=True)
    shards, n_shards = V.packed(rows, V.SHARD_ROWS, "shards")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks, n_blocks = V.packed(anchors, BLOCK_ROWS, "anchors")
    near = V.meet(blocks, n_blocks, shards, n_shards, lambda block: Mining(block, positives, False), FOUND)
    slot = F.struct("rank", F.array(F.col("vec_id").isNotNull().cast("long"), F.coalesce("vec_id", F.lit(0).cast("long")), "score").alias("cell"))
    slots = _best(near, ["anchor_row"], positives).groupBy(F.col("anchor_row").alias("row")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(slot)), lambda x: x["cell"])).alias("slots"))
    blocks, n_blocks = V.packed(anchors.join(written(slots, "positives"), "row"), BLOCK_ROWS, "positives")
    found = V.meet(blocks, n_blocks, shards, n_shards, lambda block: Mining(block, negatives, True, least), FOUND)
    best = _best(found, ["anchor_row", "slot"], negatives)
    return best.select("anchor_id", F.col("slot_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("slot_score").alias("positive_score"), F.col("score").alias("negative_score"))
