"""Merging several scorers' runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.columns import LABELS, argmax_label
from evidentia.operators.metrics import evidence_correct, f1, macro_precision, macro_recall


def ensemble_scores(runs: DataFrame, key: list[str], n_runs: int) -> DataFrame:
    """Mean score and prob of rows (key, run, score, prob); a key that a run lacks is an error at run time."""
    mean = runs.groupBy(*key).agg(F.avg("score").alias("score"), F.avg("prob").alias("prob"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == n_runs, F.col("prob")).otherwise(F.raise_error(F.lit("a run lacks a row")).cast("double"))
    return mean.withColumn("prob", checked).drop("_n")


def mean_logits(runs: DataFrame, key: list[str]) -> DataFrame:
    """Element-wise mean of rows (key, run, logits of three)."""
    return runs.groupBy(*key).agg(F.array(*[F.avg(F.get("logits", F.lit(i))) for i in range(3)]).alias("logits"))


def ensemble_labels(runs: DataFrame, key: list[str]) -> DataFrame:
    """Mean logits over runs and the label of the largest, the first on ties."""
    return mean_logits(runs, key).withColumn("predicted_label", argmax_label("logits"))


_COUNTS = ("n", "strict", "accuracy", "precision", "precision_n", "recall", "recall_n")


def _walked(n_runs: int, largest: int):
    """Rows (sums, counts, label, evid, p, r), one a claim -> counts by subset. The subsets are walked depth first: each step adds one run's logits to its parent's sums, and going back takes it away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = lambda c, w: np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, w)
            sums, counts = flat("sums", 3 * n_runs).reshape(-1, n_runs, 3), flat("counts", n_runs)
            label, evid = batch.column("label").to_numpy(zero_copy_only=False), batch.column("evid").to_numpy(zero_copy_only=False).astype(bool)
            p, r = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.float64) for c in ("p", "r"))
            out: list[tuple] = []

            def visit(start: int, names: tuple, total: np.ndarray, many: np.ndarray) -> None:
                for k in range(start, n_runs):
                    own, n = total + sums[:, k], many + counts[:, k]
                    there = n > 0
                    ok = there & (np.argmax(own / np.maximum(n, 1)[:, None], 1) == label)
                    has_p, has_r = there & ~np.isnan(p), there & ~np.isnan(r)
                    out.append((",".join(map(str, (*names, k))), there.sum(), (ok & evid).sum(), ok.sum(), p[has_p].sum(), has_p.sum(), r[has_r].sum(), has_r.sum()))
                    if len(names) + 1 < largest:
                        visit(k + 1, (*names, k), own, n)

            visit(0, (), np.zeros(sums[:, 0].shape), np.zeros(len(sums)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(np.array(c, np.float64)) for c in columns[1:])], ["subset", *_COUNTS])

    return run


def search_ensembles(runs: DataFrame, claims: DataFrame, n_runs: int, largest: int = 4) -> DataFrame:
    """verification_score for every subset of 1..largest runs in one job; ``runs``: (claim_id, run, logits), ``claims`` with gold and predicted evidence.

    A claim is one row with all its runs' logits until the counts: tasks walk the subsets (793 of 12 runs) over their claims as arrays and send one row of counts a
    subset and batch. A subset's label is that of the largest mean logit over the runs of it that the claim has; claims with none of them don't count. Null logits count as 0.
    """
    logit = lambda k, i: F.sum(F.when(F.col("run") == k, F.coalesce(F.get("logits", F.lit(i)), F.lit(0.0)).cast("double")).otherwise(0.0))
    one = runs.groupBy("claim_id").agg(F.array(*[logit(k, i) for k in range(n_runs) for i in range(3)]).alias("sums"), F.array(*[F.sum((F.col("run") == k).cast("double")) for k in range(n_runs)]).alias("counts"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.upper("label")) - 1, F.lit(-1)).cast("int")
    rows = one.join(claims.hint("merge"), "claim_id").select("sums", "counts", place.alias("label"), F.coalesce(evidence_correct(), F.lit(False)).alias("evid"), macro_precision().alias("p"), macro_recall().alias("r"))
    kind = "subset string, " + ", ".join(f"{c} double" for c in _COUNTS)
    sums = rows.mapInArrow(_walked(n_runs, largest), kind).groupBy("subset").agg(*[F.sum(c).alias(c) for c in _COUNTS]).filter("n > 0")
    mean = lambda x, n, none: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(none))
    got = sums.select("subset", (F.col("strict") / F.col("n")).alias("strict"), (F.col("accuracy") / F.col("n")).alias("accuracy"), mean("precision", "precision_n", 1.0).alias("precision"), mean("recall", "recall_n", 0.0).alias("recall"))
    return got.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_ensembles(scores: DataFrame) -> DataFrame:
    """The subset of the best accuracy and that of the best strict score; ties by name."""
    a = scores.orderBy(F.desc("accuracy"), "subset").limit(1).withColumn("best", F.lit("accuracy"))
    return a.unionByName(scores.orderBy(F.desc("strict"), "subset").limit(1).withColumn("best", F.lit("strict")))
