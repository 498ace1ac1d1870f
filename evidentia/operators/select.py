"""Selecting evidence from scored pairs (claim_id, doc_id, line_num, score, prob), and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.columns import argmax_label
from evidentia.operators.metrics import NEI, TOP, verification_scores
from evidentia.operators.tfidf import top_k

SENT = ["doc_id", "line_num"]


def hash_fraction(*cols: Column | str, seed: int = 12) -> Column:
    """A number in [0, 1) from the row's key: sampling that doesn't depend on partitioning and that other SQL engines can repeat (md5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def _listed(rows: DataFrame, claims: DataFrame | None, n: int | None = None) -> DataFrame:
    """Ranked rows as ordered lists by claim; claims without rows get empty lists."""
    item = F.struct("rank", "doc_id", "line_num", "score", "prob")
    lists = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    scored = F.transform("_l", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"), x["score"].alias("score"), x["prob"].alias("prob")))
    lists = lists.select("claim_id", scored.alias("scored"))
    if claims is not None:
        kind = dict(lists.dtypes)["scored"]
        lists = claims.join(lists.hint("merge"), "claim_id", "left").withColumn("scored", F.coalesce("scored", F.array().cast(kind)))
    top = F.col("scored") if n is None else F.slice("scored", 1, n)
    return lists.withColumn("predicted_evidence", F.transform(top, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"))))


def first_by_hash(rows: DataFrame, fraction: Column, ties: list[Column], n: int, bins: int = 1 << 16) -> DataFrame:
    """The first n rows in the order of ``fraction`` (0 to 1), then ``ties``, without a sort of all rows: fractions are counted in bins, the bins before the one where n falls are taken whole, and only that one is ordered."""
    keyed = rows.withColumn("_bin", F.floor(fraction * bins))
    counts = {r["_bin"]: r["count"] for r in keyed.groupBy("_bin").count().collect()}  # bins + 1 rows at most
    left = n
    for edge in sorted(counts):
        if counts[edge] > left:
            last = keyed.filter(F.col("_bin") == edge).orderBy(fraction, *ties).limit(left)
            return keyed.filter(F.col("_bin") < edge).unionByName(last).drop("_bin")
        left -= counts[edge]
    return rows


def best_rows(pairs: DataFrame, threshold: float, n: int, order: list[Column] | None = None) -> DataFrame:
    """Pairs with prob >= threshold, the n of the highest score by claim, with ``rank``; ties by sentence."""
    return top_k(pairs.filter(F.col("prob") >= threshold), ["claim_id"], order or [F.desc("score"), *SENT], n)


def select_by_threshold(pairs: DataFrame, claims: DataFrame | None = None, threshold: float = 0.5, n: int = TOP) -> DataFrame:
    """claim_id, scored, predicted_evidence: the best n pairs of each claim."""
    return _listed(best_rows(pairs, threshold, n), claims)


def first_rows(pairs: DataFrame, order: str) -> DataFrame:
    """The first row of each (claim, sentence) in the order of the column ``order``."""
    w = Window.partitionBy("claim_id", *SENT).orderBy(order)
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def select_unique(pairs: DataFrame, claims: DataFrame | None = None, threshold: float = 0.5, n: int = TOP, order: str = "pos") -> DataFrame:
    """As select_by_threshold, after keeping each sentence's first row."""
    return select_by_threshold(first_rows(pairs, order), claims, threshold, n)


def append_selected(selected: DataFrame, pairs: DataFrame, threshold: float, add_n: int, top_n: int = TOP, order: str = "pos") -> DataFrame:
    """Appends up to add_n passing pairs that a claim's list lacks, cut to top_n. A list of five or more is left alone, whatever top_n is."""
    extra = select_unique(pairs, None, threshold, add_n, order).select("claim_id", F.col("scored").alias("_more"))
    joined = selected.join(extra.hint("merge"), "claim_id", "left")
    have = F.col("predicted_evidence")
    more = F.coalesce(F.col("_more"), F.slice("scored", 1, 0))
    fresh = F.filter(more, lambda x: ~F.array_contains(have, F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"))))
    full = F.size("predicted_evidence") >= 5
    scored = F.when(full, F.col("scored")).otherwise(F.slice(F.concat("scored", fresh), 1, top_n))
    plain = F.transform(fresh, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num")))
    listed = F.when(full, have).otherwise(F.slice(F.concat(have, plain), 1, top_n))
    return joined.withColumns({"scored": scored, "predicted_evidence": listed}).drop("_more")


def select_prob_half(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """All pairs with prob >= 0.5 scored, the first five predicted, the gold label as the prediction."""
    rows = top_k(pairs.filter("prob >= 0.5"), ["claim_id"], [F.desc("score"), *SENT], 1 << 30)
    return _listed(rows, claims, TOP).withColumn("predicted_label", F.col("label"))


def select_scaled(pairs: DataFrame, claims: DataFrame, threshold: float) -> DataFrame:
    return select_by_threshold(pairs, claims, threshold, TOP).withColumn("predicted_label", F.col("label"))


def threshold_sweep(pairs: DataFrame, claims: DataFrame, thresholds: list[float], n: int = TOP) -> DataFrame:
    """verification_score for each threshold in one job; claims need label and evidence, the gold label is the prediction.

    A pair's level is how many thresholds it passes. What any threshold selects is among the n best pairs of each level, so a claim keeps n pairs a level (cut
    before the shuffle) in one list; the n first of a level or more are the selection at its threshold. Rows are not multiplied by thresholds.
    """
    steps = sorted({float(t) for t in thresholds})
    level = sum(((F.col("prob") >= t).cast("int") for t in steps), F.lit(0))
    best = top_k(pairs.withColumn("_level", level).filter("_level > 0"), ["claim_id", "_level"], [F.desc("score"), *SENT], n)
    item = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("falling"), *SENT, "_level")
    lists = best.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    full = claims.join(lists.hint("merge"), "claim_id", "left").withColumn("_l", F.coalesce("_l", F.array().cast(dict(lists.dtypes)["_l"]))).withColumn("predicted_label", F.col("label"))

    def chosen(i: int) -> Column:
        first = F.slice(F.filter("_l", lambda x: x["_level"] > i), 1, n)
        return F.transform(first, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num")))

    columns = {f"_p{i}": chosen(i) for i in range(len(steps))}
    return verification_scores(full.withColumns(columns), {t: f"_p{i}" for i, t in enumerate(steps)}, TOP)


def recut(selected: DataFrame, k: int) -> DataFrame:
    """Another top k of already scored lists."""
    cut = F.slice("scored", 1, k)
    return selected.withColumn("predicted_evidence", F.transform(cut, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"))))


def score_table(pairs: DataFrame, key: list[str], order: str = "pos", tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The first score of each key, and how many later rows exceed it by the tolerance or more, or have another claim text."""
    w = Window.partitionBy(*key).orderBy(order)
    ranked = pairs.withColumns({"_n": F.row_number().over(w), "_p": F.first("prob").over(w), "_q": F.first("query").over(w)})
    bad = ((F.col("prob") - F.col("_p")) >= tolerance) | ~F.col("query").eqNullSafe(F.col("_q"))
    violations = ranked.filter("_n > 1").agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("violations"))
    return ranked.filter("_n = 1").select(*key, "score", "prob", "query"), violations


def _scored_within(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their claim's score of the same ``keys``, null without one. The join's key is the claim alone, the others are a
    further condition (not written as equality, which would make them keys), so that rows and scores dealt by claim stay as they lie."""
    named = scores.withColumnsRenamed({c: f"_{c}" for c in ["claim_id", *keys]})
    on = F.col("claim_id") == F.col("_claim_id")
    for c in keys:
        on = on & (F.col(c) <= F.col(f"_{c}")) & (F.col(c) >= F.col(f"_{c}"))
    return rows.join(named.hint("merge"), on, "left").drop(*[f"_{c}" for c in ["claim_id", *keys]])


def attach_scores(rows: DataFrame, sentence_scores: DataFrame, doc_scores: DataFrame | None = None, default: float = 0.5, doc_default: float = 0.99) -> DataFrame:
    """Rows of (claim, doc, line) with sent_prob and, if given, doc_prob; missing ones get the defaults."""
    out = _scored_within(rows, sentence_scores.select("claim_id", *SENT, F.col("prob").alias("sent_prob")), SENT).fillna(default, ["sent_prob"])
    if doc_scores is not None:
        out = _scored_within(out, doc_scores.select("claim_id", "doc_id", F.col("prob").alias("doc_prob")), ["doc_id"]).fillna(doc_default, ["doc_prob"])
    return out


def clear_nei_evidence(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("predicted_evidence", F.when(F.col("predicted_label") == NEI, F.slice("predicted_evidence", 1, 0)).otherwise(F.col("predicted_evidence")))


def label_from_logits(verdicts: DataFrame, evidence: str = "predicted_evidence") -> DataFrame:
    """The label of the largest logit; not enough information without any selected sentence."""
    return verdicts.withColumn("predicted_label", F.when(F.size(evidence) == 0, NEI).otherwise(argmax_label("logits")))


def hide_labels(pairs: DataFrame, column: str = "selection_label") -> DataFrame:
    return pairs.withColumn(column, F.lit("hidden"))


def drop_gold(claims: DataFrame) -> DataFrame:
    return claims.drop("label", "evidence", "verifiable")
