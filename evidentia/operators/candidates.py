"""Sentence candidates for claims, with labels for training, and audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators.docs import topk_docs
from evidentia.operators.select import first_by_hash, hash_fraction
from evidentia.operators.tfidf import top_k

SENT = ["doc_id", "line_num"]


def gold_sentences(claims: DataFrame) -> DataFrame:
    """(claim_id, doc_id, line_num), distinct, from gold groups."""
    return claims.select("claim_id", F.explode(F.flatten("evidence")).alias("e")).select("claim_id", "e.doc_id", "e.line_num").distinct()


def sentence_candidates(docs: DataFrame, sentences: DataFrame, gold: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(claim_id, doc_id, line_num, text, selection_label): the sentences of each claim's documents (claim_id, doc_id[, rank]).

    With ``gold`` sentences (claim_id, doc_id, line_num) those are labelled true, also when no document brought them, and
    others false; without, all are hidden. ``k`` takes the first k documents by rank.
    """
    docs = docs if k is None else docs.filter(F.col("rank") <= k)
    rows = docs.select("claim_id", "doc_id").distinct().join(sentences.select(*SENT, "text").hint("merge"), "doc_id")
    if gold is None:
        return rows.withColumn("selection_label", F.lit("hidden"))
    true = gold.select("claim_id", *SENT).distinct().join(sentences.select(*SENT, "text").hint("merge"), SENT).withColumn("selection_label", F.lit("true"))
    false = rows.join(true.select("claim_id", *SENT).hint("merge"), ["claim_id", *SENT], "left_anti").withColumn("selection_label", F.lit("false"))
    return true.select("claim_id", *SENT, "text", "selection_label").unionByName(false)


def second_hop_candidates(aside: DataFrame, sentences: DataFrame, k: int = 6) -> DataFrame:
    """Hidden candidates from the first k second-hop documents by (priority desc, doc_id)."""
    return sentence_candidates(topk_docs(aside, k), sentences)


def prefix_title(doc_id: Column | str = "doc_id", line_num: Column | str = "line_num", text: Column | str = "text") -> Column:
    """``title <t> sentence``, unless it is line 0 or the sentence already has the title (regardless of case)."""
    doc_id, line_num, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, line_num, text))
    title = C.natural_title(doc_id)
    return F.when((line_num == 0) | F.lower(text).contains(F.lower(title)), text).otherwise(F.concat(title, F.lit(" <t> "), text))


def gold_selection(pairs: DataFrame) -> DataFrame:
    """Sanity: what is labelled true, as the selection."""
    item = F.struct(*SENT)
    return pairs.filter("selection_label = 'true'").groupBy("claim_id").agg(F.array_sort(F.collect_set(item)).alias("predicted_evidence"))


def downsample_negatives(pairs: DataFrame, probability: float, seed: int = 12) -> DataFrame:
    """All rows but false ones, of which a share stays, chosen by a hash of the row's key."""
    return pairs.filter((F.col("selection_label") != "false") | (hash_fraction("claim_id", *SENT, seed=seed) < probability))


def decayed(start: float, step: float, epoch: int, least: float = 0.0) -> float:
    """The downsampling probability of an epoch."""
    return max(least, start - step * epoch)


def missing_gold_pairs(gold: DataFrame, pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Gold sentences without a scored pair, as true pairs."""
    lost = gold.join(pairs.select("claim_id", *SENT).hint("merge"), ["claim_id", *SENT], "left_anti")
    return lost.join(sentences.select(*SENT, "text").hint("merge"), SENT, "left").select("claim_id", *SENT, prefix_title().alias("text"), F.lit("true").alias("selection_label"))


def gold_hit_ratio(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    hits = gold.join(pairs.select("claim_id", *SENT, F.lit(1).alias("hit")).distinct().hint("merge"), ["claim_id", *SENT], "left")
    return hits.agg(F.count("hit").alias("n_hit"), F.count("*").alias("n_gold"))


def label_balance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("selection_label").agg(F.count("*").alias("n_pairs"))


def candidate_count_stats(pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy("claim_id").agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.max("n").alias("max"), F.min("n").alias("min"), F.stddev_pop("n").alias("std"))


def balance_pairs(pairs: DataFrame, ratio: float = 1.0, seed: int = 12) -> DataFrame:
    """With m the smaller class's size: m false and ratio * m true pairs, in hash order, see ``first_by_hash``."""
    n = {r["selection_label"]: r["n_pairs"] for r in label_balance(pairs.filter("selection_label in ('true', 'false')")).collect()}
    least = min(n.get("true", 0), n.get("false", 0))
    place, ties = hash_fraction("claim_id", *SENT, seed=seed), [F.col("claim_id"), *[F.col(c) for c in SENT]]
    true = first_by_hash(pairs.filter("selection_label = 'true'"), place, ties, int(ratio * least))
    return true.unionByName(first_by_hash(pairs.filter("selection_label = 'false'"), place, ties, least))


def pairs_for_label(pairs: DataFrame, claims: DataFrame, label: str = "NOT ENOUGH INFO") -> DataFrame:
    return pairs.join(claims.filter(F.col("label") == label).select("claim_id").hint("merge"), "claim_id", "left_semi")


def top_candidates(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(pairs, ["claim_id"], [F.desc("score"), *SENT], k)
