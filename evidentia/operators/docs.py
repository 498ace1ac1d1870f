"""Ranking, expanding and disambiguating a claim's candidate documents ``(claim_id, match_key, doc_id, priority)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators.select import first_by_hash, hash_fraction
from evidentia.operators.tfidf import rank_candidates, top_k
from evidentia.plans.scratch import written

BRACKET = "-LRB-"
EXACT = 5.0


def pageview_lookup(links: DataFrame, views: DataFrame) -> DataFrame:
    """``views`` by decoded title, 0 if unknown."""
    named = links.withColumn("_title", C.brc_decode("doc_id"))
    return named.join(views.select(F.col("doc").alias("_title"), "views").hint("merge"), "_title", "left").drop("_title").fillna(0, ["views"])


def pageview_rank(links: DataFrame, views: DataFrame, merge: bool = False) -> DataFrame:
    """Groups (claim, key) of several candidates: by falling views priority max(1 - 0.2 * rank, 0); single candidates keep theirs.

    Once any group of a claim is ranked its list is the distinct union of the groups; other claims stay as they are. With
    ``merge`` ranked candidates keep what earlier rules added to their priority.
    """
    seen = pageview_lookup(links, views)
    group = Window.partitionBy("claim_id", "match_key")
    rank = F.row_number().over(group.orderBy(F.desc("views"), "doc_id")) - 1
    size = F.count("*").over(group)
    new = F.round(F.greatest(F.lit(0.0), 1 - 0.2 * F.col("_rank")), 6)
    kept = F.col("priority") + new if merge else new
    out = seen.withColumns({"_rank": rank, "_size": size}).withColumn("priority", F.when(F.col("_size") > 1, kept).otherwise(F.col("priority")))
    return out.drop("_rank", "_size", "views")


def pageview_raw(links: DataFrame, views: DataFrame) -> DataFrame:
    return pageview_lookup(links, views).withColumn("priority", F.col("views").cast("double")).drop("views")


def expand_from_docs(claims: DataFrame, links: DataFrame, sentences: DataFrame, link_rows: DataFrame, fewest: int = 2, k: int = 5, least: float = 3.0) -> DataFrame:
    """For claims with fewer than ``fewest`` documents: of each one's k closest sentences those scoring above ``least``; the documents they link to join with the parent's priority."""
    few = links.groupBy("claim_id").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") < fewest).select("claim_id")
    own = links.join(few.hint("merge"), "claim_id").select("claim_id", "doc_id", "priority").distinct()
    candidates = own.select("claim_id", F.col("doc_id").alias("parent")).join(sentences.select(F.col("doc_id").alias("parent"), "line_num", "text").hint("merge"), "parent").withColumn("pair", F.concat_ws("###", "claim_id", "parent"))
    asked = candidates.select("pair", "claim_id").distinct().join(claims.select("claim_id", "text").hint("merge"), "claim_id")
    ranked = rank_candidates(asked, candidates, "pair", ["parent", "line_num"], k=k).filter(F.col("score") > least)
    ranked = ranked.join(candidates.select("pair", "claim_id").distinct().hint("merge"), "pair")
    hops = ranked.join(link_rows.select(F.col("doc_id").alias("parent"), "line_num", "target").hint("merge"), ["parent", "line_num"]).join(own.select("claim_id", F.col("doc_id").alias("parent"), "priority").hint("merge"), ["claim_id", "parent"])
    more = hops.select("claim_id", F.col("parent").cast("string").alias("match_key"), C.brc_encode("target", True).alias("doc_id"), "priority").distinct()
    return links.select("claim_id", "match_key", "doc_id", "priority").unionByName(more)


def expand_from_sentences(selected: DataFrame, link_rows: DataFrame, constant: float | None = None, encode: bool = True) -> DataFrame:
    """(claim_id, sent_doc, sent_line, pos, doc_id, priority): the link targets of selected sentences (claim_id, doc_id, line_num, score) with the sentence's score (older form: a constant)."""
    target = C.brc_encode("target", True) if encode else F.col("target")
    rows = selected.join(link_rows.select("doc_id", "line_num", target.alias("_target")).hint("merge"), ["doc_id", "line_num"])
    priority = F.col("score") if constant is None else F.lit(float(constant))
    return rows.select("claim_id", F.col("doc_id").alias("sent_doc"), F.col("line_num").alias("sent_line"), F.col("_target").alias("doc_id"), priority.cast("double").alias("priority"))


def topk_docs(links: DataFrame, k: int = 5) -> DataFrame:
    """(claim_id, doc_id, priority, rank): the first k entries by (priority desc, doc_id), then distinct documents; a repeated document uses up its places."""
    best = top_k(links.select("claim_id", "doc_id", "priority"), ["claim_id"], [F.desc("priority"), "doc_id"], k)
    first = best.groupBy("claim_id", "doc_id").agg(F.max("priority").alias("priority"), F.min("rank").alias("rank"))
    return first


def best_sentence_links(hops: DataFrame, least: float = -100.0) -> DataFrame:
    """Of expand_from_sentences the group of the highest score by claim, the first sentence on ties."""
    groups = hops.filter(F.col("priority") > least).groupBy("claim_id", "sent_doc", "sent_line").agg(F.max("priority").alias("_s"))
    best = top_k(groups, ["claim_id"], [F.desc("_s"), "sent_doc", "sent_line"], 1).drop("rank", "_s")
    return hops.join(best.hint("merge"), ["claim_id", "sent_doc", "sent_line"])


def best_linked_sentences(selected: DataFrame, link_rows: DataFrame, least: float = -100.0) -> DataFrame:
    """The rows of ``selected`` (claim_id, doc_id, line_num, score) of each claim's sentence that best_sentence_links would choose after expand_from_sentences."""
    linked = selected.join(link_rows.select("doc_id", "line_num").distinct().hint("merge"), ["doc_id", "line_num"], "left_semi")
    linked = written(linked.select("claim_id", "doc_id", "line_num", "score"), "linked")
    groups = linked.filter(F.col("score") > least).groupBy("claim_id", "doc_id", "line_num").agg(F.max("score").alias("_s"))
    best = top_k(groups, ["claim_id"], [F.desc("_s"), "doc_id", "line_num"], 1).drop("rank", "_s")
    return linked.join(best.hint("merge"), ["claim_id", "doc_id", "line_num"], "left_semi")


def sentence_links_as_candidates(hops: DataFrame) -> DataFrame:
    """Link groups in the candidates' form, the sentence as the key; for pageview_rank over the aside group, or merged into the main list by union."""
    return hops.select("claim_id", C.pack_id("sent_doc", "sent_line").alias("match_key"), "doc_id", "priority").distinct()


def new_docs_only(aside: DataFrame, links: DataFrame) -> DataFrame:
    return aside.join(links.select("claim_id", "doc_id").distinct().hint("merge"), ["claim_id", "doc_id"], "left_anti")


def two_hop_merge(links: DataFrame, aside: DataFrame, k: int = 5, k_aside: int | None = None) -> DataFrame:
    """(claim_id, doc_id, hop): the top k of either hop; the second only with documents the first doesn't list at all."""
    first = topk_docs(links, k).select("claim_id", "doc_id", F.lit(1).alias("hop"))
    second = topk_docs(new_docs_only(aside, links), k_aside or k).select("claim_id", "doc_id", F.lit(2).alias("hop"))
    return first.unionByName(second)


def reset_bracket_priority(links: DataFrame) -> DataFrame:
    return links.withColumn("priority", F.when(F.col("doc_id").contains(BRACKET), 1.0).otherwise(F.col("priority")))


def _title_in(claim: str) -> Column:
    return F.col("doc_id").contains(BRACKET) & F.col(claim).contains(F.array_join(C.title_tokens("doc_id"), " "))


def exact_title_first(links: DataFrame, claims: DataFrame, k: int | None = None, order: str = "pos") -> DataFrame:
    """(claim_id, doc_id, priority, rank): bracketed documents whose title the claim contains get 5.0 and come first in list order; the rest by (priority desc, doc_id), each document once."""
    rows = links.join(claims.select("claim_id", F.array_join("tokens", " ").alias("_c")).hint("merge"), "claim_id").withColumn("_exact", _title_in("_c"))
    rows = rows.withColumn("priority", F.when(F.col("_exact"), EXACT).otherwise(F.col("priority")))
    best = rows.groupBy("claim_id", "doc_id").agg(F.max("priority").alias("priority"), F.max("_exact").alias("_exact"), F.min(order).alias("_pos"))
    w = Window.partitionBy("claim_id").orderBy(F.desc("_exact"), F.when(F.col("_exact"), F.col("_pos")), F.desc("priority"), "doc_id")
    out = best.withColumn("rank", F.row_number().over(w)).drop("_exact", "_pos")
    return out if k is None else out.filter(F.col("rank") <= k)


def truncate_docs(rows: DataFrame, k: int, column: str = "predicted_docids") -> DataFrame:
    return rows.withColumn(column, F.slice(column, 1, k))


def disambiguation_pairs(links: DataFrame, claims: DataFrame, sentences: DataFrame) -> DataFrame:
    """Hidden pairs (title and first sentence, claim) for bracketed documents whose title the claim lacks."""
    rows = links.select("claim_id", "doc_id").distinct().join(claims.select("claim_id", F.array_join("tokens", " ").alias("query")).hint("merge"), "claim_id")
    rows = rows.filter(F.col("doc_id").contains(BRACKET) & ~_title_in("query"))
    first = sentences.filter("line_num = 0").select("doc_id", F.col("text").alias("_t"))
    text = F.concat_ws(" ", F.array_join(C.title_tokens("doc_id"), " "), "_t")
    return rows.join(first.hint("merge"), "doc_id", "left").select(C.pack_id("claim_id", "doc_id", separator="###").alias("selection_id"), "claim_id", "doc_id", text.alias("text"), "query", F.lit("hidden").alias("selection_label"))


def disambiguation_train_pairs(links: DataFrame, gold: DataFrame, claims: DataFrame, fewest: int = 6, most: int = 12, seed: int = 12, need_positive: bool = False, ratio: float | None = None) -> DataFrame:
    """(claim_id, doc_id, selection_label): gold bracketed documents not in the claim text as true; of the first fewest..most candidates in a seeded order the bracketed ones that aren't gold as false.

    ``need_positive`` leaves out claims without a true pair; ``ratio`` keeps at most ratio * positives negatives in all.
    """
    text = claims.select("claim_id", F.array_join("tokens", " ").alias("_c"))
    positive = gold.select("claim_id", "doc_id").distinct().join(text.hint("merge"), "claim_id").filter(F.col("doc_id").contains(BRACKET) & ~_title_in("_c")).select("claim_id", "doc_id")
    order = Window.partitionBy("claim_id").orderBy(hash_fraction("claim_id", "doc_id", seed=seed), "doc_id")
    limit = fewest + F.floor(hash_fraction("claim_id", seed=seed + 1) * (most - fewest + 1))
    shuffled = links.select("claim_id", "doc_id").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
    negative = shuffled.filter(F.col("doc_id").contains(BRACKET)).join(gold.select("claim_id", "doc_id").distinct().hint("merge"), ["claim_id", "doc_id"], "left_anti").select("claim_id", "doc_id")
    if need_positive:
        negative = negative.join(positive.select("claim_id").distinct().hint("merge"), "claim_id", "left_semi")
    if ratio is not None:
        n = positive.count()
        negative = first_by_hash(negative, hash_fraction("claim_id", "doc_id", seed=seed + 2), [F.col("claim_id"), F.col("doc_id")], int(n * ratio))
    return positive.withColumn("selection_label", F.lit("true")).unionByName(negative.withColumn("selection_label", F.lit("false")))


def apply_disambiguation(links: DataFrame, scores: DataFrame, mode: str = "v2", threshold: float = 1e-5, claims: DataFrame | None = None) -> DataFrame:
    """Priorities overwritten from a scored pair table (claim_id, doc_id, score, prob, label).

    ``label``: 5.0 for true, -1.0 for false; ``v0``: 1 + score / 100; ``v1``: 1 + prob; ``v2``: prob, and entries below the
    threshold go unless the claim contains their title.
    """
    s = scores.select("claim_id", "doc_id", *[F.col(c).alias(f"_{c}") for c in ("score", "prob", "label") if c in scores.columns], F.lit(True).alias("_hit"))
    rows = links.join(s.hint("merge"), ["claim_id", "doc_id"], "left")
    new = {
        "label": lambda: F.when(F.col("_label") == "true", 5.0).otherwise(-1.0),
        "v0": lambda: 1 + F.col("_score") / 100,
        "v1": lambda: 1 + F.col("_prob"),
        "v2": lambda: F.col("_prob"),
    }[mode]()
    rows = rows.withColumn("priority", F.when(F.col("_hit"), new).otherwise(F.col("priority")))
    if mode == "v2":
        rows = rows.join(claims.select("claim_id", F.array_join("tokens", " ").alias("_c")).hint("merge"), "claim_id")
        rows = rows.filter((F.col("priority") >= threshold) | _title_in("_c"))
    return rows.select(*links.columns)


def docs_in_evidence(claims: DataFrame) -> DataFrame:
    """claim_id, all_docs (in any gold group) and common_docs (in every group)."""
    groups = F.transform("evidence", lambda g: F.array_distinct(F.transform(g, lambda e: e["doc_id"])))
    every = F.array_distinct(F.flatten(groups))
    common = F.filter(every, lambda d: F.forall(groups, lambda g: F.array_contains(g, d)))
    return claims.select("claim_id", F.array_sort(every).alias("all_docs"), F.array_sort(common).alias("common_docs"))


def docs_in_links(hops: DataFrame) -> DataFrame:
    """claim_id, docs: distinct documents of a claim's link groups."""
    return hops.groupBy("claim_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def bracket_subset(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims with a gold bracketed document that was retrieved and whose title the claim lacks."""
    gold = claims.select("claim_id", F.array_join("tokens", " ").alias("_c"), F.explode(F.flatten("evidence")).alias("e")).select("claim_id", "_c", "e.doc_id")
    gold = gold.filter(F.col("doc_id").contains(BRACKET) & ~_title_in("_c"))
    hit = gold.join(links.select("claim_id", "doc_id").hint("merge"), ["claim_id", "doc_id"], "left_semi").select("claim_id").distinct()
    return claims.join(hit.hint("merge"), "claim_id", "left_semi")
