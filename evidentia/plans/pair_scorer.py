"""The baseline pair scorer: sparse features of a claim and a sentence, and models that score only pairs they haven't seen.

What depends on the claim alone (its words, their weights, the words that a lexicon relates to them) is made once a claim. A pair's
features are then array expressions over the claim's columns and the sentence's words, so that pairs are neither exploded
into words nor shuffled with the claim's text. Features travel without texts.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.tfidf import BROADCAST_TERMS, words
from evidentia.plans.scratch import written

FEATURES = ("shared", "share_query", "share_text", "length", "tfidf", "weight_share", "antonyms", "broader")
#: Folds of claims; a fold's pairs are scored by a model of the other folds' pairs.
FOLDS = 3


def claim_table(claims: DataFrame, sentences: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(claim_id, _words, _weights, _total, _antonym, _hypernym) of each claim (claim_id, query), written.

    ``_weights``: by word its idf among ``sentences`` (text) and its weight in the claim, ln(1 + tf) * idf; words in half of the
    sentences or more, or in none, have no entry. ``_total``: the sum of the weights. ``lexicon`` (src, rel, dst) gives
    the words that stand in an antonym or hypernym relation to the claim's. Null or empty claims have empty columns.
    """
    counts = claims.select("claim_id", F.explode(words(F.col("query"))).alias("term")).groupBy("claim_id", "term").agg(F.count("*").alias("tf"))
    counts = written(counts, "claim-words")
    terms = written(counts.select("term").distinct(), "terms")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    seen = sentences.select(words(F.col("text")).alias("_w")).select(F.explode(F.array_distinct("_w")).alias("term")).join(terms, "term", "left_semi")
    sizes = sentences.agg(F.count("*").alias("n"))
    idf = seen.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(sizes)).filter("n - df > df")  # one row
    idf = idf.select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    known = counts.join(idf, "term", "left").withColumn("weight", F.log1p("tf") * F.col("idf"))
    entry = F.when(F.col("idf").isNotNull(), F.struct("term", F.struct("idf", "weight")))
    rows = known.groupBy("claim_id").agg(F.collect_list("term").alias("_words"), F.map_from_entries(F.collect_list(entry)).alias("_weights"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_total"))
    for rel in ("antonym", "hypernym"):
        if lexicon is None:
            rows = rows.withColumn(f"_{rel}", F.array().cast("array<string>"))
            continue
        related = counts.join(lexicon.filter(F.col("rel") == rel).select(F.lower("src").alias("term"), F.lower("dst").alias("_dst")), "term")
        rows = rows.join(related.groupBy("claim_id").agg(F.collect_set("_dst").alias(f"_{rel}")), "claim_id", "left")
    empty = F.array().cast("array<string>")
    rows = claims.select("claim_id").distinct().join(rows, "claim_id", "left")
    return written(rows.withColumns({**{c: F.coalesce(c, empty) for c in ("_words", "_antonym", "_hypernym")}, "_total": F.coalesce("_total", F.lit(0.0))}), "claim-table")


def pair_features(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(claim_id, doc_id, line_num) of ``pairs`` (and text) with FEATURES as doubles; ``table`` from ``claim_table``. Pairs of unknown claims go.

    ``shared`` distinct words in both, as a share of the query's and of the text's; ``length`` ln(1 + distinct words of the text);
    ``tfidf`` the sum over shared words of weight in the claim * ln(1 + tf) * idf; ``weight_share`` the share of the claim's
    weight that the text has; ``antonyms``, ``broader`` how many of the claim's related words it has. A null text has no words.
    """
    keys = ["claim_id", "doc_id", "line_num"]
    rows = pairs.select(*keys, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("_t")).join(table.hint("merge"), "claim_id")
    rows = rows.withColumn("_d", F.array_distinct("_t")).withColumn("_s", F.array_intersect("_words", "_d"))
    weighed = F.filter("_s", lambda w: F.coalesce(F.map_contains_key("_weights", w), F.lit(False)))
    rows = rows.withColumn("_k", weighed)

    def total(of) -> Column:
        return F.aggregate("_k", F.lit(0.0), lambda acc, w: acc + of(w))

    n, m, same = F.size("_words"), F.size("_d"), F.size("_s").cast("double")
    weight = lambda w: F.element_at("_weights", w)
    tf = lambda w: F.size(F.filter("_t", lambda x: x == w)).cast("double")
    return rows.select(
        *keys,
        same.alias("shared"),
        (same / F.greatest(n, F.lit(1))).alias("share_query"),
        (same / F.greatest(m, F.lit(1))).alias("share_text"),
        F.log1p(m.cast("double")).alias("length"),
        total(lambda w: weight(w)["weight"] * weight(w)["idf"] * F.log1p(tf(w))).alias("tfidf"),
        F.when(F.col("_total") > 0, total(lambda w: weight(w)["weight"]) / F.col("_total")).otherwise(0.0).alias("weight_share"),
        F.size(F.array_intersect("_antonym", "_d")).cast("double").alias("antonyms"),
        F.size(F.array_intersect("_hypernym", "_d")).cast("double").alias("broader"),
    )


def fold_of(claim: Column | str = "claim_id", folds: int = FOLDS) -> Column:
    """A claim's fold, by the CRC of its id as text; null ids are in fold 0."""
    claim = F.col(claim) if isinstance(claim, str) else claim
    return F.coalesce(F.pmod(F.crc32(claim.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def cross_fit(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``rows`` (FEATURES, claim_id, selection_label) with fold, score and prob; no pair is scored by a model that saw its claim.

    A fold's model is a logistic regression on the labelled rows of the other folds, applied as an expression of its
    coefficients (a number a feature and fold). Where those rows lack one of the labels, the score is that of the
    untrained overlap: 10 * share_query - 5. Hidden pairs are scored, not learned.
    """
    rows = rows.withColumn("fold", fold_of("claim_id", folds))
    learned = rows.filter("selection_label in ('true', 'false')").withColumn("_y", (F.col("selection_label") == "true").cast("double"))
    learned = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(learned).select("fold", "_x", "_y")
    found = {(r.fold, r._y): r.n for r in learned.groupBy("fold", "_y").agg(F.count("*").alias("n")).collect()}  # two rows a fold
    score = F.col("share_query") * 10 - 5
    for fold in range(folds):
        if not all(any(f != fold and y == label for f, y in found) for label in (0.0, 1.0)):
            continue
        model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30, regParam=1e-3).fit(learned.filter(F.col("fold") != fold).select("_x", "_y"))
        own = F.lit(float(model.intercept))
        for name, c in zip(FEATURES, model.coefficients):
            own = own + F.lit(float(c)) * F.col(name)
        score = F.when(F.col("fold") == fold, own).otherwise(score)
    return rows.withColumn("score", score).withColumn("prob", 1 / (1 + F.exp(-F.col("score"))))
