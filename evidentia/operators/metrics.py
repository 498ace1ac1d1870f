"""Metrics over predictions and gold evidence groups.

Columns: ``label`` and ``evidence`` (gold: groups of (doc_id, line_num)), ``predicted_label`` and ``predicted_evidence`` (one
list). Claims without enough information count in accuracy and strict score and are left out of precision and
recall. A group is covered when all its entries are among the first k predictions; k None means all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.columns import LABELS

NEI = LABELS[2]
TOP = 5


def _nei(label: str = "label") -> Column:
    return F.upper(F.col(label)) == NEI


def first_k(items: Column, k: int | Column | None) -> Column:
    return items if k is None else F.slice(items, 1, k)


def _docs(items: Column) -> Column:
    return F.transform(items, lambda e: e["doc_id"])


def covered(groups: Column, predicted: Column) -> Column:
    """Whether some non-empty group lies within the predicted list."""
    hit = F.exists(groups, lambda g: (F.size(g) > 0) & F.forall(g, lambda e: F.array_contains(predicted, e)))
    return F.coalesce(hit, F.lit(False))


def no_gold(groups: Column) -> Column:
    return F.coalesce(F.forall(groups, lambda g: F.size(g) == 0), F.lit(True))


def label_correct() -> Column:
    return F.upper(F.col("label")) == F.upper(F.col("predicted_label"))


PREDICTED = "predicted_evidence"


def evidence_correct(k: int | Column | None = TOP, predicted: str = PREDICTED) -> Column:
    return _nei() | covered(F.col("evidence"), first_k(F.col(predicted), k))


def strict_correct(k: int | Column | None = TOP, predicted: str = PREDICTED) -> Column:
    return label_correct() & evidence_correct(k, predicted)


def macro_precision(k: int | Column | None = TOP, predicted: str = PREDICTED) -> Column:
    """Share of the first k predictions found in any gold group; 1 without predictions; null for claims without enough information."""
    top, gold = first_k(F.col(predicted), k), F.flatten("evidence")
    hits = F.size(F.filter(top, lambda e: F.array_contains(gold, e)))
    return F.when(~_nei(), F.when(F.size(top) == 0, 1.0).otherwise(hits / F.size(top)))


def macro_recall(k: int | Column | None = TOP, predicted: str = PREDICTED) -> Column:
    hit = covered(F.col("evidence"), first_k(F.col(predicted), k)) | no_gold(F.col("evidence"))
    return F.when(~_nei(), hit.cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def _verification_means(k: int | Column | None, predicted: str = PREDICTED) -> list[Column]:
    return [
        _share(strict_correct(k, predicted)).alias("strict"), _share(label_correct()).alias("accuracy"),
        F.coalesce(F.avg(macro_precision(k, predicted)), F.lit(1.0)).alias("precision"), F.coalesce(F.avg(macro_recall(k, predicted)), F.lit(0.0)).alias("recall"),
    ]


def verification_scores(rows: DataFrame, predicted: dict[float, str], k: int | Column | None = TOP, key: str = "threshold") -> DataFrame:
    """verification_score of several predicted lists in one pass over the rows, their means side by side: a row for each name in ``predicted`` (name -> column). Without rows there is no result row."""
    means = rows.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(name).alias(key), *_verification_means(k, column)) for name, column in predicted.items()]).alias("all"))
    return means.filter("n > 0").select(F.inline("all")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def verification_score(rows: DataFrame, k: int | Column | None = TOP, by: list[str] | None = None) -> DataFrame:
    """strict, accuracy, precision, recall, f1; a row for each value of ``by``. Precision is 1 and recall 0 without any claim that counts."""
    got = rows.groupBy(*(by or [])).agg(*_verification_means(k))
    return got.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def micro_precision(rows: DataFrame) -> DataFrame:
    """Hits over predictions, summed, without a cut; claims with enough information only."""
    gold = F.flatten("evidence")
    hits = F.size(F.filter("predicted_evidence", lambda e: F.array_contains(gold, e)))
    return rows.filter(~_nei()).agg(F.try_divide(F.sum(hits).cast("double"), F.sum(F.size("predicted_evidence")).cast("double")).alias("micro_precision"))


# --- documents


def gold_docs(groups: Column) -> Column:
    return F.array_distinct(_docs(F.flatten(groups)))


def doc_hit(k: int | Column | None = TOP, predicted: str = "predicted_docids") -> Column:
    """All documents of some group are among the first k."""
    groups = F.transform("evidence", _docs)
    top = first_k(F.col(predicted), k)
    hit = F.exists(groups, lambda g: (F.size(g) > 0) & F.forall(g, lambda d: F.array_contains(top, d)))
    return _nei() | F.coalesce(hit, F.lit(False))


def doc_macro_precision(k: int | Column | None = TOP, predicted: str = "predicted_docids") -> Column:
    top = first_k(F.col(predicted), k)
    hits = F.size(F.filter(top, lambda d: F.array_contains(gold_docs(F.col("evidence")), d)))
    return F.when(~_nei(), F.when(F.size(top) == 0, 1.0).otherwise(hits / F.size(top)))


def doc_macro_recall(k: int | Column | None = TOP, predicted: str = "predicted_docids") -> Column:
    return F.when(~_nei(), (doc_hit(k, predicted) | no_gold(F.col("evidence"))).cast("double"))


def _doc_means(k: int | Column | None, predicted: str) -> list[Column]:
    return [
        _share(doc_hit(k, predicted)).alias("hit"), F.avg(doc_macro_precision(k, predicted)).alias("precision"), F.avg(doc_macro_recall(k, predicted)).alias("recall"),
        F.avg(F.size(first_k(F.col(predicted), k))).alias("mean_docs"),
    ]


def doc_score(rows: DataFrame, k: int | Column | None = TOP, predicted: str = "predicted_docids", by: list[str] | None = None) -> DataFrame:
    """hit rate, precision, recall, f1, mean number of documents considered."""
    return rows.groupBy(*(by or [])).agg(*_doc_means(k, predicted)).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def metrics_at_k(rows: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20), predicted: str = "predicted_docids") -> DataFrame:
    """doc_score for several k in one pass over the rows: the means of each k are aggregates side by side. Without rows there is no result row."""
    means = rows.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(k).alias("k"), *_doc_means(k, predicted)) for k in ks]).alias("all"))
    return means.filter("n > 0").select(F.inline("all")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def sentence_hit(ids: str = "predicted_sentids", k: int = TOP) -> Column:
    """A group's packed ids are all among the first k of the ids in falling lexical order."""
    top = F.slice(F.sort_array(F.col(ids), False), 1, k)
    return _nei() | F.coalesce(F.exists("gold_sentids", lambda g: (F.size(g) > 0) & F.forall(g, lambda e: F.array_contains(top, e))), F.lit(False))


def doc_f1(rows: DataFrame, predicted: str = "predicted_docids") -> DataFrame:
    """Mean of 2 * common / (gold + predicted) over claims with gold documents, and the mean size of predictions."""
    gold, got = gold_docs(F.col("evidence")), F.array_distinct(F.col(predicted))
    each = F.when(F.size(gold) > 0, 2 * F.size(F.array_intersect(gold, got)) / (F.size(gold) + F.size(got)))
    return rows.agg(F.avg(each).alias("doc_f1"), F.avg(F.size(predicted)).alias("mean_docs"))


def size_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.size(column).alias("n_items")).agg(F.count("*").alias("n_claims"))


def empty_evidence_by_label(rows: DataFrame) -> DataFrame:
    empty = F.sum((F.size("predicted_evidence") == 0).cast("long"))
    return rows.groupBy("label").agg(empty.alias("n_empty"), F.count("*").alias("n_claims")).withColumn("ratio", F.col("n_empty") / F.col("n_claims"))


def error_rows(rows: DataFrame, kind: str = "evidence", k: int = TOP) -> DataFrame:
    """Claims with a right label and wrong evidence (``evidence``), a wrong label (``label``), or missed documents (``retrieval``)."""
    tests = {"evidence": lambda: label_correct() & ~evidence_correct(k), "label": lambda: ~label_correct(), "retrieval": lambda: ~doc_hit(k)}
    return rows.filter(tests[kind]())


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_report(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, f1, support; and the correlation of all classes (the same in each row)."""
    cells = confusion(rows, true, predicted)
    t = cells.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    each = t.join(p.hint("merge"), "label", "full").fillna(0, ["support", "hits", "n_predicted"])
    sums = each.agg(F.sum("support").alias("s"), F.sum("hits").alias("c"), F.sum(F.col("n_predicted") * F.col("support")).alias("pt"), F.sum(F.col("n_predicted") ** 2).alias("pp"), F.sum(F.col("support") ** 2).alias("tt"))
    s2 = F.col("s") * F.col("s")
    rk = F.try_divide((F.col("c") * F.col("s") - F.col("pt")).cast("double"), F.sqrt(s2 - F.col("pp")) * F.sqrt(s2 - F.col("tt")))
    precision = F.try_divide(F.col("hits").cast("double"), F.col("n_predicted").cast("double"))
    recall = F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double"))
    each = each.crossJoin(F.broadcast(sums.select(rk.alias("correlation"))))  # one row
    return each.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), "correlation")


def selection_recall(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of gold pairs with prob >= threshold."""
    return pairs.filter("selection_label = 'true'").agg(_share(F.col("prob") >= threshold).alias("recall"))


def selection_accuracy(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    right = (F.col("prob") >= threshold) == (F.col("selection_label") == "true")
    return pairs.agg((100 * _share(right)).alias("accuracy"))


def oracle_score(rows: DataFrame, k: int | None = TOP) -> DataFrame:
    """Upper bound: gold label and first gold group as the prediction."""
    first = F.coalesce(F.get("evidence", F.lit(0)), F.slice("predicted_evidence", 1, 0))
    return verification_score(rows.withColumns({"predicted_label": F.col("label"), "predicted_evidence": first}), k)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n_claims"))


def evidence_profile(rows: DataFrame) -> DataFrame:
    """Claims by number of gold groups, and how many of those have three or more."""
    return rows.groupBy(F.size("evidence").alias("n_groups")).agg(F.count("*").alias("n_claims"), F.sum((F.size("evidence") >= 3).cast("long")).alias("n_with_three"))
