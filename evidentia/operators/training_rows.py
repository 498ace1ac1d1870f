"""Verification training and evaluation tables from claims, gold groups and selected sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators.metrics import NEI
from evidentia.operators.select import attach_scores, best_rows, hash_fraction

SENT = ["doc_id", "line_num"]
MOST = 5


def _seeded(rows: Column, take: Column, *keys: Column | str, seed: int) -> Column:
    """The first ``take`` sentences of an array in a seeded order of the keys and the sentence."""
    order = F.sort_array(F.transform(rows, lambda x: F.struct(hash_fraction(*keys, x["doc_id"], x["line_num"], seed=seed).alias("_h"), x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"))))
    return F.slice(order, F.lit(1), take.cast("int"))


def _sentences(rows: Column, added: bool) -> Column:
    return F.transform(rows, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num"), F.lit(added).alias("added")))


def augment_evidence(claims: DataFrame, selected: DataFrame, seed: int = 12, top: int = 0) -> DataFrame:
    """(claim_id, label, group_id, doc_id, line_num, added): evidence groups filled up with selected sentences.

    Claims with enough information: each gold group of n < 5 sentences plus a random 0..5-n of the claim's selected ones.
    Others: one group of 2 to 5 random selected ones, or, with ``top``, the top by score plus 0 to 2 random ones. ``added``
    marks what isn't gold. Random means a seeded hash of the row's key. A claim's selected sentences travel as one list, as
    its groups do, so that claims and selection are joined once, by claim.
    """
    rows = selected.select("claim_id", *SENT)
    if top:
        w = Window.partitionBy("claim_id").orderBy(F.desc("score"), *SENT)
        rows = selected.select("claim_id", *SENT, (F.row_number().over(w) <= top).alias("_top"))
    lists = rows.groupBy("claim_id").agg(F.collect_list(F.struct(*rows.columns[1:])).alias("_s"))
    both = claims.select("claim_id", "label", "evidence").join(lists.hint("merge"), "claim_id", "left")
    chosen = F.coalesce("_s", F.array().cast(dict(lists.dtypes)["_s"]))
    enough, none = F.col("label") != NEI, F.col("label") == NEI

    def filled(group: Column, i: Column) -> Column:
        gold = lambda x: F.coalesce(F.exists(group, lambda e: (e["doc_id"] == x["doc_id"]) & (e["line_num"] == x["line_num"])), F.lit(False))
        room = F.greatest(MOST - F.size(group), F.lit(0))
        fill = _seeded(F.filter(chosen, lambda x: ~gold(x)), F.floor(hash_fraction("claim_id", i, seed=seed) * (room + 1)), "claim_id", i, seed=seed + 1)
        return F.struct(i.alias("group_id"), F.concat(_sentences(group, False), _sentences(fill, True)).alias("rows"))

    if top:
        rest = _seeded(F.filter(chosen, lambda x: ~x["_top"]), F.floor(hash_fraction("claim_id", seed=seed) * 3), "claim_id", F.lit(False), seed=seed + 2)
        picked = F.concat(_sentences(F.filter(chosen, lambda x: x["_top"]), True), _sentences(rest, True))
    else:
        picked = _sentences(_seeded(chosen, 2 + F.floor(hash_fraction("claim_id", seed=seed) * 4), "claim_id", seed=seed + 2), True)
    groups = F.when(enough, F.transform("evidence", filled)).when(none, F.array(F.struct(F.lit(0).alias("group_id"), picked.alias("rows"))))
    return both.select("claim_id", "label", F.explode(groups).alias("_g")).select("claim_id", "label", "_g.group_id", F.inline("_g.rows"))


def augment_evidence_v11(claims: DataFrame, selected: DataFrame, seed: int = 12) -> DataFrame:
    """As augment_evidence; claims without enough information get their two best sentences plus 0 to 2 random ones."""
    return augment_evidence(claims, selected, seed, top=2)


def titled_sentence(keys: list[str], mark: str = " <t> ") -> Column:
    """The sentence, with its title before it where the document changes and the line isn't 0."""
    before = F.lag("doc_id").over(Window.partitionBy(*keys).orderBy(*SENT))
    change = before.isNull() | (before != F.col("doc_id"))
    return F.when(change & (F.col("line_num") != 0), F.concat(C.natural_title(F.col("doc_id").cast("string")), F.lit(mark), "text")).otherwise(F.col("text"))


def evidence_text_list(rows: DataFrame, keys: list[str], mark: str = " <t> ") -> DataFrame:
    """(keys, texts): a text a sentence in the order of (doc, line); rows have text."""
    texts = rows.withColumn("_t", titled_sentence(keys, mark)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*SENT, "_t"))).alias("_l"))
    return texts.select(*keys, F.transform("_l", lambda x: x["_t"]).alias("texts"))


def evidence_text(rows: DataFrame, keys: list[str], mark: str = " <t> ") -> DataFrame:
    """(keys, evid): the texts joined by spaces."""
    return evidence_text_list(rows, keys, mark).select(*keys, F.array_join("texts", " ").alias("evid"))


def _row_id() -> Column:
    return F.concat_ws("#", "claim_id", F.row_number().over(Window.partitionBy("claim_id").orderBy("group_id")) - 1)


def _with_text(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Evidence rows with their texts, dealt by claim: what follows groups and joins within claims and needs no further shuffle of texts."""
    return rows.join(sentences.select(*SENT, "text").hint("merge"), SENT).repartition("claim_id")


def training_rows(claims: DataFrame, selected: DataFrame, sentences: DataFrame, seed: int = 12, top: int = 0) -> DataFrame:
    """(id, claim, evid, label): a row an evidence group."""
    groups = augment_evidence(claims, selected, seed, top)
    texts = evidence_text(_with_text(groups, sentences), ["claim_id", "group_id"])
    rows = texts.join(claims.select("claim_id", "claim", "label").hint("merge"), "claim_id")
    return rows.select(_row_id().alias("id"), "claim", "evid", "label")


def training_rows_scored(claims: DataFrame, selected: DataFrame, sentences: DataFrame, sentence_scores: DataFrame, doc_scores: DataFrame | None = None, seed: int = 12) -> DataFrame:
    """(id, claim, label, evid: array of (text, prob[, doc_prob])); missing probabilities get the defaults."""
    groups = _with_text(augment_evidence(claims, selected, seed), sentences)
    keys = ["claim_id", "group_id"]
    rows = attach_scores(groups.withColumn("_t", titled_sentence(keys)), sentence_scores, doc_scores)
    probs = [F.col("sent_prob").alias("prob")] + ([F.col("doc_prob")] if doc_scores is not None else [])
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*SENT, F.struct(F.col("_t").alias("text"), *probs).alias("v")))).alias("_l"))
    out = lists.select(*keys, F.transform("_l", lambda x: x["v"]).alias("evid")).join(claims.select("claim_id", "claim", "label").hint("merge"), "claim_id")
    return out.select(_row_id().alias("id"), "claim", "label", "evid")


def missing_scores(groups: DataFrame, sentence_scores: DataFrame) -> DataFrame:
    """How many evidence rows have no sentence score."""
    return groups.join(sentence_scores.select("claim_id", *SENT).hint("merge"), ["claim_id", *SENT], "left_anti").agg(F.count("*").alias("n_missing"))


def eval_rows(claims: DataFrame, selected: DataFrame, sentences: DataFrame) -> DataFrame:
    """(claim_id, claim, evid): selected evidence as text; claims without any get the empty text."""
    texts = evidence_text(_with_text(selected.select("claim_id", *SENT), sentences), ["claim_id"])
    return claims.select("claim_id", "claim").join(texts.hint("merge"), "claim_id", "left").fillna("", ["evid"])


def adversarial_rows(claims: DataFrame, pairs: DataFrame, sentences: DataFrame, threshold: float = 0.5, n: int = 8, seed: int = 12) -> DataFrame:
    """Training rows filled up from what the scorer selects."""
    return training_rows(claims, best_rows(pairs, threshold, n), sentences, seed)


def nli_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The published form: cid, query, context, label."""
    a = train.select(F.col("id").alias("cid"), F.col("claim").alias("query"), F.col("evid").alias("context"), "label")
    b = evaluation.select(F.col("claim_id").cast("string").alias("cid"), F.col("claim").alias("query"), F.col("evid").alias("context"), F.lit("hidden").alias("label"))
    return a.unionByName(b)


def text_length_stats(rows: DataFrame, column: str = "evid") -> DataFrame:
    n = rows.select(F.size(F.split(column, " ")).alias("n"))
    return n.agg(F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))


def mix_tasks(*tables: tuple[str, DataFrame]) -> DataFrame:
    """(id, task, premise, hypothesis, label) from verification (``vc``) and selection (``ss``) rows; another task is an error."""
    out = None
    for task, df in tables:
        if task not in ("vc", "ss"):
            raise ValueError(f"unknown task {task}")
        rows = df.select(F.col("id").cast("string").alias("id"), F.lit(task).alias("task"), "premise", "hypothesis", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


def pair_sequence(premise: Column | str, sentences: Column | str, max_sentences: int = 5, max_tokens: int = 64) -> Column:
    """Tokens ``[CLS] p [SEP] h [SEP]``, type ids and sentence spans: evidence capped in count and tokens."""
    p = F.split(premise, " ") if isinstance(premise, str) else F.split(premise, " ")
    parts = F.transform(F.slice(sentences, 1, max_sentences), lambda s: F.slice(F.split(s, " "), 1, max_tokens))
    head = F.concat(F.array(F.lit("[CLS]")), p, F.array(F.lit("[SEP]")))
    tail = F.concat(F.flatten(parts), F.array(F.lit("[SEP]")))
    spans = F.transform(C.token_spans(parts), lambda x: F.struct((x["start"] + F.size(head)).alias("start"), (x["end"] + F.size(head)).alias("end")))
    return F.struct(F.concat(head, tail).alias("tokens"), F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(F.lit(1), F.size(tail))).alias("types"), spans.alias("spans"))


def shuffle_sentences(column: str, key: str, seed: int = 12) -> Column:
    """The array's elements in a seeded order."""
    tagged = F.transform(column, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), x.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def token_features(tokens: DataFrame, lexical: DataFrame, sentence_probs: DataFrame, doc_probs: DataFrame | None = None, keep: tuple[str, ...] = ("lexical", "number", "prob")) -> DataFrame:
    """(claim_id, pos, features) for evidence tokens (claim_id, pos, token, doc_id, line_num).

    Lexical flags (an array of 30 by claim_id and token), five numbers from the token's number bucket, and the sentence's
    probability (and the document's). ``keep`` names the parts, for ablations.
    """
    rows = attach_scores(tokens, sentence_probs, doc_probs).join(lexical.hint("merge"), ["claim_id", "token"], "left")
    bucket = C.number_bucket("token")
    numbers = F.array(*[F.when(bucket.isNull(), 0.0).otherwise(F.conv(F.substring(F.md5(F.concat_ws("|", bucket.cast("string"), F.lit(str(i)))), 1, 8), 16, 10).cast("double") / float(1 << 32)) for i in range(5)])
    probs = F.array("sent_prob", *(["doc_prob"] if doc_probs is not None else []))
    parts = {"lexical": F.coalesce(F.transform("flags", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 30)), "number": numbers, "prob": probs}
    return rows.select("claim_id", "pos", F.concat(*[parts[k] for k in keep]).alias("features"))
