"""The two-hop verification pipeline, pluggable scorers, and reuse of finished steps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import candidates as T
from evidentia.operators import docs as D
from evidentia.operators import linking as K
from evidentia.operators import select as E
from evidentia.operators import training_rows as N
from evidentia.operators.metrics import NEI, verification_score
from evidentia.operators.tfidf import words

#: Adds ``score`` and ``prob`` to pairs of (text, query).
Scorer = Callable[[DataFrame], DataFrame] | Transformer
FEATURES = ("shared", "share_query", "share_text", "length")


def filter_examples(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows a user's predicate keeps; null counts as no."""
    return rows.filter(F.coalesce(predicate, F.lit(False)))


def overlap_features(pairs: DataFrame) -> DataFrame:
    q, t = F.array_distinct(words(F.col("query"))), F.array_distinct(words(F.col("text")))
    same = F.size(F.array_intersect(q, t)).cast("double")
    return pairs.withColumns({"shared": same, "share_query": same / F.greatest(F.size(q), F.lit(1)), "share_text": same / F.greatest(F.size(t), F.lit(1)), "length": F.log1p(F.size(t).cast("double"))})


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Pairs with score and prob from a function of DataFrames (a pandas_udf inside is fine) or an ML Transformer."""
    out = scorer.transform(pairs) if isinstance(scorer, Transformer) else scorer(pairs)
    missing = {"score", "prob"} - set(out.columns)
    if missing:
        raise ValueError(f"the scorer gives no {sorted(missing)}")
    return out


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """Untrained: the share of the query's words that the text has."""
    f = overlap_features(pairs)
    return f.withColumns({"score": F.col("share_query") * 10 - 5, "prob": F.col("share_query")}).drop(*FEATURES)


def train_scorer(pairs: DataFrame) -> Scorer:
    """The bundled baseline: logistic regression on overlap features, trained on labelled pairs in Spark."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = assembler.transform(overlap_features(pairs.filter("selection_label in ('true', 'false')"))).withColumn("y", (F.col("selection_label") == "true").cast("double"))
    model = LogisticRegression(labelCol="y", maxIter=30, regParam=1e-3).fit(rows.select("features", "y"))

    def score(new: DataFrame) -> DataFrame:
        out = model.transform(assembler.transform(overlap_features(new)))
        prob = vector_to_array("probability")[1]
        return out.withColumns({"prob": prob, "score": vector_to_array("rawPrediction")[1]}).drop(*FEATURES, "features", "rawPrediction", "probability", "prediction")

    return score


def content_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order and partitions; one scan."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]).cast("decimal(38,0)")).alias("x")).first()
    return hashlib.sha256(repr((df.dtypes, row["n"], row["x"])).encode()).hexdigest()


@dataclass
class Steps:
    """Runs named steps, each result a Parquet table in ``folder`` with a manifest beside it.

    The manifest holds a digest of the step's inputs (tables by content, or texts as they are) and parameters, and is written when the table is finished. With
    ``resume`` a step whose manifest has the same digest is read, not run; one with other inputs or parameters, or whose table was left half-written,
    runs again, and so do steps that name it as an input.
    """

    spark: SparkSession
    folder: str
    resume: bool = True
    ran: list[str] = field(default_factory=list)
    digests: dict[str, str] = field(default_factory=dict)

    def __call__(self, name: str, make: Callable[[], DataFrame], inputs: Sequence[DataFrame | str] = (), params: dict | None = None) -> DataFrame:
        """``inputs``: tables, names of earlier steps, or digests that ``content_digest`` gave."""
        path = f"{self.folder.rstrip('/')}/{name}"
        own = [content_digest(x) if isinstance(x, DataFrame) else self.digests.get(x, x) for x in inputs]
        digest = hashlib.sha256(json.dumps([name, own, params or {}], sort_keys=True, default=repr).encode()).hexdigest()
        if not (self.resume and self._held(path) == digest):
            self.spark.createDataFrame([], "digest string").write.mode("overwrite").json(f"{path}.manifest")  # no word of the old table while the new one is written
            make().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
            self.ran.append(name)
        self.digests[name] = digest
        return self.spark.read.parquet(path)

    def _held(self, path: str) -> str | None:
        try:
            rows = self.spark.read.schema("digest string").json(f"{path}.manifest").take(1)
        except AnalysisException:  # no such step yet
            return None
        return rows[0]["digest"] if rows else None


def two_hop(steps: Steps, claims: DataFrame, index: DataFrame, views: DataFrame, sentences: DataFrame, link_rows: DataFrame, scorer: Scorer, verifier: Callable[[DataFrame], DataFrame], method: str = "pageview", frequencies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, metrics) for claims (claim_id, claim, tokens, lemmas, label, evidence).

    Links and ranks documents; scores and selects sentences; follows the best sentence's links for a second hop; selects
    again over both; ``verifier`` turns (claim_id, claim, evid) into logits; evidence of claims without enough
    information is cleared, and lists are filled up in two later steps.
    """
    def links_of() -> DataFrame:
        links = K.rule_chain(None, K.preset(method, claims, index, views, frequencies))
        exact = D.exact_title_first(D.reset_bracket_priority(links).withColumn("pos", F.lit(0)), claims)
        return exact.select("claim_id", F.lit("").alias("match_key"), "doc_id", "priority")

    tables = {"claims": claims, "index": index, "views": views, "sentences": sentences, "links": link_rows} | ({"frequencies": frequencies} if frequencies is not None else {})
    held = {k: content_digest(v) for k, v in tables.items()}
    models = {"scorer": getattr(scorer, "__name__", repr(scorer)), "verifier": getattr(verifier, "__name__", repr(verifier))}
    links = steps("documents", links_of, [held["claims"], held["index"], held["views"], held.get("frequencies", "")], {"method": method})
    query = claims.select("claim_id", F.col("claim").alias("query"))

    def scored(docs: DataFrame, hop: int) -> DataFrame:
        pairs = T.sentence_candidates(docs, sentences).withColumn("text", T.prefix_title()).join(query.hint("merge"), "claim_id")
        return score_pairs(pairs, scorer).select("claim_id", "doc_id", "line_num", "score", "prob", F.lit(hop).alias("pos"))

    first = steps("sentences", lambda: scored(D.topk_docs(links, 10), 1), ["documents", held["claims"], held["sentences"]], models)
    best = E.best_rows(first, 0.1, 5).select("claim_id", "doc_id", "line_num", "score")
    aside = steps("second_hop", lambda: D.new_docs_only(D.pageview_rank(D.sentence_links_as_candidates(D.best_sentence_links(D.expand_from_sentences(best, link_rows))), views), links), ["documents", "sentences", held["links"], held["views"]])
    second = steps("second_sentences", lambda: scored(D.topk_docs(aside, 6), 2), ["second_hop", held["claims"], held["sentences"]], models)

    def verify() -> DataFrame:
        chosen = E.select_unique(first, claims.select("claim_id", "claim", "label", "evidence"), 0.1, 5)
        rows = chosen.select("claim_id", F.explode("predicted_evidence").alias("e")).select("claim_id", "e.doc_id", "e.line_num")
        logits = verifier(N.eval_rows(claims, rows, sentences)).select("claim_id", "logits")
        return E.label_from_logits(chosen.join(logits.hint("merge"), "claim_id"))

    verdicts = E.clear_nei_evidence(steps("verdicts", verify, ["sentences", held["claims"], held["sentences"]], models))
    verdicts = E.clear_nei_evidence(E.append_selected(verdicts, second, 0.9, 1, 5))
    verdicts = E.clear_nei_evidence(E.append_selected(verdicts, first, -1.0, 100, 100))
    verdicts = steps("final", lambda: verdicts, ["verdicts", "second_sentences", "sentences"])
    return verdicts, verification_score(verdicts)


def overlap_verifier(rows: DataFrame) -> DataFrame:
    """Untrained logits for the demonstration: support grows with the share of the claim's words that the evidence has."""
    f = overlap_features(rows.select("claim_id", F.col("claim").alias("query"), F.col("evid").alias("text")))
    return f.select("claim_id", F.array(F.col("share_query") * 4 - 1, F.lit(-1.0), 1 - F.col("share_query") * 2).alias("logits"))


__all__ = ["NEI", "Scorer", "Steps", "filter_examples", "overlap_features", "overlap_scorer", "overlap_verifier", "score_pairs", "train_scorer", "two_hop"]
