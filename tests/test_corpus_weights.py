"""A corpus's weights from one shuffle of its terms, against counting, frequencies and weights one by one."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import tfidf
from evidentia.plans import registry
from evidentia.plans import standins as X

TEXTS = ["New York is new", "york new york", "the new of york", "new", "", None, "a b a b a b", "New\nYork, new-york", "NEW K2 K2 ñandú İ1", "word " * 30 + "york"]


def _shuffled(spark):
    """Records that all finished stages wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("repeated", [False, True])
def test_weights_of_a_corpus(spark, monkeypatch, n, repeated):
    rows = [(d, i, t) for d in ("a", "b", None) for i, t in enumerate(TEXTS)] + [("a", 3, "york new"), (None, 4, "sea")] * repeated
    docs = spark.createDataFrame(rows, "d string, line int, text string").repartition(3)
    counts = tfidf.ngram_counts(docs, ["d", "line"], n)
    rounded = lambda df: sorted((tuple(r) for r in df.select("d", "line", "term", "tf", F.round("weight", 9)).collect()), key=str)
    want = rounded(tfidf.tfidf_weights(counts, tfidf.idf_table(counts, docs)))
    monkeypatch.setattr(tfidf, "PIECE_CHARS", 20)
    monkeypatch.setattr(tfidf, "PIECE_ROWS", 3)
    assert want and rounded(tfidf.corpus_weights(docs, ["d", "line"], n, spread=5)) == want


def test_a_row_a_document_and_term_is_shuffled(spark):
    d = "/root/testdata/sf0.001"
    rows, lines = registry.queries()["t1_ngram_counts"](spark, d).count(), X.lines(spark, d).count()
    before = _shuffled(spark)
    registry.queries()["t3_tfidf_weights"](spark, d).write.format("noop").mode("overwrite").save()
    assert rows <= _shuffled(spark) - before < rows + 2 * lines + 1000
