"""Relations are found from a token upwards: a word with very many words below it brings no rows of its own."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lexical as L


@pytest.fixture
def joins_by_shuffles(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    all_ = sc.statusStore().executorList(False)
    return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))


def test_pairs_follow_the_words_above(spark, joins_by_shuffles):
    words, claims = 10_000, 40
    lex = spark.range(words).select(F.lit("hypernym").alias("rel"), F.concat(F.lit("the"), "id").alias("src"), F.lit("the").alias("dst"))
    side = lambda token: spark.range(claims).select(F.col("id").alias("claim_id"), token.alias("token"), token.alias("lemma"), F.lit(None).cast("string").alias("stem"))
    before = _shuffled(spark)
    got = L.pair_features(side(F.lit("the")), side(F.concat(F.lit("the"), "id")), lex).collect()
    assert _shuffled(spark) - before < 2_000_000  # every "the" with all words below it: 400,000 rows
    on = {(r["claim_id"], r["token"]): {(L.FAMILIES[i // 3], i % 3) for i, x in enumerate(r["flags"]) if x} for r in got}
    assert len(on) == 2 * claims
    assert on[3, "the"] == {("desc", 0), ("desc", 2), ("hypo_1", 0), ("hypo_1", 2)}
    assert on[3, "the3"] == {("anc", 1), ("anc", 2), ("hyper_1", 1), ("hyper_1", 2)}
