"""Joins with tables that grow don't go through the driver, however small Spark guesses the tables, and rule chains run each rule once."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import candidates as T
from evidentia.operators import linking as K
from evidentia.operators import training_rows as N


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def evidence(spark):
    claims = spark.createDataFrame([(1, "a claim", "SUPPORTS", [[(7, 1)]]), (2, "another", "NOT ENOUGH INFO", [])], "claim_id long, claim string, label string, evidence array<array<struct<doc_id:long,line_num:int>>>")
    selected = spark.createDataFrame([(1, 7, 1, 0.5, 0.9), (2, 8, 1, 0.4, 0.8)], "claim_id long, doc_id long, line_num int, score double, prob double")
    sentences = spark.createDataFrame([(7, 1, "seven"), (8, 1, "eight")], "doc_id long, line_num int, text string")
    return claims, selected, sentences


def test_training_rows_join_by_shuffles(spark, evidence):
    claims, selected, sentences = evidence
    made = [N.training_rows(*evidence), N.training_rows_scored(*evidence, selected), N.training_rows_scored(*evidence, selected, selected.select("claim_id", "doc_id", "prob")), N.eval_rows(*evidence), N.adversarial_rows(*evidence)]
    assert [x for x in map(_plan, made) if "Broadcast" in x] == []
    assert [r["evid"] for r in N.eval_rows(*evidence).orderBy("claim_id").collect()] == ["7 <t> seven", "8 <t> eight"]


def test_missing_gold_pairs_join_by_shuffles(spark, evidence):
    claims, selected, sentences = evidence
    assert "Broadcast" not in _plan(T.missing_gold_pairs(T.gold_sentences(claims), selected.filter("claim_id = 2"), sentences))


def test_keywords_are_broadcast_behind_a_count(spark, monkeypatch):
    claims = spark.createDataFrame([(1, ["New", "York", "is", "big"])], "claim_id long, tokens array<string>")
    index = spark.createDataFrame([("New York", "New_York", 5.0), ("big", "Big", 5.0)], "keyword string, doc_id string, priority double")
    few = K.link_keywords(claims, index)
    monkeypatch.setattr(K, "BROADCAST_KEYWORDS", 1)
    many = K.link_keywords(claims, index)
    assert "BroadcastHashJoin" in _plan(few) and "BroadcastHashJoin" not in _plan(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_a_rule_chain_runs_each_rule_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        seen.add(1)
        return x

    first = lambda links: spark.range(10).select(count("id").alias("id"))
    twice = lambda links: links.unionByName(links)
    assert K.rule_chain(None, [first, twice, twice]).count() == 40
    assert seen.value == 10


def test_a_small_index_is_broadcast_to_the_matches(spark, monkeypatch):
    claims = spark.createDataFrame([(1, ["New", "York", "is", "big"])], "claim_id long, tokens array<string>")
    index = spark.createDataFrame([("New York", "New_York", 5.0), ("big", "Big", 5.0)], "keyword string, doc_id string, priority double")
    few = K.link_keywords(claims, index)
    multi = K.link_keywords_multi(claims, index)
    assert _plan(few).count("BroadcastHashJoin") == 3 and "hashpartitioning(match_key" not in _plan(few) + _plan(multi)
    monkeypatch.setattr(K, "BROADCAST_KEYWORDS", 1)
    many = K.link_keywords(claims, index)
    assert "hashpartitioning(match_key" in _plan(many) and sorted(few.collect()) == sorted(many.collect())


def test_texts_are_split_once(spark):
    from evidentia.plans import registry

    plan = _plan(registry.queries()["c7_filter_ngram"](spark, "/root/testdata/sf0.001"))
    assert plan.count("split(text") == 1
