"""Rules over the main and the aside list, and the walk from hop to hop."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.operators import spiral


@pytest.fixture(scope="module")
def state(spark):
    claims = spark.createDataFrame([(0, "The Alpha met Beta".split(), None), (1, "Nothing here".split(), None)], "claim_id long, tokens array<string>, lemmas array<string>")
    index = spark.createDataFrame([("Alpha", "Alpha", 5.0), ("Alpha", "Alpha_-LRB-film-RRB-", 1.0), ("The Alpha", "The_Alpha", 5.0), ("Beta", "Beta", 5.0)], "keyword string, doc_id string, priority double")
    views = spark.createDataFrame([("Alpha", 3), ("Alpha_(film)", 9), ("C", 5), ("D", 7)], "doc string, views long")
    selected = spark.createDataFrame([(0, "Beta", 0, 0.9), (0, "Beta", 1, 0.2), (1, "Z", 0, 0.5)], "claim_id long, doc_id string, line_num int, score double")
    graph = spark.createDataFrame([("Beta", 0, "C"), ("Beta", 0, "D"), ("Beta", 1, "Q"), ("C", 0, "E"), ("D", 0, "Beta"), ("D", 0, "F"), ("F", 0, "D")], "doc_id string, line_num int, target string")
    return spiral.Hops(claims, index, views, selected, graph)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_presets(state):
    first = spiral.run_rules(state, "first_hop")
    assert first.aside is None
    # 'The Alpha' is the longest match; without the article Alpha's two documents join, ranked by views
    assert rows(first.links, "match_key", "doc_id", "priority") == {("The Alpha", "The_Alpha", 5.0), ("Beta", "Beta", 5.0), ("Alpha", "Alpha_-LRB-film-RRB-", 1.0), ("Alpha", "Alpha", 0.8)}
    second = spiral.run_rules(state, "second_hop")
    assert second.links is None
    assert rows(second.aside, "claim_id", "match_key", "doc_id", "priority") == {(0, "Beta<SENT_LINE>0", "D", 1.0), (0, "Beta<SENT_LINE>0", "C", 0.8)}
    both = spiral.run_rules(state, "spiral")
    assert rows(both.links, *spiral.LINK) == rows(first.links, *spiral.LINK) and rows(both.aside, *spiral.LINK) == rows(second.aside, *spiral.LINK)
    assert rows(spiral.run_rules(state, "first_hop_no_views").links, "doc_id", "priority") >= {("Alpha", 5.0)}
    assert spiral.run_rules(state, [lambda h: h]) is state


def test_walk_ends_at_visited_documents(state):
    first = spiral.run_rules(state, "first_hop")
    score = F.when(F.col("doc_id") == "D", 2.0).otherwise(1.0)
    choose = lambda docs: docs.select("claim_id", "doc_id", F.lit(0).alias("line_num"), score.alias("score"))
    got = rows(spiral.follow(first, choose, 9), "claim_id", "doc_id", "hop")
    # D's sentence leads back to Beta, which was visited, and to F; F leads back to D
    assert got == {(0, "C", 2), (0, "D", 2), (0, "F", 3)}
    assert rows(spiral.follow(first, choose, 1), "doc_id", "hop") == {("C", 2), ("D", 2)}
    assert spiral.follow(spiral.Hops(**{**first.__dict__, "selected": first.selected.filter("claim_id > 5")}), choose).count() == 0


def test_only_the_best_sentences_links_are_made(spark):
    selected = spark.createDataFrame([(1, "a", 0, 3.0), (1, "a", 0, 1.0), (1, "b", 0, 3.0), (1, "c", 0, 9.0), (2, "b", 0, -200.0)], "claim_id long, doc_id string, line_num int, score double")
    links = spark.createDataFrame([("a", 0, "X"), ("a", 0, "Y"), ("b", 0, "Z")], "doc_id string, line_num int, target string")
    views = spark.createDataFrame([("Y", 5)], "doc string, views long")
    state = spiral.run_rules(spiral.Hops(selected=selected, link_rows=links, views=views), "second_hop")
    whole = spiral.run_rules(spiral.Hops(selected=selected, link_rows=links, views=views), [spiral.from_sentences, spiral.best_aside, spiral.aside_by_views])
    assert sorted(map(tuple, state.aside.collect())) == sorted(map(tuple, whole.aside.collect())) != []
    assert {(r["claim_id"], r["sent_doc"]) for r in state.targets.collect()} == {(1, "a")}  # c has no links, the claim 2 no score above the least
    assert {(r["claim_id"], r["sent_doc"]) for r in whole.targets.collect()} == {(1, "a"), (1, "b"), (2, "b")}
