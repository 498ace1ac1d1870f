"""Evidence groups, scores and texts of a claim are joined where the claim lies: few shuffles, the same rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import training_rows as N
from evidentia.operators.select import attach_scores, hash_fraction

CLAIMS = "claim_id long, claim string, label string, evidence array<array<struct<doc_id:long,line_num:int>>>"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_are_shuffled_once_after_their_join(spark):
    claims = spark.createDataFrame([(1, "a claim", "SUPPORTS", [[(7, 1)]]), (2, "another", "NOT ENOUGH INFO", [])], CLAIMS)
    selected = spark.createDataFrame([(1, 7, 1, 0.5, 0.9), (2, 8, 1, 0.4, 0.8)], "claim_id long, doc_id long, line_num int, score double, prob double")
    sentences = spark.createDataFrame([(7, 1, "seven"), (8, 1, "eight")], "doc_id long, line_num int, text string")
    # claims and selection by claim, both sides of the texts, the texts back, scores, documents' scores and claims by claim
    assert _exchanges(N.training_rows_scored(claims, selected, sentences, selected, selected.select("claim_id", "doc_id", "prob"))) == 8
    assert _exchanges(N.training_rows(claims, selected, sentences)) == 6


@pytest.mark.parametrize("top", [0, 2])
def test_augmented_evidence_by_its_definition(spark, top):
    draw = random.Random(3)
    sentence = lambda: (draw.randint(0, 3), draw.randint(0, 2))
    label = lambda i: ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO", None][i % 4]
    claims = [(i, "c", label(i), None if i == 8 else [list({sentence() for _ in range(draw.randint(0, 6))}) for _ in range(draw.randint(0, 3))]) for i in range(40)]
    selected = [(c, *s, float(draw.randint(0, 3))) for c in range(45) if c % 7 for s in {sentence() for _ in range(draw.randint(0, 8))}] + [(0, 9, 9, 1.0), (0, 9, 9, 1.0)]
    asked = {(c, g, d, n) for c, _, _, e in claims for g in range(-1, 4) for d in [*range(4), 9] for n in [*range(3), 9]}
    h = spark.createDataFrame(sorted(asked), "c long, g int, d long, n int").withColumns({
        "take": hash_fraction("c", "g"), "fill": hash_fraction("c", "g", "d", "n", seed=13), "claim": hash_fraction("c"), "none": hash_fraction("c", "d", "n", seed=14), "rest": hash_fraction("c", F.lit(False), "d", "n", seed=14)})
    h = {(r.c, r.g, r.d, r.n): r for r in h.collect()}
    want = []
    for c, _, kind, groups in claims:
        mine = [(d, n, s) for i, d, n, s in selected if i == c]
        if kind in ("SUPPORTS", "REFUTES"):
            for g, group in enumerate(groups or []):
                want += [(c, kind, g, d, n, False) for d, n in group]
                rest = sorted((h[c, g, d, n].fill, d, n) for d, n, _ in mine if (d, n) not in group)
                take = int(h[c, g, 0, 0].take * (max(0, 5 - len(group)) + 1))
                want += [(c, kind, g, d, n, True) for _, d, n in rest[:take]]
        elif kind:
            best = sorted(mine, key=lambda x: (-x[2], x[0], x[1]))
            first = best[:top]
            order = sorted((h[c, -1, d, n].rest if top else h[c, -1, d, n].none, d, n) for d, n, _ in best[top:])
            many = int(h[c, -1, 0, 0].claim * 3) if top else 2 + int(h[c, -1, 0, 0].claim * 4)
            want += [(c, kind, 0, d, n, True) for d, n in [x[:2] for x in first] + [x[1:] for x in order[:many]]]
    got = N.augment_evidence(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(selected, "claim_id long, doc_id long, line_num int, score double"), top=top)
    assert got.columns == ["claim_id", "label", "group_id", "doc_id", "line_num", "added"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scores_are_found_within_the_claim(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, None, 0), (2, "a", 0), (3, "b", 2)], "claim_id long, doc_id string, line_num int")
    scores = spark.createDataFrame([(1, "a", 0, 0.1), (1, "b", 0, 0.2), (2, "a", 1, 0.3), (3, "b", 2, None)], "claim_id long, doc_id string, line_num int, prob double")
    docs = spark.createDataFrame([(1, "a", 0.6), (3, "a", 0.7)], "claim_id long, doc_id string, prob double")
    got = {tuple(r) for r in attach_scores(rows, scores, docs).collect()}
    assert got == {(1, "a", 0, 0.1, 0.6), (1, "a", 1, 0.5, 0.6), (1, None, 0, 0.5, 0.99), (2, "a", 0, 0.5, 0.99), (3, "b", 2, 0.5, 0.99)}
