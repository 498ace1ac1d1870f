"""The pair scorer: features against brute force, folds, and held-out order of pairs."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.plans import pair_scorer as P

CLAIMS = [(0, "The cold river runs north north"), (1, "A warm lake"), (2, ""), (3, None)]
TEXTS = [
    (0, 1, 0, "the river is cold, cold and runs"),
    (0, 1, 1, "hot air"),
    (1, 2, 0, "a lake of the north"),
    (1, 2, 1, None),
    (2, 3, 0, "the"),
    (3, 4, 0, ""),
    (1, 5, 0, "lake " * 500),
    (0, 6, 0, "the water the stream"),
]
LEXICON = [("cold", "antonym", "hot"), ("river", "hypernym", "stream"), ("river", "hypernym", "water"), ("lake", "hypernym", "water")]
PAIR = "claim_id long, doc_id long, line_num int, text string"


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(claim, text, n, df):
    q, t = Counter(words(claim)), Counter(words(text))
    idf = {w: math.log((n - df[w] + 0.5) / (df[w] + 0.5)) for w in q if 0 < df[w] < n - df[w]}
    same = [w for w in q if w in t]
    weight = {w: math.log1p(q[w]) * idf[w] for w in idf}
    total = sum(weight.values())
    related = lambda rel: len({d for s, r, d in LEXICON if r == rel and s in q and d in t})
    return (
        len(same),
        len(same) / max(1, len(q)),
        len(same) / max(1, len(t)),
        math.log1p(len(t)),
        sum(weight[w] * idf[w] * math.log1p(t[w]) for w in same if w in idf),
        sum(weight[w] for w in same if w in idf) / total if total else 0.0,
        related("antonym"),
        related("hypernym"),
    )


def test_features_equal_brute_force(spark):
    claims = spark.createDataFrame(CLAIMS, "claim_id long, query string")
    pairs = spark.createDataFrame(TEXTS, PAIR).withColumn("_t", F.lit("clash"))
    table = P.claim_table(claims, pairs, spark.createDataFrame(LEXICON, "src string, rel string, dst string"))
    got = {(r.claim_id, r.doc_id, r.line_num): tuple(r[f] for f in P.FEATURES) for r in P.pair_features(pairs, table).collect()}
    df = Counter(w for *_, t in TEXTS for w in set(words(t)))
    assert got.keys() == {t[:3] for t in TEXTS}
    for c, d, i, text in TEXTS:
        assert got[c, d, i] == pytest.approx(brute(CLAIMS[c][1], text, len(TEXTS), df)), (c, d, i)


def test_features_of_empty_tables(spark):
    claims, pairs = spark.createDataFrame([], "claim_id long, query string"), spark.createDataFrame([], PAIR)
    rows = P.pair_features(pairs, P.claim_table(claims, pairs)).withColumn("selection_label", F.lit("hidden"))
    assert P.cross_fit(rows).collect() == []


def auc(rows):
    true, false = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    return sum((a > b) + (a == b) / 2 for a in true for b in false) / (len(true) * len(false))


@pytest.fixture(scope="module")
def rare(spark):
    """Every text shares two words with its claim: a rare one and a common one, or two common ones; rare ones are labelled true."""
    claims = [(c, f"key{c} common{c % 3} common{(c + 1) % 3} plain") for c in range(60)]
    pairs = []
    for c in range(60):
        for i in range(6):
            text = f"key{c} common{c % 3} filler{i}" if i % 3 == 0 else f"common{c % 3} common{(c + 1) % 3} filler{i}"
            pairs.append((c, c, i, text, "true" if i % 3 == 0 else "false"))
    claims = spark.createDataFrame(claims, "claim_id long, query string")
    pairs = spark.createDataFrame(pairs, PAIR + ", selection_label string")
    rows = P.pair_features(pairs, P.claim_table(claims, pairs))
    return rows.join(pairs.select("claim_id", "doc_id", "line_num", "selection_label"), ["claim_id", "doc_id", "line_num"])


def test_held_out_order_beats_the_untrained_overlap(spark, rare):
    rows = P.cross_fit(rare).select("prob", "share_query", "selection_label", "score").collect()
    assert auc([(r.prob, r.selection_label == "true") for r in rows]) > 0.95
    assert auc([(r.share_query, r.selection_label == "true") for r in rows]) < 0.6
    assert all(0 <= r.prob <= 1 and (r.prob > 0.5) == (r.score > 0) for r in rows)


def test_a_fold_is_not_seen_by_its_own_model(spark, rare):
    """Turning a fold's labels around leaves its own scores as they are and changes the other folds'."""
    keys = ["claim_id", "doc_id", "line_num"]
    turned = F.when(P.fold_of() == 0, F.when(F.col("selection_label") == "true", "false").otherwise("true")).otherwise(F.col("selection_label"))
    before = {tuple(r[k] for k in keys): r for r in P.cross_fit(rare).collect()}
    after = {tuple(r[k] for k in keys): r for r in P.cross_fit(rare.withColumn("selection_label", turned)).collect()}
    folds = Counter(r.fold for r in before.values())
    assert set(folds) == {0, 1, 2}
    assert len({(r.claim_id, r.fold) for r in before.values()}) == 60  # a claim lies in one fold
    for k, r in before.items():
        if r.fold == 0:
            assert after[k].score == pytest.approx(r.score, abs=1e-6)
    assert any(abs(after[k].score - r.score) > 0.1 for k, r in before.items() if r.fold != 0)


def test_without_both_labels_the_overlap_scores(spark, rare):
    rows = P.cross_fit(rare.withColumn("selection_label", F.lit("false"))).collect()
    assert all(r.score == pytest.approx(10 * r.share_query - 5) for r in rows)
