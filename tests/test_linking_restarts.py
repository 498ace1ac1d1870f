"""The two-level trie and restarts within a claim, against the plain definition."""

import random

from test_operators import claims, index

from evidentia.functions import columns as C
from evidentia.operators import linking as K


def plain_restarts(tokens, keywords, fails):
    """Matches anew from the first token after each failing key, all matches discarded."""
    tokens = list(tokens)
    while True:
        at, taken, failed = 0, [], None
        while at < len(tokens):
            n = next((n for n in range(len(tokens) - at, 0, -1) if " ".join(tokens[at : at + n]) in keywords), 0)
            if n:
                key = " ".join(tokens[at : at + n])
                taken.append((key, at, at + n))
                if failed is None and key in fails:
                    failed = at
            at += max(n, 1)
        if failed is None:
            return taken
        del tokens[failed]


def test_restarts_equal_the_definition(spark):
    rng = random.Random(8)
    words = "a b c d e".split()
    seen = set()
    for _ in range(4):
        keywords = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(30)}
        # a document with another first letter makes a key fail; only keys of more than two words restart
        bad = {k for k in keywords if rng.random() < 0.5}
        kw = index(spark, [(k, ("z_" if k in bad else k[0] + "_") + k.replace(" ", "_"), 1.0) for k in keywords])
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
        fails = {k for k in bad if k.count(" ") > 1}
        stops = set(C.STOP_WORDS)
        want = {(i, *m) for i, t in enumerate(texts) for m in plain_restarts(t.split(), keywords, fails) if m[0] not in bad and m[0] not in stops}
        got = K.link_keywords_multi(claims(spark, *texts), kw).collect()
        assert {(r.claim_id, r.match_key, r.start, r.stop) for r in got} == want and len(got) == len(want)
        seen |= want
    assert len(seen) > 100


def test_three_hundred_failing_keys_take_no_more_jobs_than_one(spark):
    kw = index(spark, [("red green blue", "Colour", 5.0), ("Odyssey", "Odyssey", 5.0), ("blue Odyssey", "blue_Odyssey", 5.0)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        c = claims(spark, " ".join(["red green blue"] * n + ["Odyssey"]), "an Odyssey")
        spark.sparkContext.setJobGroup(f"restarts-{n}", "")
        got = {(r.claim_id, r.doc_id, r.start) for r in K.link_keywords_multi(c, kw).collect()}
        spark.sparkContext.setJobGroup("", "")
        return got, len(tracker.getJobIdsForGroup(f"restarts-{n}"))

    one, few = jobs(1)
    many, more = jobs(300)
    assert one == {(0, "blue_Odyssey", 1), (1, "Odyssey", 1)} and many == {(0, "blue_Odyssey", 599), (1, "Odyssey", 1)}
    assert more <= few + 2


def test_no_claims_no_keywords_and_ids_of_text(spark):
    kw = index(spark, [("red green blue", "Colour", 5.0), ("Odyssey", "Odyssey", 5.0)])
    assert K.link_keywords_multi(claims(spark, "x").limit(0), kw).count() == 0
    assert K.link_keywords_multi(claims(spark, "red green blue"), kw.limit(0)).count() == 0
    c = spark.createDataFrame([("q1", ["red", "green", "blue", "Odyssey"]), ("q2", []), ("q3", None), (None, ["Odyssey"])], "claim_id string, tokens array<string>")
    assert {(r.claim_id, r.doc_id) for r in K.link_keywords_multi(c, kw).collect()} == {("q1", "Odyssey"), (None, "Odyssey")}


def test_rows_looked_up_do_not_follow_the_longest_keyword(spark):
    """Two heads a place; a keyword of 60 words adds n-grams only where its head stands."""
    long = " ".join(f"w{i}" for i in range(60))
    kw = index(spark, [(long, "Long", 5.0), ("Odyssey", "Odyssey", 5.0)])
    trie = K.keyword_trie(kw)
    assert {r["head"]: r.lengths for r in trie.heads.collect()} == {"w0 w1": [60], "Odyssey": [1]}
    got = K.match_spans(claims(spark, "the " + long + " Odyssey", "w0 w1 Odyssey"), kw, ["claim_id"], trie=trie).collect()
    assert {(r.claim_id, r.start, r.stop) for r in got} == {(0, 1, 61), (0, 61, 62), (1, 2, 3)}
