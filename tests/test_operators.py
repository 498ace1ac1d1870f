"""Operators on hand-made rows with expected results, and brute-force checks of what SQL doesn't express."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import candidates as T
from evidentia.operators import docs as D
from evidentia.operators import ensemble, metrics, tfidf
from evidentia.operators import lexical as L
from evidentia.operators import linking as K
from evidentia.operators import select as E
from evidentia.operators import training_rows as N
from evidentia.operators import vocab as V
from evidentia.plans import pipeline as U
from evidentia.sources import tables as S
from evidentia.streaming import streams


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


# --- columns


def test_titles_and_brackets(spark):
    doc = "Hourglass_-LRB-James_Taylor_album-RRB-"
    tokens = C.title_tokens(F.lit(doc))
    r = one(spark, tokens.alias("t"), C.words_inside_brackets(tokens).alias("i"), C.remove_brackets(tokens).alias("o"), C.balanced_brackets(tokens).alias("b"), C.balanced_brackets(arr("-RRB-")).alias("n"), C.remove_brackets(arr("a", "b")).alias("same"), C.media_bonus(tokens).alias("m"))
    assert r.t == ["Hourglass", "-LRB-", "James", "Taylor", "album", "-RRB-"]
    assert (r.i, r.o, r.b, r.n, r.same, r.m) == (["James", "Taylor", "album"], ["Hourglass"], True, False, [], 0.1)
    score = lambda claim, lemmas: C.bracket_overlap_score(tokens, arr("Hourglass", "-LRB-", "James", "Taylor", "record", "-RRB-"), claim, lemmas)
    r = one(spark, score(arr("The", "album", "sold"), arr("x")).alias("a"), score(arr("x"), arr("record")).alias("b"), score(arr("x"), arr("x")).alias("c"))
    assert (r.a, r.b, r.c) == (3.0, 2.0, 1.0)


def test_text_functions(spark):
    r = one(spark, C.nfd(F.lit("é a")).alias("n"), C.brc_encode(F.lit("a (b): c"), True).alias("e"), C.brc_decode(F.lit("a-LRB-b-RRB--COLON-")).alias("d"), C.natural_title(F.lit("A_-LRB-b-RRB-")).alias("t"), C.filter_doc_id(F.lit("123")).alias("f1"), C.filter_doc_id(F.lit("abc م")).alias("f2"), C.filter_doc_id(F.lit("abc")).alias("f3"), C.truncate_tokens(F.lit(" "), 3).alias("z"))
    assert r.n == unicodedata.normalize("NFD", "é a")
    assert (r.e, r.d, r.t, r.f1, r.f2, r.f3, r.z) == ("a_-LRB-b-RRB--COLON-_c", "a(b):", "A ( b )", True, True, False, "@@@EMPTY@@@")
    g = arr("the", "cat")
    r = one(spark, C.filter_ngram(g, "any").alias("a"), C.filter_ngram(g, "all").alias("b"), C.filter_ngram(arr("cat", "the", "dog"), "ends").alias("c"), C.is_filtered_word(F.lit("!?")).alias("p"))
    assert (r.a, r.b, r.c, r.p) == (True, False, False, True)
    with pytest.raises(ValueError):
        C.filter_ngram(g, "other")


def test_numbered_lines(spark):
    lines = "0\tAlpha was born in Beta .\tBeta\tBeta\n1\t\n2\tShe won a prize ."
    pages = spark.createDataFrame([("Alpha", "Alpha was", lines), ("Short", "x", "0\ty"), ("Thumb", "text", "0\ta\tthumb\tb\n2\tlost\n1\tb"), ("None", None, None)], "id string, text string, lines string")
    docs = S.build_documents(pages)
    got = sorted((r.doc_id, r.line_num, r.text, r.h_links) for r in S.build_sentences(docs).collect())
    assert got == [("Alpha", 0, "Alpha was born in Beta .", ["Beta", "Beta"]), ("Alpha", 2, "She won a prize .", []), ("Thumb", 0, "a", []), ("Thumb", 1, "b", [])] or got[:2] == [("Alpha", 0, "Alpha was born in Beta .", ["Beta", "Beta"]), ("Alpha", 2, "She won a prize .", [])]
    assert S.count_sentences(docs).first().n_sentences == len(got)
    assert {r.id for r in S.list_doc_ids(docs).collect()} == {"Alpha", "Thumb"}
    assert S.list_doc_ids(docs, 1).count() == 1


def test_evidence_and_scores(spark):
    groups = [[["1", "2", "d", "3"], ["1", "2", "d", "3"], ["1", "3", "c", "0"]], [["9", "9", "c", "0"], ["9", "9", "d", "3"]], [["4", "4", None, None]]]
    df = spark.createDataFrame([(groups,)], "e array<array<array<string>>>").select(C.normalize_evidence(C.evidence_from_tuples("e")).alias("e"))
    assert [[tuple(x) for x in g] for g in df.first().e] == [[("c", 0), ("d", 3)], []]
    bad = spark.createDataFrame([([("a", None)],)], "e array<struct<doc_id:string,line_num:int>>")
    with pytest.raises(Exception, match="pairs"):
        bad.select(C.validate_evidence("e")).collect()
    x = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0), F.lit(0.5))
    r = one(spark, C.softmax(F.slice(x, 1, 3)).alias("s"), C.argmax_label(F.slice(x, 1, 3)).alias("l"), C.joint_scores(x).alias("j"), C.token_spans(F.array(arr("a", "b"), arr(), arr("c"))).alias("t"))
    assert math.isclose(sum(r.s), 1) and r.l == "REFUTES" and r.j.score == -0.5 and math.isclose(r.j.prob, 1 - 1 / (1 + math.exp(-0.5)))
    assert [tuple(t) for t in r.t] == [(0, 2), (2, 2), (2, 3)]
    r = one(spark, C.number_bucket(F.lit("12")).alias("a"), C.number_bucket(F.lit("123456")).alias("b"), C.number_bucket(F.lit("1a")).alias("c"))
    assert 0 <= r.a < 20000 and r.b is None and r.c is None


# --- sources


def test_sources(spark, tmp_path):
    (tmp_path / "claims.jsonl").write_text('{"id": 1, "label": "SUPPORTS", "claim": "c", "evidence": [[[1, 2, "d", 3]]]}\n{"id": 2, "label": "NOT ENOUGH INFO", "claim": "e", "evidence": [[[1, null, null, null]]]}\n')
    rows = {r.id: r for r in S.read_claims(spark, str(tmp_path / "claims.jsonl")).collect()}
    assert [[tuple(e) for e in g] for g in rows[1].evidence] == [[("d", 3)]] and rows[2].evidence == [[]]
    (tmp_path / "views/day").mkdir(parents=True)
    with gzip.open(tmp_path / "views/day/a.gz", "wt") as f:
        f.write("en A 3 0\nen.m A 2 0\nde A 9 0\nen B 1\nen C 1 0\n")
    assert {r.doc: r.views for r in S.count_pageviews(spark, str(tmp_path / "views")).collect()} == {"A": 5, "C": 1}
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"))
    for ranges in (1, 3, 7):
        path = str(tmp_path / f"parts{ranges}")
        S.split_by_rows(df, "id", 10, path, ranges)
        assert [r.id for r in S.merge_splits(spark, "id long, t string", path, "id").collect()] == list(range(25))
        parts = S.read_splits(spark, "id long, t string", path).groupBy("part", "file").count().collect()
        assert sorted((r.part, r["count"]) for r in parts) == [(0, 10), (1, 10), (2, 5)] and all(f"/part={r.part}/" in r.file for r in parts)
    S.write_rows(df, str(tmp_path / "out/rows"))
    with pytest.raises(Exception):  # noqa: B017
        S.write_rows(df, str(tmp_path / "out/rows"))
    cache = spark.createDataFrame([("a",)], "key string")
    assert {r.key for r in S.cache_update(cache, spark.createDataFrame([("a",), ("b",), ("b",)], "key string")).collect()} == {"b"}
    (tmp_path / "vec.txt").write_text("cat 1 2\ndog 3\nbird 4 5\n")
    got = S.read_vectors(spark, str(tmp_path / "vec.txt"), 2, spark.createDataFrame([("cat",)], "token string")).collect()
    assert [(r.word, list(r.vec)) for r in got] == [("cat", [1.0, 2.0])]
    links = spark.createDataFrame([("d", 0, ["x", "Alpha", "y", "Gone"]), ("d", 1, ["odd"])], "doc_id string, line_num int, h_links array<string>")
    assert S.odd_link_rows(links).count() == 1
    assert {r.target for r in S.dangling_links(S.links(links), spark.createDataFrame([("alpha",)], "id string")).collect()} == {"Gone"}


# --- linking


def index(spark, rows):
    return spark.createDataFrame(rows, "keyword string, doc_id string, priority double")


def claims(spark, *texts):
    return spark.createDataFrame([(i, t, t.split(" "), None) for i, t in enumerate(texts)], "claim_id long, claim string, tokens array<string>, lemmas array<string>")


def test_keyword_index(spark):
    titles = spark.createDataFrame([("Hourglass_-LRB-James_Taylor_album-RRB-", "Hourglass -LRB- James Taylor album -RRB-"), ("X_-LRB-disambiguation-RRB-", "X -LRB- disambiguation -RRB-"), ("B_-RRB-", "B -RRB-")], "doc_id string, keyword string")
    got = {(r.keyword, r.priority) for r in K.build_keyword_index(titles).collect()}
    assert got == {("Hourglass -LRB- James Taylor album -RRB-", 5.0), ("Hourglass", 1.0), ("X -LRB- disambiguation -RRB-", 5.0), ("B -RRB-", 5.0)}
    assert {r.priority for r in K.build_keyword_index(titles, brackets=False, priorities=False).collect()} == {1.0}
    assert ("X", 1.0) in {(r.keyword, r.priority) for r in K.build_keyword_index(titles, keep_disambiguation=True).collect()}
    noise = index(spark, [("1984", "1984", 5.0), ("1984", "1984_-LRB-film-RRB-", 1.0), ("7", "7", 5.0), ("The", "The", 5.0), ("21st", "21st", 5.0), ("21th", "21th", 5.0), ("11th", "11th", 5.0), ("0123", "0123", 5.0)])
    assert {r.doc_id for r in K.drop_noise_keywords(noise).collect()} == {"1984_-LRB-film-RRB-", "21th", "0123"}


def test_longest_matches(spark):
    kw = index(spark, [(k, k.replace(" ", "_"), 5.0) for k in ("New York", "New York City", "City", "Beatles", "Dog")])
    got = {}
    for r in K.link_keywords(claims(spark, "New York City is big", "York New York", "The Beatles sang", "dogs run", "DOG"), kw).collect():
        got.setdefault(r.claim_id, set()).add(r.match_key)
    assert got == {0: {"New York City"}, 1: {"New York"}, 2: {"Beatles"}}
    c = claims(spark, "The Beatles sang", "Dogs run", "DOG the")
    links = K.link_keywords(c.filter("claim_id = 9"), kw).select("claim_id", "match_key", "doc_id", "priority")
    assert {(r.claim_id, r.doc_id) for r in K.article_rule(c, links, kw).collect()} == {(0, "Beatles")}
    assert {(r.claim_id, r.doc_id) for r in K.singularize_fallback(c, links, kw).collect()} == {(1, "Dog")}
    assert {(r.claim_id, r.doc_id) for r in K.lowercase_fallback(c, links, kw).collect()} == {(0, "Beatles"), (2, "Dog")}


def test_link_keywords_equals_a_greedy_scan(spark):
    rng = random.Random(3)
    words = "a b c d e f".split()
    keys = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    want = set()
    for i, t in enumerate(texts):
        tokens, at = t.split(), 0
        while at < len(tokens):
            for n in range(4, 0, -1):
                if at + n <= len(tokens) and " ".join(tokens[at : at + n]) in keys:
                    want.add((i, at, at + n))
                    at += n
                    break
            else:
                at += 1
    got = K.match_spans(claims(spark, *texts), index(spark, [(k, k, 1.0) for k in keys]), ["claim_id"], 4).collect()
    assert {(r.claim_id, r.start, r.stop) for r in got} == want and len(got) == len(want)


def test_first_letter_rules(spark):
    kw = index(spark, [("the Odyssey of Homer", "The_Odyssey", 5.0), ("Odyssey of Homer", "Odyssey", 5.0), ("Homer", "Homer", 5.0), ("cat", "Cat_-LRB-film-RRB-", 1.0), ("of", "of", 5.0)])
    c = claims(spark, "read the Odyssey of Homer", "a cat of")
    assert {(r.claim_id, r.doc_id) for r in K.first_letter_filter(c, kw).collect()} == {(0, "Odyssey")}
    assert {(r.claim_id, r.doc_id) for r in K.link_keywords_multi(c, kw).collect()} == {(0, "Odyssey")}
    freq = spark.createDataFrame([(w, 100) for w in ("the", "odyssey", "of", "homer")], "word string, n long")
    assert {(r.claim_id, r.doc_id) for r in K.link_frequency_aware(c, kw, freq).collect()} == {(0, "Odyssey"), (1, "Cat_-LRB-film-RRB-")}
    assert {(r.claim_id, r.doc_id) for r in K.link_no_bracket(c, kw, freq).collect()} == {(0, "Odyssey")}


def test_restarts_go_on_until_no_key_fails(spark):
    """Each failing key costs a restart; the link after them stays."""
    kw = index(spark, [("red green blue", "Colour", 5.0), ("Odyssey", "Odyssey", 5.0)])
    c = claims(spark, " ".join(["red green blue"] * 5 + ["Odyssey"]))
    assert {(r.claim_id, r.doc_id) for r in K.link_keywords_multi(c, kw).collect()} == {(0, "Odyssey")}


def test_rule_chain_and_presets(spark):
    kw = index(spark, [("Beatles", "Beatles", 5.0), ("Let It Be", "Let_It_Be_-LRB-album-RRB-", 1.0), ("Let It Be", "Let_It_Be_-LRB-film-RRB-", 1.0)])
    c = claims(spark, "The Beatles made the album Let It Be")
    got = {r.doc_id: r.priority for r in K.rule_chain(None, K.preset("default", c, kw)).collect()}
    assert got == {"Beatles": 5.0, "Let_It_Be_-LRB-album-RRB-": 3.1, "Let_It_Be_-LRB-film-RRB-": 1.2}
    views = spark.createDataFrame([("Let_It_Be_(film)", 10), ("Let_It_Be_(album)", 30)], "doc string, views long")
    got = {r.doc_id: r.priority for r in K.rule_chain(None, K.preset("pageview", c, kw, views)).collect()}
    assert got == {"Beatles": 5.0, "Let_It_Be_-LRB-album-RRB-": 1.0, "Let_It_Be_-LRB-film-RRB-": 0.8}
    assert K.rule_chain(None, [*K.preset("nopageview", c, kw), lambda x: x.filter("priority > 4")]).count() == 1
    hits = K.multi_index_link(c, [(kw, 2.0), (kw.filter("priority = 5"), 9.0)]).collect()
    assert sorted((r.index_id, r.priority) for r in hits) == [(0, 2.0)] * 3 + [(1, 9.0)]


# --- documents


def test_view_ranks(spark):
    links = spark.createDataFrame([(1, "k", d, 1.0) for d in "abc"] + [(1, "s", "z", 7.0)] + [(2, "k", d, 1.0) for d in "abcdef"], "claim_id long, match_key string, doc_id string, priority double")
    views = spark.createDataFrame([("a", 10), ("b", 30)], "doc string, views long")
    got = {(r.claim_id, r.doc_id): r.priority for r in D.pageview_rank(links, views).collect()}
    assert [got[1, d] for d in "abcz"] == [0.8, 1.0, 0.6, 7.0] and got[2, "f"] == 0.0
    assert {r.priority for r in D.pageview_raw(links, views).collect()} == {0.0, 10.0, 30.0}


def test_topk_and_two_hops(spark):
    links = spark.createDataFrame([(1, "x", 1.0), (1, "y", 5.0), (1, "a", 1.0)], "claim_id long, doc_id string, priority double")
    assert [r.doc_id for r in D.topk_docs(links, 2).orderBy("rank").collect()] == ["y", "a"]
    aside = spark.createDataFrame([(1, "x", 9.0), (1, "n", 2.0), (1, "m", 1.0)], "claim_id long, doc_id string, priority double")
    assert {(r.doc_id, r.hop) for r in D.two_hop_merge(links, aside, 2, 1).collect()} == {("y", 1), ("a", 1), ("n", 2)}
    hops = spark.createDataFrame([(1, "d", 0, "p", 1.0), (1, "d", 1, "q", 3.0), (1, "e", 0, "r", 3.0)], "claim_id long, sent_doc string, sent_line int, doc_id string, priority double")
    assert [r.doc_id for r in D.best_sentence_links(hops).collect()] == ["q"]


def test_disambiguation(spark):
    c = claims(spark, "saw It ( film ) -LRB- film -RRB- It -LRB- film -RRB- twice")
    links = spark.createDataFrame([(0, "k", "It_-LRB-film-RRB-", 1.0, 2), (0, "k", "It_-LRB-novel-RRB-", 2.0, 1), (0, "k", "Zed", 3.0, 0)], "claim_id long, match_key string, doc_id string, priority double, pos int")
    assert [r.doc_id for r in D.exact_title_first(links, c).orderBy("rank").collect()] == ["It_-LRB-film-RRB-", "Zed", "It_-LRB-novel-RRB-"]
    sents = spark.createDataFrame([("It_-LRB-novel-RRB-", 0, "A book .")], "doc_id string, line_num int, text string")
    pairs = D.disambiguation_pairs(links, c, sents).collect()
    assert [(r.selection_id, r.text, r.selection_label) for r in pairs] == [("0###It_-LRB-novel-RRB-", "It -LRB- novel -RRB- A book .", "hidden")]
    scores = spark.createDataFrame([(0, "It_-LRB-novel-RRB-", 5.0, 0.0, "true"), (0, "It_-LRB-film-RRB-", 1.0, 0.0, "false")], "claim_id long, doc_id string, score double, prob double, label string")
    by = lambda mode: {r.doc_id: r.priority for r in D.apply_disambiguation(links, scores, mode, 1e-5, c).collect()}
    assert by("label") == {"It_-LRB-novel-RRB-": 5.0, "It_-LRB-film-RRB-": -1.0, "Zed": 3.0}
    assert by("v0")["It_-LRB-novel-RRB-"] == 1.05 and by("v1")["It_-LRB-film-RRB-"] == 1.0
    assert by("v2") == {"It_-LRB-film-RRB-": 0.0, "Zed": 3.0}
    gold = links.filter("doc_id = 'It_-LRB-novel-RRB-'")
    train = {(r.doc_id, r.selection_label) for r in D.disambiguation_train_pairs(links, gold, c).collect()}
    assert train == {("It_-LRB-novel-RRB-", "true"), ("It_-LRB-film-RRB-", "false")}
    assert D.reset_bracket_priority(links).filter("priority = 1").count() == 2


def test_expand_from_docs(spark):
    c = spark.createDataFrame([(1, "green apple pie")], "claim_id long, text string")
    links = spark.createDataFrame([(1, "k", "p", 4.0)], "claim_id long, match_key string, doc_id string, priority double")
    sents = spark.createDataFrame([("p", 0, "green apple pie recipe"), ("p", 1, "blue sky"), ("p", 2, "red car"), ("p", 3, "old house")], "doc_id string, line_num int, text string")
    graph = spark.createDataFrame([("p", 0, "Good Pie"), ("p", 1, "Sky")], "doc_id string, line_num int, target string")
    got = {(r.doc_id, r.priority) for r in D.expand_from_docs(c, links, sents, graph, least=0.5).collect()}
    assert got == {("p", 4.0), ("Good_Pie", 4.0)}


# --- TF-IDF


def test_tfidf_by_the_formula(spark):
    docs = spark.createDataFrame([(0, "cheap car sale"), (1, "cheap flat rent"), (2, "dog walk"), (3, "cat food"), (4, "old piano")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "cheap car"), (1, "the of")], "q long, text string")
    w = lambda tf, df: math.log1p(tf) * max(0.0, math.log((5 - df + 0.5) / (df + 0.5)))
    got = {(r.q, r.doc_id): r.score for r in tfidf.search(queries, docs, "q", ["doc_id"]).collect()}
    want = {(0, 0): w(1, 2) ** 2 + w(1, 1) ** 2 + w(1, 1) ** 2, (0, 1): w(1, 2) ** 2}  # cheap, car, "cheap car"
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)
    everywhere = spark.createDataFrame([(i, "aa bb") for i in range(4)], "doc_id long, text string")
    counts = tfidf.ngram_counts(everywhere, ["doc_id"])
    assert tfidf.tfidf_weights(counts, tfidf.idf_table(counts, everywhere)).count() == 0
    idf = tfidf.idf_table(tfidf.ngram_counts(docs, ["doc_id"]), docs)
    with pytest.raises(Exception, match="no valid word"):
        tfidf.query_vector(queries, "q", idf, strict=True).collect()
    assert tfidf.ngram_counts(docs, ["doc_id"], buckets=7).filter("term >= 7 or term < 0").count() == 0


# --- selection


PAIRS = "claim_id long, doc_id string, line_num int, score double, prob double, pos int"


def test_selection(spark):
    pairs = spark.createDataFrame([(1, "d", 0, 3.0, 0.9, 0), (1, "d", 1, 2.0, 0.4, 1), (1, "e", 5, 4.0, 0.6, 2), (1, "d", 0, 9.0, 0.99, 3)], PAIRS)
    c = spark.createDataFrame([(1,), (2,)], "claim_id long")
    lists = lambda df: {r.claim_id: [tuple(e) for e in r.predicted_evidence] for r in df.collect()}
    unique = E.select_unique(pairs, c)
    assert lists(unique) == {1: [("e", 5), ("d", 0)], 2: []}
    assert lists(E.select_by_threshold(pairs, c)) == {1: [("d", 0), ("e", 5), ("d", 0)], 2: []}
    have = unique.limit(1).filter("claim_id = 1").unionByName(unique.filter("claim_id = 9"))
    z = E._listed(E.best_rows(spark.createDataFrame([(1, "z", 1, 1.0, 1.0, 0)], PAIRS), 0, 5), None)
    assert lists(E.append_selected(z, pairs, 0.5, 1)) == {1: [("z", 1), ("e", 5)]}
    five = E._listed(E.best_rows(spark.createDataFrame([(1, "z", i, 1.0, 1.0, 0) for i in range(5)], PAIRS), 0, 5), None)
    assert lists(E.append_selected(five, pairs, 0.5, 3, 100)) == {1: [("z", i) for i in range(5)]}
    assert lists(E.recut(unique, 1))[1] == [("e", 5)] and have is not None
    table, bad = E.score_table(pairs.withColumn("query", F.lit("q")), ["claim_id", "doc_id", "line_num"])
    assert table.count() == 3 and bad.first().violations == 1


def test_sampling_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 9).alias("claim_id"), F.col("id").alias("doc_id"), F.lit(0).alias("line_num"), F.when(F.col("id") % 3 == 0, "true").otherwise("false").alias("selection_label"))
    a = {r.doc_id for r in T.downsample_negatives(rows, 0.4).collect()}
    assert a == {r.doc_id for r in T.downsample_negatives(rows.repartition(7), 0.4).collect()} and 167 < len(a) < 400
    assert [round(T.decayed(0.5, 0.1, e), 6) for e in range(3)] == [0.5, 0.4, 0.3]
    n = {r.selection_label: r.n_pairs for r in T.label_balance(T.balance_pairs(rows)).collect()}
    assert n == {"true": 167, "false": 167}


# --- metrics and ensembles


def metric_rows(spark):
    kind = "label string, predicted_label string, evidence array<array<struct<doc_id:string,line_num:int>>>, predicted_evidence array<struct<doc_id:string,line_num:int>>"
    d, e, x = ("d", 0), ("e", 2), ("x", 9)
    return spark.createDataFrame(
        [("SUPPORTS", "supports", [[d, ("d", 1)], [e]], [e, x]), ("REFUTES", "SUPPORTS", [[d, ("d", 1)]], [d]), ("NOT ENOUGH INFO", "NOT ENOUGH INFO", [[]], [])], kind
    )


def test_verification_score(spark):
    r = metrics.verification_score(metric_rows(spark)).first()
    assert [round(r[c], 6) for c in ("strict", "accuracy", "precision", "recall", "f1")] == [0.666667, 0.666667, 0.75, 0.5, 0.6]
    late = spark.createDataFrame([("SUPPORTS", "SUPPORTS", [[("g", 1)]], [("x", i) for i in range(5)] + [("g", 1)])], metric_rows(spark).schema)
    assert metrics.verification_score(late).first().strict == 0 and metrics.verification_score(late, 6).first().strict == 1
    assert metrics.oracle_score(metric_rows(spark)).first().strict == 1
    assert metrics.verification_score(late.filter("false")).first().precision == 1.0
    assert round(metrics.micro_precision(metric_rows(spark)).first().micro_precision, 6) == 0.666667


def test_confusion(spark):
    true, got = [0, 1, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1], [0, 0, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    rows = spark.createDataFrame(list(zip(true, got, strict=True)), "t int, p int")
    assert {(r.true, r.predicted): r.n for r in metrics.confusion(rows, "t", "p").collect()} == {(0, 0): 1, (1, 0): 1, (1, 1): 7, (2, 1): 1, (2, 2): 2}
    n = len(true)
    c, s = sum(a == b for a, b in zip(true, got, strict=True)), n
    tk, pk = [true.count(k) for k in range(3)], [got.count(k) for k in range(3)]
    want = (c * s - sum(a * b for a, b in zip(tk, pk, strict=True))) / math.sqrt((s * s - sum(p * p for p in pk)) * (s * s - sum(t * t for t in tk)))
    report = {r.label: r for r in metrics.confusion_report(rows, "t", "p").collect()}
    assert math.isclose(report[1].correlation, want) and report[1].support == 8 and math.isclose(report[2].recall, 2 / 3)


def test_ensembles(spark):
    runs = spark.createDataFrame([(1, 0, [1.0, 2.0, 0.0]), (1, 1, [4.0, 0.0, 0.0])], "claim_id long, run int, logits array<double>")
    r = ensemble.ensemble_labels(runs, ["claim_id"]).first()
    assert list(r.logits) == [2.5, 1.0, 0.0] and r.predicted_label == "SUPPORTS"
    scores = spark.createDataFrame([(1, 0, 1.0, 0.2), (1, 1, 1.0, 0.6)], "k long, run int, score double, prob double")
    assert math.isclose(ensemble.ensemble_scores(scores, ["k"], 2).first().prob, 0.4)
    with pytest.raises(Exception, match="lacks"):
        ensemble.ensemble_scores(scores, ["k"], 3).collect()
    gold = metric_rows(spark).filter("label = 'SUPPORTS'").drop("predicted_label").withColumn("claim_id", F.lit(1).cast("long"))
    found = ensemble.search_ensembles(runs, gold, 2)
    assert {r.subset: r.accuracy for r in found.collect()} == {"0": 0.0, "1": 1.0, "0,1": 1.0}
    assert {r.subset for r in ensemble.best_ensembles(found).collect()} == {"0,1"}


# --- rows, vocabularies, relations


def test_evidence_text(spark):
    rows = spark.createDataFrame([(1, "E", 1, "C"), (1, "D", 2, "B"), (1, "D", 0, "A")], "claim_id long, doc_id string, line_num int, text string")
    assert N.evidence_text(rows, ["claim_id"]).first().evid == "A B E <t> C"
    r = spark.createDataFrame([("a b", ["c d", "e"])], "p string, s array<string>").select(N.pair_sequence("p", F.col("s")).alias("q")).first()
    assert r.q.tokens == ["[CLS]", "a", "b", "[SEP]", "c", "d", "e", "[SEP]"] and r.q.types == [0] * 4 + [1] * 4 and [tuple(x) for x in r.q.spans] == [(4, 6), (6, 7)]
    with pytest.raises(ValueError):
        N.mix_tasks(("other", rows))


def test_oov_slots_and_vocabulary(spark):
    words = [f"word{i}é" for i in range(20)]
    got = spark.createDataFrame([(w,) for w in words], "token string").select("token", V.sha1_mod(F.col("token"), 2600).alias("i")).collect()
    assert all(r.i == int(hashlib.sha1(r.token.encode()).hexdigest(), 16) % 2600 for r in got)
    counts = spark.createDataFrame([("t", "b", 3), ("t", "a", 3), ("t", "c", 1), ("u", "z", 9)], "namespace string, token string, n long")
    v = V.build_vocab(counts, 2, include=["t"])
    assert {(r.token, r.idx) for r in v.collect()} == {("a", 2), ("b", 3)}
    pre = spark.createDataFrame([("c",)], "word string")
    assert {r.token for r in V.build_vocab(counts, 2, include=["t"], pretrained=pre).collect()} == {"a", "b", "c"}
    assert V.build_vocab(counts, 2, include=["t"], pretrained=pre, need_both=True).count() == 0
    assert {(r.token, r.idx) for r in V.special_tokens(counts).filter("namespace = 't'").collect()} == {(V.PADDING, 0), (V.OOV, 1)}
    assert V.set_special_index(v, "t", "hidden", -2).filter("idx = -2").count() == 1
    with pytest.raises(ValueError):
        V.set_special_index(v, "t", "x", 1)
    vectors = spark.createDataFrame([("a", [1.0, 3.0])], "word string, vec array<float>")
    rows = {r.token: list(r.vec) for r in V.vocab_vectors(v, vectors, 2).collect()}
    assert rows["a"] == [1.0, 3.0] and len(rows["b"]) == 2 and rows["b"] != [1.0, 3.0]


def test_relations(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {(r.src, r.dst): r.level for r in L.level_split(L.closure(edges)).collect()}
    assert got == {("a", "b"): "1", ("a", "c"): "2", ("a", "d"): "3plus", ("b", "c"): "1", ("b", "d"): "2", ("c", "d"): "1", ("x", "y"): "1", ("y", "x"): "1"}
    side = lambda *ws: spark.createDataFrame([(1, w, None, None) for w in ws], "claim_id long, token string, lemma string, stem string")
    lex = edges.select(F.lit("hypernym").alias("rel"), "src", "dst").union(spark.createDataFrame([("antonym", "hot", "cold")], "rel string, src string, dst string"))
    flags = {r.token: r.flags for r in L.pair_features(side("a", "Same", "not", "hot"), side("c", "same", "n't", "cold"), lex).collect()}
    at = lambda token, family, side: flags[token][3 * L.FAMILIES.index(family) + side - 1]
    assert at("a", "hyper_2", 1) == at("a", "anc", 1) == 1 and at("a", "hyper_1", 1) == 0
    assert at("c", "hypo_2", 2) == at("c", "desc", 2) == 1 and at("c", "hypo_2", 1) == 0
    assert at("Same", "em", 1) == at("same", "em", 2) == at("not", "em", 3) == at("hot", "ant", 1) == 1 and at("cold", "ant", 2) == 0
    assert [r.p for r in spark.createDataFrame([("JJ",), ("VBD",), ("NN",), ("RB",), ("DT",)], "t string").select(L.pos_class("t").alias("p")).collect()] == ["a", "v", "n", "r", None]


# --- pipeline and streams


def test_scorers_and_steps(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "d", 0, "red car fast" if i % 2 else "blue sky", "red car", "true" if i % 2 else "false") for i in range(40)], "claim_id long, doc_id string, line_num int, text string, query string, selection_label string")
    scored = U.score_pairs(pairs, U.train_scorer(pairs))
    assert metrics.selection_accuracy(scored).first().accuracy == 100 and metrics.selection_recall(scored).first().recall == 1
    with pytest.raises(ValueError):
        U.score_pairs(pairs, lambda x: x)
    assert U.filter_examples(pairs, F.col("claim_id") > 37).count() == 2
    steps = U.Steps(spark, str(tmp_path / "steps"))
    for _ in range(2):
        assert steps("a", lambda: spark.range(3)).count() == 3
    assert steps.ran == ["a"]
    U.Steps(spark, str(tmp_path / "steps"), resume=False)("a", lambda: spark.range(4))
    assert spark.read.parquet(str(tmp_path / "steps/a")).count() == 4


def test_two_hop_finds_the_evidence(spark, tmp_path):
    c = claims(spark, "The Beatles made Help", "Nothing here").withColumns({"label": F.when(F.col("claim_id") == 0, "SUPPORTS").otherwise("NOT ENOUGH INFO"), "evidence": F.when(F.col("claim_id") == 0, F.expr("array(array(named_struct('doc_id', 'Beatles', 'line_num', 0)))")).otherwise(F.expr("cast(array() as array<array<struct<doc_id:string,line_num:int>>>)"))})
    kw = index(spark, [("Beatles", "Beatles", 5.0)])
    sents = spark.createDataFrame([("Beatles", 0, "The Beatles made Help"), ("Beatles", 1, "other words"), ("Help_-LRB-album-RRB-", 0, "Help by The Beatles made")], "doc_id string, line_num int, text string")
    graph = spark.createDataFrame([("Beatles", 0, "Help (album)")], "doc_id string, line_num int, target string")
    views = spark.createDataFrame([("Help_(album)", 4)], "doc string, views long")
    verdicts, score = U.two_hop(U.Steps(spark, str(tmp_path / "s")), c, kw, views, sents, graph, U.overlap_scorer, U.overlap_verifier)
    got = {r.claim_id: (r.predicted_label, [e.doc_id for e in r.predicted_evidence]) for r in verdicts.collect()}
    assert got[1] == ("NOT ENOUGH INFO", []) and got[0][0] == "SUPPORTS" and {"Beatles", "Help_-LRB-album-RRB-"} <= set(got[0][1])
    assert score.first().strict == 1


def test_late_views_are_dropped_and_scores_come_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = lambda *xs: spark.createDataFrame(xs, "t string, doc string, views long").select(F.to_timestamp("t").alias("ts"), "doc", "views")
    stream = spark.readStream.schema("ts timestamp, doc string, views long").option("maxFilesPerTrigger", 1).parquet(str(src))
    rows(("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 2)).coalesce(1).write.mode("append").parquet(str(src))
    out = str(tmp_path / "out")

    def drain(df, name):
        q = df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/{name}-at").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/{name}").collect()

    views = streams.stream_pageviews(stream)
    drain(views, "v")
    rows(("2024-01-01 05:00:00", "a", 4)).coalesce(1).write.mode("append").parquet(str(src))
    drain(views, "v")
    rows(("2024-01-01 00:20:00", "a", 100), ("2024-01-01 09:00:00", "b", 1)).coalesce(1).write.mode("append").parquet(str(src))
    got = drain(views, "v")
    assert {(r.start.hour, r.doc): r.views for r in got} == {(0, "a"): 3, (5, "a"): 4}
    assert len(drain(streams.stream_dedup_scores(stream, ["doc"], late="30 days"), "d")) == 2
    assert streams.stream_pageviews(stream, slide="30 minutes").columns == streams.stream_pageviews(stream, gap="10 minutes").columns
