"""Queries of TF-IDF retrieval and sentence candidates: benchmark passages as claims, lines of documents as sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import candidates as T
from evidentia.operators import tfidf
from evidentia.operators.numbering import numbered
from evidentia.plans import pair_scorer as P
from evidentia.plans import pipeline as U
from evidentia.plans import standins as X
from evidentia.plans.registry import query
from evidentia.plans.scratch import written

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)


def grams(source: str, keys: str) -> str:
    """1- and 2-grams of source's text without filtered ends."""
    return f"""(select {keys}, unnest(list_concat(list_filter(ws, lambda w: w not in ({STOPS})), list_filter([case when ws[i] in ({STOPS}) or ws[i + 1] in ({STOPS}) then null else concat(ws[i], ' ', ws[i + 1]) end for i in range(1, len(ws))], lambda g: g is not null))) as term
    from (select {keys}, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from {source}))"""


CORPUS = f"""{X.LINES}, counts as (select doc_id, line_num, term, count(*) as tf from {grams('lines', 'doc_id, line_num')} group by all),
  dfs as (select term, count(*) as df from counts group by 1), n as (select count(*) as n from lines),
  idf as (select term, df, n from dfs, n where n - df > df),
  qc as (select item_id, term, count(*) as tf from {grams('benchmark', 'item_id')} group by all)"""
W = "ln(1 + {tf}) * greatest(0.0, ln((n - df + 0.5) / (df + 0.5)))"


def _spread(s):
    """Small tasks: four for each of the session's shuffle partitions."""
    return 4 * int(s.conf.get("spark.sql.shuffle.partitions"))


def _counts(s, d):
    """N-gram counts of all lines."""
    return tfidf.ngram_counts(X.lines(s, d), ["doc_id", "line_num"], spread=_spread(s))


@query(f"with {X.LINES} select doc_id, line_num, term, count(*) as tf from {grams('lines', 'doc_id, line_num')} group by all")
def t1_ngram_counts(s, d):
    return _counts(s, d)


@query(f"with {CORPUS} select * from dfs")
def t2_doc_freqs(s, d):
    return tfidf.doc_freqs(_counts(s, d))


@query(f"with {CORPUS} select doc_id, line_num, term, round({W.format(tf='tf')}, 6) as weight from counts join idf using (term)")
def t3_tfidf_weights(s, d):
    return tfidf.corpus_weights(X.lines(s, d), ["doc_id", "line_num"], spread=_spread(s)).select("doc_id", "line_num", "term", F.round("weight", 6).alias("weight"))


@query(f"with {CORPUS} select item_id, term, round({W.format(tf='tf')}, 6) as weight from qc join idf using (term)")
def t4_query_vector(s, d):
    """Of the lines' n-grams only the passages' are counted."""
    rows, asked = X.lines(s, d), X.read(s, d, "benchmark")
    idf = tfidf.idf_of(asked, rows, "item_id", ["doc_id", "line_num"])
    return tfidf.query_vector(asked, "item_id", idf).select("item_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""with {CORPUS}, sc as (select item_id, doc_id, line_num, round(sum(({W.format(tf='qc.tf')} * {W.format(tf='counts.tf')})::decimal(38, 12))::double, 9) as score from qc join idf using (term) join counts using (term) group by all),
  r as (select *, row_number() over (partition by item_id order by score desc, doc_id, line_num)::int as rank from sc where score > 0)
  select item_id, doc_id, line_num, round(score, 5) as score, rank from r where rank <= 5""")
def t5_closest_sentences(s, d):
    """The flagship: the five closest lines of all documents for each benchmark passage."""
    got = tfidf.search(X.read(s, d, "benchmark"), X.lines(s, d), "item_id", ["doc_id", "line_num"])
    return got.select("item_id", "doc_id", "line_num", F.round("score", 5).alias("score"), "rank")


#: Documents are dealt to all passages in turn.
DEALT = "doc_id % (select count(*) from benchmark)"
CAND = f"""{X.LINES}, cand as (select {DEALT} as item_id, doc_id, line_num, text from lines),
  counts as (select item_id, doc_id, line_num, term, count(*) as tf from {grams('cand', 'item_id, doc_id, line_num')} group by all),
  dfs as (select item_id, term, count(*) as df from counts group by all), ns as (select item_id, count(*) as n from cand group by 1),
  idf as (select item_id, term, df, n from dfs join ns using (item_id) where n - df > df),
  qc as (select item_id, term, count(*) as tf from {grams('benchmark', 'item_id')} group by all),
  sc as (select qc.item_id, doc_id, line_num, round(sum({W.format(tf='qc.tf')} * {W.format(tf='counts.tf')}), 9) as score from qc join idf on idf.item_id = qc.item_id and idf.term = qc.term join counts on counts.item_id = qc.item_id and counts.term = qc.term group by all)"""


def _dealt(s, d):
    return F.col("doc_id") % max(1, X.read(s, d, "benchmark").count())


def _candidates(s, d):
    return X.lines(s, d).withColumn("item_id", _dealt(s, d))


@query(f"with {CAND}, r as (select *, row_number() over (partition by item_id order by score desc, doc_id, line_num)::int as rank from sc where score > 0) select item_id, doc_id, line_num, round(score, 5) as score, rank from r where rank <= 5")
def t6_rank_sentences_online(s, d):
    got = tfidf.rank_candidates(X.read(s, d, "benchmark"), _candidates(s, d), "item_id", ["doc_id", "line_num"])
    return got.select("item_id", "doc_id", "line_num", F.round("score", 5).alias("score"), "rank")


DOCS = CAND.replace("counts as (select item_id, doc_id, line_num, term", "counts as (select item_id, doc_id, term").replace(grams("cand", "item_id, doc_id, line_num"), grams("dt", "item_id, doc_id")).replace(f"cand as (select {DEALT} as item_id, doc_id, line_num, text from lines)", f"dt as (select {DEALT} as item_id, doc_id, text from documents)").replace("from cand group", "from dt group").replace("qc.item_id, doc_id, line_num, round", "qc.item_id, doc_id, round")


@query(f"with {DOCS}, r as (select * from sc where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 100) select dt.item_id as claim_id, dt.doc_id, round(coalesce(score, 0.0), 5) as priority from dt left join r on r.item_id = dt.item_id and r.doc_id = dt.doc_id")
def d17_tfidf_rank_docs(s, d):
    texts = X.read(s, d, "documents").select(_dealt(s, d).alias("claim_id"), "doc_id", "text")
    claims = X.read(s, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return tfidf.rank_docs(claims, texts, claim_text="text").select("claim_id", "doc_id", F.round("priority", 5).alias("priority"))


@query(f"with {X.LINES}, g as (select doc_id from labels where quality = 1) select {DEALT} as claim_id, doc_id, line_num, sha256(text) as text, case when line_num = 0 and doc_id in (select doc_id from g) then 'true' else 'false' end as selection_label from lines")
def t7_sentence_candidates(s, d):
    docs = X.read(s, d, "documents").select(_dealt(s, d).alias("claim_id"), "doc_id")
    gold = X.read(s, d, "labels").filter("quality = 1").select(_dealt(s, d).alias("claim_id"), "doc_id", F.lit(0).alias("line_num"))
    return T.sentence_candidates(docs, X.lines(s, d), gold).withColumn("text", F.sha2("text", 256))


@query(f"with {X.LINES}, a as (select {DEALT} as claim_id, doc_id from documents qualify row_number() over (partition by {DEALT} order by n_chars desc, doc_id) <= 6) select claim_id, doc_id, line_num, 'hidden' as selection_label from a join lines using (doc_id)")
def t8_second_hop_candidates(s, d):
    aside = X.read(s, d, "documents").select(_dealt(s, d).alias("claim_id"), "doc_id", F.col("n_chars").cast("double").alias("priority"))
    return T.second_hop_candidates(aside, X.lines(s, d)).select("claim_id", "doc_id", "line_num", "selection_label")


@query(f"with {X.LINES} select doc_id, line_num, sha256(case when line_num = 0 or contains(lower(text), lower(source)) then text else concat(source, ' <t> ', text) end) as text from lines join (select doc_id, source from documents) using (doc_id)")
def t9_prefix_title(s, d):
    sources = X.read(s, d, "documents").select("doc_id", "source")
    return X.lines(s, d).join(sources.hint("merge"), "doc_id").select("doc_id", "line_num", F.sha2(T.prefix_title("source"), 256).alias("text"))


def _numbered_claims(s, d):
    """(claim_id, item_id, query): every benchmark passage with text, numbered from 0 without gaps."""
    rows = X.read(s, d, "benchmark").select(F.col("item_id").cast("long"), F.col("text").alias("query")).filter("length(query) > 0")
    return written(numbered(rows, ["item_id", "query"], "claim_id"), "claims")


#: Documents are dealt to all passages with text in turn, numbered by item_id and text.
DEALT_PAIRS = f"""{X.LINES}, cl as (select row_number() over (order by item_id, text) - 1 as claim_id, item_id, text as query from benchmark where length(text) > 0),
  qt as (select claim_id, term, count(*) as tf from (select claim_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from cl) group by all),
  lt as (select doc_id, line_num, term, count(*) as tf from (select doc_id, line_num, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from lines) group by all),
  n as (select count(*) as n from lines), idf as (select term, ln((n - df + 0.5) / (df + 0.5)) as idf from (select term, count(*) as df from lt group by 1), n where n - df > df),
  qw as (select claim_id, count(*) as n_query, coalesce(sum(ln(1 + tf) * idf), 0.0) as total from qt left join idf using (term) group by 1),
  tw as (select doc_id, line_num, count(*) as n_text from lt group by all),
  pairs as (select doc_id % (select greatest(1, count(*)) from cl) as claim_id, doc_id, line_num from lines),
  sh as (select doc_id, line_num, count(*) as shared, coalesce(sum(ln(1 + qt.tf) * idf * idf * ln(1 + lt.tf)), 0.0) as tfidf, coalesce(sum(ln(1 + qt.tf) * idf), 0.0) as has
    from pairs join lt using (doc_id, line_num) join qt using (claim_id, term) left join idf using (term) group by all)"""


def _pair_features(s, d):
    """Features of every line with its passage, and the passages."""
    claims = _numbered_claims(s, d)
    pairs = X.lines(s, d).withColumn("claim_id", F.col("doc_id") % max(1, claims.count()))
    return P.pair_features(pairs, P.claim_table(claims, X.lines(s, d))), claims


@query(f"""with {DEALT_PAIRS} select item_id as claim_id, doc_id, line_num, coalesce(shared, 0)::double as shared, round(coalesce(shared, 0) / greatest(coalesce(n_query, 0), 1), 5) as share_query,
  round(coalesce(shared, 0) / greatest(coalesce(n_text, 0), 1), 5) as share_text, round(ln(1 + coalesce(n_text, 0)), 5) as length, round(coalesce(tfidf, 0.0), 5) as tfidf,
  round(case when total > 0 then coalesce(has, 0.0) / total else 0.0 end, 5) as weight_share
  from pairs join cl using (claim_id) left join qw using (claim_id) left join tw using (doc_id, line_num) left join sh using (doc_id, line_num)""")
def u2_pair_features(s, d):
    rows, claims = _pair_features(s, d)
    named = rows.join(claims.select("claim_id", "item_id").hint("merge"), "claim_id")
    rounded = [F.round(c, 5).alias(c) for c in ("share_query", "share_text", "length", "tfidf", "weight_share")]
    return named.select(F.col("item_id").alias("claim_id"), "doc_id", "line_num", "shared", *rounded)


@query()
def u2_score_pairs(s, d):
    """Lines of documents of good quality that open them are labelled true; each passage's pairs are scored by a model of other passages' pairs."""
    rows, claims = _pair_features(s, d)
    gold = X.read(s, d, "labels").filter("quality = 1").select("doc_id", F.lit(0).alias("line_num"), F.lit("true").alias("_gold")).distinct()
    labelled = rows.join(gold.hint("merge"), ["doc_id", "line_num"], "left").withColumn("selection_label", F.coalesce("_gold", F.lit("false"))).drop("_gold")
    scored = P.cross_fit(written(labelled, "features")).join(claims.select("claim_id", "item_id").hint("merge"), "claim_id")
    return scored.select(F.col("item_id").alias("claim_id"), "doc_id", "line_num", "fold", "prob", "score")


@query(f"with {X.LINES} select doc_id, line_num from lines where length(text) > 20")
def u3_filter_examples(s, d):
    return U.filter_examples(X.lines(s, d), F.length("text") > 20).select("doc_id", "line_num")
