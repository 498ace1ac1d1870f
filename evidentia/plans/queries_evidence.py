"""Queries of selection, ensembles, metrics and training rows over orders (claims) and order lines (pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import candidates as T
from evidentia.operators import ensemble, metrics
from evidentia.operators import select as E
from evidentia.operators import training_rows as N
from evidentia.plans import standins as X
from evidentia.plans.registry import query

R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def _flat(selected: DataFrame, *extra: str) -> DataFrame:
    return selected.select("claim_id", *extra, F.posexplode("predicted_evidence").alias("pos", "e")).select("claim_id", *extra, (F.col("pos") + 1).alias("rank"), "e.doc_id", "e.line_num")


def _selected(s, d) -> DataFrame:
    return E.select_unique(X.pairs(s, d), X.claims(s, d), 0.5, 5)


# --- E


@query(f"with {X.PAIRS} select claim_id, doc_id, line_num, rank from (select *, row_number() over (partition by claim_id order by score desc, doc_id, line_num) as rank from pairs where prob >= 0.5) where rank <= 5")
def e1_select_by_threshold(s, d):
    return E.best_rows(X.pairs(s, d), 0.5, 5).select("claim_id", "doc_id", "line_num", "rank")


@query(f"with {X.PAIRS} select claim_id, doc_id, line_num, rank from best")
def e2_select_unique(s, d):
    return _flat(_selected(s, d))


@query(f"""with {X.PAIRS}, more as (select *, row_number() over (partition by claim_id order by score desc, doc_id, line_num) as r from uniq where prob >= 0.2 qualify r <= 2),
  fresh as (select m.*, row_number() over (partition by m.claim_id order by m.r) as k from more m anti join best b on b.claim_id = m.claim_id and b.doc_id = m.doc_id and b.line_num = m.line_num),
  sizes as (select claim_id, count(*) as n from best group by 1),
  whole as (select claim_id, doc_id, line_num, rank from best union all select f.claim_id, f.doc_id, f.line_num, coalesce(n, 0) + k from fresh f left join sizes using (claim_id) where coalesce(n, 0) < 5)
  select claim_id, doc_id, line_num, rank from whole where rank <= 5""")
def e3_append_selected(s, d):
    return _flat(E.append_selected(_selected(s, d), X.pairs(s, d), 0.2, 2, 5))


@query(f"with {X.PAIRS} select claim_id, doc_id, line_num, rank from (select *, row_number() over (partition by claim_id order by score desc, doc_id, line_num) as rank from pairs where prob >= 0.5) where rank <= 5")
def e4_select_prob_half(s, d):
    return _flat(E.select_prob_half(X.pairs(s, d), X.claims(s, d)))


@query(f"with {X.PAIRS} select claim_id, doc_id, line_num, rank from (select *, row_number() over (partition by claim_id order by score desc, doc_id, line_num) as rank from pairs where prob >= 0.3) where rank <= 5")
def e5_select_scaled(s, d):
    return _flat(E.select_scaled(X.pairs(s, d), X.claims(s, d), 0.3))


def _sweep_sql() -> str:
    return f"""with {X.PAIRS}, {X.CLAIMS}, ts as (select unnest([0.1, 0.5, 0.9])::double as threshold),
  top as (select t.threshold, u.*, row_number() over (partition by threshold, claim_id order by score desc, doc_id, line_num) as rank from uniq u join ts t on u.prob >= t.threshold qualify rank <= 5),
  h as (select t.threshold, g.claim_id, g.grp, bool_and(b.claim_id is not null) as covered from gold g cross join ts t left join top b on b.threshold = t.threshold and b.claim_id = g.claim_id and b.doc_id = g.doc_id and b.line_num = g.line_num group by all),
  c as (select threshold, claim_id, bool_or(covered) as covered from h group by all),
  f as (select t.threshold, c.label, coalesce(v.covered, false) as covered, v.claim_id is null as no_gold from claims c cross join ts t left join c v on v.claim_id = c.claim_id and v.threshold = t.threshold)
  select threshold, round(avg((label = 'NOT ENOUGH INFO' or covered)::int), 6) as strict, round(avg((covered or no_gold)::int) filter (label <> 'NOT ENOUGH INFO'), 6) as recall from f group by 1"""


@query(_sweep_sql())
def e6_threshold_sweep(s, d):
    rows = E.first_rows(X.pairs(s, d), "pos")
    return E.threshold_sweep(rows, X.claims(s, d).drop("predicted_label"), [0.1, 0.5, 0.9]).select("threshold", R("strict"), R("recall"))


@query(f"with {X.PAIRS} select claim_id, doc_id, line_num, rank from best where rank <= 2")
def e7_recut(s, d):
    return _flat(E.recut(_selected(s, d), 2))


@query("""with t as (select l_orderkey as claim_id, l_suppkey % 5 as doc_id, l_linenumber % 2 as line_num, l_extendedprice as pos, l_discount * 10 as prob, l_returnflag as query from lineitem),
  r as (select *, row_number() over w as n, first_value(prob) over w as p, first_value(query) over w as q from t window w as (partition by claim_id, doc_id, line_num order by pos))
  select 'rows' as kind, count(*) as n from r where n = 1 union all select 'violations', count(*) from r where n > 1 and (prob - p >= 0.01 or query <> q)""")
def e8_score_table(s, d):
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 5).alias("doc_id"), (F.col("l_linenumber") % 2).alias("line_num"), F.col("l_extendedprice").alias("pos"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") * 10).alias("prob"), F.col("l_returnflag").alias("query"))
    table, bad = E.score_table(x, ["claim_id", "doc_id", "line_num"])
    return table.agg(F.lit("rows").alias("kind"), F.count("*").alias("n")).unionByName(bad.select(F.lit("violations").alias("kind"), F.col("violations").alias("n")))


@query("""with t as (select l_orderkey as claim_id, l_suppkey % 5 as doc_id, l_extendedprice as pos, l_discount * 10 as prob from lineitem)
  select claim_id, doc_id, round(prob, 6) as prob from t qualify row_number() over (partition by claim_id, doc_id order by pos) = 1""")
def e9_doc_score_table(s, d):
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 5).alias("doc_id"), F.col("l_extendedprice").alias("pos"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") * 10).alias("prob"), F.col("l_returnflag").alias("query"))
    return E.score_table(x, ["claim_id", "doc_id"], tolerance=0.05)[0].select("claim_id", "doc_id", R("prob"))


@query(f"""with {X.PAIRS}, few as (select * from uniq where line_num % 2 = 0), docs as (select claim_id, doc_id, max(prob) as prob from few group by all)
  select b.claim_id, b.doc_id, b.line_num, round(coalesce(x.prob, 0.5), 6) as sent_prob, round(coalesce(y.prob, 0.99), 6) as doc_prob from best b left join few x using (claim_id, doc_id, line_num) left join docs y on y.claim_id = b.claim_id and y.doc_id = b.doc_id""")
def e10_attach_scores(s, d):
    p = E.first_rows(X.pairs(s, d), "pos").filter("line_num % 2 = 0")
    rows = _flat(_selected(s, d)).drop("rank")
    return E.attach_scores(rows, p, p.groupBy("claim_id", "doc_id").agg(F.max("prob").alias("prob"))).select("claim_id", "doc_id", "line_num", R("sent_prob"), R("doc_prob"))


@query("""select vec_id, round(avg(embedding[r + 1]::double), 6) as score, round(avg(abs(embedding[r + 4]::double)), 6) as prob from embeddings, (select unnest([0, 1, 2]) as r) group by 1""")
def e11_ensemble_scores(s, d):
    x = X.read(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("run"))
    x = x.select("vec_id", "run", F.get("embedding", F.col("run")).cast("double").alias("score"), F.abs(F.get("embedding", F.col("run") + 3).cast("double")).alias("prob"))
    return ensemble.ensemble_scores(x, ["vec_id"], 3).select("vec_id", R("score"), R("prob"))


def _runs(s, d) -> DataFrame:
    x = X.read(s, d, "embeddings").select(F.col("vec_id").alias("claim_id"), "embedding", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("run"))
    return x.select("claim_id", "run", F.transform(F.slice("embedding", 3 * F.col("run") + 1, 3), lambda v: v.cast("double")).alias("logits"))


RUNS = """runs as (select vec_id as claim_id, r as run, embedding[3 * r + 1]::double as a, embedding[3 * r + 2]::double as b, embedding[3 * r + 3]::double as c from embeddings, (select unnest([0, 1, 2]) as r))"""
ARG = "case when a >= b and a >= c then 'SUPPORTS' when b >= c then 'REFUTES' else 'NOT ENOUGH INFO' end"


@query(f"with {RUNS}, m as (select claim_id, avg(a) as a, avg(b) as b, avg(c) as c from runs group by 1) select claim_id, {ARG} as predicted_label, round(a, 6) as first_logit from m")
def e12_ensemble_labels(s, d):
    return ensemble.ensemble_labels(_runs(s, d), ["claim_id"]).select("claim_id", "predicted_label", F.round(F.get("logits", F.lit(0)), 6).alias("first_logit"))


@query(f"""with {RUNS}, subsets as (select unnest(['0', '1', '2', '0,1', '0,2', '1,2', '0,1,2']) as subset),
  m as (select subset, claim_id, avg(a) as a, avg(b) as b, avg(c) as c from runs join subsets on list_contains(string_split(subset, ','), run::varchar) group by all),
  l as (select subset, {ARG} as p, case label % 3 when 0 then 'SUPPORTS' when 1 then 'REFUTES' else 'NOT ENOUGH INFO' end as label from m join embeddings e on e.vec_id = m.claim_id)
  select subset, round(avg((p = label)::int), 6) as accuracy, round(avg((p = label and label = 'NOT ENOUGH INFO')::int), 6) as strict from l group by 1""")
def e13_search_ensembles(s, d):
    kind = "array<array<struct<doc_id:long,line_num:int>>>"
    label = F.element_at(F.array(*[F.lit(x) for x in C.LABELS]), F.col("label") % 3 + 1)
    claims = X.read(s, d, "embeddings").select(F.col("vec_id").alias("claim_id"), label.alias("label"), F.array().cast(kind).alias("evidence"), F.array().cast("array<struct<doc_id:long,line_num:int>>").alias("predicted_evidence"))
    return ensemble.search_ensembles(_runs(s, d), claims, 3).select("subset", R("accuracy"), R("strict"))


@query(f"with {X.PAIRS}, {X.CLAIMS} select b.claim_id, b.doc_id, b.line_num, b.rank from best b join claims c using (claim_id) where predicted_label <> 'NOT ENOUGH INFO'")
def e14_clear_nei_evidence(s, d):
    return _flat(E.clear_nei_evidence(_selected(s, d)))


@query(f"""with {RUNS}, m as (select claim_id, a, b, c from runs where run = 0) select claim_id, case when claim_id % 4 = 0 then 'NOT ENOUGH INFO' else {ARG} end as predicted_label from m""")
def e15_label_from_logits(s, d):
    x = _runs(s, d).filter("run = 0").withColumn("predicted_evidence", F.when(F.col("claim_id") % 4 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return E.label_from_logits(x).select("claim_id", "predicted_label")


@query("select l_orderkey as claim_id, 'hidden' as selection_label, count(*) as n from lineitem group by 1")
def e16_hide_labels(s, d):
    return E.hide_labels(X.pairs(s, d).withColumn("selection_label", F.lit("true"))).groupBy("claim_id", "selection_label").agg(F.count("*").alias("n"))


# --- M


def _rows(s, d) -> DataFrame:
    return _selected(s, d)


@query(f"""with {X.PAIRS}, {X.CLAIMS}, {X.FLAGS} select round(avg((ok and (nei or covered))::int), 6) as strict, round(avg(ok::int), 6) as accuracy,
  round(avg(case when n = 0 then 1.0 else hit / n end) filter (not nei), 6) as precision, round(avg((covered or no_gold)::int) filter (not nei), 6) as recall from flags""")
def m1_verification_score(s, d):
    return metrics.verification_score(_rows(s, d)).select(R("strict"), R("accuracy"), R("precision"), R("recall"))


@query(f"with {X.PAIRS}, {X.CLAIMS}, {X.FLAGS} select claim_id, ok, ok and (nei or covered) as strict, nei or covered as evidence_ok, case when not nei then round(case when n = 0 then 1.0 else hit / n end, 6) end as p, case when not nei then (covered or no_gold)::int::double end as r from flags")
def m2_to_m6_claim_flags(s, d):
    return _rows(s, d).select("claim_id", metrics.label_correct().alias("ok"), metrics.strict_correct().alias("strict"), metrics.evidence_correct().alias("evidence_ok"), F.round(metrics.macro_precision(), 6).alias("p"), metrics.macro_recall().alias("r"))


@query(f"with {X.PAIRS}, {X.CLAIMS}, {X.FLAGS} select round(sum(hit) / sum(n), 6) as micro_precision from flags where not nei")
def m7_micro_precision(s, d):
    return metrics.micro_precision(_rows(s, d)).select(R("micro_precision"))


def _doc_rows(s, d) -> DataFrame:
    """Predicted documents: suppliers of an order's lines by falling price; gold: suppliers by return flag."""
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("doc_id"), "l_returnflag", "l_extendedprice", "l_discount")
    groups = x.groupBy("claim_id", "l_returnflag").agg(F.array_sort(F.collect_set(F.struct("doc_id", F.lit(0).alias("line_num")))).alias("g")).groupBy("claim_id").agg(F.collect_list("g").alias("evidence"))
    got = x.filter("l_discount >= 0.04").groupBy("claim_id", "doc_id").agg(F.max("l_extendedprice").alias("p")).groupBy("claim_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "doc_id")), False), lambda v: v["doc_id"]).alias("predicted_docids"))
    rows = X.labels(s, d).join(groups.hint("merge"), "claim_id").join(got.hint("merge"), "claim_id", "left")
    return rows.withColumn("predicted_docids", F.coalesce("predicted_docids", F.array().cast("array<long>")))


DOCS = f"""{X.CLAIMS.split('gold as')[0].rstrip().rstrip(',')}, g as (select distinct l_orderkey as claim_id, l_returnflag as grp, l_suppkey as doc_id from lineitem),
  p0 as (select l_orderkey as claim_id, l_suppkey as doc_id, max(l_extendedprice) as p from lineitem where l_discount >= 0.04 group by all),
  p as (select *, row_number() over (partition by claim_id order by p desc, doc_id desc) as r from p0),
  ks as (select unnest([1, 2, 5]) as k),
  h as (select k, g.claim_id, grp, bool_and(p.claim_id is not null) as c from g cross join ks left join p on p.claim_id = g.claim_id and p.doc_id = g.doc_id and p.r <= k group by all),
  c as (select k, claim_id, bool_or(c) as covered from h group by all),
  n as (select k, p.claim_id, count(*) as n, count(*) filter (exists (select 1 from g where g.claim_id = p.claim_id and g.doc_id = p.doc_id)) as hit from p join ks on p.r <= k group by all),
  f as (select c.k, c.claim_id, label = 'NOT ENOUGH INFO' as nei, covered, coalesce(n, 0) as n, coalesce(hit, 0) as hit from c join claims using (claim_id) left join n on n.k = c.k and n.claim_id = c.claim_id)"""
DOC_AGG = "round(avg((nei or covered)::int), 6) as hit, round(avg(case when n = 0 then 1.0 else hit / n end) filter (not nei), 6) as precision, round(avg(covered::int) filter (not nei), 6) as recall, round(avg(n), 6) as mean_docs"


@query(f"with {DOCS} select {DOC_AGG} from f where k = 5")
def m8_doc_score(s, d):
    return metrics.doc_score(_doc_rows(s, d)).select(R("hit"), R("precision"), R("recall"), R("mean_docs"))


@query(f"with {DOCS} select claim_id, nei or covered as hit, case when not nei then round(case when n = 0 then 1.0 else hit / n end, 6) end as p, case when not nei then covered::int::double end as r from f where k = 5")
def m9_m10_doc_flags(s, d):
    return _doc_rows(s, d).select("claim_id", metrics.doc_hit().alias("hit"), F.round(metrics.doc_macro_precision(), 6).alias("p"), metrics.doc_macro_recall().alias("r"))


@query(f"""with {X.CLAIMS}, ids as (select l_orderkey as claim_id, l_returnflag as grp, concat(l_partkey, '<SENT_LINE>', l_linenumber) as sid, l_discount from lineitem),
  top as (select distinct claim_id, sid from ids where l_discount >= 0.03), t as (select *, row_number() over (partition by claim_id order by sid desc) as r from top),
  h as (select i.claim_id, i.grp, bool_and(t.sid is not null) as c from (select distinct claim_id, grp, sid from ids) i left join t on t.claim_id = i.claim_id and t.sid = i.sid and t.r <= 5 group by all)
  select claims.claim_id, label = 'NOT ENOUGH INFO' or coalesce(bool_or(c), false) as hit from claims left join h using (claim_id) group by claims.claim_id, label""")
def m11_sentence_hit(s, d):
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_returnflag", C.pack_id("l_partkey", "l_linenumber").alias("sid"), "l_discount")
    gold = x.groupBy("claim_id", "l_returnflag").agg(F.collect_set("sid").alias("g")).groupBy("claim_id").agg(F.collect_list("g").alias("gold_sentids"))
    got = x.filter("l_discount >= 0.03").groupBy("claim_id").agg(F.collect_set("sid").alias("predicted_sentids"))
    rows = X.labels(s, d).join(gold.hint("merge"), "claim_id", "left").join(got.hint("merge"), "claim_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("gold_sentids", "array<array<string>>"), ("predicted_sentids", "array<string>"))})
    return rows.select("claim_id", metrics.sentence_hit().alias("hit"))


@query(f"""with {DOCS}, a as (select claim_id, count(distinct doc_id) as n from g group by 1), b as (select claim_id, count(*) as n from p group by 1),
  i as (select g.claim_id, count(distinct g.doc_id) as n from g join p on p.claim_id = g.claim_id and p.doc_id = g.doc_id group by 1)
  select round(avg(2 * coalesce(i.n, 0) / (a.n + coalesce(b.n, 0))), 6) as doc_f1, round(avg(coalesce(b.n, 0)), 6) as mean_docs from a left join b using (claim_id) left join i using (claim_id)""")
def m12_doc_f1(s, d):
    return metrics.doc_f1(_doc_rows(s, d)).select(R("doc_f1"), R("mean_docs"))


@query(f"with {DOCS}, b as (select g.claim_id, count(distinct p.doc_id) as n from (select distinct claim_id from g) g left join p using (claim_id) group by 1) select n::int as n_items, count(*) as n_claims from b group by 1")
def m12_size_histogram(s, d):
    return metrics.size_histogram(_doc_rows(s, d), "predicted_docids")


@query(f"with {X.PAIRS}, {X.CLAIMS}, {X.FLAGS} select label, count(*) filter (n = 0) as n_empty, count(*) as n_claims, round(count(*) filter (n = 0) / count(*), 6) as ratio from flags group by 1")
def m13_empty_evidence_by_label(s, d):
    return metrics.empty_evidence_by_label(_rows(s, d)).select("label", "n_empty", "n_claims", R("ratio"))


@query(f"with {X.PAIRS}, {X.CLAIMS}, {X.FLAGS} select claim_id, label from flags where ok and not (nei or covered)")
def m14_error_rows(s, d):
    return metrics.error_rows(_rows(s, d)).select("claim_id", "label")


@query("""with c as (select quality::varchar as t, toxic::varchar as p, count(*) as n from labels group by all), k as (select unnest(['0', '1']) as label),
  e as (select label, coalesce(sum(n) filter (t = label), 0)::double as support, coalesce(sum(n) filter (p = label), 0)::double as np, coalesce(sum(n) filter (t = label and p = label), 0)::double as hits from k cross join c group by 1),
  z as (select sum(support) as s, sum(hits) as c, sum(np * support) as pt, sum(np * np) as pp, sum(support * support) as tt from e)
  select label, support::bigint as support, round(hits / nullif(np, 0), 6) as precision, round(hits / nullif(support, 0), 6) as recall, round((c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) as correlation from e, z""")
def m15_confusion_report(s, d):
    x = X.read(s, d, "labels").select(F.col("quality").cast("string").alias("t"), F.col("toxic").cast("string").alias("p"))
    return metrics.confusion_report(x, "t", "p").select("label", "support", R("precision"), R("recall"), R("correlation"))


@query(f"with {DOCS} select k::int as k, {DOC_AGG} from f group by k")
def m16_metrics_at_k(s, d):
    return metrics.metrics_at_k(_doc_rows(s, d), (1, 2, 5)).select("k", R("hit"), R("precision"), R("recall"), R("mean_docs"))


def _labelled(s, d) -> DataFrame:
    return X.pairs(s, d).withColumn("selection_label", F.when(F.col("line_num") % 2 == 0, "true").otherwise("false"))


@query(f"with {X.PAIRS} select round(avg((prob >= 0.5)::int) filter (line_num % 2 = 0), 6) as recall from pairs")
def m17_selection_recall(s, d):
    return metrics.selection_recall(_labelled(s, d)).select(R("recall"))


@query(f"with {X.PAIRS} select round(100 * avg(((prob >= 0.5) = (line_num % 2 = 0))::int), 6) as accuracy from pairs")
def m18_selection_accuracy(s, d):
    return metrics.selection_accuracy(_labelled(s, d)).select(R("accuracy"))


@query(f"""with {X.CLAIMS}, sizes as (select claim_id, grp, count(*) as n from gold group by all), first as (select claim_id, min(grp) as grp from gold group by 1),
  f as (select c.label, s.n from claims c left join first using (claim_id) left join sizes s on s.claim_id = c.claim_id and s.grp = first.grp)
  select round(avg((label = 'NOT ENOUGH INFO' or coalesce(n <= 5, false))::int), 6) as strict, 1.0::double as accuracy from f""")
def m19_oracle_score(s, d):
    return metrics.oracle_score(_rows(s, d)).select(R("strict"), R("accuracy"))


@query(f"with {X.CLAIMS} select label, count(*) as n_claims from claims group by 1")
def m20_label_counts(s, d):
    return metrics.label_counts(X.labels(s, d))


@query(f"with {X.CLAIMS}, n as (select claims.claim_id, count(distinct grp) as n from claims left join gold using (claim_id) group by 1) select n::int as n_groups, count(*) as n_claims, count(*) filter (n >= 3) as n_with_three from n group by 1")
def m21_evidence_profile(s, d):
    return metrics.evidence_profile(X.claims(s, d))


# --- N


AUG = f"""{X.PAIRS}, {X.CLAIMS}, groups as (select claim_id, label, grp, dense_rank() over (partition by claim_id order by grp) - 1 as group_id, doc_id, line_num from gold join claims using (claim_id)),
  base as (select claim_id, label, group_id, doc_id, line_num, false as added from groups where label <> 'NOT ENOUGH INFO'),
  room as (select claim_id, label, group_id, 5 - count(*) as room, floor({X.hash_sql('claim_id', 'group_id')} * (5 - count(*) + 1)) as take from base group by claim_id, label, group_id having count(*) < 5),
  cand as (select r.*, b.doc_id, b.line_num from room r join best b using (claim_id) anti join base x on x.claim_id = r.claim_id and x.group_id = r.group_id and x.doc_id = b.doc_id and x.line_num = b.line_num),
  fill as (select claim_id, label, group_id, doc_id, line_num, true as added from (select *, row_number() over (partition by claim_id, group_id order by {X.hash_sql('claim_id', 'group_id', 'doc_id', 'line_num', seed=13)}, doc_id, line_num) as r from cand) where r <= take),
  none as (select c.claim_id, label, 0 as group_id, doc_id, line_num, true as added from claims c join best b using (claim_id) where label = 'NOT ENOUGH INFO'
    qualify row_number() over (partition by c.claim_id order by {X.hash_sql('c.claim_id', 'doc_id', 'line_num', seed=14)}, doc_id, line_num) <= 2 + floor({X.hash_sql('c.claim_id')} * 4)),
  aug as (select * from base union all select * from fill union all select * from none)"""


def _best(s, d) -> DataFrame:
    return E.best_rows(E.first_rows(X.pairs(s, d, dealt=True), "pos"), 0.5, 5)


@query(f"with {AUG} select claim_id, label, group_id::int as group_id, doc_id, line_num, added from aug")
def n1_augment_evidence(s, d):
    return N.augment_evidence(X.claims(s, d), _best(s, d))


@query(f"""with {AUG}, tops as (select c.claim_id, label, doc_id, line_num, row_number() over (partition by c.claim_id order by score desc, doc_id, line_num) <= 2 as top from claims c join best b using (claim_id) where label = 'NOT ENOUGH INFO'),
  t as (select *, row_number() over (partition by claim_id, top order by {X.hash_sql('claim_id', 'top', 'doc_id', 'line_num', seed=14)}, doc_id, line_num) as r from tops),
  v as (select claim_id, label, 0 as group_id, doc_id, line_num, true as added from t where top or r <= floor({X.hash_sql('claim_id')} * 3)),
  z as (select * from base union all select * from fill union all select * from v)
  select claim_id, label, group_id::int as group_id, doc_id, line_num, added from z""")
def n2_augment_evidence_v11(s, d):
    return N.augment_evidence_v11(X.claims(s, d), _best(s, d))


TALK = """talk as (select conv_id, turn, role, text, case when coalesce(lag(role) over (partition by conv_id order by role, turn) <> role, true) and turn <> 0 then concat(role, ' <t> ', text) else text end as t from conversations)"""


def _talk(s, d) -> DataFrame:
    return X.read(s, d, "conversations").select("conv_id", F.col("role").alias("doc_id"), F.col("turn").alias("line_num"), "text")


@query(f"with {TALK} select conv_id, string_agg(t, ' ' order by role, turn) as evid from talk group by 1")
def n3_evidence_text(s, d):
    return N.evidence_text(_talk(s, d), ["conv_id"])


@query(f"with {TALK} select conv_id, row_number() over (partition by conv_id order by role, turn)::int as pos, t as text from talk")
def n5_evidence_text_list(s, d):
    return N.evidence_text_list(_talk(s, d), ["conv_id"]).select("conv_id", F.posexplode("texts").alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


def _part_sentences(s, d) -> DataFrame:
    p = X.read(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return p.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line_num"), "p_name").select("doc_id", "line_num", F.concat_ws(" ", "p_name", "line_num").alias("text"))


def _order_claims(s, d) -> DataFrame:
    return X.claims(s, d).withColumn("claim", F.concat_ws(" ", F.lit("order"), "claim_id"))


TEXTS = f"""{AUG}, st as (select a.claim_id, a.group_id, a.label, a.doc_id, a.line_num, concat(p_name, ' ', line_num) as text, lag(doc_id) over (partition by claim_id, group_id order by doc_id, line_num) as before from aug a join part on p_partkey = doc_id),
  tt as (select *, case when (before is null or before <> doc_id) then concat(doc_id, ' <t> ', text) else text end as t from st),
  rows as (select claim_id, group_id, any_value(label) as label, string_agg(t, ' ' order by doc_id, line_num) as evid from tt group by all),
  ided as (select concat(claim_id, '#', row_number() over (partition by claim_id order by group_id) - 1) as id, concat('order ', claim_id) as claim, evid, label, claim_id, group_id from rows)"""


@query(f"with {TEXTS} select id, claim, evid, label from ided")
def n4_training_rows(s, d):
    return N.training_rows(_order_claims(s, d), _best(s, d), _part_sentences(s, d))


@query(f"with {TEXTS}, few as (select * from uniq where line_num % 2 = 0) select id, label, count(*) as n, round(sum(coalesce(s.prob, 0.5)), 6) as total from ided i join aug a using (claim_id, group_id, label) left join few s on s.claim_id = a.claim_id and s.doc_id = a.doc_id and s.line_num = a.line_num group by all")
def n6_training_rows_scored(s, d):
    scores = E.first_rows(X.pairs(s, d, dealt=True), "pos").filter("line_num % 2 = 0")
    got = N.training_rows_scored(_order_claims(s, d), _best(s, d), _part_sentences(s, d), scores)
    return got.select("id", "label", F.size("evid").cast("long").alias("n"), F.round(F.aggregate("evid", F.lit(0.0), lambda a, e: a + e["prob"]), 6).alias("total"))


@query(f"with {TEXTS}, few as (select * from uniq where line_num % 2 = 0), dd as (select claim_id, doc_id, max(prob) as prob from few group by all) select id, label, round(sum(coalesce(dd.prob, 0.99)), 6) as total from ided i join aug a using (claim_id, group_id, label) left join dd on dd.claim_id = a.claim_id and dd.doc_id = a.doc_id group by all")
def n7_training_rows_doc_scored(s, d):
    scores = E.first_rows(X.pairs(s, d, dealt=True), "pos").filter("line_num % 2 = 0")
    got = N.training_rows_scored(_order_claims(s, d), _best(s, d), _part_sentences(s, d), scores, scores.groupBy("claim_id", "doc_id").agg(F.max("prob").alias("prob")))
    return got.select("id", "label", F.round(F.aggregate("evid", F.lit(0.0), lambda a, e: a + e["doc_prob"]), 6).alias("total"))


EVAL = f"""{X.PAIRS}, {X.CLAIMS}, st as (select claim_id, doc_id, line_num, concat(p_name, ' ', line_num) as text, lag(doc_id) over (partition by claim_id order by doc_id, line_num) as before from best join part on p_partkey = doc_id),
  ev as (select claim_id, string_agg(case when before is null or before <> doc_id then concat(doc_id, ' <t> ', text) else text end, ' ' order by doc_id, line_num) as evid from st group by 1)"""


@query(f"with {EVAL} select claim_id, concat('order ', claim_id) as claim, coalesce(evid, '') as evid from claims left join ev using (claim_id)")
def n8_eval_rows(s, d):
    return N.eval_rows(_order_claims(s, d), _best(s, d), _part_sentences(s, d))


@query(f"with {TEXTS} select count(*) as n, count(distinct id) as n_ids, sum(length(evid))::bigint as chars from ided")
def n9_adversarial_rows(s, d):
    got = N.adversarial_rows(_order_claims(s, d), E.first_rows(X.pairs(s, d, dealt=True), "pos"), _part_sentences(s, d), 0.5, 5)
    return got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.sum(F.length("evid")).alias("chars"))


@query("select concat('d', doc_id) as cid, lang as query, sha256(text) as context, 'train' as label from documents union all select concat('b', item_id), 'hidden', sha256(text), 'hidden' from benchmark")
def n10_nli_pairs(s, d):
    train = X.read(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("claim"), F.sha2("text", 256).alias("evid"), F.lit("train").alias("label"))
    other = X.read(s, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("claim_id"), F.lit("hidden").alias("claim"), F.sha2("text", 256).alias("evid"))
    return N.nli_pairs(train, other)


@query("with n as (select len(string_split(text, ' ')) as n from documents) select max(n)::int as max, round(avg(n), 6) as mean, round(stddev_pop(n), 5) as std from n")
def n11_text_length_stats(s, d):
    return N.text_length_stats(X.read(s, d, "documents"), "text").select("max", R("mean"), R("std", 5))


@query("select doc_id::varchar as id, 'vc' as task, n_chars, lang as label from documents union all select item_id::varchar, 'ss', length(text), 'none' from benchmark")
def n12_mix_tasks(s, d):
    a = X.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("premise"), F.lit(0).alias("hypothesis"), F.col("lang").alias("label"))
    b = X.read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("premise"), F.lit(0).alias("hypothesis"), F.lit("none").alias("label"))
    return N.mix_tasks(("vc", a), ("ss", b)).select("id", "task", F.col("premise").alias("n_chars"), "label")


@query("""with t as (select conv_id, turn, string_split(role, ' ') as p, list_slice(string_split(text, chr(10)), 1, 5) as s from conversations),
  u as (select conv_id, turn, len(p) + 2 as head, list_transform(s, lambda x: least(64, len(string_split(x, ' ')))) as n from t)
  select conv_id, turn, head + list_sum(n) + 1 as n_tokens, list_sum(n) + 1 as n_second, head + list_sum(n) as last_end from u""")
def n13_pair_sequence(s, d):
    x = X.read(s, d, "conversations").withColumn("q", N.pair_sequence("role", F.split("text", "\n")))
    return x.select("conv_id", "turn", F.size("q.tokens").cast("long").alias("n_tokens"), F.aggregate("q.types", F.lit(0), lambda a, b: a + b).cast("long").alias("n_second"), F.element_at("q.spans", -1)["end"].cast("long").alias("last_end"))


@query("select conv_id, string_agg(text, '|' order by md5(concat_ws('|', '12', conv_id, text)), text) as texts from conversations group by 1")
def n14_shuffle_sentences(s, d):
    x = X.read(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("t"))
    return x.select("conv_id", F.array_join(N.shuffle_sentences("t", "conv_id"), "|").alias("texts"))


@query(f"select conv_id as claim_id, turn * 100000 + i as pos, 36 as n, {X.hash_sql('text')} as prob from (select conv_id, turn, text, unnest(range(len(string_split_regex(text, '\\s+')))) as i from conversations)")
def n15_token_features(s, d):
    x = _talk(s, d).select(F.col("conv_id").alias("claim_id"), "doc_id", "line_num", F.posexplode(F.split("text", r"\s+")).alias("i", "token"))
    tokens = x.withColumn("pos", F.col("line_num") * 100_000 + F.col("i"))
    lexical = tokens.select("claim_id", "token").distinct().withColumn("flags", F.array_repeat((F.length("token") % 2).cast("int"), 30))
    probs = _talk(s, d).select(F.col("conv_id").alias("claim_id"), "doc_id", "line_num", E.hash_fraction("text").alias("prob"))
    return N.token_features(tokens, lexical, probs).select("claim_id", "pos", F.size("features").alias("n"), F.element_at("features", -1).alias("prob"))


# --- T with labels


@query(f"with {X.PAIRS}, {X.CLAIMS}, p as (select *, case when exists (select 1 from gold g where g.claim_id = pairs.claim_id and g.doc_id = pairs.doc_id and g.line_num = pairs.line_num and g.grp = 'R') then 'true' else 'false' end as l from pairs) select l as selection_label, count(*) as n_pairs from p group by 1")
def t13_label_balance(s, d):
    gold = X.gold_rows(s, d).filter("grp = 'R'").select("claim_id", "doc_id", "line_num", F.lit("true").alias("selection_label")).distinct()
    rows = X.pairs(s, d).join(gold.hint("merge"), ["claim_id", "doc_id", "line_num"], "left").fillna("false", ["selection_label"])
    return T.label_balance(rows)


@query(f"with {X.PAIRS}, n as (select claim_id, count(*) as n from pairs group by 1) select round(avg(n), 6) as mean, max(n) as max, min(n) as min, round(stddev_pop(n), 6) as std from n")
def t14_candidate_count_stats(s, d):
    return T.candidate_count_stats(X.pairs(s, d)).select(R("mean"), "max", "min", R("std"))


@query(f"with {X.PAIRS}, p as (select *, line_num % 2 = 0 as t from pairs) select claim_id, doc_id, line_num, score from p where t or {X.hash_sql('claim_id', 'doc_id', 'line_num')} < 0.3")
def t11_downsample_negatives(s, d):
    return T.downsample_negatives(_labelled(s, d), 0.3).select("claim_id", "doc_id", "line_num", "score")


@query(f"""with {X.PAIRS}, p as (select *, line_num % 2 = 0 as t, {X.hash_sql('claim_id', 'doc_id', 'line_num')} as h from uniq), m as (select least(count(*) filter (t), count(*) filter (not t)) as m from p)
  select claim_id, doc_id, line_num, t::varchar as selection_label from (select *, row_number() over (partition by t order by h, claim_id, doc_id, line_num) as r from p), m where r <= m""")
def t15_balance_pairs(s, d):
    rows = E.first_rows(X.pairs(s, d, dealt=True), "pos").withColumn("selection_label", F.when(F.col("line_num") % 2 == 0, "true").otherwise("false"))
    return T.balance_pairs(rows).select("claim_id", "doc_id", "line_num", "selection_label")


@query(f"with {X.PAIRS}, {X.CLAIMS} select p.claim_id, count(*) as n from pairs p join claims using (claim_id) where label = 'NOT ENOUGH INFO' group by 1")
def t16_pairs_for_label(s, d):
    return T.pairs_for_label(X.pairs(s, d), X.labels(s, d)).groupBy("claim_id").agg(F.count("*").alias("n"))


@query(f"with {X.PAIRS} select claim_id, count(distinct (doc_id, line_num)) as n from pairs where line_num % 2 = 0 group by 1")
def t10_gold_selection(s, d):
    return T.gold_selection(_labelled(s, d)).select("claim_id", F.size("predicted_evidence").cast("long").alias("n"))


@query(f"with {X.PAIRS}, {X.CLAIMS}, g as (select distinct claim_id, doc_id, line_num from gold) select g.claim_id, g.doc_id, g.line_num, concat(g.doc_id, ' <t> ', p_name, ' ', g.line_num) as text, 'true' as selection_label from g anti join best b on b.claim_id = g.claim_id and b.doc_id = g.doc_id and b.line_num = g.line_num join part on p_partkey = g.doc_id where not contains(concat(p_name, ' ', g.line_num), g.doc_id::varchar)")
def t12_missing_gold_pairs(s, d):
    gold = X.gold_rows(s, d).select("claim_id", "doc_id", "line_num").distinct()
    got = T.missing_gold_pairs(gold, _best(s, d), _part_sentences(s, d).withColumn("doc_id", F.col("doc_id")))
    return got.filter(F.col("text").contains(" <t> "))


@query(f"with {X.PAIRS}, {X.CLAIMS}, g as (select distinct claim_id, doc_id, line_num from gold) select count(b.claim_id) as n_hit, count(*) as n_gold from g left join best b on b.claim_id = g.claim_id and b.doc_id = g.doc_id and b.line_num = g.line_num")
def t12_gold_hit_ratio(s, d):
    gold = X.gold_rows(s, d).select("claim_id", "doc_id", "line_num").distinct()
    return T.gold_hit_ratio(gold, _best(s, d))
