"""Queries of corpus tables, column functions, vocabularies, lexical relations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import lexical as L
from evidentia.operators import vocab as V
from evidentia.plans import pipeline as U
from evidentia.plans import standins as X
from evidentia.plans.queries_linking import INDEX, TOPK, encoded, matches
from evidentia.plans.registry import query
from evidentia.plans.scratch import scratch_dir, written
from evidentia.sources import tables as S
from evidentia.streaming import streams

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)
ENCODE = "replace(replace(replace(replace(replace(replace(replace({}, '(', '-LRB-'), ')', '-RRB-'), '[', '-LSB-'), ']', '-RSB-'), '{{', '-LCB-'), '}}', '-RCB-'), ':', '-COLON-')"


#: As functions.columns.TOKEN.
TOKEN = C.TOKEN.replace("'", "''")
DECODE = "replace(replace(replace(replace(replace(replace(replace({}, '-LRB-', '('), '-RRB-', ')'), '-LSB-', '['), '-RSB-', ']'), '-LCB-', '{{'), '-RCB-', '}}'), '-COLON-', ':')"
NATURAL = f"array_to_string(regexp_extract_all(replace({DECODE.format('doc_id')}, '_', ' '), '{TOKEN}'), ' ')"


# --- S


def _pages_raw(s, d):
    """Documents as raw pages: numbered lines with a tab and, on even ones, a link. Tabs of the text, which end a field there, become spaces."""
    x = X.read(s, d, "documents").withColumn("text", F.replace("text", F.lit("\t"), F.lit(" ")))
    numbered = F.transform(F.split("text", "\n"), lambda t, i: F.concat_ws("\t", i.cast("string"), t, F.when(i % 2 == 0, F.lit("a\tA")), F.when(i % 5 == 3, F.lit("thumb"))))
    return x.select(F.concat(F.lit("p"), "doc_id").alias("id"), "text", F.array_join(numbered, "\n").alias("lines"))


PAGES = """p as (select concat('p', doc_id) as id, text, string_split(nfc_normalize(text), chr(10)) as l from (select doc_id, replace(text, chr(9), ' ') as text from documents)),
  u as (select id, text, unnest(range(len(l))) as line_num, unnest(l) as t, l from p)"""


def _rewritten(s, df, name: str) -> str:
    """``df`` as JSON lines in a scratch folder."""
    path = f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}"
    S.write_rows(df, path)
    return path


@query(f"with {X.CLAIMS} select c.claim_id as id, label, count(distinct grp) as n_groups, count(grp) as n_sentences from claims c left join gold using (claim_id) group by 1, 2")
def s1_read_claims(s, d):
    """Orders as claims in JSON lines, evidence as string tuples with a repeated and an empty one in each group."""
    entry = lambda e: F.array(F.lit("1"), F.lit("2"), e["doc_id"].cast("string"), e["line_num"].cast("string"))
    none = F.array(F.lit("1"), F.lit("2"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    groups = F.transform("evidence", lambda g: F.concat(F.transform(g, entry), F.transform(F.slice(g, 1, 1), entry), F.array(none)))
    rows = X.claims(s, d).select(F.col("claim_id").alias("id"), F.lit("VERIFIABLE").alias("verifiable"), "label", F.lit("c").alias("claim"), groups.alias("evidence"))
    got = S.read_claims(s, _rewritten(s, rows, "claims"))
    return got.select("id", "label", F.size("evidence").cast("long").alias("n_groups"), F.aggregate("evidence", F.lit(0), lambda n, g: n + F.size(g)).cast("long").alias("n_sentences"))


@query("select concat('p', doc_id) as id, sha256(replace(text, chr(9), ' ')) as text, len(string_split(text, chr(10)))::int as n_lines from documents")
def s2_read_pages(s, d):
    got = S.read_pages(s, _rewritten(s, _pages_raw(s, d), "pages"))
    return got.select("id", F.sha2("text", 256).alias("text"), F.size(F.split("lines", "\n")).alias("n_lines"))


@query("select conv_id, turn, role, text from conversations")
def s9_write_rows(s, d):
    rows = X.read(s, d, "conversations").select("conv_id", "turn", "role", "text")
    return s.read.schema(rows.schema).json(_rewritten(s, rows, "rows"))


@query(f"with {X.TITLES} select distinct doc_id, {NATURAL} as keyword from titles")
def s12_read_keyword_dict(s, d):
    """Titles and, as ids without letters, part numbers, which the filter drops."""
    ids = X.titles(s, d).select(F.col("doc_id").alias("docid")).union(X.read(s, d, "part").select(F.col("p_partkey").cast("string"))).distinct()
    return S.read_keyword_dict(s, _rewritten(s, ids, "keywords"))


@query(f"with {X.CLAIMS} select c.claim_id as id, predicted_label, count(grp) as n_evidence from claims c left join gold using (claim_id) group by 1, 2")
def s16_write_submission(s, d):
    rows = X.claims(s, d).select(F.col("claim_id").alias("id"), "predicted_label", "label", F.flatten("evidence").alias("predicted_evidence"))
    schema = "id long, predicted_label string, predicted_evidence array<struct<doc_id:long,line_num:int>>"
    got = s.read.schema(schema).json(_rewritten(s, S.submission(rows), "submission"))
    return got.select("id", "predicted_label", F.size("predicted_evidence").cast("long").alias("n_evidence"))


@query(f"with {PAGES} select id, line_num::int as line_num, length(nfc_normalize(trim(t))) as n, case when line_num % 2 = 0 and line_num % 5 <> 3 then 2 else 0 end as n_links from u")
def s3_build_documents(s, d):
    docs = S.build_documents(_pages_raw(s, d)).select("id", F.inline("lines"))
    return docs.select("id", "line_num", F.length(nfc("text")).cast("long").alias("n"), F.size("h_links").alias("n_links"))


def nfc(column: str):
    """Composed again, so that lengths compare with the tables'."""
    import unicodedata

    return F.pandas_udf(lambda t: t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), "string")(column)


def _saved(s, d):
    """The lines of documents as a bucketed table in the scratch folder."""
    name = f"sentences_{uuid.uuid4().hex}"
    S.save_sentences(X.lines(s, d), name, 16, f"{scratch_dir(s)}/{name}")
    return s.table(name)


@query(f"with {X.LINES} select doc_id, line_num, sha256(text) as text from lines")
def s4_build_sentences(s, d):
    return _saved(s, d).withColumn("text", F.sha2("text", 256))


@query(f"with {X.LINES}, e as (select doc_id, quality + 3 * toxic as line_num from labels) select e.doc_id, e.line_num, sha256(text) as text from e left join lines using (doc_id, line_num)")
def s5_lookup_evidence(s, d):
    e = X.read(s, d, "labels").select("doc_id", (F.col("quality") + 3 * F.col("toxic")).cast("int").alias("line_num"))
    return S.lookup_evidence(e, _saved(s, d)).withColumn("text", F.sha2("text", 256))


@query(f"with {X.LINES} select doc_id, line_num, sha256(text) as text from labels join lines using (doc_id)")
def s6_lookup_doc_sentences(s, d):
    return S.lookup_doc_sentences(X.read(s, d, "labels").select("doc_id"), _saved(s, d)).withColumn("text", F.sha2("text", 256))


@query("select concat('p', doc_id) as id from documents where length(text) > 1")
def s7_list_doc_ids(s, d):
    return S.list_doc_ids(S.build_documents(_pages_raw(s, d)))


@query(f"with {PAGES} select count(*) as n_sentences from u where length(trim(t)) > 0 and length(text) > 1")
def s8_count_sentences(s, d):
    return S.count_sentences(S.build_documents(_pages_raw(s, d)))


@query("""select concat(event_type, '_', user_id % 100) as doc, sum(cast(floor(value) as bigint))::bigint as views from events where user_id % 4 <> 0 and user_id % 7 <> 1 group by 1""")
def s10_count_pageviews(s, d):
    """Events as dump lines: other projects, and lines with a field too few, are left out."""
    x = X.read(s, d, "events")
    project = F.when(F.col("user_id") % 4 == 0, "de").when(F.col("user_id") % 4 == 1, "en.m").otherwise("en")
    line = F.concat_ws(" ", project, F.concat_ws("_", "event_type", (F.col("user_id") % 100).cast("string")), F.floor("value").cast("string"), F.when(F.col("user_id") % 7 != 1, F.lit("0")))
    return S.parse_pageviews(x.select(line.alias("value")))


#: Rows of a part of s11.
PART_ROWS = 300
_BY_KEY = "row_number() over (order by l_orderkey, l_linenumber) - 1"


@query(f"""with n as (select concat_ws('-', lpad(l_orderkey::varchar, 12, '0'), l_linenumber) as id, {_BY_KEY} as number from lineitem)
  select (number // {PART_ROWS})::bigint as part, count(*) as n_rows, 1::bigint as n_files, min(id) as first, max(id) as last, true as in_place from n group by 1""")
def s11_split_and_merge(s, d):
    """By part, as read back: its rows, files, first and last key, and whether its number is in the file's path."""
    path = f"{scratch_dir(s)}/split-{uuid.uuid4().hex}"
    key = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"))
    S.split_by_rows(X.read(s, d, "lineitem").select(key.alias("id"), "l_partkey"), "id", PART_ROWS, path)
    rows = S.read_splits(s, "id string, l_partkey long", path)
    named = F.bool_and(F.contains("file", F.concat(F.lit("/part="), F.col("part").cast("string"), F.lit("/"))))
    return rows.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files"), F.min("id").alias("first"), F.max("id").alias("last"), named.alias("in_place"))


@query("select concat('w', vec_id) as word, round(embedding[1]::double, 5) as first, round(embedding[64]::double, 5) as last from embeddings where label % 2 = 0 and vec_id % 5 <> 0")
def s13_read_vectors(s, d):
    x = X.read(s, d, "embeddings")
    short = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = x.select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(short.cast("array<string>"), " ")).alias("value"))
    keep = x.filter("label % 2 = 0").select(F.concat(F.lit("w"), "vec_id").alias("token"))
    return S.parse_vectors(rows, 64, keep).select("word", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.get("vec", F.lit(63)).cast("double"), 5).alias("last"))


@query("select doc_id as id, sha256(text) as text from documents union all select item_id, sha256(text) from benchmark")
def s14_concat_datasets(s, d):
    a = X.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"))
    return S.concat_datasets(a, X.read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("text")))


def _customers(s, d):
    """(fresh, cached) customers: those whose account isn't overdrawn are cached."""
    rows = X.read(s, d, "customer")
    named = [F.col("c_custkey").alias("key"), F.col("c_name").alias("value")]
    return rows.select(*named), rows.filter("c_acctbal >= 0").select(*named)


@query("select c_custkey as key, c_name as value from customer where coalesce(c_acctbal, -1) < 0")
def s15_cache_update(s, d):
    fresh, cached = _customers(s, d)
    return S.cache_update(cached, fresh)


@query("select c_custkey as key, c_name as value from customer")
def s15_cache_load(s, d):
    """The cache after the missing rows were appended: each key once."""
    fresh, cached = _customers(s, d)
    path = f"{scratch_dir(s)}/cache-{uuid.uuid4().hex}"
    cached.write.parquet(path)
    S.cache_append(s, path, fresh)
    return S.cache_load(s, path, fresh.schema)


# --- C


@query(f"select doc_id, md5({ENCODE.format('text')}) as encoded, md5(replace({ENCODE.format('text')}, ' ', '_')) as as_id, md5(text) as decoded from documents")
def c2_c3_brackets_as_tokens(s, d):
    x = X.read(s, d, "documents").withColumn("e", C.brc_encode("text"))
    return x.select("doc_id", F.md5("e").alias("encoded"), F.md5(C.brc_encode("text", True)).alias("as_id"), F.md5(C.brc_decode("e")).alias("decoded"))


@query(f"select role, count(*) filter (regexp_matches(w, '^\\p{{P}}+$') or lower(w) in ({STOPS})) as n_filtered, count(*) as n from (select role, unnest(string_split_regex(text, '\\s+')) as w from conversations) where w <> '' group by 1")
def c6_filtered_words(s, d):
    x = X.read(s, d, "conversations").select("role", F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''")
    return x.groupBy("role").agg(F.sum(C.is_filtered_word(F.col("w")).cast("long")).alias("n_filtered"), F.count("*").alias("n"))


FW = f"(regexp_matches({{0}}, '^\\p{{{{P}}}}+$') or lower({{0}}) in ({STOPS}))"


@query(f"""with g as (select role, unnest([[ws[i], ws[i + 1]] for i in range(1, len(ws))]) as g from (select role, string_split_regex(text, '\\s+') as ws from conversations)),
  f as (select role, {FW.format('g[1]')} as a, {FW.format('g[2]')} as b from g) select role, count(*) filter (a or b) as n_any, count(*) filter (a and b) as n_all, count(*) filter (a or b) as n_ends from f group by 1""")
def c7_filter_ngram(s, d):
    x = X.read(s, d, "conversations").select("role", F.split("text", r"\s+").alias("ws"))  # a column of its own: in the lambda a text would be split for each word
    pairs = F.when(F.size("ws") > 1, F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.slice("ws", i, 2)))
    x = x.select("role", F.explode(pairs).alias("g"))
    return x.groupBy("role").agg(*[F.sum(C.filter_ngram("g", m).cast("long")).alias(f"n_{m}") for m in ("any", "all", "ends")])


@query("""with l as (select doc_id, string_split(text, chr(10))[1] as l from documents),
  t as (select doc_id, unnest([l, regexp_replace(l, '[a-zA-Z]', '', 'g'), concat(l, ' ', chr(1605)), concat(chr(65010), l), concat(l, chr(126464)), concat(l, chr(1424))]) as title, unnest(range(6)) as form from l)
  select doc_id, form, not regexp_matches(title, '[a-zA-Z]') or regexp_matches(title, '[\\x{600}-\\x{6FF}\\x{750}-\\x{77F}\\x{8A0}-\\x{8FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{10E60}-\\x{10E7F}\\x{1EE00}-\\x{1EEFF}]') as dropped from t""")
def c8_filter_doc_id(s, d):
    """First lines as they are, without ASCII letters, with a letter of three Arabic ranges, and with one just below the first range."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    forms = F.array(line, F.regexp_replace(line, "[a-zA-Z]", ""), F.concat(line, F.lit(" \u0645")), F.concat(F.lit("\ufdf2"), line), F.concat(line, F.lit("\U0001ee00")), F.concat(line, F.lit("\u0590")))
    rows = X.read(s, d, "documents").select("doc_id", F.posexplode(forms).alias("form", "title"))
    return rows.select("doc_id", F.col("form").cast("long").alias("form"), C.filter_doc_id("title").alias("dropped"))


@query("""with t as (select p_partkey, p_size % 5 = 0 as open, p_name, lower(p_type) as ty from part)
  select p_partkey, not open as ok, case when open then concat(ty, ' x') else ty end as inside, case when open then p_name else concat(p_name, ' x') end as outside from t""")
def c9_c10_brackets(s, d):
    p = X.read(s, d, "part")
    t = F.concat(F.split("p_name", " "), F.array(F.lit("-LRB-"), F.lower("p_type")), F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("-RRB-"))), F.array(F.lit("x")))
    p = p.withColumn("t", t)
    return p.select("p_partkey", C.balanced_brackets("t").alias("ok"), F.array_join(C.words_inside_brackets("t"), " ").alias("inside"), F.array_join(C.remove_brackets("t"), " ").alias("outside"))


@query(f"with {X.TITLES} select p_partkey, case when bracketed and inside = 'film' then 0.2 when bracketed and inside = 'album' then 0.1 else 0.0 end::double as bonus, case when bracketed and inside = 'economy' then 3.0 when bracketed and inside = 'small' then 2.0 else 1.0 end::double as overlap from titles")
def c11_c12_title_scores(s, d):
    t = X.titles(s, d).withColumn("t", C.title_tokens("doc_id"))
    claim, lemma = F.array(F.lit("Economy"), F.lit("the")), F.array(F.lit("SMALL"))
    return t.select("p_partkey", C.media_bonus("t").alias("bonus"), C.bracket_overlap_score("t", "t", claim, lemma).alias("overlap"))


@query("select l_orderkey as claim_id, count(distinct groups) as n_groups, sum(n)::bigint as n_entries from (select l_orderkey, groups, any_value(n) as n from (select l_orderkey, l_returnflag, string_agg(distinct concat(l_suppkey % 3, ':', l_linenumber % 2), '|' order by concat(l_suppkey % 3, ':', l_linenumber % 2)) as groups, count(distinct (l_suppkey % 3, l_linenumber % 2)) as n from lineitem group by all) group by all) group by 1")
def c16_normalize_evidence(s, d):
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_returnflag", F.array(F.lit("1"), F.lit("2"), (F.col("l_suppkey") % 3).cast("string"), (F.col("l_linenumber") % 2).cast("string")).alias("t"))
    g = x.groupBy("claim_id", "l_returnflag").agg(F.collect_list("t").alias("g")).groupBy("claim_id").agg(F.collect_list("g").alias("e"))
    e = g.select("claim_id", C.validate_evidence(F.flatten(C.normalize_evidence(C.evidence_from_tuples("e")))).alias("flat"), C.normalize_evidence(C.evidence_from_tuples("e")).alias("e"))
    return e.select("claim_id", F.size("e").cast("long").alias("n_groups"), F.size("flat").cast("long").alias("n_entries"))


@query("select l_orderkey as claim_id, l_partkey as doc_id, l_linenumber as line_num, count(*) as n from lineitem group by all")
def c14_c15_packed_ids(s, d):
    x = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), C.pack_id("l_partkey", "l_linenumber").alias("sid"))
    x = x.select("claim_id", F.explode(C.to_scoring_format(F.array("sid"))).alias("e"))
    return x.groupBy("claim_id", F.col("e.doc_id").cast("long").alias("doc_id"), F.col("e.line_num").alias("line_num")).agg(F.count("*").alias("n"))


@query("""with n as (select conv_id, turn, len(string_split(text, ' ')) as n from conversations), s as (select conv_id, turn, sum(n) over (partition by conv_id order by turn) as e, n from n)
  select conv_id, row_number() over (partition by conv_id order by turn)::int - 1 as pos, (e - n)::int as start, e::int as stop from s""")
def c18_spans(s, d):
    x = X.read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    spans = C.token_spans(F.transform("l", lambda t: F.split(t["text"], " ")))
    return x.select("conv_id", F.posexplode(spans).alias("pos", "x")).select("conv_id", "pos", "x.start", F.col("x.end").alias("stop"))


@query("select doc_id, sha256(case when trim(text) = '' then '@@@EMPTY@@@' else array_to_string(string_split_regex(trim(text), '\\s+')[1:20], ' ') end) as text from documents")
def c19_truncate_tokens(s, d):
    return X.read(s, d, "documents").select("doc_id", F.sha2(C.truncate_tokens("text", 20), 256).alias("text"))


@query("""with x as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)
  select vec_id, case when a >= b and a >= c then 'SUPPORTS' when b >= c then 'REFUTES' else 'NOT ENOUGH INFO' end as label, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) as p from x""")
def c20_softmax(s, d):
    x = X.read(s, d, "embeddings").withColumn("l", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")))
    return x.select("vec_id", C.argmax_label("l").alias("label"), F.round(F.get(C.softmax("l"), F.lit(0)), 6).alias("p"))


@query("select vec_id, round(-embedding[4]::double, 6) as score, round(1 - 1 / (1 + exp(-embedding[4]::double)), 6) as prob from embeddings")
def c21_joint_scores(s, d):
    x = X.read(s, d, "embeddings").withColumn("j", C.joint_scores(F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))))
    return x.select("vec_id", F.round("j.score", 6).alias("score"), F.round("j.prob", 6).alias("prob"))


@query("select p_partkey, w as token, case when regexp_matches(w, '^[0-9]{1,5}$') then (('0x' || substr(md5(w), 1, 8))::bigint % 20000)::int end as bucket from (select p_partkey, unnest([p_partkey::varchar, (p_partkey * 7919)::varchar, p_name]) as w from part)")
def c23_number_bucket(s, d):
    tokens = F.array(F.col("p_partkey").cast("string"), (F.col("p_partkey") * 7919).cast("string"), F.col("p_name"))
    return X.read(s, d, "part").select("p_partkey", F.explode(tokens).alias("token")).select("p_partkey", "token", C.number_bucket("token").alias("bucket"))


@query("""select doc_id, sha256(nfc_normalize(text)) as composed, length(nfc_normalize(text)) + len(list_filter(string_split(nfc_normalize(text), ''), lambda c: c <> strip_accents(c))) as n_decomposed from documents""")
def c1_nfd(s, d):
    """The decomposed length, and the text after composing it again."""
    x = X.read(s, d, "documents").select("doc_id", C.nfd("text").alias("t"))
    return x.select("doc_id", F.sha2(nfc("t"), 256).alias("composed"), F.length("t").cast("long").alias("n_decomposed"))


@query(f"with {X.TITLES} select p_partkey, {NATURAL} as title from titles")
def c4_natural_title(s, d):
    return X.titles(s, d).select("p_partkey", C.natural_title("doc_id").alias("title"))


@query(f"select doc_id, len(t) as n_tokens, sha256(array_to_string(t, ' ')) as tokens from (select doc_id, regexp_extract_all(text, '{TOKEN}') as t from documents)")
def c5_tokenize(s, d):
    x = X.read(s, d, "documents").select("doc_id", C.tokenize("text").alias("t"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query("""with l as (select doc_id, string_split(replace(text, chr(9), ' '), chr(10)) as l from documents), u as (select doc_id, len(l) as n, unnest(range(len(l))) as i, unnest(l) as t from l)
  select doc_id, i::int as line_num, sha256(trim(case when i = 6 and n > 7 then concat(t, '8') else t end)) as text from u where i < 7""")
def c13_split_numbered_lines(s, d):
    """Documents as numbered lines whose numbers skip 7: from there on the rest stays in line 6, whose text ends at the next tab."""
    number = lambda i: F.when(i < 7, i).otherwise(i + 1).cast("string")
    x = X.read(s, d, "documents").withColumn("text", F.replace("text", F.lit("\t"), F.lit(" ")))
    x = x.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.concat_ws("\t", number(i), t)), "\n").alias("lines"))
    return x.select("doc_id", F.inline(C.split_numbered_lines("lines"))).select("doc_id", "line_num", F.sha2("text", 256).alias("text"))


@query(f"with {X.CLAIMS} select c.claim_id, count(grp) as n from claims c left join gold using (claim_id) group by 1")
def c17_validate_evidence(s, d):
    return X.claims(s, d).select("claim_id", F.size(C.validate_evidence(F.flatten("evidence"))).cast("long").alias("n"))


@query(f"with {X.LINES}, p as (select doc_id, line_num, row_number() over (partition by doc_id order by line_num) - 1 as pos, least(5, count(*) over (partition by doc_id)) as k from lines) select doc_id, line_num, round(1.1 * pow(0.8 / 1.1, case when k > 1 then pos / (k - 1) else 0.0 end), 6) as weight from p where pos < k")
def c24_position_weight(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    x = X.lines(s, d).withColumns({"pos": F.row_number().over(w.orderBy("line_num")) - 1, "n": F.count("*").over(w)})
    return x.select("doc_id", "line_num", F.round(C.position_weight("pos", "n"), 6).alias("weight")).filter("weight is not null")


# --- V

U01 = "((('0x' || substr(md5(concat(token, '|12|', i, '|{j}')), 1, 8))::bigint)::double + 0.5) / 4294967296.0"
VC = "vc as (select lang as namespace, w as token, count(*) as n from (select lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents) group by all)"


@query(f"with {VC} select namespace, token, (row_number() over (partition by namespace order by n desc, token) + 1)::int as idx from vc where n >= 3 and namespace <> 'es'")
def v1_build_vocab(s, d):
    return V.build_vocab(V.token_counts(X.read(s, d, "documents"), "lang", "text"), 3, exclude=["es"])


def _vocab(s, d):
    return V.build_vocab(V.token_counts(X.read(s, d, "documents"), "lang", "text"), 20, oov=2600)


SHA = "0::hugeint"
for _i in range(5):
    SHA = f"(({SHA}) * 4294967296 + (('0x' || substr(sha1(token), {1 + 8 * _i}, 8))::bigint)) % 2600"


@query(f"with {VC}, v as (select namespace, token, row_number() over (partition by namespace order by n desc, token) + 2600 as idx from vc where n >= 20) select vc.namespace, vc.token, coalesce(v.idx, 1 + {SHA.replace('token', 'vc.token')})::bigint as idx from vc left join v on v.namespace = vc.namespace and v.token = vc.token")
def v2_token_index(s, d):
    tokens = V.token_counts(X.read(s, d, "documents"), "lang", "text").select("namespace", "token")
    return V.token_index(tokens, _vocab(s, d))


@query(f"with {VC}, v as (select namespace, token, (row_number() over (partition by namespace order by n desc, token) + 2600)::int as idx from vc where n >= 20) select * from v union all select 'en', 'hidden', -2")
def v3_set_special_index(s, d):
    return V.set_special_index(_vocab(s, d), "en", "hidden", -2)


@query(f"with {VC}, v as (select namespace, token, (row_number() over (partition by namespace order by n desc, token) + 2600)::int as idx from vc where n >= 20) select * from v")
def v4_save_and_load_vocab(s, d):
    path = f"{scratch_dir(s)}/vocab-{uuid.uuid4().hex}"
    V.save_vocab(_vocab(s, d), path)
    return V.load_vocab(s, path)


@query(f"""with v as (select concat('w', vec_id) as token, vec_id::int as idx, label % 2 = 0 as known, embedding from embeddings), s as (select avg(x::double) as mean, stddev_pop(x::double) as std from (select unnest(embedding) as x from v where known)),
  p as (select token, idx, known, embedding, unnest(range(64))::int as i from v)
  select token, idx, i, round((case when known then embedding[i + 1]::float else (mean + std * sqrt(-2 * ln({U01.format(j=0)})) * cos(2 * pi() * {U01.format(j=1)}))::float end)::double, 4) as x from p, s""")
def v5_vocab_vectors(s, d):
    x = X.read(s, d, "embeddings")
    vectors = x.filter("label % 2 = 0").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    vocab = x.select(F.concat(F.lit("w"), "vec_id").alias("token"), F.col("vec_id").cast("int").alias("idx"))
    got = V.vocab_vectors(vocab, vectors, 64).select("token", "idx", F.posexplode("vec").alias("i", "x"))
    return got.withColumn("x", F.round(F.col("x").cast("double"), 4))


@query("select distinct concat('w', vec_id % 100) as word from embeddings")
def v6_pretrained_words(s, d):
    rows = X.read(s, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), (F.col("vec_id") % 100).cast("string")), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value"))
    return V.pretrained_words(rows)


# --- L

EDGES = """edges as (select distinct concat('c', c_custkey) as src, concat('n', c_nationkey) as dst from customer union select concat('n', n_nationkey), concat('r', n_regionkey) from nation
  union select concat('o', o_orderkey), concat('c', o_custkey) from orders union select concat('r', r_regionkey), 'world' from region)"""


def _edges(s, d):
    r = lambda t: X.read(s, d, t)
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    e = r("customer").select(k("c", "c_custkey").alias("src"), k("n", "c_nationkey").alias("dst")).union(r("nation").select(k("n", "n_nationkey"), k("r", "n_regionkey")))
    return e.union(r("orders").select(k("o", "o_orderkey"), k("c", "o_custkey"))).union(r("region").select(k("r", "r_regionkey"), F.lit("world")))


CLOSED = f"""recursive {EDGES}, closed as (select src, dst, 1 as depth from edges union select c.src, e.dst, c.depth + 1 from closed c join edges e on e.src = c.dst where c.depth < 17), least as (select src, dst, min(depth) as depth from closed group by all)"""


@query(f"with {CLOSED} select src, dst, depth from least")
def l1_closure(s, d):
    return L.closure(_edges(s, d))


@query(f"with {CLOSED} select src, dst, depth from least where depth <= 2")
def l2_closure_to_level(s, d):
    return L.closure_to_level(_edges(s, d), 2)


@query(f"with {CLOSED} select src, dst, case when depth < 3 then depth::varchar else '3plus' end as level from least")
def l3_level_split(s, d):
    return L.level_split(L.closure(_edges(s, d))).select("src", "dst", "level")


def _sides(s, d):
    """Side 1: words of even turns, side 2: of odd ones, by conversation."""
    x = X.read(s, d, "conversations").select(F.col("conv_id").alias("claim_id"), "turn", F.explode(F.split("text", r"\s+")).alias("token")).filter("token <> ''")
    x = x.withColumns({"lemma": F.regexp_replace(F.lower("token"), "[.,]", ""), "stem": F.lit(None).cast("string")})
    return x.filter("turn % 2 = 0").drop("turn").distinct(), x.filter("turn % 2 = 1").drop("turn").distinct()


@query("""with w as (select distinct conv_id as claim_id, turn % 2 as side, token from (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as token from conversations) where token <> ''),
  f as (select claim_id, side, token, unnest([lower(token), regexp_replace(lower(token), '[.,]', '', 'g'), case when lower(token) in ('not', 'n''t') then 'not' else lower(token) end]) as form from w)
  select distinct a.claim_id, a.token from f a join f b on a.claim_id = b.claim_id and a.form = b.form where a.side = 0 and b.side = 1""")
def l4_exact_match(s, d):
    return L.exact_match(*_sides(s, d))


@query("""with w as (select distinct conv_id as claim_id, turn % 2 as side, token from (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as token from conversations) where token <> ''),
  f as (select claim_id, side, token, unnest([lower(token), regexp_replace(lower(token), '[.,]', '', 'g'), case when lower(token) in ('not', 'n''t') then 'not' else lower(token) end]) as form from w),
  em as (select distinct a.claim_id, a.side, a.token, 'em' as family from f a join f b on a.claim_id = b.claim_id and a.form = b.form and a.side <> b.side),
  ant as (select distinct a.claim_id, a.side, a.token, 'ant' as family from w a join w b on a.claim_id = b.claim_id and a.side <> b.side and b.token = reverse(a.token)),
  up as (select distinct a.claim_id, a.side, a.token, unnest(['anc', 'hyper_1']) as family from w a join w b on a.claim_id = b.claim_id and a.side <> b.side and length(a.token) > 3 and b.token = left(a.token, 3)),
  down as (select distinct a.claim_id, a.side, a.token, unnest(['desc', 'hypo_1']) as family from w a join w b on a.claim_id = b.claim_id and a.side <> b.side and length(b.token) > 3 and a.token = left(b.token, 3)),
  found as (select * from em union all select * from ant union all select * from up union all select * from down),
  cells as (select claim_id, token, k, v from (select distinct claim_id, token from w), (select unnest(range(30)) as k), (select 1 as v)),
  hit as (select claim_id, token, (list_position(['em', 'ant', 'anc', 'desc', 'hypo_1', 'hyper_1'], family) - 1) * 3 + unnest([side, 2]) as k from found)
  select claim_id, token, string_agg(case when h.k is null then '0' else '1' end, '' order by c.k) as flags from cells c left join (select distinct * from hit) h using (claim_id, token, k) group by 1, 2""")
def l5_pair_features(s, d):
    one, two = _sides(s, d)
    words = one.select("token").union(two.select("token")).distinct()
    lex = words.filter(F.length("token") > 3).select(F.lit("hypernym").alias("rel"), F.col("token").alias("src"), F.substring("token", 1, 3).alias("dst"))
    lex = lex.union(words.select(F.lit("antonym"), "token", F.reverse("token")))
    return L.pair_features(one, two, lex).select("claim_id", "token", F.array_join(F.col("flags").cast("array<string>"), "").alias("flags"))


@query("select role, case left(upper(role), 1) when 'J' then 'a' when 'V' then 'v' when 'N' then 'n' when 'R' then 'r' end as pos, count(*) as n from conversations group by all")
def l6_pos_class(s, d):
    return X.read(s, d, "conversations").groupBy("role", L.pos_class(F.upper("role")).alias("pos")).agg(F.count("*").alias("n"))


# --- R

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _drained(s, stream, mode: str = "append"):
    """Runs a stream over what is there into a scratch table."""
    path = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


@query("""with w as (select date_trunc('hour', ts) as start, event_type as doc, sum(user_id)::bigint as views from events group by all), m as (select max(ts) as m from events)
  select start, doc, views from w, m where start + interval 1 hour <= m - interval 1 hour""")
def r1_stream_pageviews(s, d):
    """Hours that the watermark has closed; the last ones stay open until later events come."""
    x = streams.read_stream(s, d, EVENT, "events.parquet").select("ts", F.col("event_type").alias("doc"), F.col("user_id").alias("views"))
    return _drained(s, streams.stream_pageviews(x)).select("start", "doc", "views")


def _viewed(s, d) -> DataFrame:
    return streams.read_stream(s, d, EVENT, "events.parquet").select("ts", F.col("event_type").alias("doc"), F.col("user_id").alias("views"))


@query("""with e as (select ts, event_type as doc, user_id, time_bucket(interval 30 minutes, ts, timestamp '1970-01-01 00:00:00') as last, unnest(range(4)) as k from events),
  w as (select last - k * interval 30 minutes as start, doc, sum(user_id)::bigint as views from e group by all), m as (select max(ts) as m from events)
  select start, start + interval 2 hours as stop, doc, views from w, m where start + interval 2 hours <= m - interval 1 hour""")
def r1_stream_pageviews_sliding(s, d):
    """Two hours every half hour; an event counts in four windows."""
    return _drained(s, streams.stream_pageviews(_viewed(s, d), width="2 hours", slide="30 minutes"))


@query("""with e as (select ts, concat(event_type, '/', user_id) as doc, user_id, lag(ts) over (partition by event_type, user_id order by ts) as before from events),
  n as (select *, sum((before is null or ts > before + interval 30 minutes)::int) over (partition by doc order by ts rows unbounded preceding) as n from e),
  w as (select min(ts) as start, max(ts) + interval 30 minutes as stop, doc, sum(user_id)::bigint as views from n group by doc, n), m as (select max(ts) as m from events)
  select start, stop, doc, views from w, m where stop <= m - interval 1 hour""")
def r1_stream_pageviews_sessions(s, d):
    """Sessions of a user's events of a type: no more than half an hour apart."""
    x = _viewed(s, d).withColumn("doc", F.concat_ws("/", "doc", F.col("views").cast("string")))
    return _drained(s, streams.stream_pageviews(x, gap="30 minutes"))


@query(f"""with recursive {INDEX}, exact as (select keyword, doc_id, 5.0::double as priority from k1), said as (select p_partkey as claim_id, string_split(concat('the ', p_name, ' ', p_partkey % 50), ' ') as tokens from part), {matches('linked', 'said', 'exact')},
  r as (select claim_id, doc_id, priority, row_number() over (partition by claim_id, match_key order by length(doc_id) desc, doc_id) - 1 as place, count(*) over (partition by claim_id, match_key) as n from linked),
  ranked as (select claim_id, doc_id, case when n > 1 then round(greatest(0.0, 1 - 0.2 * place), 6)::double else priority end as priority from r), {TOPK} select * from topd""")
def r2_stream_link_claims(s, d):
    index = written(X.keyword_titles(s, d).transform(lambda t: t.select("keyword", "doc_id", F.lit(5.0).alias("priority"))), "index")
    x = streams.read_stream(s, d, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part.parquet")
    claims = x.select(F.col("p_partkey").alias("claim_id"), F.split(F.concat(F.lit("the "), "p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string")), " ").alias("tokens"))
    views = index.select(F.col("doc_id").alias("doc"), F.length("doc_id").cast("long").alias("views")).distinct()
    path = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    streams.stream_link_claims(claims, index, views, f"{path}/out", f"{path}/at").awaitTermination()
    return s.read.schema("claim_id long, doc_id string, priority double, rank int, batch int").parquet(f"{path}/out").drop("batch")


@query(f"""with {X.HREFS}, chosen as (select page_id // 20 as claim_id, page_id, length(html)::double as score from pages), own as (select claim_id, page_id, target, score from chosen join hrefs using (page_id) where pos = 0),
  best as (select * from own qualify row_number() over (partition by claim_id order by score desc, page_id) = 1), c as (select claim_id, {encoded('target')} as doc_id, target, score from best),
  linked as (select distinct page_id // 20 as claim_id, target as doc_id from hrefs where pos = 1), ranked as (select claim_id, doc_id, score as priority from c anti join linked using (claim_id, doc_id)), {TOPK} select * from topd""")
def r3_stream_second_hop(s, d):
    """Pages in six files, one a batch: a claim's sentences come in several batches."""
    graph = X.hrefs(s, d).select(F.col("page_id").alias("doc_id"), F.posexplode("h_links").alias("line_num", "target"))
    path = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    X.read(s, d, "pages").select("page_id", "html").repartition(6, F.hash("page_id")).write.parquet(f"{path}/in")
    x = streams.read_stream(s, f"{path}/in", "page_id long, html string", "*.parquet", 1)
    chosen = x.select(F.floor(F.col("page_id") / 20).alias("claim_id"), F.col("page_id").alias("doc_id"), F.lit(0).alias("line_num"), F.length("html").cast("double").alias("score"))
    views = X.hrefs(s, d).select(F.explode("h_links").alias("doc")).groupBy("doc").agg(F.count("*").alias("views"))
    links = graph.filter("line_num = 1").select(F.floor(F.col("doc_id") / 20).alias("claim_id"), F.col("target").alias("doc_id")).distinct()
    streams.stream_second_hop(chosen, graph, links, views, f"{path}/out", f"{path}/at").awaitTermination()
    return streams.second_hop_result(s, f"{path}/out")


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def r4_stream_dedup_scores(s, d):
    x = streams.read_stream(s, d, EVENT, "events.parquet")
    got = _drained(s, streams.stream_dedup_scores(x, ["user_id", "event_type"], late="3650 days").select("user_id", "event_type"))
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# --- U


@query("""with a as (select p_brand, count(*) as n from part where p_size > 10 group by 1)
  select run, p_brand, n, ran from (values ('first', 'brands,largest'), ('again', ''), ('other size', 'brands,largest'), ('other limit', 'largest')) v(run, ran),
  lateral (select p_brand, n from (select p_brand, count(*) as n from part where p_size > case run when 'first' then 10 when 'again' then 10 else 20 end group by 1) where n > case run when 'other limit' then 5 else 2 end)""")
def u4_step_reuse(s, d):
    """Two steps over one folder, four times: unchanged they are read, after a change of the first one's input both run, after one of the second's parameter only that one."""
    folder, out = f"{scratch_dir(s)}/steps-{uuid.uuid4().hex}", None
    for run, size, limit in (("first", 10, 2), ("again", 10, 2), ("other size", 20, 2), ("other limit", 20, 5)):
        steps = U.Steps(s, folder)
        parts = X.read(s, d, "part").filter(F.col("p_size") > size)
        brands = steps("brands", lambda parts=parts: parts.groupBy("p_brand").agg(F.count("*").alias("n")), [parts])
        rows = steps("largest", lambda brands=brands, limit=limit: brands.filter(F.col("n") > limit), ["brands"], {"limit": limit})
        rows = written(rows, "reuse").select(F.lit(run).alias("run"), "p_brand", "n", F.lit(",".join(steps.ran)).alias("ran"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def u5_two_hop(s, d):
    """The whole pipeline: claims about parts, titles as documents, their types as sentences, links between like names."""
    from evidentia.operators import linking as K

    titles = X.titles(s, d)
    claims = X.title_claims(s, d)
    gold = titles.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("claim_id"), F.array(F.array(F.struct("doc_id", F.lit(0).alias("line_num")))).alias("evidence"))
    claims = claims.join(gold, "claim_id", "left").withColumn("label", F.when(F.col("evidence").isNull(), C.LABELS[2]).otherwise(C.LABELS[0])).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<array<struct<doc_id:string,line_num:int>>>")))
    sentences = titles.groupBy("doc_id", "base").agg(F.min("p_size").alias("z")).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_num"), F.concat_ws(" ", "base", "z", F.lit("album"), "line_num").alias("text"))
    graph = titles.groupBy("doc_id", "base").agg(F.max("p_partkey").alias("m")).select("doc_id", F.lit(0).alias("line_num"), F.concat("base", F.lit("_"), (F.col("m") % 50).cast("string")).alias("target"))
    index = K.build_keyword_index(X.keyword_titles(s, d))
    views = titles.groupBy(C.brc_decode("doc_id").alias("doc")).agg(F.count("*").alias("views"))
    steps = U.Steps(s, f"{scratch_dir(s)}/two-hop-{uuid.uuid4().hex}")
    verdicts, _ = U.two_hop(steps, claims, index, views, sentences, graph, U.overlap_scorer, U.overlap_verifier)
    return verdicts.select("claim_id", "predicted_label", F.size("predicted_evidence").alias("n_evidence"))
