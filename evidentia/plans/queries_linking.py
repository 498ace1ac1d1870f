"""Queries of keyword linking and document ranking over part titles, events and page links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import docs as D
from evidentia.operators import linking as K
from evidentia.operators import spiral
from evidentia.plans import standins as X
from evidentia.plans.queries_retrieval import W as WEIGHT
from evidentia.plans.queries_retrieval import grams
from evidentia.plans.registry import query
from evidentia.plans.scratch import written
from evidentia.sources import tables as S

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)
TITLE_STOPS = ", ".join("'" + w.title().replace("'", "''") + "'" for w in C.STOP_WORDS)


def _tokens(text: str) -> F.Column:
    return F.split(text, r"\s+")


def encoded(target: str) -> str:
    """SQL of a link target as a document id."""
    for plain, code in (("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-"), (":", "-COLON-"), (" ", "_")):
        target = f"replace({target}, '{plain}', '{code}')"
    return target


# --- K

INDEX = f"""{X.TITLES}, kt as (select distinct doc_id, trim(regexp_replace(replace(doc_id, '_', ' '), '(-(?:[LR][RSC]B|COLON)-)', ' \\1 ', 'g')) as k0, base, bracketed, other from titles),
  k1 as (select doc_id, array_to_string(list_filter(string_split_regex(k0, '\\s+'), lambda w: w <> ''), ' ') as keyword, base, bracketed from kt),
  idx0 as (select keyword, doc_id, 5.0::double as priority from k1 union all select base, doc_id, 1.0::double from k1 where bracketed),
  idx as (select keyword, doc_id, max(priority) as priority from idx0 group by all)"""


@query(f"with {INDEX} select * from idx")
def k1_build_keyword_index(s, d):
    return K.build_keyword_index(X.keyword_titles(s, d))


def _word_index(s, d) -> DataFrame:
    """Words and turn numbers of conversations as keywords; the word itself and a bracketed title as documents."""
    x = X.read(s, d, "conversations").select(F.explode(F.concat(_tokens("text"), F.array((F.col("conv_id") * 37).cast("string"), F.concat((F.col("conv_id") % 200).cast("string"), F.lit("th"))))).alias("keyword")).filter("keyword <> ''").distinct()
    return x.select("keyword", F.explode(F.array("keyword", F.concat("keyword", F.lit("_-LRB-film-RRB-")))).alias("doc_id"), F.lit(1.0).alias("priority"))


@query(f"""with w as (select distinct unnest(list_concat(string_split_regex(text, '\\s+'), [(conv_id * 37)::varchar, concat(conv_id % 200, 'th')])) as keyword from conversations),
  i as (select keyword, unnest([keyword, concat(keyword, '_-LRB-film-RRB-')]) as doc_id, 1.0::double as priority from w where keyword <> ''),
  n as (select *, try_cast(regexp_extract(keyword, '^(\\d+)', 1) as integer) as n from i)
  select keyword, doc_id, priority from n where not (doc_id = keyword and (coalesce(regexp_matches(keyword, '^(0|[1-9][0-9]{{0,4}})$'), false)
    or (regexp_matches(keyword, '^(0|[1-9][0-9]{{0,2}})(st|nd|rd|th)$') and right(keyword, 2) = case when n % 100 between 11 and 13 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end)
    or keyword in ({STOPS}) or keyword in ({TITLE_STOPS})))""")
def k2_drop_noise_keywords(s, d):
    return K.drop_noise_keywords(_word_index(s, d))


def _index(s, d) -> DataFrame:
    return K.build_keyword_index(X.keyword_titles(s, d))

def matches(name: str, claims: str, index: str = "idx", lower: bool = False) -> str:
    """SQL of the leftmost-longest matches of ``claims`` (claim_id, tokens) as ``name``: the sweep follows each taken span to the next free start."""
    key, word = ("lower(match_key)", "lower(keyword)") if lower else ("match_key", "keyword")
    return f"""{name}_g as (select claim_id, start, start + k as stop, array_to_string(tokens[start + 1:start + k], ' ') as match_key from (
    select *, unnest(range(1, least(len(tokens) - start, (select max(len(string_split(keyword, ' '))) from {index})) + 1)) as k from (select claim_id, tokens, unnest(range(len(tokens))) as start from {claims}))),
  {name}_b as (select claim_id, start, max(stop) as stop, arg_max(match_key, stop) as match_key from {name}_g where {key} in (select {word} from {index}) group by claim_id, start),
  {name}_x as (select a.*, (select min(b.start) from {name}_b b where b.claim_id = a.claim_id and b.start >= a.stop) as following from {name}_b a),
  {name}_s as (select x.* from {name}_x x join (select claim_id, min(start) as start from {name}_b group by 1) using (claim_id, start) union all select x.* from {name}_s s join {name}_x x on x.claim_id = s.claim_id and x.start = s.following),
  {name} as (select claim_id, match_key, start::int as start, stop::int as stop, doc_id, max(priority)::double as priority from {name}_s join {index} on {key} = {word} group by all)"""


TITLE_CLAIMS = "claims as (select p_partkey as claim_id, string_split(concat('The ', p_name, ' ', p_partkey % 50, ' beat a ', lower(p_type), ' and the ', p_name, ' album'), ' ') as tokens from part)"
MATCHED = f"recursive {INDEX}, {TITLE_CLAIMS}, {matches('links', 'claims')}"
#: Every keyword and its documents start with the same letter here, so no key fails and none is matched again; tests/test_operators.py has rows where that happens.
SAME_LETTER = f"left(doc_id, 1) = left(match_key, 1) and lower(match_key) not in ({STOPS})"
FREQUENT = f"""freq as (select unnest(regexp_extract_all(lower(array_to_string(tokens, ' ')), '[a-z0-9]+')) as word, from claims), n as (select word, count(*) as n from freq group by 1),
  words as (select match_key, unnest(string_split(lower(match_key), ' ')) as word from (select distinct match_key from links)),
  flags as (select match_key, bool_and(coalesce(n, 0) > {{above}}) as frequent from words left join n using (word) group by 1)"""
PLAIN = "claim_id, match_key, doc_id, priority"
#: The first of the tokens left in title case.
TITLED = "list_concat([concat(upper(left(tokens[2], 1)), lower(substr(tokens[2], 2)))], tokens[3:])"
ARTICLE = f"bare as (select claim_id, {TITLED} as tokens from claims where tokens[1] in ('The', 'A', 'An') and len(tokens) > 1), {matches('more', 'bare')}, both_ as (select {PLAIN} from links union select {PLAIN} from more)"
SINGULAR = """case when regexp_matches(w, '(?i)(ss|us|is)$') then w when regexp_matches(w, '(?i)[^aeiou]ies$') then regexp_replace(w, '(?i)([^aeiou])ies$', '\\1y') when regexp_matches(w, '(?i)(sh|ch|x|ss|z)es$') then regexp_replace(w, '(?i)(sh|ch|x|ss|z)es$', '\\1')
    when regexp_matches(w, '(?i)[aeo]ves$') then regexp_replace(w, '(?i)([aeo])ves$', '\\1f') when regexp_matches(w, '(?i)men$') then regexp_replace(w, '(?i)men$', 'man') when regexp_matches(w, '(?i)s$') then regexp_replace(w, '(?i)s$', '') else w end"""
SINGULARS = f"rest as (select claim_id, list_transform(tokens, lambda w: {SINGULAR}) as tokens from claims where claim_id not in (select claim_id from {{linked}})), {matches('single', 'rest')}"


@query(f"with {MATCHED} select * from links")
def k3_link_keywords(s, d):
    return K.link_keywords(X.title_claims(s, d), _index(s, d))


@query(f"with {MATCHED} select claim_id, match_key, doc_id, max(priority) as priority from links where {SAME_LETTER} group by all")
def k4_first_letter_filter(s, d):
    return K.first_letter_filter(X.title_claims(s, d), _index(s, d))


@query(f"with {MATCHED} select * from links where {SAME_LETTER}")
def k5_link_keywords_multi(s, d):
    return K.link_keywords_multi(X.title_claims(s, d), _index(s, d))


def _frequencies(s, d) -> DataFrame:
    return K.word_frequencies(X.title_claims(s, d), "claim")


@query(f"with {MATCHED}, {FREQUENT.format(above=5)} select links.* from links join flags using (match_key) where lower(match_key) not in ({STOPS}) and (not frequent or left(doc_id, 1) = left(match_key, 1))")
def k6_link_frequency_aware(s, d):
    return K.link_frequency_aware(X.title_claims(s, d), _index(s, d), _frequencies(s, d))


@query(f"with {MATCHED}, {FREQUENT.format(above=1000)} select links.* from links join flags using (match_key) where lower(match_key) not in ({STOPS}) and case when frequent then left(doc_id, 1) = left(match_key, 1) when regexp_matches(match_key, '^[a-z]') then not contains(doc_id, '-LRB-') else true end")
def k7_link_no_bracket(s, d):
    return K.link_no_bracket(X.title_claims(s, d), _index(s, d), _frequencies(s, d), 1000)


@query("select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents) group by 1 having count(*) > 10")
def k8_word_frequencies(s, d):
    return K.frequent_words(K.word_frequencies(X.read(s, d, "documents")))


@query(f"with {MATCHED}, {ARTICLE} select * from both_")
def k9_article_rule(s, d):
    claims, index = X.title_claims(s, d), written(_index(s, d), "index")
    trie = K.keyword_trie(index)
    return K.article_rule(claims, K.link_keywords(claims, index, trie=trie), index, trie=trie)


@query(f"with {MATCHED.replace(TITLE_CLAIMS, TITLE_CLAIMS.replace('claims as', 'said as') + ", claims as (select claim_id, list_transform(tokens, lambda t: concat(t, 's')) as tokens from said)")}, {SINGULARS.format(linked='links')} select {PLAIN} from links union all select {PLAIN} from single")
def k10_singularize_fallback(s, d):
    claims, index = X.title_claims(s, d).withColumn("tokens", F.transform("tokens", lambda t: F.concat(t, F.lit("s")))), written(_index(s, d), "index")
    trie = K.keyword_trie(index)
    links = K.link_keywords(claims, index, trie=trie).select("claim_id", "match_key", "doc_id", "priority")
    return K.singularize_fallback(claims, links, index, trie)


@query(f"""with {MATCHED.replace(TITLE_CLAIMS, TITLE_CLAIMS.replace('claims as', 'said as') + ", claims as (select claim_id, list_transform(tokens, lambda t: upper(t)) as tokens from said)")},
  rest as (select claim_id, list_filter(tokens, lambda w: lower(w) not in ({STOPS})) as tokens from claims where claim_id not in (select claim_id from links)), {matches('low', 'rest', lower=True)} select {PLAIN} from links union all select {PLAIN} from low""")
def k11_lowercase_fallback(s, d):
    claims, index = X.title_claims(s, d).withColumn("tokens", F.transform("tokens", F.upper)), written(_index(s, d), "index")
    links = K.link_keywords(claims, index).select("claim_id", "match_key", "doc_id", "priority")
    return K.lowercase_fallback(claims, links, index)


@query("select item_id, sha256(replace(replace(text, 'the', 'THE'), 'and', '&')) as text from benchmark")
def k12_literal_rewrite(s, d):
    return K.literal_rewrite(X.read(s, d, "benchmark"), {"the": "THE", "and": "&"}, "text").select("item_id", F.sha2("text", 256).alias("text"))


@query(f"""with {X.TITLES}, l as (select p_partkey as claim_id, doc_id, bracketed, inside, case when p_partkey % 2 = 0 then 1.0 else 5.0 end as p from titles)
  select claim_id, doc_id, round((case when p <> 1.0 then p when bracketed and inside = case when claim_id % 4 = 0 then 'film' else 'economy' end then 3.0 else 1.0 end) + case when bracketed and inside = 'film' then 0.2 when bracketed and inside = 'album' then 0.1 else 0.0 end, 6)::double as priority from l""")
def k13_docid_rules(s, d):
    t = X.titles(s, d).withColumnRenamed("p_partkey", "claim_id")
    links = t.select("claim_id", "doc_id", F.when(F.col("claim_id") % 2 == 0, 1.0).otherwise(5.0).alias("priority"))
    claims = t.select("claim_id", F.when(F.col("claim_id") % 4 == 0, F.array(F.lit("A"), F.lit("Film"))).otherwise(F.array(F.lit("ECONOMY"))).alias("tokens"), F.lit(None).cast("array<string>").alias("lemmas"))
    return K.docid_rules(links, claims).select("claim_id", "doc_id", "priority")


DOCID_RULES = f"""inner_ as (select chained.*, tokens, regexp_extract(doc_id, '-LRB-(.*)-RRB-', 1) as inside from chained join claims using (claim_id)),
  ruled as (select claim_id, match_key, doc_id, round((case when priority <> 1 then priority when inside <> '' and inside not in ({STOPS}) and list_contains(list_transform(tokens, lambda w: lower(w)), inside) then 3.0 else 1.0 end)
    + case inside when 'film' then 0.2 when 'album' then 0.1 else 0.0 end, 6)::double as priority from inner_)"""


@query(f"with {MATCHED}, {ARTICLE}, {SINGULARS.format(linked='both_')}, chained as (select * from both_ union all select {PLAIN} from single), {DOCID_RULES} select * from ruled")
def k14_rule_chain(s, d):
    claims, index = X.title_claims(s, d), _index(s, d)
    return K.rule_chain(None, K.preset("default", claims, index))


#: Selected sentences of part claims, links from sentences to titles, and views of titles; all from order lines.
HOPS = """selected as (select l_partkey as claim_id, concat('s', l_suppkey) as doc_id, l_linenumber as line_num, max(l_extendedprice)::double as score from lineitem where l_returnflag <> 'N' group by all),
  graph as (select distinct concat('s', l_suppkey) as doc_id, l_linenumber as line_num, t.doc_id as target from lineitem join titles t on t.p_partkey = l_partkey where l_returnflag = 'A'),
  seen as (select replace(replace(t.doc_id, '-LRB-', '('), '-RRB-', ')') as doc, count(*) as views from lineitem join titles t on t.p_partkey = l_partkey group by 1)"""


def by_views(name: str, source: str) -> str:
    """SQL of ``source`` (claim_id, match_key, doc_id, priority) as ``name`` with groups of several documents ranked by views."""
    decoded = "replace(replace(doc_id, '-LRB-', '('), '-RRB-', ')')"
    return f"""{name}_r as (select x.*, row_number() over (partition by claim_id, match_key order by coalesce(views, 0) desc, doc_id) - 1 as r, count(*) over (partition by claim_id, match_key) as n from {source} x left join seen on doc = {decoded}),
  {name} as (select claim_id, match_key, doc_id, case when n > 1 then round(greatest(0.0, 1 - 0.2 * r), 6)::double else priority end as priority from {name}_r)"""


FIRST_HOP = f"""{MATCHED}, {HOPS}, chained as (select {PLAIN} from links), {DOCID_RULES}, {SINGULARS.format(linked='links')}, listed as (select {PLAIN} from ruled union all select {PLAIN} from single),
  bare as (select claim_id, {TITLED} as tokens from claims where tokens[1] in ('The', 'A', 'An') and len(tokens) > 1), {matches('more', 'bare')},
  main as (select * from listed union all select {PLAIN} from more anti join listed using (claim_id, match_key, doc_id)), {by_views('first_hop', 'main')}"""
_SIDES = """reached as (select claim_id, s.doc_id as sent_doc, s.line_num as sent_line, target as doc_id, score as priority from selected s join graph g using (doc_id, line_num)),
  top as (select claim_id, sent_doc, sent_line from reached where priority > -100 qualify row_number() over (partition by claim_id order by priority desc, sent_doc, sent_line) = 1),
  beside as (select distinct claim_id, concat(sent_doc, '<SENT_LINE>', sent_line) as match_key, doc_id, priority from reached join top using (claim_id, sent_doc, sent_line))"""
SECOND_HOP = f"{_SIDES}, {by_views('second_hop', 'beside')}"


def _spiral_state(s, d) -> spiral.Hops:
    lines, titles = X.read(s, d, "lineitem"), X.titles(s, d)
    sentence = [F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("doc_id"), F.col("l_linenumber").alias("line_num")]
    selected = lines.filter("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("claim_id"), *sentence).agg(F.max("l_extendedprice").cast("double").alias("score"))
    named = titles.select(F.col("p_partkey").alias("l_partkey"), F.col("doc_id").alias("target"))
    graph = lines.filter("l_returnflag = 'A'").join(named.hint("merge"), "l_partkey").select(*sentence, "target").distinct()
    views = lines.join(named.hint("merge"), "l_partkey").groupBy(C.brc_decode("target").alias("doc")).agg(F.count("*").alias("views"))
    return spiral.Hops(X.title_claims(s, d), _index(s, d), views, selected, graph, encode=False)


@query(f"with {FIRST_HOP} select * from first_hop")
def k14_first_hop(s, d):
    return spiral.run_rules(_spiral_state(s, d), "first_hop").links


@query(f"with {X.TITLES}, {HOPS}, {SECOND_HOP} select * from second_hop")
def k14_second_hop(s, d):
    return spiral.run_rules(_spiral_state(s, d), "second_hop").aside


@query(f"with {FIRST_HOP}, {SECOND_HOP} select *, 'main' as list from first_hop union all select *, 'aside' from second_hop")
def k14_spiral(s, d):
    state = spiral.run_rules(_spiral_state(s, d), "spiral")
    return state.links.withColumn("list", F.lit("main")).unionByName(state.aside.withColumn("list", F.lit("aside")))


@query(f"""with recursive {INDEX}, {TITLE_CLAIMS}, i0 as (select * from idx where priority = 5), i1 as (select * from idx where priority = 1), {matches('l0', 'claims', 'i0')}, {matches('l1', 'claims', 'i1')}
  select * replace (5.0::double as priority), 0 as index_id from l0 union all select * replace (1.0::double as priority), 1 from l1""")
def k15_multi_index_link(s, d):
    index = written(_index(s, d), "index")
    return K.multi_index_link(X.title_claims(s, d), [(index.filter("priority = 5"), 5.0), (index.filter("priority = 1"), 1.0)])


@query(f"with {MATCHED} select {PLAIN} from links where priority = 5 and not contains(doc_id, 'disambiguation') and length(match_key) > 9")
def u1_user_rules(s, d):
    """A user's own rule set: any functions of links, in their order."""
    claims, index = X.title_claims(s, d), _index(s, d)
    rules = [lambda links: K.link_keywords(claims, index).select("claim_id", "match_key", "doc_id", "priority"), lambda links: links.filter("priority = 5 and not contains(doc_id, 'disambiguation')"), lambda links: links.filter("length(match_key) > 9")]
    return K.rule_chain(None, rules)


RAW = MATCHED.replace("links as (", "every as (") + f", links as (select claim_id, match_key, doc_id, max(priority) as priority from every where {SAME_LETTER} group by all)"


@query(f"with {RAW}, {ARTICLE}, {SINGULARS.format(linked='both_')}, chained as (select *, 'nopageview' as method from both_ union all select *, 'raw_id' from both_ union all select {PLAIN}, 'raw_id' from single), {DOCID_RULES.replace('select claim_id, match_key', 'select method, claim_id, match_key')} select * from ruled")
def u6_method_choice(s, d):
    """Presets by name over the same claims."""
    claims, index = X.title_claims(s, d), written(_index(s, d), "index")
    runs = [K.rule_chain(None, K.preset(name, claims, index)).select(F.lit(name).alias("method"), "claim_id", "match_key", "doc_id", "priority") for name in ("nopageview", "raw_id")]
    return runs[0].unionByName(runs[1])


@query(f"with {INDEX} select distinct doc_id, keyword from k1")
def k16_build_keyword_dict(s, d):
    return K.build_keyword_dict(X.titles(s, d).select(F.col("doc_id").alias("id")).distinct())


# --- D


@query(f"with {X.VIEWS} select claim_id, match_key, doc_id, coalesce(views, 0) as views from links left join views on doc = doc_id")
def d1_pageview_lookup(s, d):
    return D.pageview_lookup(X.links(s, d), X.views(s, d)).select("claim_id", "match_key", "doc_id", "views")


D2 = f"""{X.VIEWS}, r as (select claim_id, match_key, doc_id, row_number() over (partition by claim_id, match_key order by coalesce(views, 0) desc, doc_id) - 1 as rank, count(*) over (partition by claim_id, match_key) as n from links left join views on doc = doc_id),
  ranked as (select claim_id, match_key, doc_id, case when n > 1 then round(greatest(0.0, 1 - 0.2 * rank), 6)::double else 1.0::double end as priority from r)"""


@query(f"with {D2} select * from ranked")
def d2_pageview_rank(s, d):
    return D.pageview_rank(X.links(s, d), X.views(s, d)).select("claim_id", "match_key", "doc_id", "priority")


@query(f"with {X.VIEWS} select claim_id, match_key, doc_id, coalesce(views, 0)::double as priority from links left join views on doc = doc_id")
def d3_pageview_raw(s, d):
    return D.pageview_raw(X.links(s, d), X.views(s, d)).select("claim_id", "match_key", "doc_id", "priority")


def _page_links(s, d) -> DataFrame:
    return X.hrefs(s, d).select(F.col("page_id").alias("doc_id"), F.posexplode("h_links").alias("line_num", "target"))


@query(f"""with {X.HREFS}, pairs as (select page_id as item_id, unnest(range(len(l))) as line_num, unnest(l) as text from (select page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) as l from pages)),
  asked as (select page_id as item_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as text from pages),
  counts as (select item_id, line_num, term, count(*) as tf from {grams('pairs', 'item_id, line_num')} group by all), qc as (select item_id, term, count(*) as tf from {grams('asked', 'item_id')} group by all),
  dfs as (select item_id, term, count(*) as df from counts group by all), ns as (select item_id, count(*) as n from pairs group by 1), idf as (select item_id, term, df, n from dfs join ns using (item_id) where n - df > df),
  sc as (select item_id, line_num, round(sum({WEIGHT.format(tf='qc.tf')} * {WEIGHT.format(tf='counts.tf')}), 9) as score from qc join idf using (item_id, term) join counts using (item_id, term) group by all),
  chosen as (select item_id, line_num from (select * from sc where score > 0 qualify row_number() over (partition by item_id order by score desc, line_num) <= 5) where score > 0.5),
  more as (select distinct item_id, {encoded('target')} as doc_id from chosen join hrefs on page_id = item_id and pos % 4 = line_num)
  select page_id as claim_id, page_id::varchar as doc_id, 1.0::double as priority from pages union all select item_id, doc_id, 1.0::double from more""")
def d4_expand_from_docs(s, d):
    p = X.read(s, d, "pages").withColumn("doc", F.col("page_id").cast("string"))
    sentences = p.select(F.col("doc").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))).alias("line_num", "text"))
    claims = p.select(F.col("page_id").alias("claim_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    links = p.select(F.col("page_id").alias("claim_id"), F.lit("").alias("match_key"), F.col("doc").alias("doc_id"), F.lit(1.0).alias("priority"))
    graph = _page_links(s, d).withColumns({"line_num": F.col("line_num") % 4, "doc_id": F.col("doc_id").cast("string")})
    return D.expand_from_docs(claims, links, sentences, graph, least=0.5).select("claim_id", "doc_id", "priority")


HOPS = f"""{X.HREFS}, hops as (select page_id // 10 as claim_id, page_id as sent_doc, pos % 3 as sent_line, replace(replace(replace(replace(replace(replace(replace(target, '(', '-LRB-'), ')', '-RRB-'), '[', '-LSB-'), ']', '-RSB-'), '{{', '-LCB-'), '}}', '-RCB-'), ':', '-COLON-') as t, (page_id % 7 + pos % 3)::double as priority from hrefs),
  h as (select claim_id, sent_doc, sent_line::int as sent_line, replace(t, ' ', '_') as doc_id, priority from hops)"""


def _hops(s, d) -> DataFrame:
    graph = _page_links(s, d).withColumn("line_num", F.col("line_num") % 3)
    chosen = graph.select(F.floor(F.col("doc_id") / 10).alias("claim_id"), "doc_id", "line_num", (F.col("doc_id") % 7 + F.col("line_num")).cast("double").alias("score")).distinct()
    return D.expand_from_sentences(chosen, graph)


@query(f"with {HOPS} select * from h")
def d5_expand_from_sentences(s, d):
    return _hops(s, d)


TOPK = "top as (select *, row_number() over (partition by claim_id order by priority desc, doc_id) as r from ranked), topd as (select claim_id, doc_id, max(priority) as priority, min(r)::int as rank from top where r <= 5 group by all)"


@query(f"with {D2}, {TOPK} select * from topd")
def d6_topk_docs(s, d):
    return D.topk_docs(D.pageview_rank(X.links(s, d), X.views(s, d)), 5)


BEST = "g as (select claim_id, sent_doc, sent_line, max(priority) as s from h group by all), b as (select claim_id, sent_doc, sent_line from g qualify row_number() over (partition by claim_id order by s desc, sent_doc, sent_line) = 1)"


@query(f"with {HOPS}, {BEST} select h.* from h join b using (claim_id, sent_doc, sent_line)")
def d7_best_sentence_links(s, d):
    return D.best_sentence_links(_hops(s, d)).select("claim_id", "sent_doc", "sent_line", "doc_id", "priority")


def _hop_views(s, d) -> DataFrame:
    return X.hrefs(s, d).select(F.explode("h_links").alias("doc")).groupBy("doc").agg(F.count("*").alias("views"))


D8 = f"""{HOPS}, {BEST}, c as (select distinct claim_id, concat(sent_doc, '<SENT_LINE>', sent_line) as match_key, doc_id, priority from h join b using (claim_id, sent_doc, sent_line)),
  hv as (select target as doc, count(*) as views from hrefs group by 1),
  r8 as (select c.*, row_number() over (partition by claim_id, match_key order by coalesce(views, 0) desc, doc_id) - 1 as rank, count(*) over (partition by claim_id, match_key) as n from c left join hv on doc = replace(replace(replace(replace(replace(replace(replace(doc_id, '-LRB-', '('), '-RRB-', ')'), '-LSB-', '['), '-RSB-', ']'), '-LCB-', '{{'), '-RCB-', '}}'), '-COLON-', ':')),
  aside as (select claim_id, match_key, doc_id, case when n > 1 then round(greatest(0.0, 1 - 0.2 * rank), 6)::double else priority end as priority from r8)"""


def _aside(s, d) -> DataFrame:
    return D.pageview_rank(D.sentence_links_as_candidates(D.best_sentence_links(_hops(s, d))), _hop_views(s, d)).select("claim_id", "match_key", "doc_id", "priority")


@query(f"with {D8} select * from aside")
def d8_pageview_rank_aside(s, d):
    return _aside(s, d)


FIRST = """first as (select distinct page_id // 10 as claim_id, target as doc_id, 1.0::double as priority from hrefs where pos = 0)"""


def _first(s, d) -> DataFrame:
    """A page's first link is its first hop; ten pages in turn are a claim's."""
    return _page_links(s, d).filter("line_num = 0").select(F.floor(F.col("doc_id") / 10).alias("claim_id"), F.col("target").alias("doc_id"), F.lit(1.0).alias("priority")).distinct()


NEW = "fresh as (select a.* from aside a anti join first f on f.claim_id = a.claim_id and f.doc_id = a.doc_id)"


@query(f"with {D8}, {FIRST}, {NEW}, t1 as (select claim_id, doc_id, row_number() over (partition by claim_id order by priority desc, doc_id) as r from first), t2 as (select claim_id, doc_id, row_number() over (partition by claim_id order by priority desc, doc_id) as r from fresh) select distinct claim_id, doc_id, 1 as hop from t1 where r <= 3 union all select distinct claim_id, doc_id, 2 from t2 where r <= 3")
def d9_two_hop_merge(s, d):
    return D.two_hop_merge(_first(s, d), _aside(s, d), 3)


@query(f"with {D8}, {FIRST}, {NEW} select * from fresh")
def d10_new_docs_only(s, d):
    return D.new_docs_only(_aside(s, d), _first(s, d)).select("claim_id", "match_key", "doc_id", "priority")


def _title_links(s, d) -> DataFrame:
    """Twenty parts in turn are a claim's candidates."""
    return X.titles(s, d).select(F.floor(F.col("p_partkey") / 20).alias("claim_id"), "doc_id", (F.col("p_size") % 9).cast("double").alias("priority"), F.col("p_partkey").alias("pos"), F.lit("k").alias("match_key"))


def _title_texts(s, d) -> DataFrame:
    """Claim c holds the natural titles of its first part's name with each bracketed kind."""
    p = X.read(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("claim_id")).agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    text = F.concat_ws(" ", F.lit("a"), "p_name", F.lit("-LRB- film -RRB- and"), "p_name", F.lit("-LRB- album -RRB-"))
    return p.select("claim_id", text.alias("claim"), F.split(text, " ").alias("tokens"))


TL = f"""{X.TITLES}, tl as (select p_partkey // 20 as claim_id, doc_id, (p_size % 9)::double as priority, p_partkey as pos, bracketed or other as br, base, inside, bracketed from titles),
  tx as (select p_partkey // 20 as claim_id, arg_min(p_name, p_partkey) as p_name from part group by 1),
  te as (select tl.*, br and bracketed and contains(concat('a ', p_name, ' -LRB- film -RRB- and ', p_name, ' -LRB- album -RRB-'), concat(base, ' -LRB- ', inside, ' -RRB-')) as exact, p_name from tl join tx using (claim_id))"""


@query(f"with {X.TITLES} select p_partkey, doc_id, case when bracketed or other then 1.0 else 7.0 end::double as priority from titles")
def d11_reset_bracket_priority(s, d):
    return D.reset_bracket_priority(X.titles(s, d).select("p_partkey", "doc_id", F.lit(7.0).alias("priority")))


@query(f"with {TL}, m as (select claim_id, doc_id, max(case when exact then 5.0 else priority end)::double as priority, bool_or(exact) as e, min(pos) as pos from te group by all) select claim_id, doc_id, priority, row_number() over (partition by claim_id order by e desc, case when e then pos end nulls first, priority desc, doc_id)::int as rank from m")
def d12_exact_title_first(s, d):
    return D.exact_title_first(_title_links(s, d), _title_texts(s, d))


@query(f"with {TL} select distinct concat(claim_id, '###', doc_id) as selection_id, claim_id, doc_id, 'hidden' as selection_label from te where br and not exact")
def d13_disambiguation_pairs(s, d):
    first = X.titles(s, d).select("doc_id", F.lit(0).alias("line_num"), F.col("base").alias("text")).distinct()
    return D.disambiguation_pairs(_title_links(s, d), _title_texts(s, d), first).select("selection_id", "claim_id", "doc_id", "selection_label")


@query(f"""with {TL}, cand as (select distinct claim_id, doc_id, br from te), gold as (select distinct claim_id, doc_id from te where priority < 2), pos as (select distinct claim_id, doc_id from te where priority < 2 and br and not exact),
  placed as (select *, row_number() over (partition by claim_id order by {X.hash_sql('claim_id', 'doc_id')}, doc_id) as r, 6 + floor({X.hash_sql('claim_id', seed=13)} * 7) as most from cand),
  neg as (select claim_id, doc_id from placed anti join gold using (claim_id, doc_id) where r <= most and br), kept as (select * from neg qualify row_number() over (order by {X.hash_sql('claim_id', 'doc_id', seed=14)}, claim_id, doc_id) <= 2 * (select count(*) from pos))
  select *, 'true' as selection_label from pos union all select *, 'false' from kept""")
def d14_disambiguation_train_pairs(s, d):
    links = _title_links(s, d)
    return D.disambiguation_train_pairs(links, links.filter("priority < 2"), _title_texts(s, d), ratio=2.0)


@query(f"""with {TL}, sc as (select distinct claim_id, doc_id, round((length(doc_id) % 10) / 10.0, 6) as prob from tl where br), p as (select te.*, coalesce(sc.prob, te.priority) as np from te left join sc using (claim_id, doc_id))
  select claim_id, doc_id, pos, np::double as priority from p where np >= 0.4 or exact""")
def d15_apply_disambiguation(s, d):
    links = _title_links(s, d)
    scores = links.filter(F.col("doc_id").contains("-LRB-")).select("claim_id", "doc_id").distinct().withColumn("prob", F.round(F.length("doc_id") % 10 / 10.0, 6)).withColumn("score", F.col("prob"))
    return D.apply_disambiguation(links, scores, "v2", 0.4, _title_texts(s, d)).select("claim_id", "doc_id", "pos", "priority")


@query(f"with {X.TITLES} select p_partkey // 20 as claim_id, count(*) as n, least(3, count(*)) as kept from titles group by 1")
def d16_truncate_docs(s, d):
    rows = _title_links(s, d).groupBy("claim_id").agg(F.count("*").alias("n"), F.collect_list("doc_id").alias("predicted_docids"))
    return D.truncate_docs(rows, 3).select("claim_id", "n", F.size("predicted_docids").cast("long").alias("kept"))


@query(f"with {X.CLAIMS}, a as (select distinct claim_id, doc_id from gold), g as (select claim_id, count(distinct grp) as n from gold group by 1), k as (select gold.claim_id, doc_id from gold join g using (claim_id) group by gold.claim_id, doc_id, n having count(distinct grp) = n) select c.claim_id, count(distinct a.doc_id) as n_all, count(distinct k.doc_id) as n_common from (select distinct claim_id from gold) c join a using (claim_id) left join k using (claim_id) group by 1")
def d18_docs_in_evidence(s, d):
    got = D.docs_in_evidence(X.claims(s, d)).filter("size(all_docs) > 0")
    return got.select("claim_id", F.size("all_docs").cast("long").alias("n_all"), F.size("common_docs").cast("long").alias("n_common"))


@query(f"with {HOPS} select claim_id, string_agg(distinct doc_id, '|' order by doc_id) as docs from h group by 1")
def d18_docs_in_links(s, d):
    return D.docs_in_links(_hops(s, d)).select("claim_id", F.array_join("docs", "|").alias("docs"))


@query(f"with {TL} select distinct te.claim_id from te semi join (select claim_id, doc_id from tl where priority >= 1) h on h.claim_id = te.claim_id and h.doc_id = te.doc_id where br and not exact and priority < 2")
def d19_bracket_subset(s, d):
    links = _title_links(s, d)
    gold = links.filter("priority < 2").groupBy("claim_id").agg(F.array(F.collect_list(F.struct("doc_id", F.lit(0).alias("line_num")))).alias("evidence"))
    return D.bracket_subset(_title_texts(s, d).join(gold.hint("merge"), "claim_id"), links.filter("priority >= 1")).select("claim_id")


# --- audits


@query(f"with {X.HREFS} select page_id from (select distinct page_id, len(l) as n from hrefs) where n % 2 = 1")
def q1_odd_link_rows(s, d):
    return S.odd_link_rows(X.hrefs(s, d)).select("page_id")


@query(f"with {X.HREFS} select page_id, pos::int as pos, target from hrefs where lower(target) not in (select lower(regexp_extract(url, 'https?://[^/]*(/[^?#]*)', 1)) from pages)")
def q2_dangling_links(s, d):
    ids = X.read(s, d, "pages").select(F.regexp_extract("url", "https?://[^/]*(/[^?#]*)", 1).alias("id"))
    rows = X.hrefs(s, d).select("page_id", F.posexplode("h_links").alias("pos", "target"))
    return S.dangling_links(rows, ids, encode=False).select("page_id", "pos", "target")
