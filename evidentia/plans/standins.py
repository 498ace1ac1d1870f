"""The driver's tables in the shapes that the operators take, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.sources import tables as S


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- sentences: the lines of documents

LINES = """lines as (select doc_id, line_num, text from (
  select doc_id, unnest(range(len(l))) as line_num, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents))
  where trim(text) <> '')"""


def lines(spark, sf_dir) -> DataFrame:
    return S.text_lines(read(spark, sf_dir, "documents"))


# --- scored pairs: order lines; claims: orders

PAIRS = """pairs as (select l_orderkey as claim_id, l_partkey as doc_id, l_linenumber as line_num, l_extendedprice as score, l_discount * 10 as prob,
  l_extendedprice as pos from lineitem),
  uniq as (select * from pairs qualify row_number() over (partition by claim_id, doc_id, line_num order by pos) = 1),
  best as (select *, row_number() over (partition by claim_id order by score desc, doc_id, line_num) as rank from uniq where prob >= 0.5
    qualify rank <= 5)"""
LABEL = "case o_orderstatus when 'F' then 'SUPPORTS' when 'O' then 'REFUTES' else 'NOT ENOUGH INFO' end"
CLAIMS = f"""claims as (select o_orderkey as claim_id, {LABEL} as label, case when o_orderkey % 5 = 0 then 'REFUTES' else {LABEL} end as predicted_label from orders),
  gold as (select distinct l_orderkey as claim_id, l_returnflag as grp, l_partkey as doc_id, l_linenumber as line_num from lineitem)"""
#: per claim: whether a gold group lies within the first k predictions, how many predictions hit, how many there are, how many groups
FLAGS = """hits as (select g.claim_id, g.grp, bool_and(b.claim_id is not null) as covered from gold g
    left join best b on b.claim_id = g.claim_id and b.doc_id = g.doc_id and b.line_num = g.line_num group by all),
  cover as (select claim_id, bool_or(covered) as covered from hits group by 1),
  counted as (select b.claim_id, count(*) as n, count(*) filter (exists (select 1 from gold g where g.claim_id = b.claim_id and g.doc_id = b.doc_id and g.line_num = b.line_num)) as hit from best b group by 1),
  flags as (select c.*, coalesce(v.covered, false) as covered, v.claim_id is null as no_gold, coalesce(n, 0) as n, coalesce(hit, 0) as hit,
    c.label = c.predicted_label as ok, c.label = 'NOT ENOUGH INFO' as nei from claims c left join cover v using (claim_id) left join counted using (claim_id))"""


def pairs(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """``dealt``: by claim, so that first rows, the best ones and scores of a claim follow without a further shuffle."""
    x = read(spark, sf_dir, "lineitem")
    if dealt:  # before the price stands in two columns
        x = x.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount").repartition("l_orderkey")
    return x.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("line_num"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") * 10).alias("prob"), F.col("l_extendedprice").alias("pos"))


def labels(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", C.LABELS[0]).when(F.col("o_orderstatus") == "O", C.LABELS[1]).otherwise(C.LABELS[2])
    rows = x.select(F.col("o_orderkey").alias("claim_id"), label.alias("label"))
    return rows.withColumn("predicted_label", F.when(F.col("claim_id") % 5 == 0, C.LABELS[1]).otherwise(F.col("label")))


def gold_rows(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_linenumber").repartition("l_orderkey")  # distinct rows, groups and claims lie within an order
    return x.select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("line_num")).distinct()


def claims(spark, sf_dir) -> DataFrame:
    """claim_id, label, predicted_label, evidence: gold groups are an order's lines by return flag."""
    rows = gold_rows(spark, sf_dir).groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("grp", "doc_id", "line_num"))).alias("_l"))
    group = lambda g: F.transform(F.filter("_l", lambda x: x["grp"].eqNullSafe(g)), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["line_num"].alias("line_num")))
    groups = rows.select("claim_id", F.transform(F.array_distinct(F.transform("_l", lambda x: x["grp"])), group).alias("evidence"))
    out = labels(spark, sf_dir).join(groups.hint("merge"), "claim_id", "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast(dict(groups.dtypes)["evidence"])))


# --- links: events as (claim, key, document); views: events by document

VIEWS = """views as (select concat('d', user_id % 40) as doc, count(*) as views from events group by 1),
  links as (select distinct user_id as claim_id, event_type as match_key, concat('d', cast(floor(value) as bigint) % 60) as doc_id, 1.0::double as priority from events)"""


def links(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "events")
    doc = F.concat(F.lit("d"), (F.floor("value") % 60).cast("string"))
    return x.select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("match_key"), doc.alias("doc_id"), F.lit(1.0).alias("priority")).distinct()


def views(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string")).alias("doc")).agg(F.count("*").alias("views"))


# --- link graph of pages

HREFS = """hrefs as (select page_id, unnest(range(len(l))) as pos, unnest(l) as target, l from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages))"""


def hrefs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("h_links"))


# --- titles of parts, some with bracketed types

TITLES = """titles as (select p_partkey, concat(replace(p_name, ' ', '_'), case when p_partkey % 3 = 0 then concat('_-LRB-', case when p_size % 4 = 0 then 'film' when p_size % 4 = 1 then 'album' else lower(p_type) end, '-RRB-')
    when p_partkey % 11 = 1 then '_-LRB-disambiguation-RRB-' else concat('_', p_partkey % 50) end) as doc_id,
  p_name as base, p_partkey % 3 = 0 as bracketed, p_partkey % 11 = 1 as other, case when p_size % 4 = 0 then 'film' when p_size % 4 = 1 then 'album' else lower(p_type) end as inside, p_size from part)"""


def titles(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    inside = F.when(F.col("p_size") % 4 == 0, "film").when(F.col("p_size") % 4 == 1, "album").otherwise(F.lower("p_type"))
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_-LRB-"), inside, F.lit("-RRB-"))).when(F.col("p_partkey") % 11 == 1, "_-LRB-disambiguation-RRB-").otherwise(F.concat(F.lit("_"), (F.col("p_partkey") % 50).cast("string")))
    return p.select("p_partkey", F.concat(F.translate("p_name", " ", "_"), tail).alias("doc_id"), F.col("p_name").alias("base"), "p_size")


def keyword_titles(spark, sf_dir) -> DataFrame:
    return titles(spark, sf_dir).select("doc_id", F.array_join(C.title_tokens("doc_id"), " ").alias("keyword")).distinct()


def title_claims(spark, sf_dir) -> DataFrame:
    """Claims whose tokens hold part names: order lines' part names in a sentence."""
    p = read(spark, sf_dir, "part")
    claim = F.concat(F.lit("The "), "p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"), F.lit(" beat a "), F.lower("p_type"), F.lit(" and the "), "p_name", F.lit(" album"))
    return p.select(F.col("p_partkey").alias("claim_id"), claim.alias("claim"), F.split(claim, " ").alias("tokens"), F.lit(None).cast("array<string>").alias("lemmas"))


# --- a number in [0, 1) from a row's key, as operators.select.hash_fraction


def hash_sql(*parts: str, seed: int = 12) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 12))::bigint)::double / 281474976710656.0)"
