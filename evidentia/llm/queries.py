"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import alignment, bpe, brown_lm, hard_negatives, langid, line_dedup, maxscore, media, mixing, near_dedup, spotsigs, token_counts, toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"
SIDES = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORDS = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), WORDS, Fraction(4, 5))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.class_scores(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), labels=_read(spark, sf_dir, "labels"), keep=("doc_id",))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_read(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.to_media(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("removed_lines").cast("long").alias("removed_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), *map(public_tokenizers.path, SIDES))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_read(spark, sf_dir, "embeddings"))


_ALL = (op1_near_dedup, op2_toxicity, op3_brown_lm, op4_mixing, op5_spotsigs, op6_media, op7_bpe, op8_token_counts, op9_langid, op10_line_dedup, op11_hard_negatives, op12_alignment, op13_maxscore)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of documents that share a shingle, and reachability over links. For small tables.
OP1_SQL = f"""with recursive w as (select doc_id, coalesce({_WORDS.format(_LOWER)}, []) as ws from documents),
  s as (select doc_id, case when len(ws) < 2 then ws else list_distinct([concat(ws[i], ' ', ws[i + 1]) for i in range(1, len(ws))]) end as sh from w),
  n as (select doc_id, len(sh) as n from s), e as (select doc_id, unnest(sh) as g from s),
  o as (select a.doc_id as x, b.doc_id as y, count(*) as i from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
  l as (select x, y from o join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 80 * (nx.n + ny.n - i)),
  both_ways as (select x, y from l union all select y, x from l),
  reach as (select doc_id as a, doc_id as b from documents union select r.a, l.y from reach r join both_ways l on l.x = r.b)
  select doc_id, any_value(n) as n_shingles, min(b) as component_id, doc_id = min(b) as kept from reach join n on n.doc_id = a group by doc_id"""

#: Each run of lines with 50 words or more that cannot be shortened from one end, and its first occurrence.
OP10_SQL = f"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
  u as (select doc_id, unnest(range(1, len(ls) + 1)) as k, unnest(ls) as line from l),
  c0 as (select *, len({_WORDS.format('line')}) as n from u),
  c as (select *, sum(n) over (partition by doc_id order by k) as total from c0),
  fw as (select a.doc_id, a.k as s, min(b.k) as e from c a join c b on b.doc_id = a.doc_id and b.k >= a.k and b.total - a.total + a.n >= 50 group by all),
  bw as (select b.doc_id, max(a.k) as s, b.k as e from c a join c b on b.doc_id = a.doc_id and b.k >= a.k and b.total - a.total + a.n >= 50 group by b.doc_id, b.k),
  win as (select * from fw union select * from bw),
  wc as (select doc_id, s, e, array_to_string([trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13))) for x in ls[s:e]], chr(10)) as content from win join l using (doc_id)),
  first as (select content, min((doc_id, s)) as f from wc group by 1),
  later as (select doc_id, s, e from wc join first using (content) where (doc_id, s) > f),
  gone as (select distinct u.doc_id, u.k from u join later on later.doc_id = u.doc_id and u.k between s and e),
  kept as (select u.doc_id, count(g.k) as removed, coalesce(string_agg(line, chr(10) order by u.k) filter (g.k is null), '') as t from u left join gone g on g.doc_id = u.doc_id and g.k = u.k group by 1)
  select doc_id, coalesce(removed, 0) as removed_lines, length(t) as kept_chars, sha256(t) as kept_sha256 from documents left join kept using (doc_id)"""


_VECTORS = """v as materialized (select row_number() over () as r, vec_id, label, [floor({} * x::double) for x in embedding] as e from embeddings
    where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0)"""

#: Each anchor against all rows.
OP11_SQL = f"""with {_VECTORS.format(256)},
  l as (select r, vec_id, e, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label from v where label is not null),
  s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from l a join l b on a.r <> b.r where a.vec_id % 100 = 0),
  p as (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, br) <= 5),
  n as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.ar, p.br order by s.score desc, s.vec_id, s.br)::int as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on s.ar = p.ar and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
  select * from n where rank <= 5"""

#: Each query against all rows.
OP13_SQL = f"""with {_VECTORS.format(64)},
  s as (select q.r as qr, q.vec_id as query_id, c.r, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 20 = 0),
  f as (select query_id, row_number() over (partition by qr order by score desc, vec_id, r)::int as rank, vec_id, score from s)
  select * from f where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force, round trips or held-out rows."""
    return {"op1_near_dedup": OP1_SQL, "op10_line_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_maxscore": OP13_SQL}
