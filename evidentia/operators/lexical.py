"""Lexical relation features as joins over an edge table ``lex(rel, src, dst)`` that the user supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans.scratch import written

NEGATIONS = ("not", "n't")
FAMILIES = ("em", "ant", "anc", "desc", "hypo_1", "hyper_1", "hypo_2", "hyper_2", "hypo_3plus", "hyper_3plus")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): every node reachable over (src, dst) edges with its least depth (1 and up), without src itself.

    The known pairs, all of depth up to d, are doubled: a shortest path of d + 1 to 2 d steps is a pair of depth exactly d and a known
    pair, so rounds grow with the logarithm of the depth. They end when no pair of depth d is left; cycles end there too, since only least depths
    are kept. ``max_depth`` asks for the pairs within that many steps only; without it nothing is cut. Null ends are left out. Each round's pairs are written.
    """
    step = edges.select("src", "dst").filter("src <> dst").distinct().withColumn("depth", F.lit(1))
    known, reach = written(step, "closure"), 1
    while max_depth is None or reach < max_depth:
        edge = known.filter(F.col("depth") == reach).select("src", F.col("dst").alias("mid"), F.col("depth").alias("first"))
        if not edge.limit(1).count():
            break
        paths = edge.join(known.select(F.col("src").alias("mid"), "dst", "depth"), "mid").filter("src <> dst")
        paths = paths.groupBy("src", "dst").agg(F.min(F.col("first") + F.col("depth")).alias("depth"))
        fresh = paths.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        reach *= 2
        if max_depth is not None:
            fresh = fresh.filter(F.col("depth") <= max_depth)
        known = written(known.unionByName(fresh), "closure")
    return known


def closure_to_level(edges: DataFrame, level: int) -> DataFrame:
    """(src, dst, depth) within ``level`` steps."""
    return closure(edges, level)


def level_split(closed: DataFrame) -> DataFrame:
    """closure with ``level``: 1, 2 or 3plus by least depth."""
    return closed.withColumn("level", F.when(F.col("depth") < 3, F.col("depth").cast("string")).otherwise("3plus"))


def exact_match(tokens: DataFrame, others: DataFrame) -> DataFrame:
    """Tokens (claim_id, token, lemma, stem) that equal, or share a lemma or stem with, a token of the other side; negations always match a negation."""
    forms = lambda df: df.select("claim_id", "token", F.explode(F.array_distinct(F.array(F.lower("token"), F.coalesce("lemma", F.lower("token")), F.coalesce("stem", F.lower("token")), F.when(F.lower("token").isin(*NEGATIONS), F.lit("not")).otherwise(F.lower("token"))))).alias("form"))
    return forms(tokens).join(forms(others).select("claim_id", "form").distinct().hint("merge"), ["claim_id", "form"], "left_semi").select("claim_id", "token").distinct()


def antonym_match(tokens: DataFrame, others: DataFrame, lex: DataFrame) -> DataFrame:
    """Tokens with an antonym on the other side."""
    ant = lex.filter("rel = 'antonym'").select(F.col("src").alias("token"), "dst")
    return tokens.join(ant.hint("merge"), "token").join(others.select("claim_id", F.col("token").alias("dst")).distinct().hint("merge"), ["claim_id", "dst"], "left_semi").select("claim_id", "token").distinct()


def _above(lower: DataFrame, upper: DataFrame, depths: DataFrame) -> DataFrame:
    """(claim_id, token, other, depth): tokens of one side and those of the other that lie above them.

    Always found from the token upwards: a word has few words above it, but any number below it.
    """
    up = lower.join(depths.withColumnsRenamed({"src": "token", "dst": "other"}).hint("merge"), "token")
    return up.join(upper.withColumnRenamed("token", "other").hint("merge"), ["claim_id", "other"], "left_semi")


def _levels(pairs: DataFrame, token: str, whole: str, name: str) -> DataFrame:
    """(claim_id, token, family): the relation and its level, of levels the nearest."""
    nearest = pairs.groupBy("claim_id", F.col(token).alias("token")).agg(F.min("depth").alias("depth"))
    family: Column = F.when(F.col("depth") < 3, F.concat(F.lit(f"{name}_"), F.col("depth").cast("string"))).otherwise(f"{name}_3plus")
    return nearest.select("claim_id", "token", F.explode(F.array(F.lit(whole), family)).alias("family"))


def pair_features(side_1: DataFrame, side_2: DataFrame, lex: DataFrame) -> DataFrame:
    """(claim_id, token, flags): for each token of either side, by family three flags: as a token of side 1, of side 2, of any.

    Sides, relations and found pairs are written: each is read several times.
    """
    sides = [written(x, "side") for x in (side_1, side_2)]
    lex = written(lex, "lex")
    depths = closure(lex.filter("rel = 'hypernym'"))
    tokens = [x.select("claim_id", "token").distinct() for x in sides]
    above = [written(_above(tokens[i], tokens[1 - i], depths), "above") for i in (0, 1)]
    found = None
    for i in (0, 1):
        own = exact_match(sides[i], sides[1 - i]).withColumn("family", F.lit("em"))
        own = own.unionByName(antonym_match(sides[i], sides[1 - i], lex).withColumn("family", F.lit("ant")))
        own = own.unionByName(_levels(above[i], "token", "anc", "hyper")).unionByName(_levels(above[1 - i], "other", "desc", "hypo"))
        own = own.withColumn("side", F.lit(i + 1))
        found = own if found is None else found.unionByName(own)
    rows = found.unionByName(tokens[0].unionByName(tokens[1]).select("claim_id", "token", F.lit(None).cast("string").alias("family"), F.lit(None).cast("int").alias("side")))
    flags = [F.max(F.coalesce(((F.col("family") == f) & c).cast("int"), F.lit(0))) for f in FAMILIES for c in (F.col("side") == 1, F.col("side") == 2, F.lit(True))]
    return rows.groupBy("claim_id", "token").agg(F.array(*flags).alias("flags"))


def pos_class(tag: Column | str) -> Column:
    """Adjective, verb, noun or adverb by the tag's first letter, else null."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    first = F.substring(tag, 1, 1)
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "N", "n").when(first == "R", "r")
