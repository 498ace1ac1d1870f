"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.scratch import written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step: each node's neighbours (large: all; small: the smaller ones and itself) move to its least neighbour.

    The least neighbour comes from a pre-aggregated minimum that is written and joined back: both sides of the join are
    plain exchanges, which adaptive execution can split, so a node with very many neighbours is never gathered in one task.
    """
    near = edges.select("u", "v")
    if both_ways:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    joined = near.join(least, "u")
    if both_ways:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; direction, repeats and loops don't matter, null
    ends are dropped. Work stays in Spark: each round is two joins over the remaining edges, written to the scratch
    folder. An empty input gives an empty result.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = written(_stars(_stars(e, True), False), "edges")
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
