"""Exact row numbers in an order, without a window over all rows.

Rows are dealt to ranges of the order and sorted within them; each range is counted, the counts' running sums (a row a range) are the
ranges' offsets, and a row's number is its range's offset plus its place there. Equal rows are told apart by a row id, so that a
value which a third of the rows share spreads over several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.scratch import written

#: Spark's row ids hold the partition above this bit and the place within it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... without gaps in the order of ``order`` (ties in any order). ``ranges``: how many tasks share the rows, by default the session's shuffle partitions.

    The rows are written twice: with their row ids, which so are fixed for the sampling of the ranges and for retries, and in their ranges.
    An empty table gives an empty result. Columns named ``_numbering_...`` are the operator's own.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = written(rows.withColumn("_numbering_row", F.monotonically_increasing_id()), "rows")
    dealt = fixed.repartitionByRange(ranges, *order, "_numbering_row").sortWithinPartitions(*order, "_numbering_row")
    dealt = written(dealt.withColumn("_numbering_id", F.monotonically_increasing_id()), "ranges")
    placed = dealt.withColumn("_numbering_range", F.shiftright("_numbering_id", _PLACE_BITS)).withColumn("_numbering_place", F.col("_numbering_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    counts = placed.groupBy("_numbering_range").agg(F.count("*").alias("_n"))  # a row a range
    before = Window.orderBy("_numbering_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("_numbering_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_numbering_offset")), "offsets")
    joined = placed.join(F.broadcast(offsets), "_numbering_range")
    return joined.withColumn(name, (F.col("_numbering_offset") + F.col("_numbering_place")).cast("long")).drop("_numbering_range", "_numbering_place", "_numbering_offset", "_numbering_row", "_numbering_id")


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order of ``order`` within each value of ``keys``, however many rows one of them holds.

    One numbering over (keys, order); a key's least number comes from a pre-aggregated table that is written and joined back. Null keys are a group.
    """
    all_rows = numbered(rows, [*[F.col(k) for k in keys], *order], "_number", ranges)
    first = written(all_rows.groupBy(*keys).agg(F.min("_number").alias("_first")), "firsts")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = all_rows.alias("r").join(first.alias("f"), on)
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_number") - F.col("_first") + 1).cast("long").alias(name))
