"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key whose rate is its quality weight; within a source, documents in key order are
taken until the token budget is reached. Whole epochs come first, the remainder is the prefix of the key order. No
source is sorted in one task: keys are binned twice (4,096 bins, then 4,096 in the bin where the budget ends), bins
are pre-aggregated, and only the documents of the last sub-bin are ordered. Bins are even in the key's logarithm: a
rate only shifts that, so the documents spread over as many bins whatever their rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Rates are kept between these; the logarithms of all keys then lie within LOGS.
RATES = (1e-6, 1e6)
LOGS = (-52.0, 18.0)
#: Sources (one row each) up to which the plan is broadcast; beyond, an ordinary join is used.
BROADCAST_SOURCES = 100_000


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(col: str = "text") -> Column:
    """The default quality weight: the share of ASCII letters and of characters beyond ASCII among all but white space, from 0.05 to 1."""
    text = F.coalesce(F.col(col), F.lit(""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), letters / F.greatest(solid, F.lit(1))))


#: The features that a learned quality weight looks at: tenths of letter_share, and characters a word up to SPANS.
SHARES, SPANS = 10, 12
#: Weight of the overall share of good documents in each cell of features, in documents.
PRIOR = 5.0


def _cell(text: str = "text", size: str = "size") -> Column:
    """The number of a document's cell of features, below SHARES * SPANS."""
    share = F.least(F.lit(SHARES - 1), F.floor(letter_share(text) * SHARES))
    span = F.least(F.lit(SPANS - 1), F.floor(F.coalesce(F.length(text), F.lit(0)) / F.greatest(F.col(size), F.lit(1))))
    return (share * SPANS + span).cast("int")


def _learned(rows: DataFrame, labels: DataFrame) -> Column:
    """The share of labelled documents with ``quality`` 1 in each row's ``cell``, smoothed towards the share in all; from 0.05 to 1.

    Learned from all labels with an id and a quality of 0 or 1. SHARES * SPANS sums at most come to the driver. Without labels all
    documents weigh the same.
    """
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    known = rows.groupBy("doc_id", "cell").agg(F.count("*").alias("times")).join(marks.hint("merge"), "doc_id")
    sums = known.groupBy("cell").agg(F.sum(F.col("good") * F.col("times")).alias("good"), F.sum(F.col("n") * F.col("times")).alias("n")).collect()
    n = sum(r["n"] for r in sums)
    overall = sum(r["good"] for r in sums) / n if n else 1.0
    by_cell = {r["cell"]: (r["good"] + PRIOR * overall) / (r["n"] + PRIOR) for r in sums}
    return F.lit([max(0.05, by_cell.get(c, overall)) for c in range(SHARES * SPANS)])[F.col("cell")]


def _targets(totals: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Sources with their target: a share of all sizes by weight, at most max_epochs times the size, the excess reshared by weight.

    In order of cap / weight, the sources that stop at their caps are a prefix; the first one that does not gives the
    common level. One row a source enters the window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(max_epochs))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _cut(rows: DataFrame, plan: DataFrame, level: str, start: str) -> DataFrame:
    """plan with the last bin that begins below the remainder (``cut``, -1 if none) and the size before it (``done``)."""
    bins = rows.groupBy("source", level).agg(F.sum("size").alias("bin_size"))
    joined = bins.join(plan, bins["source"].eqNullSafe(plan["source"])).select(bins["source"], level, "bin_size", "remainder", F.col(start).alias("start"))
    w = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("before", F.col("start") + F.coalesce(F.sum("bin_size").over(w), F.lit(0)))
    ends = joined.filter("before < remainder").groupBy(F.col("source").alias("s")).agg(F.max(F.struct(level, "before")).alias("end"))
    out = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left").drop("s")
    return out.withColumn(f"cut_{level}", F.coalesce(F.col(f"end.{level}"), F.lit(-1))).withColumn(f"done_{level}", F.coalesce("end.before", F.col(start))).drop("end")


#: Spark's row ids hold the partition above this bit.
_PLACE_BITS = 33


def _first_copies(tied: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``last_in``: the row id of the k-th of a source's tied rows (source, place_in, k).

    Counted by partition of the row ids first; only the partition where k falls is ordered, so a source's copies never meet in one task.
    """
    split = tied.withColumn("slice", F.shiftright("place_in", _PLACE_BITS))
    counts = split.groupBy("source", "slice").agg(F.count("*").alias("n"), F.first("k").alias("k"))  # a row a source and partition
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = written(counts.withColumn("need", F.col("k") - ahead).filter("need > 0 and need <= n").select(F.col("source").alias("s"), F.col("slice").alias("at"), "need"), "slices")
    near = split.select("source", "slice", "place_in").join(where, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
    nth = near.withColumn("i", F.row_number().over(Window.partitionBy("source", "slice").orderBy("place_in"))).filter("i = need").select(F.col("source").alias("s"), F.col("place_in").alias("last_in"))
    return plan.join(nth, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, quality: Column | None = None, labels: DataFrame | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies and taken added (replacing columns of these names).

    Size is the number of words of the text. Sources in code-point order (null last) take the weights in turn, repeating;
    targets share 100 % of all sizes by weight and stop at ``max_epochs`` times their source's size. ``copies`` is how often
    the mix takes a document: the whole epochs, and one more for the documents whose midpoint in the source's key order
    lies within the remainder, so a source misses its target by half a document at most. ``taken`` is copies * size.

    The quality weight is the column ``quality``; else, with ``labels`` (doc_id, quality 0 or 1), the learned chance that a
    document like this one is good; else ``letter_share``. ``keep`` names the columns of ``docs`` to return (default all): the
    texts are read once, and what is kept of them is written with their sizes and keys.

    Keys come from a hash of doc_id, source, text and ``seed``: reruns agree, whatever the partitioning. Null and empty
    texts have size 0 and take nothing. Rows that repeat in all of doc_id, source and text tie; where the budget ends among them, as many of
    them as it holds are taken, those that come first in the input (which of such rows it is makes no difference). A null quality counts as the least rate. With all sizes 0 all targets are 0. An empty table gives an empty
    result. Other columns are kept, whatever their names: a row travels as one struct beside the operator's own columns.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    hashed = F.xxhash64("doc_id", "source", "text", F.lit(seed))
    kept = [f"`{c}`" for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*kept).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), hashed.alias("tie"), *([] if labels is not None else [(letter_share() if quality is None else quality).alias("quality")]), "text")
    if labels is not None:
        rows = rows.withColumn("cell", _cell())
    rows = written(rows.drop("text").withColumn("place_in", F.monotonically_increasing_id()), "sizes")
    weight = F.col("quality") if labels is None else _learned(rows, labels)
    u = (F.pmod("tie", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rate = F.greatest(F.lit(RATES[0]), F.least(F.lit(RATES[1]), weight))
    rows = rows.select("doc", "source", "size", "tie", "place_in", (-F.log(u) / rate).alias("key"))
    width = (LOGS[1] - LOGS[0]) / (BINS * BINS)
    place = F.greatest(F.lit(0), F.least(F.lit(BINS * BINS - 1), F.floor((F.log("key") - LOGS[0]) / width)))
    rows = rows.withColumn("place", place).withColumns({"b1": F.floor(F.col("place") / BINS), "b2": F.col("place") % BINS})
    slim = rows.drop("doc")

    plan = _targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn("remainder", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("zero", F.lit(0).cast("long"))
    plan = written(plan, "targets")
    few = plan.count() <= BROADCAST_SOURCES
    shared = F.broadcast if few else lambda x: x
    plan = written(_cut(slim, plan, "b1", "zero"), "cuts")

    def at(rows: DataFrame, columns: list[str], plan: DataFrame) -> DataFrame:
        p = shared(plan.select(F.col("source").alias("s"), *columns))
        return rows.join(p, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    inner = at(slim, ["cut_b1"], plan).filter("b1 = cut_b1")
    plan = written(_cut(inner, plan, "b2", "done_b1"), "cuts")
    last = at(slim, ["cut_b1", "cut_b2", "done_b2", "remainder"], plan).filter("b1 = cut_b1 and b2 = cut_b2")
    # the sub-bin in key order, rows that repeat as one entry with their number: of each entry as many rows are in as have their midpoint within the remainder
    entries = last.groupBy("source", "key", "tie", "size").agg(F.count("*").alias("m"), F.first("done_b2").alias("start"), F.first("remainder").alias("remainder"))
    order = Window.partitionBy("source").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(order), F.lit(0))
    room = F.floor((F.col("remainder") - before) / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    entries = entries.withColumn("k", F.greatest(F.lit(0), F.least(F.col("m"), F.when(F.col("size") > 0, room).when(before <= F.col("remainder"), F.col("m")).otherwise(0))).cast("long"))
    ends = entries.filter("k > 0").groupBy("source").agg(F.max(F.struct("key", "tie", "size", "k", "m")).alias("end")).select(F.col("source").alias("e"), F.struct("end.key", "end.tie", "end.size").alias("edge"), "end.k", F.col("end.k") < F.col("end.m"))
    plan = written(plan.join(ends.toDF("e", "edge", "k", "part"), F.col("source").eqNullSafe(F.col("e")), "left").drop("e"), "cuts")
    plan = written(_first_copies(at(slim, ["cut_b1", "cut_b2", "edge", "k", "part"], plan).filter("part and b1 = cut_b1 and b2 = cut_b2 and struct(key, tie, size) = edge"), plan), "cuts")

    full = at(rows, ["source_size", "target", "epochs", "cut_b1", "cut_b2", "edge", "last_in"], plan)
    cut = F.col("cut_b1") * BINS + F.col("cut_b2")
    own = F.struct("key", "tie", "size")
    more = (F.col("cut_b1") >= 0) & ((F.col("place") < F.when(F.col("cut_b2") >= 0, cut).otherwise(F.col("cut_b1") * BINS)) | ((F.col("place") == cut) & F.coalesce((own < F.col("edge")) | ((own == F.col("edge")) & (F.col("place_in") <= F.coalesce("last_in", F.lit((1 << 63) - 1)))), F.lit(False))))
    full = full.withColumn("copies", (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return full.select("doc.*", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "taken")


def apply_mix(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as ``copies`` says."""
    extra = ("size", "source_size", "target", "copies", "taken")
    kept = [f"`{c}`" for c in mixed.columns if c not in extra]
    return mixed.filter("copies > 0").select(F.struct(*kept).alias("doc"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
