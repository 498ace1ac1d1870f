"""Document fingerprints by SpotSigs.

A signature is an anchor (a common word) and the chain of the next ``CHAIN`` content words (words that are no anchors)
after it. A document's fingerprint is the set of its signatures, which follows running prose and ignores boilerplate
with few common words. Where no common word comes for ``GAP`` words (lists, other languages) a quarter of the words, chosen by hash, are
anchors too, so that no long stretch of a text is without signatures. Likeness is Jaccard's; a search compares only documents whose set lengths allow the
threshold, over the rarest signatures, and gives up a comparison when the threshold is out of reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.arrow import pieces, row_hash
from evidentia.plans.scratch import written

CHAIN = 2
GAP = 24
#: Bytes of text that a range of (doc_id, text hash) aims at; beyond MAX_RANGES of them ranges grow instead of their number.
RANGE_BYTES = 32 << 20
MAX_RANGES = 1 << 16
# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = frozenset(
    """
    a an and are as at be by for from has have he her his in is it its not of on or she that the their they this to was were which with you
    als an auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht sich sie und von war wie zu zum
    au aux avec ce dans de des du elle en est et il la le les ne par pas pour qui que se sur un une
    al como con de del el ella en es la las lo los más no para por que se su un una y
    """.split()
)
_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


class _Words(dict):
    LIMIT = 300_000

    def __missing__(self, word: str) -> tuple[int, bool]:
        w = word.strip(_STRIP)
        out = self[word] = (xxhash.xxh3_64_intdigest((w or word).encode()), w in ANCHORS)
        return out


def signatures(text: str, cache: _Words) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's signatures. The start of the text is an anchor too, so no text is without; a chain cut off by the end is padded."""
    found = [cache[w] for w in text.lower().split()]
    if len(cache) > cache.LIMIT:
        cache.clear()
    hashes = np.fromiter((h for h, _ in found), np.uint64, len(found))
    anchor = np.fromiter((a for _, a in found), bool, len(found))
    at = np.arange(len(found))
    since = at - np.maximum.accumulate(np.where(anchor, at, -1))
    anchor |= (since > GAP) & (hashes % np.uint64(4) == 0)
    content = np.concatenate([hashes[~anchor], np.arange(1, CHAIN + 1, dtype=np.uint64)])
    spots = np.flatnonzero(anchor)
    follow = np.concatenate([[0], spots - np.arange(len(spots))])  # how many content words stand before the anchor
    h = np.concatenate([np.zeros(1, np.uint64), hashes[spots]])
    for i in range(CHAIN):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + content[np.minimum(follow + i, len(content) - 1)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition come group by group in order; each row is compared with the one after it in its group."""
    cache = _Words()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held = None  # (group, doc_id, text, signatures)
    for part in pieces(batches):
        for group, doc_id, text, sent in zip(*(part.column(c).to_pylist() for c in ("group", "doc_id", "text", "sent")), strict=True):
            text = text or ""
            own = signatures(text, cache)
            if held is not None and held[0] == group:
                new = edited(held[2], text)
                other = signatures(new, cache)
                rows.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), _hex(held[3]), _hex(other), likeness(held[3], other), likeness(held[3], own)))
            held = None if sent else (group, doc_id, text, own)
        yield flush()


def fingerprints(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness and that to the next document.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (the sorted signature hashes
    in hex), near_edited, near_next (Jaccard of the sets, 0 to 1). The next document is the one after it by doc_id (null
    last, ties by a hash of the text, then the text), after the last the first; a single document follows itself. Null
    texts count as empty. Equal texts have equal fingerprints. Whole texts; other columns are ignored; an empty table gives
    an empty result.

    Texts are read twice and shuffled once, into ranges of (doc_id, text hash), see ``_ranges``; the first row of each range is
    also sent to the range before, so that each row meets its successor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    ranges, n = _ranges(rows, groups)
    keyed = rows.withColumn("place", _place()).crossJoin(F.broadcast(ranges))  # one row
    keyed = keyed.withColumn("group", _group()).select("group", "place", "doc_id", "text", "firsts", "before")
    own = F.struct("group", F.lit(False).alias("sent"))
    is_first = F.get("firsts", F.col("group")).eqNullSafe(F.col("place"))
    to = F.when(is_first, F.array(own, F.struct(F.get("before", F.col("group")).alias("group"), F.lit(True).alias("sent")))).otherwise(F.array(own))
    both = keyed.select(F.inline(to), "place", "doc_id", "text")
    # a task for each range, instead of ranges that meet by their hashes
    both = both.repartitionById(n, F.col("group")).sortWithinPartitions("group", "sent", "place", "text")
    return both.select("group", "doc_id", "text", "sent").mapInArrow(_compared, SCHEMA)


def _place() -> Column:
    """The order of documents: by doc_id, null last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("hash"))


def _cell() -> Column:
    """Number of ``cuts`` that are not above doc_id, by halving; null ids come after all."""
    size = F.size("cuts")
    powers = F.array(*[F.lit(1 << i) for i in reversed(range((2 * MAX_RANGES).bit_length()))])
    below = F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= size) & (F.get("cuts", at + p - 1) <= F.col("doc_id")), at + p).otherwise(at))
    return F.when(F.col("doc_id").isNull(), size + 1).otherwise(below)


def _group() -> Column:
    """The range of a row: its cell's first range and, where a cell of one doc_id has several, the share of the hashes below its own."""
    cell = _cell()
    parts = F.get("offsets", cell + 1) - F.get("offsets", cell)
    share = F.shiftright((F.shiftright("hash", 32) + F.lit(1 << 31)) * parts, 32)
    return (F.get("offsets", cell) + share).cast("int")


def _ranges(rows: DataFrame, groups: int | None) -> tuple[DataFrame, int]:
    """One row of arrays that describes the ranges, and how many there are.

    ``cuts`` are quantiles of doc_id; one that fills several is a cell of its own, as are null ids, and such a cell is divided by
    hash into as many ranges as it has bytes for. ``offsets``: a cell's first range; ``firsts`` and ``before``: a range's first
    row's place and the range (with rows) before it. A few numbers a range come to the driver, for four times
    MAX_RANGES ranges at most; texts don't: all is found from a written table of ids, hashes and sizes.
    """
    spark = rows.sparkSession
    keys = written(rows.select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "places")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = groups or min(MAX_RANGES, max(8, -(-total // RANGE_BYTES)))
    found = [int(b) for b in (keys.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])]
    hot = {v for v, again in zip(found, found[1:]) if v == again}
    cuts = sorted(set(found) | {v + 1 for v in hot if v < (1 << 63) - 1})
    bounds = spark.createDataFrame([(cuts,)], "cuts array<long>")
    celled = keys.crossJoin(F.broadcast(bounds)).groupBy(_cell().alias("cell")).agg(F.sum("size").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    each = -(-max(total, 1) // n)
    parts = {r["cell"]: max(1, r["size"] // each) for r in celled.collect() if r["low"] == r["high"]}  # a row a cell; they add up to n at most
    offsets = np.concatenate([[0], np.cumsum([parts.get(c, 1) for c in range(len(cuts) + 2)])]).tolist()
    cells = spark.createDataFrame([(cuts, offsets)], "cuts array<long>, offsets array<int>")
    found = keys.crossJoin(F.broadcast(cells)).groupBy(_group().alias("group")).agg(F.min(_place()).alias("place")).orderBy("group").collect()  # a row a range
    firsts, before = [None] * offsets[-1], [None] * offsets[-1]
    for i, r in enumerate(found):
        firsts[r["group"]], before[r["group"]] = tuple(r["place"]), found[i - 1]["group"]
    kind = "cuts array<long>, offsets array<int>, firsts array<struct<none:boolean,doc_id:long,hash:long>>, before array<int>"
    return spark.createDataFrame([(cuts, offsets, firsts, before)], kind), offsets[-1]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for part in pieces(batches):
        sets = [signatures(t or "", cache).astype(np.int64) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "sigs"])


def similar_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different signature sets with Jaccard ``threshold`` or more, as (set_a, set_b, likeness), and no other pair.

    Exact. Documents with equal sets share a set id (a hash of the set), see ``signature_sets``. Sets are partitioned by
    length: a pair meets only when the shorter has at least threshold * the longer's length. Within these, sets meet over
    their rarest signatures (a prefix long enough that a pair above the threshold must share one), so frequent signatures
    make no pairs. Empty tables give no pairs.
    """
    t = Fraction(threshold).limit_denominator(1000)
    sets = written(signature_sets(docs).select("set_id", "sigs").dropDuplicates(["set_id"]), "sets")
    spots = sets.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    df = spots.groupBy("sig").count()
    w = Window.partitionBy("set_id").orderBy("count", "sig")
    rare = spots.join(df, "sig").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * float(t) - 1e-9) + 1)
    rare = written(rare.select("set_id", "n", "sig", "rank"), "rare")
    a, b = rare.toDF("a", "na", "sig", "ra"), rare.toDF("b", "nb", "sig", "rb")
    close = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, "sig").filter(close & (F.col("na") >= float(t) * F.col("nb") - 1e-9)).select("a", "b").distinct()
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("same", same).withColumn("likeness", F.col("same") / (F.size("sa") + F.size("sb") - F.col("same"))).filter(F.col("likeness") >= float(t) - 1e-12).select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "likeness")


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set_id, sigs: each document's signature set; documents with equal sets share the set_id."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("hash")).alias("row"), "text")
    got = rows.select("row.doc_id", "row.hash", "text").withColumnRenamed("doc_id", "row").mapInArrow(_sets, "row long, sigs array<long>")
    return got.select(F.col("row").alias("doc_id"), F.xxhash64("sigs").alias("set_id"), "sigs")
