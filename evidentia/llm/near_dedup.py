"""Near-duplicate documents by HyperMinHash.

One hash per shingle: its top bits choose a bucket, and a bucket's register keeps, of the least remaining hash, the
count of leading zeros and a few mantissa bits in one byte. Registers of empty buckets are borrowed from filled ones
(by a fixed random preference of each bucket) for banding only, so that short texts are banded as surely as long
ones. The registers are banded twice, in different orders and with different borrowing: a pair of exactly the threshold 0.8
then shares no band with a probability near 2e-8, short sets (which get all bands of the second order) less. Documents
that share a band are candidates; the registers' collision-corrected Jaccard estimate discards candidates far below
the threshold; the rest are confirmed on full shingle sets.

No bucket is expanded into all pairs: each member is compared with the bucket's pivot, the member with the most
neighbours (the original of a group of edited copies), and verified links are contracted to components. For buckets that still span several components, an exact prefix join over the members' differences from the
hub of the pivot's component, its node with the most neighbours, finds the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.arrow import WordHashes, as_bytes, mixed, pieces, ragged, words
from evidentia.llm.components import components
from evidentia.plans.scratch import written

BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
ROWS = 8  # registers a band: one 64-bit word
BANDS = BUCKETS // ROWS
#: Sets of at most SHORT shingles, where two least hashes in one bucket weigh most, get all bands of the second order; longer ones the first MORE_BANDS.
SHORT = 200
MORE_BANDS = BANDS // 2
MANTISSA_BITS = 4
MAX_ZEROS = 14
#: A candidate is discarded when its estimate is this many standard errors below the threshold.
MARGIN = 6.0
#: Sets, or pairs of sets, whose registers are worked on at a time.
PAIRS = 1024

_K = np.uint64(0x9E3779B97F4A7C15)
_ATTEMPTS = 12


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; with fewer words the whole sequence is one; without words none.

    The 64-bit hashes stand for the shingles: two different shingles of one pair of documents coincide with a
    probability under 1e-9 for texts of 100,000 words.
    """
    if not len(hashes):
        return hashes
    k = min(size, len(hashes))
    n = len(hashes) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _K + hashes[i : i + n]
    return np.unique(mixed(h))


def registers(sh: np.ndarray) -> np.ndarray:
    """A byte per bucket: 0 when empty, else (leading zeros + 1) and the mantissa bits of the bucket's least hash. ``sh`` is sorted."""
    out = np.zeros(BUCKETS, np.uint8)
    if not len(sh):
        return out
    bucket = (sh >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (sh[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))  # 53 bits: exact
    zeros = 53 - exponent
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    mantissa[zeros >= MAX_ZEROS] = 0
    out[bucket[first]] = ((np.minimum(zeros, MAX_ZEROS) + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


class _Banding:
    """Borrowing for empty buckets, and band keys, in one order of the registers."""

    def __init__(self, order: int) -> None:
        rng = np.random.default_rng(20240607 + order)  # fixed: the preferences are part of the signature's definition
        self.tries = rng.integers(0, BUCKETS, (_ATTEMPTS, BUCKETS))
        self.rank = rng.permuted(np.tile(np.arange(BUCKETS, dtype=np.int16), (BUCKETS, 1)), axis=1)
        self.salt = mixed(np.arange(order * BANDS + 1, (order + 1) * BANDS + 1, dtype=np.uint64) * _K)
        self.place = rng.permutation(BUCKETS)

    def keys(self, regs: np.ndarray) -> np.ndarray:
        """regs: documents x buckets, each with a filled bucket. Returns documents x bands, int64."""
        full = regs.copy()
        doc, empty = np.nonzero(regs == 0)
        for attempt in self.tries:
            got = regs[doc, attempt[empty]]
            hit = got > 0
            full[doc[hit], empty[hit]] = got[hit]
            doc, empty = doc[~hit], empty[~hit]
            if not len(doc):
                break
        for d in np.unique(doc):
            filled = np.flatnonzero(regs[d])
            left = empty[doc == d]
            full[d, left] = regs[d, filled[self.rank[np.ix_(left, filled)].argmin(1)]]
        full = full[:, self.place]
        return mixed(np.ascontiguousarray(full).view(np.uint64).reshape(len(full), BANDS) ^ self.salt).view(np.int64)


def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end, as fractions, of the hashes that each non-empty register value stands for."""
    lo, hi = [], []
    for z in range(MAX_ZEROS):
        base = 2.0 ** -(z + 1)
        for m in range(1 << MANTISSA_BITS):
            lo.append(base * (1 + m / (1 << MANTISSA_BITS)))
            hi.append(base * (1 + (m + 1) / (1 << MANTISSA_BITS)))
    lo.append(0.0)
    hi.append(2.0**-MAX_ZEROS)
    return np.array(lo), np.array(hi)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs, and the number of registers each rests on.

    Two unlike minima still agree when they fall in one register value; for sets of na and nb shingles the chance
    follows from the exponential law of a bucket's minimum and is taken out of the share of equal registers.
    """
    either = ((a > 0) | (b > 0)).sum(1)
    share = ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1)
    lo, hi = _cells()

    def law(n: np.ndarray) -> np.ndarray:
        load = (n / BUCKETS)[:, None]
        return np.exp(-load * lo) - np.exp(-load * hi)

    some = 1 - np.exp(-(na + nb) / BUCKETS)
    chance = np.clip((law(na) * law(nb)).sum(1) / np.maximum(some, 1e-12), 0, 0.5)
    return np.clip((share - chance) / (1 - chance), 0, 1), either


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in pieces(batches):
            n, keys, regs = [], [], []
            for text in as_bytes(part.column("text")):
                sh = shingles(cache.of(words(text)), size)
                cache.trim()
                n.append(len(sh))
                keys.append(xxhash.xxh3_128_digest(sh.tobytes()))
                regs.append(registers(sh).tobytes() if len(sh) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "regs"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def band_keys(regs: np.ndarray, sizes: np.ndarray, bandings: tuple[_Banding, _Banding]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of sets one after another, and how many each set has."""
    keys = np.concatenate([b.keys(regs) for b in bandings], 1)
    bands = np.where(sizes <= SHORT, 2 * BANDS, BANDS + MORE_BANDS)
    return keys[np.arange(2 * BANDS) < bands[:, None]], bands


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bandings = _Banding(0), _Banding(1)
    for batch in batches:
        for start in range(0, batch.num_rows, PAIRS):
            part = batch.slice(start, PAIRS)
            if not part.num_rows:
                continue
            keys, bands = band_keys(_matrix(part.column("regs")), part.column("n_shingles").to_numpy(), bandings)
            yield pa.RecordBatch.from_arrays([part.column("node"), ragged(keys, bands)], ["node", "keys"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                if not part.num_rows:
                    continue
                na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
                guess, seen = estimates(_matrix(part.column("ra")), _matrix(part.column("rb")), na, nb)
                slack = MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(seen, 1))
                keep = (guess >= threshold - slack) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-6)
                yield part.filter(pa.array(keep)).select(["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in pieces(batches):
            out = []
            for text, key in zip(as_bytes(part.column("text")), part.column("set_key").to_pylist(), strict=True):
                sh = shingles(cache.of(words(text)), size)
                cache.trim()
                out.append(sh.tobytes() if xxhash.xxh3_128_digest(sh.tobytes()) == key else None)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])

    return run


def _confirmed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * same >= num * (len(p) + len(q) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _likely_pairs(pairs: DataFrame, reps: DataFrame, threshold: Fraction) -> DataFrame:
    """Candidate pairs (a, b) of nodes that their registers don't rule out."""
    regs = reps.select("node", "n_shingles", "regs")
    both = pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b")
    return written(both.mapInArrow(_likely(float(threshold)), "a long, b long"), "likely")


def _sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): full sets, made again from the text of one document of each node, which its doc_id and its text's hash name (rows without an id too)."""
    wanted = nodes.select("node").distinct().join(reps.select("node", "set_key", F.col("rep").alias("doc_id"), "text_hash"), "node")
    texts = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    texts = wanted.hint("shuffle_merge").join(texts, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    sets = texts.select("node", "set_key", "text").mapInArrow(_sets(size), "node long, shingles binary").filter("shingles is not null")
    return written(sets.dropDuplicates(["node"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough, as edges (u, v)."""
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return full.mapInArrow(_confirmed(threshold.numerator, threshold.denominator), "a long, b long").toDF("u", "v")


def _differences(num: int, den: int):
    """Rows (p, x, root, other, sp, sx) -> (p, x, root, other, far, n, m, items): the symmetric difference of x's set and p's, and whether they are too far apart for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, n, items = [], [], []
            for x, y in zip(batch.column("sx"), batch.column("sp"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                apart = np.setxor1d(a, b, assume_unique=True)
                union = (len(a) + len(b) + len(apart)) // 2
                far.append(den * (union - len(apart)) < num * union)
                n.append(len(a))
                items.append(apart.view(np.int64))
            sizes = [len(x) for x in items]
            listed = ragged(np.concatenate(items) if items else np.zeros(0, np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("p", "x", "root", "other")], pa.array(far, pa.bool_()), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), listed], ["p", "x", "root", "other", "far", "n", "m", "items"])

    return run


def _rest_pairs(around: DataFrame, sets: DataFrame, roots: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components, around a common pivot, that may still be similar enough; no such pair is missed. Beside them the links (u, v) of pivots to members of other components, if the estimate has discarded any.

    ``around``: (p, x), the nodes x that share a bucket with its pivot p. Copies of one original differ from it in few
    shingles, and differently: so not the sets are compared but their differences X = x ^ p. With t the threshold, x and y are
    linked only if |X ^ Y| <= (|x| + |y|) (1 - t) / (1 + t). One of the two, say x, is of another component than p, so far from
    it (else it were linked to p), and from these two follow |X & Y| >= t / (1 + t) |Y| and |X & Y| >= |X| - (1 - t) / t |x|. So the two differences share an
    item among the first few in any common order, the rarest first: a prefix join that meets next to none of the copies
    which are merely near the same original. Items that only members of one component have can't tell such a pair: they come
    first in the order, with those that no far node of another component has, and are not joined.
    """
    t = float(threshold)
    rooted = around.join(roots.toDF("x", "root"), "x", "left").join(roots.toDF("p", "own"), "p", "left").withColumn("root", F.coalesce("root", "x"))
    rooted = rooted.select("p", "x", "root", (F.col("root") != F.coalesce("own", "p")).alias("other"))
    rows = rooted.join(sets.toDF("x", "sx"), "x").join(sets.toDF("p", "sp"), "p")
    kind = "p long, x long, root long, other boolean, far boolean, n long, m long, items array<long>"
    diff = rows.mapInArrow(_differences(threshold.numerator, threshold.denominator), kind)
    spots = written(diff.select("p", "x", "root", "other", "far", "n", "m", F.explode("items").alias("item")), "spots")
    missed = spots.filter("other and not far").select(F.col("p").alias("u"), F.col("x").alias("v")).distinct()
    often = spots.groupBy("p", "item").agg(F.count_if(F.col("far") & F.col("other")).alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    often = written(often.filter("df > 0 and r0 <> r1").select("p", "item", "df"), "often")
    met = spots.join(often, ["p", "item"])
    # items that are not met come first in the order and use up places of the prefix
    own = Window.partitionBy("p", "x")
    ranked = met.withColumn("place", F.row_number().over(own.orderBy("df", "item")) + F.col("m") - F.count("*").over(own))
    near_end = F.col("m") - F.ceil(F.col("m") * (t / (1 + t)) - 1e-9) + 1
    far_end = F.col("m") - F.greatest(F.lit(1), F.col("m") - F.floor(F.col("n") * ((1 - t) / t) + 1e-9)) + 1
    ranked = ranked.withColumns({"near": F.col("place") <= near_end, "far": F.col("far") & F.col("other") & (F.col("place") <= far_end)}).filter("near or far")
    ranked = written(ranked.select("p", "item", "x", "n", "m", "place", "near", "far", "root"), "prefixes")
    left = ranked.filter("far").select("p", "item", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("m").alias("my"), F.col("place").alias("py"), F.col("root").alias("ry"))
    found = left.join(ranked.filter("near"), ["p", "item"]).filter("ry <> root").filter(F.least("n", "ny") * threshold.denominator >= F.greatest("n", "ny") * threshold.numerator)
    # after the first item that two differences share, enough must be left of both
    need = (F.col("m") + F.col("my") - (F.col("n") + F.col("ny")) * ((1 - t) / (1 + t))) / 2
    found = found.filter(1 + F.least(F.col("m") - F.col("place"), F.col("my") - F.col("py")) >= need - 1e-9)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), missed


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Documents are linked when the Jaccard similarity of
    their shingle sets is ``threshold`` or more; component_id is the least doc_id reachable over links. Null and empty
    texts, and texts of white space only, have 0 shingles, are linked with nothing and keep their own doc_id. Equal sets
    (so repeated rows too) are always linked. Of a null doc_id, component_id is the least non-null doc_id reachable, else
    null; such a row is kept only in the latter case. Rows that repeat a doc_id and its text get equal results. An empty
    table gives an empty result. A text of any length is shingled whole.
    """
    threshold = Fraction(threshold).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = written(hashed.mapInArrow(_signatures(shingle_words), "doc_id long, text_hash long, n_shingles long, set_key binary, regs binary"), "signed")
    sets = signed.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    reps = sets.groupBy("set_key").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    reps = reps.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n_shingles", "regs")
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    bands = reps.select("node", "n_shingles", "regs").mapInArrow(_bands, "node long, keys array<long>")
    bands = written(bands.select("node", F.explode("keys").alias("key")), "bands")
    sizes = written(bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    shared = written(bands.join(sizes, "key"), "shared")
    # a bucket's pivot: its member with the most neighbours over all buckets; that is the original of a group of edited
    # copies, to which they are linked when they may not be to each other
    degree = written(shared.groupBy("node").agg(F.sum("members").alias("degree")), "degree")
    pivots = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("p"))
    pivots = written(pivots, "pivots")
    pairs = shared.join(pivots, "key").filter("p <> node").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    tested = written(pairs.distinct(), "pairs")
    likely = _likely_pairs(tested, reps, threshold)
    sets = _sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")), reps, docs, shingle_words)
    edges = written(_links(likely, sets, threshold), "links")
    roots = written(components(edges), "roots")

    # Buckets of two members have had their pair tested. Larger ones that span several components have pairs left.
    members = shared.filter("members > 2").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = written(members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key"), "apart")
    # all buckets whose pivots are of one component are compared with that component's node of the highest degree
    placed = degree.join(roots, "node", "left").withColumn("own", F.coalesce("root", "node"))
    hubs = written(placed.groupBy("own").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")), "hubs")
    of = written(pivots.join(apart, "key").join(placed.select(F.col("node").alias("p"), "own"), "p").join(hubs, "own").select("key", F.col("hub").alias("p")), "of")
    around = members.join(of, "key").select("p", F.col("node").alias("x")).filter("p <> x").distinct()
    around = written(around, "around")
    if around.limit(1).count():
        sets = _sets_of(around.select(F.explode(F.array("p", "x")).alias("node")), reps, docs, shingle_words)
        more, missed = _rest_pairs(around, sets, roots, threshold)
        more = more.join(tested, ["a", "b"], "left_anti")
        edges = written(edges.unionByName(_links(_likely_pairs(more, reps, threshold), sets, threshold)).unionByName(missed), "links")
        roots = written(components(edges), "roots")

    found = reps.select("node", "set_key", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(found.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    found = written(found.join(least, "root").select("set_key", "component_id"), "found")
    out = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
