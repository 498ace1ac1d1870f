"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import fold, pieces

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages at most: bounds the broadcast matrix to BUCKETS * MAX_LANGUAGES * 4 bytes.
MAX_LANGUAGES = 512
_CHUNK = 300_000
#: Log probabilities looked up at once at most.
_CELLS = 4_000_000

_P = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a space before and after, and the texts' lengths so."""
    padded = [f" {t.lower()} " for t in texts]
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.array([len(p) for p in padded])


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point, but for the last order - 1."""
    n = len(points) - order + 1
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = (h + points[i : i + n]) * _P
        h ^= h >> np.uint64(29)
    return (h * _P >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class _Group:
    """Texts, or parts of long texts, laid end to end: which text each belongs to, its length, and how many n-grams of it start in the part itself."""

    def __init__(self) -> None:
        self.index, self.parts, self.lengths, self.own, self.size = [], [], [], [], 0

    def add(self, i: int, part: np.ndarray, own: int) -> None:
        self.index.append(i)
        self.parts.append(part)
        self.lengths.append(len(part))
        self.own.append(own)
        self.size += len(part)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """A bucket for each code point, and the places where no n-gram of this order starts: at the end of a text, or where the next part repeats them."""
        lengths = np.array(self.lengths)
        spare = lengths - np.minimum(self.own, np.maximum(lengths - order + 1, 0))
        ends = np.cumsum(lengths)
        none = np.concatenate([(ends - k)[spare >= k] for k in range(1, max(ORDERS))])
        return _grams(np.concatenate([*self.parts, np.zeros(order - 1, np.uint64)]), order), none


def _groups(texts: list[str], limit: int) -> Iterator[_Group]:
    """Texts in groups of bounded size. A text of more than ``limit`` characters is cut into parts that overlap, and each of its n-grams counts in one part."""
    group = _Group()
    for i, t in enumerate(texts):
        points, _ = _points([t])
        for at in range(0, len(points), limit):
            part = points[at : at + limit + max(ORDERS) - 1]
            group.add(i, part, limit if at + limit < len(points) else len(part))
            if group.size >= limit:
                yield group
                group = _Group()
    if group.index:
        yield group


def _counts(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for part in pieces(batches):
            rows = [(place[x], t) for t, x in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True) if t]
            for k in {r[0] for r in rows}:
                for group in _groups([t for p, t in rows if p == k], _CHUNK):
                    for order in ORDERS:
                        grams, none = group.grams(order)
                        total[k] += np.bincount(grams, minlength=BUCKETS) - np.bincount(grams[none], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


class Model:
    """Log probabilities: buckets x languages, and log priors."""

    def __init__(self, langs: list[str], logs: np.ndarray, priors: np.ndarray) -> None:
        self.langs, self.logs, self.priors = langs, logs, priors


def fit(docs: DataFrame) -> Model:
    """Learns from all rows of (text, lang) with a non-null lang; null and empty texts add nothing but their language to the priors.

    Counts are gathered by partition, summed in Spark and arrive as a matrix of BUCKETS x languages.
    """
    labelled = docs.filter("lang is not null").select("text", "lang")
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = {r["lang"]: r["count"] for r in sizes}
    langs = sorted(n)
    table = np.full((BUCKETS, max(len(langs), 1)), SMOOTHING)
    if langs:
        got = labelled.mapInArrow(_counts(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        table[got["bucket"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
    logs = np.log(table / table.sum(0)).astype(np.float32)
    priors = np.log(np.array([n[x] for x in langs] or [1]) + 1.0)
    return Model(langs, logs, priors - np.logaddexp.reduce(priors))


def _scored(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for part in pieces(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            sums = np.tile(m.priors, (len(texts), 1))
            for group in _groups(texts, min(_CHUNK, max(1000, _CELLS // m.logs.shape[1]))):
                starts = np.concatenate([[0], np.cumsum(group.lengths)[:-1]])
                for order in ORDERS:
                    grams, none = group.grams(order)
                    logs = m.logs[grams]
                    logs[none] = 0
                    np.add.at(sums, group.index, np.add.reduceat(logs, starts, axis=0, dtype=np.float64))
            best = sums.argmax(1)
            score = np.exp(sums[np.arange(len(sums)), best] - np.logaddexp.reduce(sums, axis=1))
            letters = [any(map(str.isalpha, t)) for t in texts]
            lang = [m.langs[b] if ok and m.langs else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            score = np.where([x != UNKNOWN for x in lang], np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang), pa.array(score)], [*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (the posterior probability) added, replacing columns of these names.

    lang_pred is ``und`` with score 0 where the text is null, empty, has no letter, or nothing was learned. Texts are
    scored whole, each by its own n-grams only, so a score depends neither on the texts beside it nor on partitions; ties go to the first language by name. Repeated rows and other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scored(shared, docs.columns), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows outside the held-out fold (a null doc_id counts as the empty text's fold)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (fold("doc_id", folds) == held_out).alias("held_out"))
    model = fit(rows.filter("not held_out"))
    return predict(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
