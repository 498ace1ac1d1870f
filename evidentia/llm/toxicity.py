"""Toxicity scores by a factorization machine over hashed terms.

A document's features are its distinct words (lower case, letters only at the ends) and their four- and five-letter
beginnings, hashed. The machine's score is a bias, a weight for each term and, for each pair of terms present, the
product of their factors, so that pairs such as an insult and a mention of a group count beyond their single weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import fold, id_text, pieces, ragged

BITS = 18
FACTORS = 8
#: Labelled rows of either kind that the model is fitted on at most, chosen by a hash of doc_id. Bounds the training data on the driver.
MAX_TRAIN = 4_000
#: A term gets a weight and factors when it is met in MIN_ROWS training rows and its chi-square against the label is MIN_CHI2 or more; so do both terms
#: of a pair that goes beyond its single terms' effects by PAIR_CHI2, for terms met in PAIR_SHARE of the training rows. Other terms are noise.
MIN_ROWS = 3
MIN_CHI2 = 8.0
PAIR_SHARE, PAIR_ROWS, PAIR_CHI2 = 0.025, 10, 100.0
#: Terms whose pairs are counted at a time.
PAIR_BLOCK = 1024
THRESHOLD = 0.3

_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


class Terms(dict):
    """word -> its feature ids."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        w = word.strip(_EDGES)
        ids = {xxhash.xxh3_64_intdigest(f"{kind}{part}".encode()) >> (64 - BITS) for kind, part in (("w", w), ("4", w[:4] if len(w) >= 4 else ""), ("5", w[:5] if len(w) >= 5 else "")) if part}
        out = self[word] = tuple(ids)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature ids of a text."""
        found: set[int] = set()
        for word in set((text or "").lower().split()):
            found.update(self[word])
        if len(self) > self.LIMIT:
            self.clear()
        return np.array(sorted(found), np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for part in pieces(batches):
        ids = [terms.of(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("toxic"), ragged(np.concatenate(ids) if ids else np.zeros(0, np.int32), [len(x) for x in ids])], ["toxic", "terms"])


class Machine:
    """bias + sum of weights + sum over pairs of the factors' products."""

    def __init__(self) -> None:
        self.bias = 0.0
        self.weights = np.zeros(1 << BITS, np.float32)
        self.factors = np.zeros((1 << BITS, FACTORS), np.float32)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(docs), self.bias)
        filled = [i for i, d in enumerate(docs) if len(d)]
        if filled:
            flat = np.concatenate([docs[i] for i in filled])
            starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in filled])[:-1]])
            v = self.factors[flat]
            total = np.add.reduceat(v, starts, axis=0)
            pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            out[filled] += np.add.reduceat(self.weights[flat], starts) + pairs
        return out

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(docs), -30, 30)))


def informative(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which features occur often enough and unequally enough between the labels."""
    flat, owner = np.concatenate(docs), np.repeat(labels, [len(d) for d in docs])
    n = np.bincount(flat, minlength=1 << BITS).astype(float)
    hits = np.bincount(flat, owner, minlength=1 << BITS)
    p, total = labels.mean(), len(labels)
    spread = n * p * (1 - p) * (1 - n / total)
    chi2 = np.divide((hits - n * p) ** 2, spread, out=np.zeros_like(n), where=spread > 0)
    return (n >= MIN_ROWS) & (chi2 >= MIN_CHI2)


def interacting(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which features take part in a pair whose rows bear the label more or less often than the two terms' single effects, added up, would have it.

    So terms that tell nothing alone are found when their pair does. Pairs are counted by products of 0/1 matrices, block by block.
    """
    flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    n = np.bincount(flat, minlength=1 << BITS)
    asked = np.flatnonzero((n >= max(MIN_ROWS, PAIR_SHARE * len(docs))) & (n < len(docs)))
    place = np.full(1 << BITS, -1)
    place[asked] = np.arange(len(asked))
    at, row = place[flat], owner
    at, row = at[at >= 0], row[at >= 0]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    starts = np.searchsorted(at, np.arange(0, len(asked) + PAIR_BLOCK, PAIR_BLOCK))
    p = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    hits = np.bincount(at, labels[row], len(asked))
    rate = (hits + 2 * p) / (n[asked] + 2)
    effect = np.log(rate / (1 - rate)) - np.log(p / (1 - p))
    out = np.zeros(1 << BITS, bool)

    def block(k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.arange(k * PAIR_BLOCK, min((k + 1) * PAIR_BLOCK, len(asked)))
        m = np.zeros((len(docs), len(ids)), np.float32)
        m[row[starts[k] : starts[k + 1]], at[starts[k] : starts[k + 1]] - k * PAIR_BLOCK] = 1
        return ids, m

    blocks = -(-len(asked) // PAIR_BLOCK)
    y = labels.astype(np.float32)[:, None]
    for i in range(blocks):
        ids_i, m_i = block(i)
        marked = m_i * y
        for j in range(i, blocks):
            ids_j, m_j = (ids_i, m_i) if i == j else block(j)
            both, good = m_i.T @ m_j, marked.T @ m_j
            q = 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + effect[ids_i][:, None] + effect[ids_j], -30, 30)))
            strange = (both >= PAIR_ROWS) & ((good - both * q) ** 2 >= PAIR_CHI2 * np.maximum(both * q * (1 - q), 0.25))
            # where one term always comes with the other the pair says no more than that one
            strange &= (both < 0.95 * n[asked[ids_i]][:, None]) & (both < 0.95 * n[asked[ids_j]])
            out[asked[ids_i[strange.any(1)]]] = True
            out[asked[ids_j[strange.any(0)]]] = True
    return out


def train(docs: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, epochs: int = 8, rate: float = 0.05, l2: float = 1e-4, batch: int = 64, seed: int = 3) -> Machine:
    """Fits by mini-batches with adaptive steps. ``importance`` weighs rows (to undo unequal sampling of the two labels)."""
    m, rng = Machine(), np.random.default_rng(seed)
    if not len(docs) or labels.min() == labels.max():
        m.bias = -30.0 if not len(labels) or not labels.max() else 30.0
        return m
    used = informative(docs, labels) | interacting(docs, labels)
    docs = [d[used[d]] for d in docs]
    p = float((labels * importance).sum() / importance.sum())
    m.bias = float(np.log(p / (1 - p)))
    m.factors[used] = rng.normal(0, 0.01, (int(used.sum()), FACTORS))
    seen_w, seen_v, seen_b = np.full(1 << BITS, 1e-2), np.full((1 << BITS, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = [i for i in order[at : at + batch] if len(docs[i])]
            if not rows:
                continue
            sizes = [len(docs[i]) for i in rows]
            flat = np.concatenate([docs[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = m.factors[flat]
            total = np.add.reduceat(v, starts, axis=0)
            logit = m.bias + np.add.reduceat(m.weights[flat], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) * importance[rows]
            each = np.repeat(slope, sizes)
            ids, place = np.unique(flat, return_inverse=True)
            gw = np.bincount(place, each, len(ids)) + l2 * m.weights[ids]
            grad = each[:, None] * (np.repeat(total, sizes, axis=0) - v)
            gv = np.stack([np.bincount(place, grad[:, k], len(ids)) for k in range(FACTORS)], 1) + l2 * m.factors[ids]
            gb = float(slope.sum())
            seen_w[ids] += gw**2
            seen_v[ids] += gv**2
            seen_b += gb**2
            m.weights[ids] -= rate * gw / np.sqrt(seen_w[ids])
            m.factors[ids] -= 0.3 * rate * gv / np.sqrt(seen_v[ids])
            m.bias -= rate * gb / seen_b**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Learns ``toxic`` (0 or 1) from the labelled documents: up to ``max_train`` rows of either label, by a hash of doc_id.

    Rows with a null id or label are left out, null and empty texts have no terms. Only the sample's feature ids reach the
    driver. Repeated labels of a document count as often as they occur.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample is bounded: 2 * max_train ids
    rows = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, terms array<int>").toArrow()
    y = rows["toxic"].to_numpy().astype(np.float64)
    x = [np.asarray(t.values.to_numpy(), np.int64) for t in rows["terms"].combine_chunks()] if len(y) else []
    # rows come in no fixed order: sort, so that reruns train alike
    order = sorted(range(len(x)), key=lambda i: (y[i], xxhash.xxh3_64_intdigest(x[i].tobytes())))
    x, y = [x[i] for i in order], y[order]
    share = {v: counts.get(v, 0) / max(1, min(counts.get(v, 0), max_train)) for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return train(x, y, weight / weight.mean() if len(weight) else weight)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), model.value
        for part in pieces(batches):
            score = m.scores([terms.of(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of rows with doc_id, held_out and text. The model (9 MB, fixed) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Learns only from labels outside the held-out fold. Texts are scored whole; null and empty texts get the score of a
    document without terms; without labels, or with one label only, all scores are near 0 (or near 1). Repeated rows,
    ties and null ids give a row each; other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels.filter(fold("doc_id", folds) != held_out), max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(id_text()) % folds == held_out).alias("held_out"), "text")
    return score(rows, model)
