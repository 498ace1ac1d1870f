"""Each operator against a brute-force version on small tables, and on the awkward rows that it has to define."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import bpe, brown_lm, langid, line_dedup, media, mixing, near_dedup, spotsigs, token_counts, toxicity
from evidentia.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower()) if text else []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def table(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog ran off", "en", "a", 10),
        (1, "the cat sat on the mat and the dog ran off", "en", "a", 10),
        (2, "the cat sat on the mat and the dog ran off", "en", None, 10),
        (3, None, None, "a", None),
        (4, "", "en", "b", 0),
        (None, "the cat sat on the mat and the dog ran off", "en", "b", 10),
        (None, None, None, None, None),
        (5, long_text, "en", "b", len(long_text)),
        (6, " \t\n ", "en", "c", 4),
        (7, "één woord 😀 ퟿ x", "nl", "c", 5),
        (8, "single", "en", "c", 6),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named like the operators' own."""
    names = ("node", "row", "place", "score", "size", "taken", "copies", "target", "group", "spans", "held_out", "lang_pred", "removed_lines", "_s", "key")
    return df.withColumns({c: F.lit(1) for c in (*names, *MORE_NAMES)})


#: Names that an operator uses within itself and does not return.
MORE_NAMES = ("_key", "_place", "_tie", "epochs", "cut_b1", "cut_b2", "edge", "doc", "s", "tie", "b1", "_id", "_row", "at_id", "at_row", "first", "content", "mark", "c0", "c1")


def kept_values(df):
    return Counter((r.doc_id, *(r[c] for c in MORE_NAMES)) for r in df.collect())


def brute_components(table, k, threshold=Fraction(4, 5)):
    sets = {}
    for i, text, *_ in table:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            same = len(sets[a] & sets[b])
            if same >= threshold * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, table, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(clashing(docs), k).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in brute_components(table, k).items()}
    assert got == want
    assert len({c for _, c, _ in got.values()}) < len(got)


def test_near_duplicates_of_edited_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (4, 7, 20, 90, 400):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(14):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 12))):
                    text[rng.randrange(size)] = rng.choice(vocabulary)
                rows.append((i, " ".join(text), None, None, None))
                i += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute_components(rows, 2)


def test_register_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    for n, same in ((40, 30), (600, 500), (5000, 3000)):
        x = np.sort(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        rng.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:same], x[n : 2 * n - same]]))
        true = same / (2 * n - same)
        got, seen = near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(got[0] - true) < 5 * math.sqrt(true * (1 - true) / seen[0]) + 0.01


@pytest.mark.parametrize("union", [5, 10, 20, 50, 100, 250, 500, 2000])
def test_pairs_at_the_threshold_share_a_band(union):
    """No pair of exactly Jaccard 0.8 in 10,000 (2,000 of large sets) is lost before the confirmation on full sets."""
    rng = np.random.default_rng(union)
    bandings = near_dedup._Banding(0), near_dedup._Banding(1)
    apart, left = union // 5, 10_000 if union <= 500 else 2_000
    while left:
        n = min(left, 1_000)
        sets = [np.sort(rng.integers(0, 1 << 64, union, dtype=np.uint64)) for _ in range(n)]
        split = [rng.permutation(union) for _ in range(n)]
        cut = [rng.integers(0, apart + 1) for _ in range(n)]
        a = [np.sort(np.delete(s, p[:apart][:c])) for s, p, c in zip(sets, split, cut, strict=True)]
        b = [np.sort(np.delete(s, p[:apart][c:])) for s, p, c in zip(sets, split, cut, strict=True)]
        ra, rb = (np.stack([near_dedup.registers(x) for x in side]) for side in (a, b))
        na, nb = (np.array([len(x) for x in side]) for side in (a, b))
        (ka, ca), (kb, cb) = near_dedup.band_keys(ra, na, bandings), near_dedup.band_keys(rb, nb, bandings)
        ka, kb = np.split(ka, np.cumsum(ca)[:-1]), np.split(kb, np.cumsum(cb)[:-1])
        assert all((x[: min(len(x), len(y))] == y[: min(len(x), len(y))]).any() for x, y in zip(ka, kb, strict=True))
        guess, seen = near_dedup.estimates(ra, rb, na, nb)
        assert (guess >= 0.8 - near_dedup.MARGIN * np.sqrt(0.16 / seen)).all()
        left -= n


def test_near_duplicates_of_odd_rows(odd, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, 2).collect())
    assert got[1, 10, 1, True] == 2 and got[2, 10, 1, False] == 1 and got[None, 10, 1, False] == 1
    assert got[3, 0, 3, True] == got[4, 0, 4, True] == got[6, 0, 6, True] == got[None, 0, None, True] == 1
    assert sum(got.values()) == 11 and got[8, 1, 8, True] == 1
    assert near_dedup.near_duplicates(empty, 2).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((0, 1), 0))


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = set((10 + rng.integers(0, 5, 3)).tolist())
        docs.append(np.array(sorted({1, 2} - ({1} if not a else set()) - ({2} if not b else set()) | noise), np.int64))
        y.append(float(a and b))
    m = toxicity.train(docs, np.array(y), np.ones(len(y)), epochs=30)
    both, one = m.scores([np.array([1, 2, 11])])[0], m.scores([np.array([1, 11]), np.array([2, 11])]).max()
    assert both > 0.8 > 0.3 > one
    assert (m.factors[1] @ m.factors[2]) > 0


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(clashing(odd), labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert toxicity.toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def brute_base(table, folds=5, held=1):
    train = [r for r in table if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % folds != held]
    counts = Counter(w for r in train for w in [*words(r[1]), "end"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in table:
        tokens = [*words(r[1]), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((r[0], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)))
    return Counter(out)


@pytest.mark.parametrize("head", [brown_lm.HEAD, 500])
def test_base_scores_equal_brute_force_and_classes_score_better(monkeypatch, docs, table, head):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    got = brown_lm.class_scores(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == brute_base(table)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution(docs):
    """Over all items the transitions sum to 1, and over a class's words and the unseen the emissions do."""
    texts = [t.encode() for (t,) in docs.select("text").limit(40).collect()]
    counts = Counter(w for t in texts for w in t.lower().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[:200]
    slots = brown_lm._Slots()
    found, sizes = slots.of(texts)
    head = brown_lm.Head(brown_lm._signed([slots.hashes[slots[w]] for w in top]), np.array([counts[w] for w in top]))
    item = head.item_of(slots, head.look_up(slots, np.zeros(0, np.int64)))
    full, before, _ = brown_lm._with_ends(item[found], sizes)
    n = brown_lm.ITEMS
    matrix = np.bincount(before * n + full, minlength=n * n).reshape(n, n).astype(float)
    group = brown_lm.exchange(matrix)
    one = np.zeros((n, brown_lm.CLASSES))
    one[np.arange(n), group] = 1
    per_item = np.bincount(item, minlength=n)
    tokens = matrix.sum(0)
    m = brown_lm.Model(head, group, one.T @ matrix @ one, one.T @ tokens, one.T @ per_item, int(tokens.sum()), len(counts))
    assert np.allclose((10**m.step).sum(1), 1)
    for c in set(group) - {0}:
        ws = [w for w in counts if group[item[slots[w]]] == c]
        unseen = brown_lm.WORD_PRIOR * 10 ** m.emission[c]
        assert math.isclose(sum((counts[w] + brown_lm.WORD_PRIOR) * 10 ** m.emission[c] for w in ws) + unseen, 1, abs_tol=1e-9)
    start = np.zeros(n, int)
    start[1:] = 1 + np.arange(n - 1) % (brown_lm.CLASSES - 1)

    def likelihood(g):
        o = np.zeros((n, brown_lm.CLASSES))
        o[np.arange(n), g] = 1
        t = o.T @ matrix @ o
        x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    assert likelihood(group) > likelihood(start)


def likelihood_of(table):
    x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
    return x(table) - x(table.sum(0)) - x(table.sum(1))


def test_further_words_get_the_class_of_most_gain():
    """Against the likelihood of the whole table, with the word put into each class in turn."""
    rng = np.random.default_rng(4)
    k = brown_lm.CLASSES
    tokens = rng.integers(0, 300, 6000)
    tokens[1::7] = tokens[::7][: len(tokens[1::7])]
    group = 1 + rng.integers(0, k - 1, 300)
    pairs = np.zeros((300, 300))
    np.add.at(pairs, (tokens[:-1], tokens[1:]), 1)

    def table(g):
        one = np.eye(k)[g]
        return one.T @ pairs @ one

    for w in range(0, 300, 20):
        pred, succ = (np.bincount(group, x, k) for x in (pairs[:, w], pairs[w]))
        pred[group[w]] -= pairs[w, w]
        succ[group[w]] -= pairs[w, w]
        near = np.concatenate([pred, succ, [pairs[w, w]]])
        key = np.flatnonzero(near)
        got = brown_lm.best_classes(table(group), group[[w]], np.zeros(len(key), int), key, near[key])[0]
        moved = lambda c: likelihood_of(table(np.where(np.arange(300) == w, c, group)))  # noqa: E731, B023
        assert math.isclose(moved(got), max(moved(c) for c in range(1, k)), abs_tol=1e-5)


def test_exchange_ends_where_no_word_gains():
    rng = np.random.default_rng(5)
    counts = rng.poisson(rng.gamma(0.3, 2, (160, 160))).astype(float)
    group = brown_lm.exchange(counts, 9)

    def likelihood(g):
        one = np.eye(9)[g]
        return likelihood_of(one.T @ counts @ one)

    best = likelihood(group)
    assert all(likelihood(np.where(np.arange(160) == w, c, group)) <= best + 1e-6 for w in range(1, 160) for c in range(1, 9))


def test_words_beyond_the_clustered_have_classes_of_their_own(monkeypatch, spark):
    """Two kinds of rare words with one ending, each among words of its own: among the first kind's, its rare words are likelier."""
    monkeypatch.setattr(brown_lm, "HEAD", 1030)
    rng = random.Random(6)
    kinds = [[f"{kind}{i}" for i in range(520)] for kind in "ab"]
    texts = [" ".join(f"{'ab'[i % 2]}q{rng.randint(0, 2999)}xyz" if rng.random() < 0.1 else rng.choice(kinds[i % 2]) for _ in range(300)) for i in range(400)]
    held = [next(i for i in range(10_000 * k, 99_999) if zlib.crc32(str(i).encode()) % 5 == 1) for k in (1, 2)]
    free = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 != 1][:400]
    counts = Counter(w for t in texts for w in t.split())
    around = kinds[0][:200]
    rows = [(i, t, None, None, None) for i, t in zip(free, texts, strict=True)]
    for at, kind in zip(held, "ab", strict=True):
        seen = sorted(w for w in counts if w.startswith(f"{kind}q") and counts[w] == 3)[:200]
        rows.append((at, " ".join(w for pair in zip(around, seen, strict=True) for w in pair), None, None, None))
    got = {r.doc_id: r for r in brown_lm.class_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 401
    assert got[held[0]].score - got[held[0]].base_score > got[held[1]].score - got[held[1]].base_score + 20


def test_class_scores_of_odd_rows(odd, empty):
    rows = [tuple(r)[:2] for r in odd.collect()]
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in brown_lm.class_scores(clashing(odd)).collect())
    assert got == brute_base(rows)
    assert brown_lm.class_scores(empty).count() == 0


def brute_targets(table, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for _, text, _, source in table:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / share > 3 * sizes[s]]
        if not over:
            return sizes, {s: fixed[s] if s in fixed else rest * w[s] / share for s in order}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_operators_that_return_rows_keep_clashing_columns(odd):
    rows = clashing(odd)
    want = kept_values(rows)
    for got in (mixing.mix(rows), line_dedup.dedup_lines(rows, 4), langid.predict(rows, langid.fit(rows))):
        assert set(got.columns) >= set(rows.columns) and kept_values(got) == want
    assert {r.row for r in line_dedup.dedup_lines(rows, 4).collect()} == {r.row for r in mixing.mix(rows).collect()} == {1}
    mixed = mixing.apply_mix(mixing.mix(rows))
    assert set(kept_values(mixed)) <= set(want)


def check_mix(rows, got):
    sizes, targets = brute_targets(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r, source in got:
        assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_mixing(docs, table):
    got = mixing.mix(docs).collect()
    check_mix(table, [(r, r.source) for r in got])
    assert len({r.copies for r in got}) > 2
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    mixed = mixing.apply_mix(mixing.mix(docs))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_of_skewed_and_odd_rows(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), None, "hot" if i % 3 else f"s{i % 11}", None) for i in range(2000)] + [(5000 + i, "x y", None, None, None) for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check_mix([r[:4] for r in rows], [(r, r.source) for r in got])
    got = mixing.mix(clashing(odd)).collect()
    assert len(got) == 11 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(empty).count() == 0
    nothing = mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(nothing) == 11 and all(r.taken == 0 and r.target == 0 for r in nothing)


def test_mixing_spreads_low_rates_over_bins(spark):
    """With the least rates the keys still fall into many bins, and the result is that of the order by key."""
    rows = [(i, "w " * (1 + i % 5), None, f"s{i % 3}", None) for i in range(3000)]
    for rate in (1e-6, 0.05, 1.0):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), quality=F.lit(rate)).collect()
        check_mix([r[:4] for r in rows], [(r, r.source) for r in got])


def test_mixing_learns_quality_from_labels(spark):
    """Digits are bad here: unlabelled documents of digits are taken less often; the rest of the contract holds."""
    rows = [(i, ("abcd " if i % 2 else "1234 ") * 5, None, f"s{i % 6 // 2}", None) for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400)] + [(None, 0), (3, None)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, weights=(1, 4, 1), labels=labels).collect()
    assert set(mixing.mix(df, labels=labels, keep=("doc_id",)).columns) == {"doc_id", "size", "source_size", "target", "copies", "taken"}
    by = Counter()
    for r in got:
        if r.source != "s1":
            by[r.doc_id % 2] += r.taken
    assert by[1] > 1.5 * by[0] > 0
    check_mix([r[:4] for r in rows], [(r, r.source) for r in mixing.mix(df, labels=labels).collect()])
    check_mix([r[:4] for r in rows], [(r, r.source) for r in mixing.mix(df, labels=labels.limit(0)).collect()])


def test_mixing_prefers_quality(spark):
    rows = [(i, ("abcd " if i % 2 else "1234 ") * 5, None, f"s{i % 6 // 2}", None) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 4, 1)).filter("source <> 's1'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    by = {r.good: r.t for r in got}
    assert by[1] > 1.5 * by[0]


def test_spotsigs(docs, table):
    rows = sorted(table, key=lambda r: r[0])
    got = {r.doc_id: r for r in spotsigs.fingerprints(clashing(docs)).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text, *_) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (set(re.findall(".{8}", f)) for f in (r.fingerprint, r.edited_fingerprint, got[rows[(i + 1) % len(rows)][0]].fingerprint))
        assert math.isclose(r.near_edited, len(a & b) / len(a | b)) and math.isclose(r.near_next, len(a & c) / len(a | c))
    by_text = defaultdict(set)
    for doc_id, text, *_ in rows:
        by_text[text].add(got[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) < len(rows)
    assert sum(r.near_edited for r in got.values()) > 10 * sum(r.near_next for r in got.values())


def test_texts_without_common_words_have_signatures_all_along():
    text = [f"zq{i}" for i in range(400)]
    one = set(spotsigs.signatures(" ".join(text), spotsigs._Words()).tolist())
    assert len(one) > 50
    shared = []
    for at in (100, 300):
        other = set(spotsigs.signatures(" ".join(text[:at] + [f"other{i}" for i in range(80)] + text[at + 80 :]), spotsigs._Words()).tolist())
        shared.append(len(one & other) / len(one | other))
    assert all(0.5 < x < 0.9 for x in shared)


def test_signatures_equal_a_plain_version(table):
    """Anchors, chains and hashes word by word with Python's integers."""
    mask = (1 << 64) - 1

    def plain(text):
        words = [w.strip(spotsigs._STRIP) or w for w in text.lower().split()]
        bare = [w.strip(spotsigs._STRIP) for w in text.lower().split()]
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        last, anchors = -1, []
        for i, w in enumerate(bare):
            if w in spotsigs.ANCHORS:
                last = i
                anchors.append(i)
            elif i - last > spotsigs.GAP and h[i] % 4 == 0:
                anchors.append(i)
        out, known = set(), set(anchors)
        for at, x in [(-1, 0)] + [(i, h[i]) for i in anchors]:
            chain = list(itertools.islice((h[j] for j in range(at + 1, len(h)) if j not in known), spotsigs.CHAIN))
            chain += list(range(1, spotsigs.CHAIN + 1))[: spotsigs.CHAIN - len(chain)]
            for c in chain:
                x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 + c) & mask
            x ^= x >> 29
            out.add(((x * 0xBF58476D1CE4E5B9) & mask) >> 32)
        return out

    cache = spotsigs._Words()
    texts = ["", "the", "The quick, brown fox of the hill", "!!! --- the ???", "la"] + [t for _, t, *_ in table][:60] + [" ".join(f"zq{i}" for i in range(300))]
    for t in texts:
        assert set(spotsigs.signatures(t, cache).tolist()) == plain(t)


def test_spotsigs_of_hot_ids_and_many_ranges(spark):
    """A third of the rows share a doc_id, some have none: such cells are divided by hash, and each row meets its successor."""
    rows = [((7 if i % 3 == 0 else None if i % 10 == 1 else i * 1000003 % 5000 - 2000), f"text {i} of the row and more {i * i}", None, None, None) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    want = sorted((str(r[0]), hashlib.sha256((r[1][: len(r[1]) - len(r[1]) // 2] + n[1][: len(r[1]) // 2]).encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1]))
    for n in (None, 1, 5, 64, 500):
        got = spotsigs.fingerprints(df, n)
        assert sorted((str(r.doc_id), r.edited_sha256) for r in got.collect()) == want
    ranges, _ = spotsigs._ranges(df.select("doc_id", "text", F.xxhash64("text").alias("hash")), 64)
    sizes = df.withColumn("hash", F.xxhash64("text")).crossJoin(ranges).groupBy(spotsigs._group().alias("g")).count()
    assert sizes.agg(F.max("count")).first()[0] < 40


def test_spotsigs_of_odd_rows(spark, odd, empty):
    got = spotsigs.fingerprints(odd, 3).collect()
    assert len(got) == 11
    last = [r for r in got if r.doc_id is None and r.n_chars]
    assert len(last) == 1 and len([r for r in got if r.n_chars == 0]) == 3
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(9, "abcd", None, None, None)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1


def test_similar_documents_equal_brute_force(docs):
    sets = {r.set_id: set(r.sigs) for r in spotsigs.signature_sets(docs).collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = [frozenset((r.set_a, r.set_b)) for r in spotsigs.similar_documents(docs, 0.6).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_media_round_trip(docs, table, odd, empty):
    got = {r.doc_id: r for r in media.to_media(docs).collect()}
    for doc_id, text, *_ in table:
        data = media.payload(text.encode())
        r = got[doc_id]
        assert r.n_bytes == len(text.encode()) and r.payload_bytes == len(data) and len(data) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.read_png(bytes(r.media)).tobytes() == data
    odd_rows = media.to_media(clashing(odd)).collect()
    assert len(odd_rows) == 11 and min(r.payload_bytes for r in odd_rows) == 192
    assert media.to_media(empty).count() == 0


def test_png_rows_are_filtered_across_blocks(monkeypatch):
    monkeypatch.setattr(media, "WRITTEN", 5)
    monkeypatch.setattr(media, "BLOCK", 7)
    rng = np.random.default_rng(6)
    for height in (1, 4, 5, 6, 23):
        for pixels in (rng.integers(0, 256, (height, 6, 3)), np.cumsum(rng.integers(0, 3, (height, 6, 3)), 0), np.cumsum(rng.integers(0, 3, (height, 6, 3)), 1), np.full((height, 6, 3), 200)):
            pixels = pixels.astype(np.uint8)
            assert (media.read_png(media.write_png(pixels)) == pixels).all()
    kinds = media._filtered(np.cumsum(rng.integers(0, 3, (20, 18)), 0).astype(np.uint8), 3)[:, 0]
    assert (kinds == 2).any()
    with pytest.raises(ValueError):
        media.read_png(media.SIGNATURE + media._chunk(b"IHDR", bytes(8) + b"\x08\x02\0\0\0") + media._chunk(b"IDAT", b"") + media._chunk(b"IEND", b""))


def plain_cosine_hash(pixels):
    """The hash by its definition, coefficient by coefficient."""
    grey = pixels.mean(2)
    h, w = grey.shape
    pool = np.zeros((32, 32))
    for i in range(32):
        for j in range(32):
            a, b = (i * h // 32, (i + 1) * h // 32) if h >= 32 else (i * h // 32, i * h // 32 + 1)
            c, d = (j * w // 32, (j + 1) * w // 32) if w >= 32 else (j * w // 32, j * w // 32 + 1)
            pool[i, j] = grey[a:b, c:d].mean()
    low = np.array([[sum(pool[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(1, 9)] for u in range(1, 9)])
    return low, np.median(low)


def test_cosine_hash_equals_its_definition():
    rng = np.random.default_rng(7)
    for height, width in ((40, 64), (3, 64)):
        pixels = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
        low, middle = plain_cosine_hash(pixels)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(pixels)), np.uint8)).reshape(8, 8)
        clear = abs(low - middle) > 1e-6
        assert (bits[clear] == (low > middle)[clear]).all() and clear.sum() >= 60


def test_png_filters_and_damage(spark):
    rng = np.random.default_rng(4)
    for channels in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (9, 5, channels), dtype=np.uint8)
        flat = pixels.reshape(9, -1).astype(int)
        rows = []
        for y, row in enumerate(flat):  # filter by the format's definition, a type a row
            kind, out = y % 5, []
            for x, value in enumerate(row):
                a = row[x - channels] if x >= channels else 0
                b = flat[y - 1][x] if y else 0
                c = flat[y - 1][x - channels] if y and x >= channels else 0
                p = a + b - c
                near = min((a, b, c), key=lambda v: abs(p - v))
                out.append((value - (0, a, b, (a + b) // 2, near)[kind]) & 255)
            rows.append([kind, *out])
        assert (media._unfiltered(np.array(rows, np.uint8), channels).reshape(pixels.shape) == pixels).all()
        png = media.write_png(pixels)
        assert (media.read_png(png) == pixels).all()
        for at in (0, 20, len(png) // 2, len(png) - 5):
            bad = bytearray(png)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media.read_png(bytes(bad))
    good = media.write_png(np.zeros((2, 2, 3), np.uint8))
    got = media.media_features(spark.createDataFrame([(bytearray(good),), (bytearray(b"no"),), (None,)], "media binary")).collect()
    assert sorted((r.width or 0, r.error is not None) for r in got) == [(0, False), (0, True), (2, False)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(docs, table, odd, empty, tiktoken_encoding):
    got = {r.doc_id: r for r in bpe.encode(clashing(docs), RANKS, PATTERN).collect()}
    for doc_id, text, *_ in table:
        ids = tiktoken_encoding.encode_ordinary(text)
        r = got[doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    odd_rows = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS)
    assert Counter((r.doc_id, r.text) for r in odd_rows.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_prefix_tables_append_and_replace(tiktoken_encoding):
    vocabulary, rng = bpe.Vocabulary(bpe.read_ranks(RANKS)), random.Random(8)
    for _ in range(300):
        data = bytes(rng.choice(b"  theinonerabc\xc3\xa9\xff0.") for _ in range(rng.randint(0, 30)))
        table = bpe.PrefixTable(vocabulary, data[:7])
        table.append(data[7:])
        assert table.ids() == vocabulary.merged(data)
        start = rng.randint(0, len(data))
        stop = rng.randint(start, len(data))
        table.replace(start, stop, b"ing\xc3")
        assert table.data == data[:start] + b"ing\xc3" + data[stop:] and table.ids() == vocabulary.merged(table.data)


def test_token_counts_follow_edits(docs, table, odd, empty, tiktoken_encoding):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, RANKS, PATTERN).collect()}
    for doc_id, text, *_ in table:
        new = text
        for start, stop, put in token_counts.standard_edits(len(text)):
            new = new[:start] + put + new[stop:]
        r = got[doc_id]
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(tiktoken_encoding.encode_ordinary(text)), len(tiktoken_encoding.encode_ordinary(new)), len(new))
    assert sum(r.chars_encoded_again for r in got.values()) < 0.2 * sum(r.edited_chars for r in got.values())
    assert token_counts.token_counts(clashing(odd), RANKS, PATTERN).count() == 11
    assert token_counts.token_counts(empty, RANKS, PATTERN).count() == 0


def test_count_tree_on_random_edits(tiktoken_encoding):
    import regex

    encoder, pattern, rng = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), PATTERN), regex.compile(PATTERN), random.Random(9)
    letters = "ab éß'sltdre \n\t  .,-19ñ"
    for _ in range(60):
        tree = token_counts.CountTree("".join(rng.choice(letters) for _ in range(rng.randint(0, 900))), encoder, pattern)
        for _ in range(25):
            at = rng.randint(0, len(tree.text) + 2)
            tree.edit(at, at + rng.randint(0, 30), "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
            assert tree.tokens == len(tiktoken_encoding.encode_ordinary(tree.text))
            assert tree.pre_tokens == len(encoder.find(tree.text))


def test_count_tree_of_a_pattern_that_looks_over_white_space():
    """``\\s*[\\r\\n]+`` takes a line break however far it stands behind white space; a wider ``ahead`` serves a pattern that looks further."""
    import regex

    split = r"\s*[\r\n]+|\s+(?!\S)|\s?\S+|\s+"
    encoder, pattern, rng = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), split), regex.compile(split), random.Random(10)
    tree = token_counts.CountTree("foo\n" + " " * 10 + "x\nbar", encoder, pattern)
    tree.edit(14, 15, "")
    assert tree.pre_tokens == len(encoder.find(tree.text)) == 3
    for _ in range(60):
        tree = token_counts.CountTree("".join(rng.choice("ab \n  \t") for _ in range(rng.randint(0, 400))), encoder, pattern)
        for _ in range(20):
            at = rng.randint(0, len(tree.text) + 2)
            tree.edit(at, at + rng.randint(0, 30), "".join(rng.choice("ab \n  ") for _ in range(rng.randint(0, 20))))
            assert tree.pre_tokens == len(encoder.find(tree.text))
    far = r"a(?=.{8}b)|\w+|\W+"
    encoder, pattern = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), far), regex.compile(far)
    tree = token_counts.CountTree("." * 40 + "ac12345678.", encoder, pattern, ahead=9)
    tree.edit(49, 50, "b")
    assert tree.pre_tokens == len(encoder.find(tree.text)) == 4


def test_language_id(docs, table, odd, empty):
    lang = {r[0]: r[2] for r in table}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rows = langid.identify(odd).collect()
    assert len(rows) == 11
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 6)} == {"und"} and all(r.lang_pred in ("en", "nl", "und") for r in rows)
    assert langid.identify(empty).count() == 0
    kept = langid.predict(clashing(odd), langid.fit(odd))
    assert kept.count() == 11 and set(clashing(odd).columns) == set(kept.columns)
    none = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_scores_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("text", "lang").limit(60).collect()]
    model = langid.fit(docs.limit(60))
    counts = {x: np.full(langid.BUCKETS, langid.SMOOTHING) for x in model.langs}
    for text, lang in rows:
        for order in langid.ORDERS:
            counts[lang] += np.bincount(langid._grams(langid._points([text])[0], order), minlength=langid.BUCKETS)
    for k, x in enumerate(model.langs):
        assert np.allclose(model.logs[:, k], np.log(counts[x] / counts[x].sum()), atol=1e-4)


def test_language_scores_depend_on_the_text_alone(spark, docs, monkeypatch):
    model = langid.fit(docs)
    texts = ["hello", "", None, "guten tag", "une phrase", "x" * 5, "one two three " * 40]

    def scores(order, parts):
        rows = [(i, texts[i], None, None, None) for i in order]
        got = langid.predict(spark.createDataFrame(rows, SCHEMA).repartition(parts), model).collect()
        return {r.doc_id: (r.lang_pred, r.score) for r in got}

    alone = {i: scores([i], 1)[i] for i in range(len(texts))}
    assert scores(range(len(texts)), 1) == alone == scores([6, 3, 0, 5, 1, 2, 4], 3)


def test_long_texts_count_each_gram_once(monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choice("abcd ef") for _ in range(1000))
    points, _ = langid._points([text])
    for limit in (1, 2, 3, 7, 100, 333, 1001, 1002, 5000):
        for order in langid.ORDERS:
            got = np.zeros(langid.BUCKETS, int)
            for group in langid._groups([text, "", "ab"], limit):
                grams, none = group.grams(order)
                got += np.bincount(grams, minlength=langid.BUCKETS) - np.bincount(grams[none], minlength=langid.BUCKETS)
            want = sum(np.bincount(langid._grams(langid._points([t])[0], order), minlength=langid.BUCKETS) for t in (text, "", "ab") if len(t) + 2 >= order)
            assert (got == want).all()


def test_long_texts_in_parts_score_alike(spark, docs, monkeypatch):
    model = langid.fit(docs)
    model.priors = model.priors * 0
    text = " ".join(r.text for r in docs.filter("lang = 'de'").limit(200).collect())
    while len(text) <= 3 * langid._CHUNK:
        text += " " + text
    sums = np.zeros(len(model.langs))
    for order in langid.ORDERS:
        sums += model.logs[langid._grams(langid._points([text])[0], order)].sum(0, dtype=np.float64)
    got = langid.predict(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), model).first()
    assert got.lang_pred == model.langs[sums.argmax()] and math.isclose(got.score, 1, abs_tol=1e-9)
    group_sums = np.zeros(len(model.langs))
    for group in langid._groups([text], langid._CHUNK):
        for order in langid.ORDERS:
            grams, none = group.grams(order)
            logs = model.logs[grams]
            logs[none] = 0
            group_sums += logs.sum(0, dtype=np.float64)
    assert np.allclose(sums, group_sums, rtol=1e-9)


def brute_lines(rows, min_words):
    """Every run of lines with min_words words that occurs earlier is deleted, checked run by run."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    seen, out = {}, {}
    runs = []
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(x.strip() for x in lines[s:e])
                if sum(len(x.encode().split()) for x in run) >= min_words:
                    seen.setdefault(run, (i, s))
                    runs.append((i, s, e, run))
    drop = defaultdict(set)
    for i, s, e, run in runs:
        if seen[run] != (i, s):
            drop[i] |= set(range(s, e))
    for i in range(len(rows)):
        text = rows[i][1]
        out[i] = text if text is None or i not in drop else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop[i])
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    lines = [" ".join(f"l{i}w{j}" for j in range(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(14)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))), "x", "y", 1) for i in range(120)]
    for min_words in (6, 10):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(spark.createDataFrame(rows, SCHEMA)), min_words).collect()}
        want = brute_lines(rows, min_words)
        assert {i: r.text for i, r in got.items()} == want
        assert any(r.removed_lines for r in got.values()) and any(not r.removed_lines for r in got.values())


def test_line_dedup_catches_passages_and_leaves_the_rest(spark, odd, empty):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(i, f"own line {i}\n{passage}\nother line {i}\nshared short line", None, None, None) for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own line {i}\nother line {i}\nshared short line" for i in range(1, 300))
    rows = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(odd).collect())
    assert rows == Counter((r.doc_id, r.text) for r in odd.collect())
    assert line_dedup.dedup_lines(empty).count() == 0
