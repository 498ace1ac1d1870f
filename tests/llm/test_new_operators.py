"""Hard negatives, alignment and MaxScore against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import alignment, hard_negatives, maxscore, mixing, near_dedup, toxicity, vectors
from evidentia.llm.queries import SIDES

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int, rank int, part int"
A, B = map(public_tokenizers.path, SIDES)


def usable(rows, labelled):
    for vec_id, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and label is None):
            yield vec_id, [float(np.float32(x)) for x in v], label


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(x):
    return -x[0], x[1] is None, x[1] or 0


def brute_top(rows, every=20, k=20):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e, _ in usable(rows, False)]
    out = []
    for q, (i, e) in enumerate(v):
        if i is not None and i % every == 0:
            best = sorted(((dot(e, f), j) for n, (j, f) in enumerate(v) if n != q), key=order)[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def brute_negatives(rows, every=100):
    v = [(i, [math.floor(256 * x) for x in e], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, e, label in usable(rows, True)]
    out = []
    for q, (i, e, label) in enumerate(v):
        if i is None or i % every:
            continue
        scored = [(dot(e, f), j, m) for n, (j, f, m) in enumerate(v) if n != q]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            near = sorted((x for x in scored if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:5]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def grouped():
    """Vectors in a few tight groups (one with half of the rows), exact copies, ties, one label for a third."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(700):
        c = centres[0 if i % 2 else rng.randrange(6)]
        v = [x + rng.gauss(0, 0.03) for x in c] if i % 5 else list(c)
        rows.append((i * 2, v, 3 if i % 3 == 0 else rng.randrange(10), "x", i, i, i))
    return rows


ODD = [
    (0, [0.5, 0.25], 1, "a", 0, 0, 0),
    (0, [0.5, 0.25], 1, "a", 0, 0, 0),
    (20, [0.5, -0.25, 1.0], 1, None, 0, 0, 0),
    (40, [], 2, "a", 0, 0, 0),
    (60, None, 2, "a", 0, 0, 0),
    (80, [float("nan"), 1.0], 2, "a", 0, 0, 0),
    (100, [float("inf"), 1.0], 2, "a", 0, 0, 0),
    (100, [0.5, None], 2, "a", 0, 0, 0),
    (120, [1.0, 1.0], None, "a", 0, 0, 0),
    (None, [1.0, 1.0], 1, "a", 0, 0, 0),
    (None, [1.0, 1.0], 4, "a", 0, 0, 0),
    (200, [2.0, -3000.0], 1, "a", 0, 0, 0),
    (7, [0.5, 0.25], 0, "a", 0, 0, 0),
    (201, [0.45, 0.25], 5, "a", 0, 0, 0),
    (202, [0.45, 0.25], 5, "a", 0, 0, 0),
]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(4096, 4096), (60, 16)])
def test_top_k_equals_brute_force(spark, grouped, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", sizes[1])
    assert found(maxscore.top_k(spark.createDataFrame(grouped, SCHEMA))) == brute_top(grouped)


def test_top_k_of_odd_rows(spark):
    assert found(maxscore.top_k(spark.createDataFrame(ODD, SCHEMA))) == brute_top(ODD)
    assert maxscore.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    big = [(i, [1e7 * (i + 1), 3e8], 1, None, 0, 0, 0) for i in range(25)]
    assert found(maxscore.top_k(spark.createDataFrame(big[:3], SCHEMA), k=2, scale=1))[0][3] == dot(*[[math.floor(float(np.float32(x))) for x in big[i][1]] for i in (0, 2)])


def test_search_leaves_out_what_cannot_reach_the_threshold():
    """Sparse terms with a few high impacts: most contributions are neither traversed nor looked up, and the answers stay exact."""
    rng = np.random.default_rng(1)
    m = (rng.random((3000, 40)) < 0.15) * rng.integers(1, 6, (3000, 40))
    m[:, :3] *= 40
    rows = lambda x, at: vectors.Rows(x, np.arange(at, at + len(x)), np.arange(at, at + len(x)), np.ones(len(x), bool), np.zeros(len(x), np.int64))
    queries = (rng.random((30, 40)) < 0.3) * rng.integers(1, 4, (30, 40))
    search = maxscore.Search(rows(queries, 100_000), 5)
    for at in range(0, 3000, 250):
        search.add(rows(m[at : at + 250], at))
    scores = queries @ m.T
    for i in range(30):
        want = sorted(((-s, j) for j, s in enumerate(scores[i])))[:5]
        assert sorted(zip((-search.score[search.owner == i]).tolist(), search.ids[search.owner == i].tolist(), strict=True)) == want
    assert search.traversed + search.probed < 0.7 * scores.size * 40


@pytest.mark.parametrize("sizes", [(4096, 512), (60, 3)])
def test_hard_negatives_equal_brute_force(spark, grouped, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", sizes[1])
    want = brute_negatives(grouped)
    assert want
    assert found(hard_negatives.hard_negatives(spark.createDataFrame(grouped, SCHEMA))) == want


def test_hard_negatives_of_odd_rows(spark):
    got = found(hard_negatives.hard_negatives(spark.createDataFrame(ODD, SCHEMA)))
    assert got == brute_negatives(ODD) and got
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = [r for r in ODD if r[0] == 20]
    assert hard_negatives.hard_negatives(spark.createDataFrame(alone, SCHEMA)).collect() == []


def test_spanning_tree_and_its_bounds_save_work():
    rng = np.random.default_rng(2)
    anchors = np.concatenate([rng.integers(-3, 4, (40, 16)) + c for c in rng.integers(-200, 200, (4, 1, 16))])
    parent, edge, levels = hard_negatives.spanning_tree(anchors)
    d = np.sqrt(((anchors[:, None] - anchors) ** 2).sum(2).astype(float))
    left, total = set(range(1, len(anchors))), 0.0  # Kruskal's sum, by brute force
    label = list(range(len(anchors)))
    for i, j in sorted(((i, j) for i in range(len(anchors)) for j in range(i)), key=lambda p: d[p]):
        if label[i] != label[j]:
            total += d[i, j]
            label = [label[i] if x == label[j] else x for x in label]
    assert edge.sum() == pytest.approx(total)
    assert parent[0] == -1 and sorted(np.concatenate(levels)) == list(range(len(anchors)))
    assert all((parent[level] >= 0).all() for level in levels[1:]) and left
    m = np.concatenate([rng.integers(-40, 40, (500, 16)) + c for c in (150, -150, 0)])
    rows = lambda x, at: vectors.Rows(x, np.arange(at, at + len(x)), np.arange(at, at + len(x)), np.ones(len(x), bool), np.zeros(len(x), np.int64))
    work = hard_negatives.Mining(rows(anchors, 10_000), 5, False)
    for at in range(0, len(m), 300):
        work.add(rows(m[at : at + 300], at))
    assert work.rescored < 0.6 * work.seen
    scores = anchors @ m.T
    for i in range(0, len(anchors), 13):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()))[:5]
        assert sorted(zip((-work.score[work.owner == i]).tolist(), work.ids[work.owner == i].tolist(), strict=True)) == want


# --- alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_alignment(texts, tokenizers):
    """A row per text from the definitions: links by overlap, groups by common ends, counts over all texts."""
    a, b = tokenizers
    of = alignment._byte_of()
    rows, counts, linked = [], Counter(), []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append((0, 0, 0, 0, ""))
            linked.append(Counter())
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links = Counter()
        for i, (s, e) in enumerate(spans[0]):
            for j, (t, f) in enumerate(spans[1]):
                if s < f and t < e:
                    links[ids_a[i], ids_b[j]] += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([i for i, (s, e) in zip(ids_a, spans[0], strict=True) if x < e <= y], [i for i, (s, e) in zip(ids_b, spans[1], strict=True) if x < e <= y]) for x, y in zip([0, *cuts], cuts, strict=False)]
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(text_of.encode()).hexdigest()))
        linked.append(links)
        counts.update(links.keys())
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*r[:4], sum(t for p, t in li.items() if counts[p] == most[p[0]]), sum(t * counts[p] for p, t in li.items()), r[4]) for r, li in zip(rows, linked, strict=True)]


TEXTS = [None, "", " ", "a", "hello world", "hello world", "  two  spaces ", "tab\tand\nline\r\n\n", "▁marks", "<|endoftext|> <s> </s> <unk> <0x41>", "één woord 😀 ퟿ x", "naïve café 漢字 и слова", "x" * 300, "12345 678 9.10", "don't we'll I'M", "\x00 null", " lead", "ﬁ ligature Å"]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, tokenizers, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 4000").limit(25).select("doc_id", "text").collect()
    texts = TEXTS + [r.text for r in docs]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair int, row string").repartition(3)
    got = sorted(tuple(r) for r in alignment.align(rows, A, B, limit).collect())
    assert got == [(i, *r) for i, r in enumerate(brute_alignment(texts, tokenizers))]


def test_alignment_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], kind), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], kind), A, B).collect()
    assert sorted((r.doc_id or -1, r.n_links, r.count_sum) for r in got) == [(-1, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]


def test_long_texts_are_cut_where_both_sides_begin_anew(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 40)
    sides = alignment.Sides(A, B)
    assert sides.space
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word", "The", " ", " ", "  ", "\n", "é", "9", "'s", ".", "漢", "-x"]) for _ in range(rng.randrange(10, 120)))
        got = sides.encode([text])[0]
        ids = tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)
        if got is None:
            continue
        assert (got[0].tolist(), got[1].tolist()) == ids


def test_terminals_by_pointer_jumping():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2)]
        got = alignment.terminals(*cuts)
        ends = np.concatenate(cuts)
        common = np.intersect1d(*cuts)
        assert np.array_equal(ends[got], common[np.searchsorted(common, ends)]) and (got < len(cuts[0])).all()


# --- mixing of repeated rows


@pytest.mark.parametrize("sources", [("a", "b"), ("c", "b"), ("b", "a"), ("", None)])
def test_mixing_meets_targets_with_repeated_rows(spark, sources):
    """1,000 equal rows as the source of the first, second or third weight: capped, fractional and without a whole epoch."""
    crowded, other = sources
    rows = [(1, "four words in here", crowded, "x")] * 1000 + [(i, " ".join(["w"] * (i % 9)), other, "x") for i in range(2, 1500)] + [(i, "one two", "b2", "x") for i in range(5000, 5200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place_in string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    copies = {r.copies for r in got if r.source == crowded}
    assert max(copies) - min(copies) <= 1
    assert all(r.place_in == "x" for r in got)
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


# --- pairs of terms that tell nothing alone


@pytest.mark.parametrize("rule", ["and", "same", "different"])
def test_factorization_machine_finds_pairs_of_neutral_terms(rule):
    rng = random.Random(8)
    noise = [f"noise{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([rng.choice(noise) for _ in range(20)] + ["zork"] * a + ["blim"] * b))
        labels.append(float({"and": a and b, "same": a == b, "different": a != b}[rule]))
    terms = toxicity.Terms()
    x = [np.asarray(terms.of(t), np.int64) for t in texts]
    model = toxicity.train(x, np.array(labels), np.ones(len(x)))
    score = lambda end: model.scores([np.asarray(terms.of(" ".join(noise[:20]) + end), np.int64)])[0]
    both, alone = score(" zork blim"), max(score(" zork"), score(" blim"))
    assert (both < 0.3 and alone > 0.8) if rule == "different" else (both > 0.8 and alone < 0.3)
    # the score by its definition: every pair's product, in O(n^2)
    for d in x[:20]:
        pairs = sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(d) for j in d[:n])
        plain = model.bias + float(model.weights[d].sum()) + pairs
        assert model.logits([d])[0] == pytest.approx(plain, abs=1e-3)


# --- near duplicates without ids


def test_rows_without_ids_are_fetched_by_their_texts(spark):
    """Each edited text is confirmed on its own row only, so rows without ids, or with one id, cost what rows with ids cost."""
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], "edited"])]
    for ids in ((None,) * 300, (7,) * 300):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        reps = df.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("text").alias("text_hash"), "text", F.col("doc_id").alias("rep"))
        signed = df.withColumn("text_hash", F.xxhash64("text")).mapInArrow(near_dedup._signatures(2), "doc_id long, text_hash long, n_shingles long, set_key binary, regs binary")
        reps = reps.join(signed.select("text_hash", "set_key"), "text_hash")
        assert near_dedup._sets_of(reps, reps, df, 2).count() == 300
        got = near_dedup.near_duplicates(df, 2).collect()
        assert len(got) == 300 and {r.component_id for r in got} == {ids[0]}
