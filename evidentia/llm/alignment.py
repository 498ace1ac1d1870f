"""Alignment of two tokenizations of one text, by pointer jumping.

Tokens of both sides are nodes. Each points to the farthest-right token of the other side that overlaps it, or to itself where none
reaches farther; where two end together the one of side B points to the one of side A. Successors are doubled (s = s[s]) until
nothing changes: every token then points to the terminal token of its component, whose end is an offset where both sides
end, and that labels the groups. All texts of a piece are done in one go, one after another on a common byte axis: a text's end is a
common end too.

Corpus-wide counts of linked id pairs come from each document's distinct pairs, summed in Spark; they return to the
documents as a broadcast table while there are few enough (checked), else by a join on the pair.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import pieces, ragged
from evidentia.plans.scratch import written

#: Text bytes that are encoded at a time, and those of a stretch of a longer text.
PIECE_BYTES, STRETCH = 400_000, 100_000
#: Distinct id pairs up to which their counts (9 bytes each) are broadcast.
BROADCAST_PAIRS = 4_000_000
#: A pair is packed as a * SIDE + b; SIDE is above every id of side B.
SIDE = 1 << 15
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_of() -> dict[str, int]:
    """Character of a byte-level vocabulary entry -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Sides:
    """Both tokenizers, with the bytes of their tokens. ``space``: side B has no piece with a space after another character, so texts may be cut before single spaces."""

    def __init__(self, a: str, b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        of, vocab = _byte_of(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        entries = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(entries) > SIDE or len(self.bytes_a) * SIDE >= 1 << 31:
            raise ValueError("these vocabularies don't fit into packed pairs of 31 bits")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
        self.space = not any(" " in p.replace("▁", " ").lstrip(" ") for p in entries)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # a token's text in a group: followed by another of its side, or by the end of the side or group
        self.texts = np.array([f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)], dtype=object)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text; None where a side's bytes aren't those of space + text."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in self._stretches(text):
                parts.append(part)
                owner.append(i)
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        got: list[list] = [[[], [], True] for _ in texts]
        for i, part, x, y in zip(owner, parts, ids_a, ids_b, strict=True):
            raw = b" " + part.encode()
            same = b"".join(map(self.bytes_a.__getitem__, x)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw
            got[i][0].append(np.array(x, np.int64))
            got[i][1].append(np.array(y, np.int64))
            got[i][2] &= same
        return [(np.concatenate(x), np.concatenate(y)) if ok and t else None for (x, y, ok), t in zip(got, texts, strict=True)]

    def _stretches(self, text: str) -> Iterator[str]:
        """The text cut before single spaces between ASCII letters, without these spaces: both sides begin a token there, and both put the space back."""
        start = 0
        while self.space and len(text) - start > STRETCH:
            cut = _CUT.search(text, start + STRETCH)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.end()
        yield text[start:]


@functools.lru_cache(maxsize=2)
def _sides(a: str, b: str) -> Sides:
    """A worker process keeps its tokenizers from task to task."""
    return Sides(a, b)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token's component, tokens numbered A first, then B. ``ends``: rising byte offsets of the tokens' ends."""
    n = len(ends_a)
    last_b = np.searchsorted(ends_b, ends_a)  # the B token that holds a token's last byte, and so on
    last_a = np.searchsorted(ends_a, ends_b)
    to_a = np.where(ends_b[last_b] > ends_a, n + last_b, np.arange(n))
    to_b = np.where(ends_a[last_a] >= ends_b, last_a, n + np.arange(len(ends_b)))
    s = np.concatenate([to_a, to_b])
    while True:
        further = s[s]
        if np.array_equal(further, s):
            return s
        s = further


def aligned(sides: Sides, encoded: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """For each (non-empty) pair of id arrays: n_a, n_b, n_groups, n_links, groups (their text), pairs (packed, distinct, sorted) and times (how often each is linked)."""
    if not encoded:
        return []
    a, b = (np.concatenate([e[k] for e in encoded]) for k in (0, 1))
    count_a, count_b = (np.array([len(e[k]) for e in encoded]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(sides.sizes_a[a]), np.cumsum(sides.sizes_b[b])
    end_of = terminals(ends_a, ends_b)
    n = len(a)
    final_a, final_b = (np.diff(x, append=-1) != 0 for x in (end_of[:n], end_of[n:]))  # the last token of its side in its group
    group_a, group_b = (np.cumsum(x) - x for x in (final_a, final_b))
    # links: an A token overlaps the B tokens from the one with its first byte to the one with its last
    first = np.searchsorted(ends_b, ends_a - sides.sizes_a[a], side="right")
    width = np.searchsorted(ends_b, ends_a) - first + 1
    owner = np.repeat(np.arange(n), width)
    other = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + first[owner]
    doc = np.repeat(np.arange(len(encoded)), count_a)
    keys, times = np.unique((doc[owner] << 31) | (a[owner] * SIDE + b[other]), return_counts=True)
    key_doc = keys >> 31
    pair_ends = np.searchsorted(key_doc, np.arange(len(encoded) + 1))
    # the groups' text: A's tokens of a group, then B's
    code_a = a + final_a * len(sides.bytes_a)
    code_b = b + 2 * len(sides.bytes_a) + final_b * len(sides.bytes_b)
    tokens_a, tokens_b = np.bincount(group_a), np.bincount(group_b)
    text = np.empty(n + len(b), dtype=object)
    text[np.arange(n) + (np.cumsum(tokens_b) - tokens_b)[group_a]] = sides.texts[code_a]
    text[np.arange(len(b)) + np.cumsum(tokens_a)[group_b]] = sides.texts[code_b]
    stops_a, stops_b = np.cumsum(count_a), np.cumsum(count_b)
    out = []
    for k in range(len(encoded)):
        lo, hi = (stops_a[k] - count_a[k]) + (stops_b[k] - count_b[k]), stops_a[k] + stops_b[k]
        part = slice(pair_ends[k], pair_ends[k + 1])
        own = slice(stops_a[k] - count_a[k], stops_a[k])
        out.append({"n_a": int(count_a[k]), "n_b": int(count_b[k]), "n_groups": int(final_a[own].sum()), "n_links": int(width[own].sum()), "groups": "".join(text[lo:hi].tolist())[:-1], "pairs": (keys[part] & ((1 << 31) - 1)).astype(np.int32), "times": times[part].astype(np.int32)})
    return out


HELD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _held(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a, b)
        for part in pieces(batches, limit=PIECE_BYTES):
            encoded = sides.encode([t or "" for t in part.column("text").to_pylist()])
            done = iter(aligned(sides, [e for e in encoded if e is not None]))
            none = np.zeros(0, np.int32)
            rows = [next(done) if e is not None else {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": None, "pairs": none, "times": none} for e in encoded]
            counts = [pa.array([r[c] for r in rows], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            digests = pa.array(["" if r["groups"] is None else hashlib.sha256(r["groups"].encode()).hexdigest() for r in rows])
            sizes = [len(r["pairs"]) for r in rows]
            lists = [ragged(np.concatenate([r[c] for r in rows]), sizes) for c in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, *lists], [c.split()[0] for c in HELD.split(", ")])

    return run


def aligned_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per document as HELD says: counts, the digest of the groups, and the distinct linked pairs with how often each is linked there."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_held(a, b), HELD)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair with the same A id is in more. At most a row for each pair of ids of the two vocabularies."""
    counts = written(held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", 15)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(table) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(pairs, lists.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEPT), pa.array(total(times * best[place])), pa.array(total(times * n[place]))], [*KEPT, "n_best", "count_sum"])

    return run


KEPT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def align(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is the file of a byte-level tokenizer, which encodes space + text, ``b`` that of a sentence-piece model, which adds the space. Special tokens' strings
    are plain text. Texts that are null or empty, or whose tokens on either side don't join to the bytes of space + text, have no
    tokens: zeros and an empty digest. Links are the overlapping pairs of an A and a B token; a pair of ids counts the documents in which
    it is linked. n_best: links whose pair is in as many documents as any of their A id. count_sum: the pairs' counts summed over
    links. The digest is of the groups, in order, as ``a1,a2|b1;a3|b2,b3``. Repeated rows are documents of their own; other columns are ignored; an
    empty table gives an empty result. Whole texts; a long one is encoded in stretches that both sides begin anew by themselves.
    """
    held = written(aligned_documents(docs, a, b), "aligned")
    counts = written(pair_counts(held), "counts")
    if counts.count() <= broadcast_pairs:
        got = counts.toArrow().combine_chunks()
        order = np.argsort(got["pair"].to_numpy())
        table = tuple(got[c].to_numpy()[order] for c in ("pair", "n", "best"))
        shared = docs.sparkSession.sparkContext.broadcast(table)
        kind = f"{', '.join(HELD.split(', ')[:6])}, n_best long, count_sum long"
        out = held.mapInArrow(_looked_up(shared), kind)
    else:
        rows = written(held.withColumn("row", F.monotonically_increasing_id()), "rows")
        spots = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = spots.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
