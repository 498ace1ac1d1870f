"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds the token counts and lengths of up to ``LEAF`` consecutive pre-tokens, an inner node the sums below it.
An edit re-splits and re-encodes from a few characters before it to the first old pre-token boundary after it, and
updates the sums on the paths to the leaves it touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import pieces
from evidentia.llm.bpe import Encoder, kept_encoder, rank_name, read_ranks

LEAF = 32
#: A pattern's decision on a pre-token looks at most this many characters past its end (the longest contraction) and the white space after it.
AHEAD = 3


class TokenCounts(Encoder):
    """pre-token -> its number of tokens."""

    LIMIT = 500_000

    @staticmethod
    def value(ids: list[int]) -> int:
        return len(ids)

    count = Encoder.__getitem__


class CountTree:
    """Pre-tokens of one text with subtree sums of characters, pre-tokens and tokens.

    ``found``: the text's pre-tokens, where they are known already. ``ahead``: how many characters, beside white space, the
    pattern looks past a pre-token's end; a pattern that looks further needs a larger one.
    """

    def __init__(self, text: str, encoder: Encoder, pattern: regex.Pattern, found: list[str] | None = None, ahead: int = AHEAD) -> None:
        self.encoder, self.pattern, self.ahead = encoder, pattern, ahead
        self.text = text
        found = encoder.find(text) if found is None else found
        self.build(list(map(len, found)), list(map(encoder.count, found)))

    def build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [[lengths[i : i + LEAF], counts[i : i + LEAF]] for i in range(0, len(lengths), LEAF)] or [[[], []]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)
        if lengths:
            starts, bottom = np.arange(0, len(lengths), LEAF), self.sums[self.size : self.size + len(self.leaves)]
            bottom[:, 0] = np.add.reduceat(lengths, starts)
            bottom[:, 1] = np.diff(starts, append=len(lengths))
            bottom[:, 2] = np.add.reduceat(counts, starts)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def pre_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last leaf beyond the end), and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        i = node - self.size
        if i >= len(self.leaves):
            i = len(self.leaves) - 1
            start = int(self.sums[1, 0] - self.sums[self.size + i, 0])
        return i, start

    def edit(self, start: int, stop: int, new: str) -> int:
        """Characters [start, stop) become ``new``; returns how many characters were encoded again."""
        old_length = len(self.text)
        start, stop = max(0, min(start, old_length)), max(0, min(stop, old_length))
        stop = max(start, stop)
        shift = len(new) - (stop - start)
        self.text = text = self.text[:start] + new + self.text[stop:]
        reach = start  # white space before the edit may have been split by what stood after it
        while reach and text[reach - 1].isspace():
            reach -= 1
        first, at = self.find(max(0, reach - self.ahead))
        # from the pre-token that ends within ``ahead`` of it on, everything may change
        begin, keep = at, 0
        lengths, counts = self.leaves[first]
        while keep < len(lengths) and begin + lengths[keep] + self.ahead <= reach:
            begin += lengths[keep]
            keep += 1
        head = (lengths[:keep], counts[:keep])
        fresh_lengths, fresh_counts, position = [], [], begin
        leaf, old_at, tail = first, at, ([], [])
        ends = None
        while position < len(text):
            if position >= start + len(new):
                old = position - shift
                while leaf < len(self.leaves) - 1 and old >= old_at + int(self.sums[self.size + leaf, 0]):
                    old_at += int(self.sums[self.size + leaf, 0])
                    leaf, ends = leaf + 1, None
                if ends is None:
                    ends = {old_at: 0}
                    p = old_at
                    for k, n in enumerate(self.leaves[leaf][0]):
                        p += n
                        ends[p] = k + 1
                if old in ends and old >= stop:
                    tail = (self.leaves[leaf][0][ends[old] :], self.leaves[leaf][1][ends[old] :])
                    break
            match = self.pattern.match(text, position)
            piece = match.group()
            fresh_lengths.append(len(piece))
            fresh_counts.append(self.encoder.count(piece))
            position = match.end()
        else:
            leaf = len(self.leaves) - 1
        merged = [[*head[0], *fresh_lengths, *tail[0]], [*head[1], *fresh_counts, *tail[1]]]
        self.put(first, leaf, merged)
        return sum(fresh_lengths)

    def put(self, first: int, last: int, leaf: list) -> None:
        """Leaves first..last become one; leaves that grew too long make the tree anew from its counts, without encoding."""
        if len(leaf[0]) > 8 * LEAF:
            self.leaves[first : last + 1] = [leaf]
            self.build([n for a, _ in self.leaves for n in a], [n for _, b in self.leaves for n in b])
            return
        self.leaves[first] = leaf
        for i in range(first + 1, last + 1):
            self.leaves[i] = [[], []]
        for i in range(first, last + 1):
            a, b = self.leaves[i]
            node = self.size + i
            self.sums[node] = sum(a), len(a), sum(b)
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def _counted(ranks, name: str, pattern: str, edits, ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compiled = kept_encoder(TokenCounts, name, ranks.value, pattern), regex.compile(pattern)
        for part in pieces(batches):
            rows = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [encoder.find(t) for t in texts]
            encoder.learn(found)
            for text, pre_tokens in zip(texts, found, strict=True):
                tree = CountTree(text, encoder, compiled, pre_tokens, ahead)
                before = (tree.pre_tokens, tree.tokens)
                again = sum(tree.edit(*e) for e in edits(len(tree.text)))
                rows.append((*before, tree.pre_tokens, tree.tokens, len(tree.text), again))
                encoder.trim()
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *NAMES])

    return run


NAMES = ("n_pre_tokens", "n_tokens", "edited_pre_tokens", "edited_tokens", "edited_chars", "chars_encoded_again")


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """The edits that the query applies to a text of n characters: one insertion, one replacement, one deletion (positions of the text as it is then)."""
    return [(n // 2, n // 2, " edit's 42\n"), (n // 4, n // 4 + 7, "Ünïcode"), (3 * n // 4, 3 * n // 4 + 11, "")]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, edits=standard_edits, ahead: int = AHEAD) -> DataFrame:
    """One row per document: doc_id, counts of pre-tokens and tokens before and after ``edits``, and the characters encoded again.

    ``edits(n_chars)`` lists (start, stop, new text), applied in turn; positions beyond the text are cut to its end. ``ahead``: see
    ``CountTree``; it belongs to the pattern. A null
    text counts as empty. Whole texts of any length; repeated rows, ties and null ids give a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    ranks = read_ranks(ranks_path)
    name, ranks = rank_name(ranks), docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(ranks, name, pattern, edits, ahead), schema)
