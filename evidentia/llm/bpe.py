"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes, ``last[i]`` is the last token of the BPE encoding of its first i bytes. That token is unique: it
is the token t ending at i for which the pair (last[i - len(t)], t) is itself what BPE makes of the pair's bytes. So a
piece is encoded left to right, appended bytes extend the table exactly, and an edit at byte j only invalidates
entries from j on (``PrefixTable``).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import pieces


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with the validity of neighbouring tokens, decided once a pair and remembered."""

    PAIRS = 1_000_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.valid: dict[int, bool] = {}
        #: finds all tokens that end at each byte, longest first, in one pass (bytes as the characters 0 to 255)
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary needs all 256 bytes; {len(missing)} are missing")

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: merge the leftmost pair of least rank until none is left. For short inputs."""
        ranked, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [ranked(data[i : i + 2], never) for i in range(len(data) - 1)]
        while near:
            rank = min(near)
            if rank == never:
                break
            i = near.index(rank)
            parts[i] += parts.pop(i + 1)
            del near[i]
            if i:
                near[i - 1] = ranked(parts[i - 1] + parts[i], never)
            if i < len(near):
                near[i] = ranked(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives these two tokens; left -1: whether the right one's bytes give it alone."""
        if len(self.valid) >= self.PAIRS:
            self.valid.clear()
        data = self.tokens[right] if left < 0 else self.tokens[left] + self.tokens[right]
        known = self.valid[left << 32 | right] = self.merged(data) == ([right] if left < 0 else [left, right])
        return known


class PrefixTable:
    """The last token of each prefix of a growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the piece; earlier entries stay as they are."""
        v, last = self.vocabulary, self.last
        known, end = v.valid.get, len(self.data)
        self.data += more
        for at, (n, token) in v.automaton.iter(self.data.decode("latin-1"), max(0, end - v.longest + 1)):
            if at >= end:  # the first token that ends here and is valid; the single byte comes last
                left = last[at + 1 - n]
                fits = known(left << 32 | token)
                if fits or fits is None and v.fits(left, token):
                    last.append(token)
                    end = at + 1

    def turn_into(self, data: bytes) -> None:
        """Becomes the table of ``data``, keeping the entries of the prefix that it shares with the piece so far."""
        old, keep, most = self.data, 0, min(len(self.data), len(data))
        while keep < most and old[keep] == data[keep]:
            keep += 1
        self.data = old[:keep]
        del self.last[keep + 1 :]
        self.append(data[keep:])

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Bytes [start, stop) become ``new``: entries up to ``start`` are kept, later ones are computed again."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at, tokens = [], len(self.data), self.vocabulary.tokens
        while at:
            out.append(self.last[at])
            at -= len(tokens[out[-1]])
        return out[::-1]


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers (``value``).

    Memory is bounded by two generations of ``LIMIT`` entries: a full one becomes the old one, whose entries move over
    when they are met again, so frequent pre-tokens stay.
    """

    LIMIT = 300_000

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        super().__init__()
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.table, self.old = PrefixTable(vocabulary), {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            data = piece.encode()
            rank = self.vocabulary.ranks.get(data)
            if rank is None:
                self.table.turn_into(data)
            out = self.value([rank] if rank is not None else self.table.ids())
        self[piece] = out
        return out

    @staticmethod
    def value(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def count(self, piece: str) -> int:
        return len(self[piece]) // 4

    def learn(self, found: list[list[str]]) -> None:
        """Encodes the pre-tokens that are new in sorted order, so that each extends the table of a prefix it shares with the one before."""
        for piece in sorted(set().union(*found).difference(self)):
            self[piece]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        found = [self.find(t) for t in texts]
        self.learn(found)
        for pieces_of_text in found:
            yield b"".join(map(self.__getitem__, pieces_of_text))
        self.trim()

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.old = dict(self)
            self.clear()


#: kind of encoder -> (what it was made for, the encoder): what a worker process has learned serves its next tasks too.
_KEPT: dict[type, tuple[tuple[str, str], Encoder]] = {}


def kept_encoder(kind: type[Encoder], name: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """This process's encoder for the ranks named ``name`` (see ``rank_name``); results don't depend on what it has learned."""
    if kind not in _KEPT or _KEPT[kind][0] != (name, pattern):
        _KEPT[kind] = (name, pattern), kind(Vocabulary(ranks), pattern)
    return _KEPT[kind][1]


def rank_name(ranks: dict[bytes, int]) -> str:
    """A digest that names the ranks."""
    return hashlib.sha256(b"".join(b"%d %d %b" % (r, len(t), t) for t, r in sorted(ranks.items()))).hexdigest()


def _coded(ranks, name: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(Encoder, name, ranks.value, pattern)
        tokens = encoder.vocabulary.tokens
        for part in pieces(batches):
            n, ids_hex, bytes_hex, ids = [], [], [], []
            for coded in encoder.encode_all([t or "" for t in part.column("text").to_pylist()]):
                numbers = np.frombuffer(coded, "<u4")
                n.append(len(numbers))
                ids_hex.append(hashlib.sha256(coded).hexdigest())
                bytes_hex.append(hashlib.sha256(b"".join(map(tokens.__getitem__, numbers.tolist()))).hexdigest())
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(bytes_hex)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids.

    Each match of ``pattern`` is encoded separately, without special tokens; ids_sha256 is taken over the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 over the bytes that the ids decode to. A null text counts as
    empty (no ids). A text of any length is encoded whole; memory follows the longest text. Repeated rows, ties and
    null ids give a row each; other columns are ignored; an empty table gives an empty result. The ranks (about 1 MB)
    are read on the driver and broadcast.
    """
    ranks = read_ranks(ranks_path)
    name, ranks = rank_name(ranks), docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coded(ranks, name, pattern, with_ids), schema)


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows with ``ids`` get ``text``: the decoded bytes as UTF-8, U+FFFD for bytes that aren't. Null ids give a null text."""
    ranks = coded.sparkSession.sparkContext.broadcast({r: t for t, r in read_ranks(ranks_path).items()})

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else b"".join(map(ranks.value.__getitem__, x)).decode("utf-8", "replace"))

    return coded.withColumn("text", text("ids"))
