"""Shared helpers of the Arrow-batch functions: bounded pieces, words, hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes that one piece holds at most, unless a single text is longer.
PIECE_BYTES = 1_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to ``limit`` bytes at most (a longer text is alone), so memory follows the longest text, not the batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker may stay idle for a while


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``; bytes.lower and bytes.split are defined on exactly these bytes."""
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (uint64): all bits depend on all bits."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


class WordHashes(dict):
    """word -> 64-bit hash; call ``trim`` between texts to bound the memory."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


def ragged(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list array from concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def id_text(col: str = "doc_id") -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``."""
    return F.crc32(id_text(col)) % parts


def row_hash(*cols: str) -> Column:
    """A 64-bit hash that, together with doc_id, names a row; equal rows share it and get equal results."""
    return F.xxhash64(*[F.col(c) for c in cols])
