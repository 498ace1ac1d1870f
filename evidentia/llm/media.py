"""Media columns: bytes stored as PNG, read back with checksum tests, and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import as_bytes, pieces

UNIT = 192
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one next to left + up - corner; left before up before corner on ties."""
    a, b = abs(up - corner), abs(left - corner)
    c = abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


#: Rows that are filtered, and unfiltered, at once.
WRITTEN, BLOCK = 4096, 256


def _filtered(data: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples -> rows with a filter byte first: of None, Sub and Up (which whole rows undo), the one with the least sum of differences as signed bytes, the first on ties."""
    left, up = data.copy(), data.copy()
    left[:, bpp:] -= data[:, :-bpp]
    up[1:] -= data[:-1]
    tried = np.stack([data, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    kind = cost.argmin(0)
    out = np.empty((len(data), data.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = tried[kind, np.arange(len(data))]
    return out


def write_png(pixels: np.ndarray, level: int = 3) -> bytes:
    """A PNG of height x width x channels 8-bit samples (1: grey, 2: grey and alpha, 3: RGB, 4: RGBA), each row by the filter that suits it."""
    height, width, channels = pixels.shape
    color = {v: k for k, v in CHANNELS.items()}[channels]
    data, pack = pixels.reshape(height, -1), zlib.compressobj(level)
    # by blocks, so that memory follows a block; a block's first row is filtered with the row above it
    body = []
    for start in range(0, height, WRITTEN):
        above = min(start, 1)
        body.append(pack.compress(_filtered(data[start - above : start + WRITTEN], channels)[above:].tobytes()))
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(body) + pack.flush()) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with a filter byte first -> samples.

    Sub and Up are running sums, of whole rows and over runs of rows. For Average and Paeth a sample needs those left, above and
    in the corner between: there pixels are laid out by diagonals (row + column), each of which needs only the two before
    it, and all filters of all rows on a diagonal are undone at once.
    """
    filters, data = rows[:, 0].astype(np.int64), rows[:, 1:].copy()
    if filters.max(initial=0) > 4:
        raise ValueError(f"unknown row filter {filters.max()}")
    width = data.shape[1] // bpp
    above = np.zeros((width, bpp), np.int16)
    for start in range(0, len(data), BLOCK):
        kind = filters[start : start + BLOCK]
        block = data[start : start + BLOCK].reshape(len(kind), width, bpp)
        if kind.max() <= 2:
            sub = kind == 1
            if sub.any():
                block[sub] = np.cumsum(block[sub], axis=1, dtype=np.uint8)
            changes = np.flatnonzero(np.diff(kind == 2, prepend=False, append=False))
            for first, stop in changes.reshape(-1, 2).tolist():  # runs of Up rows
                run = block[first:stop]
                run[0] += block[first - 1] if first else above.astype(np.uint8)
                np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        else:
            n, x = len(kind), np.arange(width)
            # plane d + 2 holds the pixels with row + column = d; row 0 is the one above the block
            planes = np.zeros((n + width + 3, n + 1, bpp), np.int16)
            planes[x + 2, 0] = above
            at = np.arange(1, n + 1)[:, None]
            planes[at + x + 2, at] = block
            kinds = np.concatenate([[0], kind])[:, None]
            for d in range(1, n + width):
                lo, hi = max(1, d - width + 1), min(n, d) + 1
                left, up, corner = planes[d + 1, lo:hi], planes[d + 1, lo - 1 : hi - 1], planes[d, lo - 1 : hi - 1]
                guess = np.choose(kinds[lo:hi], (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
                planes[d + 2, lo:hi] = (planes[d + 2, lo:hi] + guess) & 255
            block[:] = planes[at + x + 2, at]
        above = block[-1].astype(np.int16)
    return data


def read_png(data: bytes) -> np.ndarray:
    """height x width x channels samples of an 8-bit PNG without palette or interlace; ValueError for anything damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + size]
        if len(content) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in CHANNELS or interlace:
        raise ValueError("only 8-bit samples without palette or interlace")
    if not width or not height:
        raise ValueError("an image without pixels")
    channels = CHANNELS[color]
    size = height * (1 + width * channels)
    # no more is unpacked than the header promises
    unpack = zlib.decompressobj()
    raw = np.frombuffer(unpack.decompress(b"".join(body), size + 1), np.uint8)
    if len(raw) != size or not unpack.eof:
        raise ValueError("wrong number of samples")
    return _unfiltered(raw.reshape(height, -1), channels).reshape(height, width, channels)


def payload(text: bytes) -> bytes:
    """The bytes padded with bytes 32 to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


_BASIS = _cosines(SIDE, LOW + 1)[1:]


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: signs against the median of the 8 x 8 lowest cosine coefficients (without the constant ones) of the 32 x 32 mean-pooled luminance."""
    grey = pixels.mean(2)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = (np.arange(SIDE) * n) // SIDE
        if n >= SIDE:
            grey = np.add.reduceat(grey, edges, axis=axis) / np.expand_dims(np.diff(np.append(edges, n)), 1 - axis)
        else:
            grey = np.take(grey, edges, axis=axis)
    low = _BASIS @ grey @ _BASIS.T
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def _stored(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows, media = [], []
            for text in as_bytes(part.column("text")):
                data = payload(text or b"")
                png = write_png(np.frombuffer(data, np.uint8).reshape(-1, UNIT // 3, 3))
                pixels = read_png(png)
                back = pixels.tobytes()
                rows.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)))
                media.append(png)
            n_bytes, size, sha, tail, stored, media_sha, feature = zip(*rows, strict=True)
            arrays = [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(stored, pa.int64()), pa.array(media_sha), pa.array(feature)]
            names = list(FIELDS)
            if with_media:
                arrays.append(pa.array(media, pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


FIELDS = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def to_media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row per document: the text's UTF-8 bytes, padded, as an RGB PNG 64 pixels wide, and what reading it back gives.

    Columns: FIELDS and, if wanted, ``media`` (the PNG). The digests are those of the bytes read back from the stored form,
    after its checksums were tested. A null text counts as empty and becomes one row of padding. Equal texts give equal
    values. Texts are stored whole (memory follows the longest); repeated rows and null ids give a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    schema = ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", media binary" * with_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored(with_media), schema)


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Rows with binary PNG ``column`` get ``width``, ``height``, ``feature`` and ``error``: the message for a damaged file (null values else), all null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(column).to_pylist():
                try:
                    pixels = None if data is None else read_png(data)
                    out.append((None,) * 4 if pixels is None else (pixels.shape[1], pixels.shape[0], cosine_hash(pixels), None))
                except (ValueError, zlib.error, struct.error) as e:
                    out.append((None, None, None, str(e)))
            w, h, f, e = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(f, pa.string()), pa.array(e, pa.string())], [*batch.schema.names, "width", "height", "feature", "error"])

    media = media.drop("width", "height", "feature", "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{schema}, width int, height int, feature string, error string")
