"""Integer vectors in blocks: query blocks meet groups of shards, one task at a time.

A table of vectors is dealt to shards of about ``SHARD_ROWS`` rows by a hash of a row number, so that neither repeated ids nor
a crowded label fill one of them. A shard, or a block of queries, travels as one row with its vectors as a matrix. Each
pair of a block and a group of ``SHARDS`` shards is one unit of work: its rows are dealt to a task together and come block first,
then shard by shard, so that thresholds rise from shard to shard and a task holds one shard at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.scratch import written

SHARD_ROWS = 4096
#: Shards that a task goes through for one block.
SHARDS = 4
#: Tasks that all units are dealt to at most.
TASKS = 1 << 16
_KINDS = "bhiq"
PACKED = "part int, width int, kind string, data binary, rows array<long>, ids array<long>, labels array<long>, slots array<array<long>>"


def quantized(table: DataFrame, scale: int, labelled: bool = False) -> DataFrame:
    """(row, vec_id, label, v): each vector's components as floor(scale * x), x as double; ``row`` tells repeated rows apart. Written.

    Left out: null vectors, vectors with null or non-finite components and, with ``labelled``, rows without a label. An empty
    vector stays and scores 0. Vectors of unlike lengths score as if the shorter one went on with zeros.
    """
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long") if labelled else F.lit(None).cast("long")
    rows = table.filter(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    if labelled:
        rows = rows.filter("label is not null")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


@dataclass
class Rows:
    """Some rows as arrays; ``ids`` holds 0 where ``known`` is false."""

    m: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    slots: list = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by ``part`` -> a row for each part."""
    schema = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("rows", "ids", "labels")), ("slots", pa.list_(pa.list_(pa.int64())))])

    def flush(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = pa.Table.from_batches(held)
        v = got["v"].combine_chunks()
        lengths = np.diff(v.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        flat = v.flatten().to_numpy()
        most = max(int(flat.max(initial=0)), -int(flat.min(initial=0)) - 1)
        kind = next(k for k in _KINDS if most <= np.iinfo(k).max)
        m = np.zeros((len(lengths), width), kind)
        m[np.arange(width) < lengths[:, None]] = flat
        cells = [got[c].to_pylist() for c in ("row", "vec_id", "label", "slots")]
        return pa.RecordBatch.from_pylist([{"part": part, "width": width, "kind": kind, "data": m.tobytes(), "rows": cells[0], "ids": cells[1], "labels": cells[2], "slots": cells[3]}], schema)

    now, held = None, []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            if now is not None and parts[start] != now:
                yield flush(now, held)
                held = []
            now = int(parts[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield flush(now, held)


def packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` (row, vec_id, label, v, and ``slots`` if any) in parts of about ``size`` rows, a row each (PACKED), written; and how many parts there are."""
    parts = max(1, -(-rows.count() // size))
    if "slots" not in rows.columns:
        rows = rows.withColumn("slots", F.lit(None).cast("array<long>"))
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).select("part", "row", "vec_id", "label", "v", "slots")
    return written(keyed.repartition("part").sortWithinPartitions("part", "row").mapInArrow(_packed, PACKED), name), parts


def _unpacked(batch: pa.RecordBatch, i: int) -> Rows:
    at = lambda c: batch.column(c)[i]
    m = np.frombuffer(at("data").as_py(), at("kind").as_py()).reshape(len(at("rows")), at("width").as_py())
    ids, labels = at("ids").values, at("labels").values
    return Rows(m, at("rows").values.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), labels.fill_null(0).to_numpy(), at("slots").as_py())


def meet(blocks: DataFrame, n_blocks: int, shards: DataFrame, n_shards: int, state: Callable[[Rows], object], schema: str) -> DataFrame:
    """Runs ``state(block)`` against every group of shards: ``add(shard)`` for each shard, then ``result()``, a record batch of ``schema``.

    Every block meets every shard, in units of work of one size: the block is sent to each group and each group to each block.
    """
    groups = -(-n_shards // SHARDS)
    left = blocks.select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("shard"), *PACKED_COLUMNS)
    right = shards.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.floor(F.col("part") / SHARDS).cast("int").alias("group"), F.col("part").alias("shard"), *PACKED_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                unit = batch.column("block")[i].as_py(), batch.column("group")[i].as_py()
                own = _unpacked(batch, i)
                if batch.column("shard")[i].as_py() < 0:
                    if work is not None:
                        yield work.result()
                    now, work = unit, state(own)
                elif unit == now:
                    work.add(own)
        if work is not None:
            yield work.result()

    both = left.unionByName(right).repartition(min(TASKS, 2 * n_blocks * groups), "block", "group").sortWithinPartitions("block", "group", "shard")
    return both.mapInArrow(run, schema)


PACKED_COLUMNS = ("width", "kind", "data", "rows", "ids", "labels", "slots")


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integer matrices with one width (shorter rows go on with zeros), in the fastest type in which their inner products, and all partial sums, are exact."""
    width = max(a.shape[1], b.shape[1], 1)
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    most = width * top(a) * top(b)
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors don't fit in 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return tuple(np.pad(m.astype(kind), ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def firsts(owner: np.ndarray, score: np.ndarray, known: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k entries of each owner, by falling score, then id (unknown last), in that order."""
    order = np.lexsort((rows, ids, ~known, -score, owner))
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.diff(sorted_owner, prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[place < k]
