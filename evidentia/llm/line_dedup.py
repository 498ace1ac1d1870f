"""Line dedup by winnowing over line hashes.

The unit is a run of consecutive lines that holds ``min_words`` words or more. Windows over the line hashes are measured
in words: from each line the shortest run forward, and to each line the shortest run backward, that reaches
``min_words``. Each window selects its least line hash (the last of equal ones); a line that is selected, by however many
windows, is one fingerprint. Equal windows select the same line, so every repeated run of that length shares a
fingerprint: no repeat is missed. Fingerprints that occur once in the corpus end there. Positions of the others are
joined by fingerprint, and each is extended both ways: of the windows that selected it, those whose lines agree with
an earlier occurrence's are repeated. The union of a document's repeated windows is exactly its repeated runs, because a
line lies in a repeated run if and only if it lies in a repeated forward or backward window. Later runs are deleted; the
first stays. No pairs of occurrences are made: each one meets the first occurrence only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from evidentia.llm.arrow import as_bytes, pieces, ragged, row_hash
from evidentia.plans.scratch import written

MIN_WORDS = 50


def windows(counts: np.ndarray, min_words: int) -> np.ndarray:
    """(start, end) of the shortest runs of lines, forward from each line and backward from each, that hold min_words words."""
    total = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    forward = np.stack([np.arange(n), ends], 1)[ends <= n]
    backward = np.stack([starts, np.arange(1, n + 1)], 1)[total[1:] >= min_words]
    return np.unique(np.concatenate([forward, backward]), axis=0)


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip())


def _fingerprints(min_words: int):
    """A row for each selected line: its hash, and the windows that selected it with the hash of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            row, mark, sizes, start, end, content = [], [], [], [], [], []
            for i, text in enumerate(as_bytes(part.column("text"))):
                lines = text.split(b"\n") if text else []
                spans = windows(np.array([len(x.split()) for x in lines], np.int64), min_words) if lines else ()
                if not len(spans):
                    continue
                hashes = np.fromiter(map(line_hash, lines), np.uint64, len(lines))
                selected: dict[int, list[tuple[int, int]]] = {}
                for s, e in spans.tolist():
                    selected.setdefault(e - 1 - int(hashes[s:e][::-1].argmin()), []).append((s, e))
                for at, around in selected.items():
                    row.append(i)
                    mark.append(hashes[at])
                    sizes.append(len(around))
                    for s, e in around:
                        start.append(s)
                        end.append(e)
                        content.append(xxhash.xxh3_64_intdigest(hashes[s:e].tobytes()))
            at = pa.array(row, pa.int64())
            lists = [ragged(np.array(start, np.int32), sizes), ragged(np.array(end, np.int32), sizes), ragged(np.array(content, np.uint64).view(np.int64), sizes)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("row").take(at), pa.array(np.array(mark, np.uint64).view(np.int64)), *lists], ["doc_id", "row", "mark", "starts", "ends", "contents"])

    return run


def _without(names: list[str]):
    """The columns ``names``, as c0, c1 and so on, without the lines of ``spans`` in the text; then removed_lines."""
    at = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            texts, removed = [], []
            for text, spans in zip(as_bytes(part.column(at)), part.column("spans").to_pylist(), strict=True):
                if not spans:
                    texts.append(text)
                    removed.append(0)
                    continue
                lines = text.split(b"\n")
                keep = np.ones(len(lines), bool)
                for s in spans:
                    keep[s["start"] : s["end"]] = False
                texts.append(b"\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                removed.append(int((~keep).sum()))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else part.column(f"c{i}") for i, c in enumerate(names)] + [pa.array(removed, pa.int32())], [*names, "removed_lines"])

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with later repeats of runs of lines taken out of ``text``, and ``removed_lines`` added (replacing a column of that name).

    Runs of consecutive lines with ``min_words`` words or more that occur earlier, in the same or another document, are
    deleted; the order is doc_id (null last), then a hash of the text, then the line. Lines are compared without white
    space at their ends; the first occurrence, shorter repeats and everything else stay unchanged. A text deleted whole
    becomes the empty text; null stays null. Rows that repeat both doc_id and text count as one document and get the same
    result. Texts of any length are read whole. An empty table gives an empty result. Other columns are kept, whatever
    their names.
    """
    docs = docs.drop("removed_lines")
    text = docs.columns.index("text")
    # the user's columns go by number, so their names clash with nothing
    keyed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = keyed.withColumns({"doc_id": F.col(f"c{docs.columns.index('doc_id')}").cast("long"), "row": row_hash(f"c{text}")})
    rows = keyed.select("doc_id", "row", F.col(f"c{text}").alias("text"))
    marks = written(rows.mapInArrow(_fingerprints(min_words), "doc_id long, row long, mark long, starts array<int>, ends array<int>, contents array<long>"), "fingerprints")
    often = written(marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "often")
    around = marks.join(often.hint("merge"), "mark").select("doc_id", "row", "mark", F.explode(F.arrays_zip("starts", "ends", "contents")).alias("w"))
    around = around.select("mark", "w.contents", "doc_id", "row", F.col("w.starts").alias("start"), F.col("w.ends").alias("end"))
    around = written(around.withColumnRenamed("contents", "content"), "windows")
    around = around.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start"))
    first = around.groupBy("mark", "content").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "first")
    later = around.join(first, ["mark", "content"]).filter("place > first").select("doc_id", "row", F.struct("start", "end").alias("span"))
    spans = later.groupBy(F.col("doc_id").alias("at_id"), F.col("row").alias("at_row")).agg(F.collect_set("span").alias("spans"))
    spans = written(spans, "spans")
    # the number of documents with repeats grows with the corpus: the same sort-merge join at every size
    joined = keyed.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row") == F.col("at_row")), "left").drop("doc_id", "row", "at_id", "at_row")
    return joined.mapInArrow(_without(docs.columns), StructType([*docs.schema.fields, StructField("removed_lines", IntegerType())]))
