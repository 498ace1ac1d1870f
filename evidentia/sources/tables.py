"""Readers, writers and the corpus tables: documents, sentences, page views, vectors, caches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.functions import columns as C
from evidentia.operators.numbering import numbered
from evidentia.plans.scratch import written
from evidentia.sources import schemas


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims from JSON lines; gold evidence becomes groups of (doc_id, line_num), cleaned."""
    raw = spark.read.schema(schemas.CLAIMS).json(path)
    return raw.withColumn("evidence", C.normalize_evidence(C.evidence_from_tuples("evidence")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages from a folder of JSON-lines shards."""
    return spark.read.schema(schemas.PAGES).json(path)


def build_documents(pages: DataFrame) -> DataFrame:
    """(id, text, lines): normalised id and text, numbered lines parsed."""
    return pages.select(C.nfd("id").alias("id"), C.nfd("text").alias("text"), C.split_numbered_lines(C.nfd("lines")).alias("lines"))


def build_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, line_num, text, h_links): a row a non-empty line of documents with more than one character of text."""
    rows = documents.filter(F.length("text") > 1).select(F.col("id").alias("doc_id"), F.inline("lines"))
    return rows.filter(F.length("text") > 0)


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_num, text) from running text: a row a line, blank lines left out, numbers kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_num", "text"))
    return rows.filter(F.trim("text") != "")


def save_sentences(sentences: DataFrame, table: str, buckets: int = 512, path: str | None = None) -> None:
    """A table bucketed by doc_id, a file a bucket, so that look-ups by document join without a shuffle of the corpus. ``path``: where its files go, else the warehouse."""
    dealt = sentences.repartition(buckets, "doc_id")
    writer = dealt.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "line_num").mode("errorifexists")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def lookup_evidence(evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows with (doc_id, line_num) get text and h_links, null where the sentence is absent.

    The join's key is doc_id alone, the line a further condition: so sentences bucketed by doc_id (save_sentences) are read as they lie.
    """
    named = sentences.withColumnsRenamed({"doc_id": "_doc", "line_num": "_line"})
    on = (F.col("doc_id") == F.col("_doc")) & (F.col("line_num") - F.col("_line") == 0)
    return evidence.join(named, on, "left").drop("_doc", "_line")


def lookup_doc_sentences(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows with doc_id -> a row for each of its sentences."""
    return docs.join(sentences, "doc_id")


def list_doc_ids(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of documents with more than a character of text and with lines."""
    ids = documents.filter((F.length("text") > 1) & (F.size("lines") > 0)).select("id")
    return ids if limit is None else ids.orderBy("id").limit(limit)


def count_sentences(documents: DataFrame) -> DataFrame:
    return build_sentences(documents).agg(F.count("*").alias("n_sentences"))


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def parse_pageviews(lines: DataFrame, prefix: str = "en") -> DataFrame:
    """(doc, views) summed over dump lines ``project title count bytes`` whose project starts with the prefix; others are left out."""
    cells = F.split("value", " ")
    rows = lines.filter(F.col("value").startswith(prefix)).select(cells.alias("c")).filter(F.size("c") == 4)
    return rows.select(F.get("c", F.lit(1)).alias("doc"), F.get("c", F.lit(2)).cast("long").alias("views")).groupBy("doc").agg(F.sum("views").alias("views"))


def count_pageviews(spark: SparkSession, path: str, prefix: str = "en") -> DataFrame:
    """As parse_pageviews over a folder of gzip dumps."""
    return parse_pageviews(spark.read.option("recursiveFileLookup", "true").text(path), prefix)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as a name that ``open`` takes, None if it lies in a store that only Spark reaches."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    local = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    return os.path.abspath(path) if local and ":" not in path.split("/")[0] else None


def _part_files(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes lines that come part by part, a file each, and returns how many it wrote. A file gets its name once it is whole, so a repeated task puts the same file in its place."""

    def write(batches):
        part, out, n = None, None, 0

        def finish() -> None:
            out.close()
            os.replace(out.name, f"{folder}/part={part}/rows.json")

        for batch in batches:
            numbers, lines = batch.column("part").to_numpy(), batch.column("line").to_pylist()
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(numbers)) + 1), len(lines)] if lines else []):
                if numbers[i] != part:
                    if out is not None:
                        finish()
                    part, n = numbers[i], n + 1
                    os.makedirs(f"{folder}/part={part}", exist_ok=True)
                    out = open(f"{folder}/part={part}/.{uuid.uuid4().hex}", "wb")
                out.write(b"\n".join(lines[i:j]) + b"\n")
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return write


def split_by_rows(df: DataFrame, key: str, rows: int, path: str, ranges: int | None = None) -> None:
    """JSON parts of exactly ``rows`` rows (the last one: the rest) in the order of ``key``, one file each: part 12 lies in the folder ``part=12``.

    A row's part follows from its exact number (operators.numbering), so it doesn't depend on how many tasks sorted the rows. Parts are
    dealt to a fixed number of tasks, as a file costs more than its few rows and sizes in bytes would join them to few tasks. In a mounted
    folder tasks write the files themselves: there Spark's writer starts three processes a file to set permissions, which takes most of its time.
    """
    spark = df.sparkSession
    parts = numbered(df, [key], "_number", ranges).withColumn("part", F.floor(F.col("_number") / rows))
    dealt = parts.repartition(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "_number")
    folder = _mounted(spark, path)
    if folder is None:
        dealt.drop("_number").write.partitionBy("part").option("maxRecordsPerFile", 0).mode("errorifexists").json(path)
        return
    os.makedirs(folder)
    lines = dealt.select("part", F.to_json(F.struct(*df.columns)).cast("binary").alias("line"))
    lines.mapInArrow(_part_files(folder), "n long").agg(F.sum("n")).collect()


def read_splits(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The parts' rows with ``part`` and ``file``, the file that each was read from."""
    rows = spark.read.schema(f"{schema}, part long").json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def merge_splits(spark: SparkSession, schema: str, path: str, key: str) -> DataFrame:
    """All parts' rows in the order of their part's number, then of ``key``."""
    return spark.read.schema(f"{schema}, part long").json(path).orderBy("part", key).drop("part")


def read_keyword_dict(spark: SparkSession, path: str, filtering: bool = True) -> DataFrame:
    """(doc_id, keyword): the tokenised title as the keyword; with filtering, ids without Latin letters are dropped."""
    rows = spark.read.schema(schemas.KEYWORDS).json(path)
    rows = rows.filter(~C.filter_doc_id("docid")) if filtering else rows
    return rows.select(F.col("docid").alias("doc_id"), C.natural_title("docid").alias("keyword"))


def parse_vectors(lines: DataFrame, width: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, vec) from lines ``word v1 ... vd``; rows of another width are dropped, and words outside the vocabulary (column ``token``)."""
    cells = F.split(F.rtrim("value"), " ")
    rows = lines.select(cells.alias("c")).filter(F.size("c") == width + 1)
    rows = rows.select(F.get("c", F.lit(0)).alias("word"), F.slice("c", 2, width).cast("array<float>").alias("vec"))
    return rows if vocabulary is None else rows.join(vocabulary, rows["word"] == vocabulary["token"], "left_semi")


def read_vectors(spark: SparkSession, path: str, width: int, vocabulary: DataFrame | None = None) -> DataFrame:
    return parse_vectors(spark.read.text(path), width, vocabulary)


def concat_datasets(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cache_update(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """The rows of ``fresh`` whose key the cache lacks: those to append."""
    return fresh.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def cache_load(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A cache written by cache_append."""
    return spark.read.schema(schema).parquet(path)


def cache_append(spark: SparkSession, path: str, fresh: DataFrame, key: str = "key") -> None:
    """Appends the rows of ``fresh`` whose key the cache lacks; they are written aside first, so that the cache isn't read while it grows."""
    new = written(cache_update(cache_load(spark, path, fresh.schema), fresh, key), "cache")
    new.write.mode("append").parquet(path)


def submission(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("id", "predicted_label", "predicted_evidence")


def odd_link_rows(sentences: DataFrame) -> DataFrame:
    """Audit: sentences whose flat link list (anchor, target, ...) has odd length."""
    return sentences.filter(F.size("h_links") % 2 == 1)


def links(sentences: DataFrame) -> DataFrame:
    """(doc_id, line_num, anchor, target) from flat link lists."""
    place = F.sequence(F.lit(0), F.floor(F.size("h_links") / 2).cast("int") - 1)
    rows = sentences.filter(F.size("h_links") > 1).select("doc_id", "line_num", "h_links", F.explode(place).alias("i"))
    return rows.select("doc_id", "line_num", F.get("h_links", 2 * F.col("i")).alias("anchor"), F.get("h_links", 2 * F.col("i") + 1).alias("target"))


def dangling_links(link_rows: DataFrame, doc_ids: DataFrame, encode: bool = True) -> DataFrame:
    """Audit: link targets with no page, regardless of case."""
    target: Column = C.brc_encode("target", spaces=True) if encode else F.col("target")
    rows = link_rows.withColumn("key", F.lower(target))
    known = doc_ids.select(F.lower("id").alias("key")).distinct()
    return rows.join(known, "key", "left_anti").drop("key")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
