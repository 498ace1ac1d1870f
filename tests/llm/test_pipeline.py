"""The pipeline's stages against what each one's input asks for."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import DATA, brute_components, brute_lines, check_mix

from evidentia.llm import mixing


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, DATA).write.parquet(path)
        done = spark.read.parquet(path)
        out[name] = (docs, done)
        docs = done
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_columns(results):
    for name, (docs, done) in results.items():
        if name != "bpe":
            assert done.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_clean_documents(results):
    docs, done = results["language_id"]
    assert docs.join(done, "doc_id", "left_anti").filter(F.col("text").rlike("[A-Za-z]{3}")).count() == 0


def test_line_stage(results):
    docs, done = results["line_dedup"]
    before = rows(docs)
    want = {before[i][0]: t for i, t in brute_lines(before, 50).items() if t.strip() or t == before[i][1]}
    assert {r[0]: r[1] for r in rows(done)} == want
    assert done.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_near_stage(results):
    docs, done = results["near_dedup"]
    want = {i for i, (_, c) in brute_components(rows(docs), 5).items() if i == c}
    assert {r[0] for r in rows(done)} == want


def test_mixing_stage(results):
    docs, done = results["mixing"]
    plan = mixing.mix(docs).collect()
    check_mix(rows(docs), [(r, r.source) for r in plan])
    assert Counter(r[0] for r in rows(done)) == Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_encoding_stage_and_run(spark, results):
    docs, done = results["bpe"]
    assert done.count() == docs.count()
    want = Counter((r.doc_id, r.ids_sha256) for r in done.collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()) == want
