"""Exact numbers, closures by doubling, and the second hop as a stateful stream, against plain versions."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.operators import docs as D
from evidentia.operators import lexical as L
from evidentia.operators import vocab as V
from evidentia.operators.numbering import numbered, ranked_within
from evidentia.streaming import streams


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_numbers_have_no_gaps_whatever_the_ranges(spark, ranges):
    rng = random.Random(ranges)
    values = [7 if rng.random() < 0.4 else rng.randrange(50) for _ in range(1000)] + [None] * 20
    df = spark.createDataFrame([(v, "x") for v in values], "v int, _place string").repartition(5)
    got = numbered(df, ["v"], ranges=ranges)
    assert got.columns == ["v", "_place", "number"]
    rows = sorted(got.collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(1020))
    assert [r.v for r in rows] == sorted(values, key=lambda v: -1 if v is None else v)
    assert numbered(df.filter("v > 100"), ["v"]).count() == 0


def test_a_crowded_value_spreads_over_ranges(spark):
    df = spark.range(900).select(F.lit(3).alias("v"))
    per_task = numbered(df, ["v"], ranges=6).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(per_task) >= 3 and max(r["count"] for r in per_task) < 450


def test_ranks_within_keys(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else "ab"[rng.random() < 0.8], rng.randrange(30), i) for i in range(400)]
    got = ranked_within(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), "i"], ranges=5)
    want = {}
    for k in (None, "a", "b"):
        want |= {i: n for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1)}
    assert {r.i: r["rank"] for r in got.collect()} == want


def test_vocabulary_ranks_equal_a_plain_sort(spark):
    rng = random.Random(2)
    counts = [(ns, f"t{i}", 1 if rng.random() < 0.6 else rng.randrange(1, 9)) for ns, size in (("big", 500), ("small", 7)) for i in range(size)]
    got = V.build_vocab(spark.createDataFrame(counts, "namespace string, token string, n long").repartition(6), max_size=300, oov=3)
    want = {}
    for ns in ("big", "small"):
        order = sorted((c for c in counts if c[0] == ns), key=lambda c: (-c[2], c[1]))[:300]
        want |= {(ns, t): 4 + i for i, (_, t, _) in enumerate(order)}
    assert {(r.namespace, r.token): r.idx for r in got.collect()} == want


def least_depths(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for start in list(after):
        seen, wave, depth = {start}, {start}, 0
        while wave:
            wave, depth = {y for x in wave for y in after[x]} - seen, depth + 1
            seen |= wave
            out |= {(start, y): depth for y in wave}
    return out


def test_closure_of_a_long_chain_and_of_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(120)]
    rng = random.Random(3)
    tangle = [(f"c{rng.randrange(25)}", f"c{rng.randrange(25)}") for _ in range(60)] + [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    edges = chain + tangle + [("x", "x"), (None, "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = least_depths([e for e in edges if None not in e])
    assert {(r.src, r.dst): r.depth for r in L.closure(df).collect()} == want
    assert max(want.values()) == 120
    for most in (1, 2, 5):
        assert {(r.src, r.dst): r.depth for r in L.closure(df, most).collect()} == {k: v for k, v in want.items() if v <= most}


# --- the second hop over a stream

SELECTED = "claim_id long, doc_id string, line_num int, score double"


@pytest.fixture(scope="module")
def hop(spark):
    graph = spark.createDataFrame([(f"d{i}", line, f"T {(i * 3 + line) % 11}") for i in range(8) for line in range(2) if (i, line) != (7, 1)], "doc_id string, line_num int, target string")
    views = spark.createDataFrame([(f"T_{i}", i * 5 % 7) for i in range(9)], "doc string, views long")
    links = spark.createDataFrame([(c, f"T_{c}") for c in range(5)], "claim_id long, doc_id string")
    rng = random.Random(6)
    rows = [(rng.randrange(5), f"d{rng.randrange(8)}", rng.randrange(2), float(rng.randrange(6))) for _ in range(40)]
    rows = [(c, doc, line, {(a, b, e): x for a, b, e, x in rows}[c, doc, line]) for c, doc, line, _ in rows]  # a sentence has one score
    return rows + [(1, None, 0, 9.0), (None, "d1", 0, 9.0)], graph, views, links


def at_once(spark, hop):
    rows, graph, views, links = hop
    selected = spark.createDataFrame([r for r in rows if None not in r], SELECTED).distinct()
    aside = D.pageview_rank(D.sentence_links_as_candidates(D.best_sentence_links(D.expand_from_sentences(selected, graph))), views)
    return sorted(map(tuple, D.topk_docs(D.new_docs_only(aside, links)).collect()))


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_second_hop_does_not_depend_on_batches(spark, hop, tmp_path, cuts):
    rows, graph, views, links = hop
    for i in range(cuts):
        spark.createDataFrame(rows[i::cuts], SELECTED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), SELECTED, "*.parquet", 1)
    out = str(tmp_path / "out")
    streams.stream_second_hop(stream, graph, links, views, out, str(tmp_path / "at")).awaitTermination()
    got = streams.second_hop_result(spark, out)
    assert sorted(map(tuple, got.select("claim_id", "doc_id", "priority", "rank").collect())) == at_once(spark, hop)
    if cuts == 3:  # a restart goes on where the first run stopped; state is still there
        spark.createDataFrame([(0, "d0", 0, -50.0), (2, "d3", 1, 100.0)], SELECTED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_second_hop(stream, graph, links, views, out, str(tmp_path / "at")).awaitTermination()
        more = (rows + [(0, "d0", 0, -50.0), (2, "d3", 1, 100.0)], *hop[1:])
        assert sorted(map(tuple, streams.second_hop_result(spark, out).select("claim_id", "doc_id", "priority", "rank").collect())) == at_once(spark, more)


def test_states_end_behind_the_watermark(spark, tmp_path):
    kind = "claim_id long, doc_id string, line_num int, score double, at timestamp"

    def put(*rows):
        spark.createDataFrame([(*r[:4], r[4]) for r in rows], kind.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put((1, "a", 0, 5.0, "2024-01-01 00:00:00"))
    put((1, "b", 0, 3.0, "2024-01-01 01:00:00"))
    put((2, "x", 0, 1.0, "2024-01-09 00:00:00"))
    put((1, "c", 0, 2.0, "2024-01-09 01:00:00"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), kind, "*.parquet", 1)
    seen = []
    best = streams.best_so_far(stream, "at", "2 days")
    best.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert [r for r in seen if r[0] == 1] == [(1, "a", 0, 5.0), (1, "c", 0, 2.0)]  # b is no better; c comes after the state's end
    assert list(itertools.chain(*[r[:2] for r in seen if r[0] == 2])) == [2, "x"]


def test_numeric_documents_stay_whole_in_the_state(spark, tmp_path):
    kind, big = "claim_id long, doc_id long, line_num int, score double", (1 << 53) + 1
    for row in [(1, big, 2, 5.0), (1, big + 2, 1, 5.0), (1, big - 2, 1, 4.0), (1, big - 1, 3, 5.0)]:  # a tie, a lower score, a tie that wins
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    best = streams.best_so_far(streams.read_stream(spark, str(tmp_path / "in"), kind, "*.parquet", 1))
    seen = []
    best.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(1, big, 2, 5.0), (1, big - 1, 3, 5.0)]
