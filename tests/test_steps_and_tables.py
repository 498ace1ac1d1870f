"""Step manifests, bucketed look-ups, the threshold sweep and the ensemble walk, against plain versions."""

from __future__ import annotations

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.functions.columns import LABELS
from evidentia.operators import ensemble
from evidentia.operators import select as E
from evidentia.operators.metrics import verification_score
from evidentia.plans import pipeline as U
from evidentia.sources import tables as S


def test_steps_run_again_when_inputs_or_parameters_change(spark, tmp_path):
    folder = str(tmp_path)
    table = lambda n: spark.range(n).repartition(3)

    def run(n, limit):
        steps = U.Steps(spark, folder)
        first = steps("first", lambda: table(n).filter("id % 2 = 0"), [table(n)])
        second = steps("second", lambda: first.filter(F.col("id") < limit), ["first"], {"limit": limit})
        return steps.ran, second.count()

    assert run(10, 6) == (["first", "second"], 3)
    assert run(10, 6) == ([], 3)
    assert run(10, 4) == (["second"], 2)
    assert run(20, 4) == (["first", "second"], 2)
    with pytest.raises(ZeroDivisionError):
        U.Steps(spark, folder)("first", lambda: 1 // 0, [table(30)])
    assert run(20, 4)[0] == ["first"]  # the broken run took away the old manifest; the second step's inputs are what they were
    assert U.content_digest(table(9)) == U.content_digest(spark.range(9)) != U.content_digest(table(8))


@pytest.mark.parametrize("kind", ["evidence", "sentences"])
def test_bucketed_sentences_are_not_shuffled(spark, tmp_path, kind):
    name = f"sentences_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(d, n, f"{d}/{n}", [f"l{d}"]) for d in range(40) for n in range(3)], "doc_id long, line_num int, text string, h_links array<string>")
    S.save_sentences(rows, name, 8, str(tmp_path / "s"))
    asked = spark.createDataFrame([(d, n) for d in (1, 1, 39, 77, None) for n in (0, 2, 9)], "doc_id long, line_num int").hint("merge")
    saved = spark.table(name)
    got = S.lookup_evidence(asked, saved) if kind == "evidence" else S.lookup_doc_sentences(asked.select("doc_id").distinct().hint("merge"), saved)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    side = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    scan = [line for line in side.splitlines() if "Exchange hashpartitioning" in line or "FileScan" in line]
    assert "SortMergeJoin" in side and "Bucketed: true" in side
    assert sum("FileScan" in line for line in scan) == 1 and scan.index(next(x for x in scan if "FileScan" in x)) == len(scan) - 1
    want = [(d, n, f"{d}/{n}" if d is not None and d < 40 and n < 3 else None) for d in (1, 1, 39, 77, None) for n in (0, 2, 9)] if kind == "evidence" else [(d, n, f"{d}/{n}") for d in (1, 39) for n in range(3)]
    assert sorted(((r.doc_id, r.line_num, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    spark.sql(f"drop table {name}")


KIND = "claim_id long, doc_id string, line_num int, score double, prob double"


def test_threshold_sweep_equals_a_selection_for_each(spark):
    rng = random.Random(3)
    rows = [(c, f"d{rng.randrange(4)}", n, float(rng.randrange(4)) if rng.random() < 0.9 else None, rng.choice([0.1, 0.3, 0.5, 0.7, None])) for c in range(30) for n in range(rng.randrange(20))]
    pairs = spark.createDataFrame(rows, KIND)
    claims = spark.createDataFrame([(c, LABELS[c % 3], [[(f"d{c % 4}", 1)], [("d1", 2), ("d2", 3)]]) for c in range(33)], "claim_id long, label string, evidence array<array<struct<doc_id:string,line_num:int>>>")
    thresholds = [0.5, 0.0, 0.3, 0.9]
    got = {r.threshold: tuple(r)[1:] for r in E.threshold_sweep(pairs, claims, thresholds, 3).collect()}
    for t in thresholds:
        one = E.select_by_threshold(pairs, claims, t, 3).withColumn("predicted_label", F.col("label"))
        assert got[t] == pytest.approx(tuple(verification_score(one).first()))
    assert E.threshold_sweep(pairs, claims.filter("claim_id < 0"), thresholds).count() == 0


def test_ensemble_walk_equals_the_means(spark):
    rng = random.Random(4)
    n_runs, largest = 6, 4
    logits = {(c, k): [float(rng.randrange(4)) for _ in range(3)] for c in range(25) for k in range(n_runs) if rng.random() < 0.9}
    labels = {c: rng.choice(LABELS) for c in range(25)}
    claims = spark.createDataFrame([(c, labels[c], [[("d", 1)]], [("d", c % 2)]) for c in range(25)], "claim_id long, label string, evidence array<array<struct<doc_id:string,line_num:int>>>, predicted_evidence array<struct<doc_id:string,line_num:int>>")
    runs = spark.createDataFrame([(c, k, v) for (c, k), v in logits.items()], "claim_id long, run int, logits array<double>").repartition(4)
    got = {r.subset: r for r in ensemble.search_ensembles(runs, claims, n_runs, largest).collect()}
    subsets = [s for size in range(1, largest + 1) for s in itertools.combinations(range(n_runs), size)]
    assert set(got) == {",".join(map(str, s)) for s in subsets}
    for s in subsets[:: 3]:
        ok, strict, hits = [], [], []
        for c in range(25):
            own = [logits[c, k] for k in s if (c, k) in logits]
            if own:
                mean = [sum(x) / len(own) for x in zip(*own, strict=True)]
                ok.append(LABELS[mean.index(max(mean))] == labels[c])
                strict.append(ok[-1] and (labels[c] == LABELS[2] or c % 2 == 1))
                if labels[c] != LABELS[2]:
                    hits.append(c % 2)
        r = got[",".join(map(str, s))]
        assert (r.accuracy, r.strict, r.recall) == pytest.approx((sum(ok) / len(ok), sum(strict) / len(strict), sum(hits) / len(hits)))
