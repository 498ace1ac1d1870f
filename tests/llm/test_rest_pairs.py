"""The prefix join of near duplicates meets only items that can tell a pair of two components, and gives back links that the estimate has discarded."""

from fractions import Fraction

import numpy as np

from evidentia.llm import near_dedup


def test_rest_pairs_join_items_of_two_components_only(spark, monkeypatch):
    base = set(range(100))
    edited = lambda gone, new: base - set(gone) | set(new)
    held = {
        0: base,
        1: edited(range(90, 95), range(1000, 1005)),
        2: edited(range(40, 70), range(3000, 3030)),  # far, of the pivot's component, as 3
        3: edited(range(40, 70), [*range(3000, 3020), *range(4000, 4010)]),
        4: edited(range(12), range(2000, 2012)),  # far, of no component: its partner is 5
        5: edited(range(10), range(2000, 2010)),
        6: edited(range(80, 83), range(5000, 5003)),  # near, but not linked yet
    }
    tables = {}
    kept = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name="table": tables.setdefault(name, kept(df, name)))
    around = spark.createDataFrame([(0, x) for x in range(1, 7)], "p long, x long")
    sets = spark.createDataFrame([(n, bytearray(np.array(sorted(v), np.uint64).tobytes())) for n, v in held.items()], "node long, shingles binary")
    roots = spark.createDataFrame([(n, 0) for n in (0, 1, 2, 3, 5)], "node long, root long")
    pairs, missed = near_dedup._rest_pairs(around, sets, roots, Fraction(4, 5))
    assert {tuple(r) for r in pairs.collect()} == {(4, 5)}
    assert {tuple(r) for r in missed.collect()} == {(0, 6)}
    assert {r.item for r in tables["often"].collect()} == {*range(10), *range(2000, 2010)}
