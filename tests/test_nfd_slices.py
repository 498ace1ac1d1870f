import unicodedata

from evidentia.functions import columns as C


def test_nfd_goes_by_slices(spark, monkeypatch):
    texts = ["é" * i + "x" for i in range(7)] + [None, "", "plain", "Å", "한"]
    monkeypatch.setattr(C, "NFD_ROWS", 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["n"] for r in df.select("i", C.nfd("t").alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else unicodedata.normalize("NFD", t) for t in texts]
    assert df.filter("false").select(C.nfd("t")).collect() == []
