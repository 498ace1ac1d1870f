"""Parts of a table in a mounted folder: tasks write them, a file each, and a repeated task replaces its own files."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.sources import tables as S


def _rows(folder):
    return {p: [json.loads(x) for x in open(f"{folder}/{p}/rows.json", encoding="utf-8")] for p in sorted(os.listdir(folder))}


def test_a_part_is_one_file_and_nothing_beside_it(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit('é"\n'), "id")).alias("t"))
    for name, path in (("plain", f"{tmp_path}/plain"), ("uri", f"file://{tmp_path}/uri")):
        S.split_by_rows(df, "id", 10, path, 3)
        assert [os.listdir(f"{tmp_path}/{name}/part={i}") for i in range(3)] == [["rows.json"]] * 3
        got = _rows(tmp_path / name)
        assert [[r["id"] for r in got[f"part={i}"]] for i in range(3)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
        assert S.merge_splits(spark, "id long, t string", path, "id").collect() == df.orderBy("id").collect()
        with pytest.raises(FileExistsError):
            S.split_by_rows(df, "id", 10, path, 3)


def test_parts_go_over_batches_and_repeated_tasks(tmp_path):
    batch = lambda *rows: pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int64()), "line": [x for _, x in rows]})
    batches = [batch((1, b"1"), (1, b"2")), pa.RecordBatch.from_pydict({"part": pa.array([], pa.int64()), "line": pa.array([], pa.binary())}), batch((1, b"3"), (4, b"4"))]
    for _ in range(2):
        assert [b.to_pydict() for b in S._part_files(str(tmp_path))(iter(batches))] == [{"n": [2]}]
        assert _rows(tmp_path) == {"part=1": [1, 2, 3], "part=4": [4]} and len(os.listdir(tmp_path / "part=1")) == 1
    assert [b.to_pydict() for b in S._part_files(str(tmp_path))(iter([]))] == [{"n": [0]}]


def test_other_stores_are_left_to_spark(spark):
    assert S._mounted(spark, "viewfs://store/x") is None and S._mounted(spark, "hdfs:/x") is None
    assert S._mounted(spark, "file:///a/b") == S._mounted(spark, "file:/a/b") == S._mounted(spark, "/a/b") == "/a/b"
