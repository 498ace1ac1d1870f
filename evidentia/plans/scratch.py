"""Written intermediate tables: they cut lineage, survive lost executors and are read, not recomputed."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-evidentia-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; in a local session without it a new temporary one, elsewhere its absence is an error."""
    named = spark.conf.get(SETTING, None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
    return named or _own_dir()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, read back with its own schema.

    Every later use scans the table: no recomputation, and values such as
    ``monotonically_increasing_id`` are fixed once written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
