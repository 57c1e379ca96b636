"""Cutting the lineage of iterative jobs by written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def _root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors share no folder")
        root = tempfile.mkdtemp(prefix="vouchline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again; removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{_root(spark)}/vouchline-core/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            return
