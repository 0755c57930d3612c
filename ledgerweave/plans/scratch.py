"""Folders that the driver and all executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, kind: str = "graph") -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may have none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """rows as a Parquet table of their own, read again: a lost executor costs no earlier step. by: columns that become folders."""
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """A folder that no later step reads goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
