"""Lineage is cut by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and all tasks run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what follows neither computes it again nor loses it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/layerlens-graph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop(*tables: DataFrame | str | None) -> None:
    """Delete tables that ``cut`` wrote (or their paths), once nothing reads them any more; others are left alone."""
    spark = SparkSession.active()
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_cut_path", None)
        if path:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
