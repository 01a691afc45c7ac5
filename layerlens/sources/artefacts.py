"""Artefact tables of a run, by window: written as CSV or Parquet, found again by window or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.signature import normalise_labels


class MissingArtefact(FileNotFoundError):
    """The table was not written, or lies elsewhere."""


def _path(root: str, window: str, name: str) -> str:
    return f"{root.rstrip('/')}/{window}/{name}"


def write_table(df: DataFrame, root: str, window: str, name: str, fmt: str = "parquet", gzip: bool = False, partition_by: list[str] | None = None, append: bool = False) -> str:
    """Write a table; ``partition_by`` gives one folder a key."""
    path = _path(root, window, name)
    out = df.write.mode("append" if append else "overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out = out.option("header", True)
        if gzip:
            out = out.option("compression", "gzip")
    out.format(fmt).save(path)
    return path


def load_table(spark: SparkSession, root: str, window: str, name: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a table back; label columns come in the current vocabulary."""
    path = _path(root, window, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise MissingArtefact(f"{path} is missing: run the distillation for window {window} first")
    reader = spark.read.schema(schema) if schema else spark.read
    return normalise_labels(reader.option("header", True).format(fmt).load(path))


def write_summary(df: DataFrame, root: str, window: str) -> str:
    """One JSON object of a one-row table."""
    path = _path(root, window, "summary")
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
