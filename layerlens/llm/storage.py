"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder under ``spark.checkpoint.dir``; a local folder only where that is unset and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/layerlens-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables that the innermost ``discarding`` block wrote: session, path, whether to keep.
_WRITTEN: ContextVar[list[tuple[SparkSession, str, bool]] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the result has no lineage to redo.  ``keep`` outlives a ``discarding`` block."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append((spark, path, keep))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def discarding() -> Iterator[None]:
    """Delete what ``materialise`` wrote inside once the block ends well, but for kept tables, which a block around it then holds.

    What is read after the block has to be written inside with ``keep``."""
    outer, own = _WRITTEN.get(), []
    token = _WRITTEN.set(own)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
    for spark, path, keep in own:
        if not keep:
            _delete(spark, path)
        elif outer is not None:
            outer.append((spark, path, False))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lowest_hashes(rows: DataFrame, h: str, n: int) -> DataFrame:
    """About the ``n`` rows with the lowest of the 64-bit hashes in column ``h``, never more; a cut by the range of the hash keeps all others from sort and driver."""
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.col(h) < F.lit(int(2.0**64 * (2 * n / total) - 2.0**63)))
    return rows.orderBy(h).limit(n)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables."""
    _delete(spark, shared_dir(spark))


def text_buckets(docs: DataFrame, text: str, each: int = 32 << 20) -> int:
    """Number of buckets that hold about ``each`` bytes of text, one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def join_values(rows: DataFrame, values: DataFrame, keys: list[str], spread: str, most: float) -> DataFrame:
    """``rows`` with the ``value`` of their keys, if any.

    Keys with ``n`` over ``most`` in ``values`` are broadcast and their rows dealt
    by ``spread``, so that no key's rows meet; as n adds up to at most the rows,
    such keys are few where ``most`` is a fixed share of them.
    """
    large = F.broadcast(values.where(F.col("n") > most).select(*keys, F.struct("value").alias("_large")))
    other = values.where(F.col("n") <= most).select(*keys, F.lit(0).cast("long").alias("_salt"), F.col("value").alias("_other"))
    salt = F.when(F.col("_large").isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(spread), 1) + 1)
    found = rows.join(large, keys, "left").withColumn("_salt", salt).join(other, [*keys, "_salt"], "left")
    return found.withColumn("value", F.coalesce("_large.value", "_other")).drop("_salt", "_large", "_other")
