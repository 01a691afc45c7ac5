"""Two measures of the same nodes side by side: overlap of the best, ranks and rank correlation; q-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics


def side_by_side(micro: DataFrame, macro: DataFrame, keys: list[str]) -> DataFrame:
    """keys, micro, macro: all nodes of either table, absent values 0."""
    both = micro.join(macro, keys, "full")
    return both.select(*keys, *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("micro", "macro")))


def ranked(both: DataFrame) -> DataFrame:
    """Add least ranks (1 is best) of both measures."""
    one = Window.partitionBy(F.lit(1))
    return both.withColumns({f"rank_{c}": F.rank().over(one.orderBy(F.desc(c))) for c in ("micro", "macro")})


def top_overlap(both: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """n (nodes), k, shared: nodes among the k best by both (ties by key), and the expected number."""
    best = lambda c: both.orderBy(F.desc(c), *keys).limit(k).select(*keys)
    shared = best("micro").join(best("macro"), keys, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    size = both.agg(F.count(F.lit(1)).alias("n"))
    out = shared.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("k", F.lit(k))
    return out.withColumn("expected", F.col("k") * F.col("k") / F.nullif("n", F.lit(0)))


def mean_ranks(df: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """Add the average rank (ascending, ties share)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (ties - 1) / 2.0)


def spearman(both: DataFrame) -> DataFrame:
    """rho, n of the two measures."""
    rows = mean_ranks(mean_ranks(both, "micro", "_a"), "macro", "_b")
    return rows.agg(F.corr("_a", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def overlap_test(overlap: DataFrame) -> dict[str, float]:
    """shared and p_overlap (hypergeometric) of ``top_overlap``."""
    o = overlap.first()
    best = min(o["k"], o["n"])
    return {"shared": o["shared"], "p_overlap": statistics.hypergeometric_tail(o["shared"], o["n"], best, best)}


def spearman_test(rho: DataFrame) -> dict[str, float]:
    """rho and p_rho (Student's t; 1 without a correlation, 0 for a perfect one) of ``spearman``."""
    r = rho.first()
    value, freedom = r["rho"], r["n"] - 2
    if value is None or freedom < 1:
        return {"rho": value, "p_rho": 1.0}
    return {"rho": value, "p_rho": statistics.student(value * (freedom / (1 - value * value)) ** 0.5, freedom) if abs(value) < 1 else 0.0}


def q_values(df: DataFrame, p: str = "p", name: str = "q") -> DataFrame:
    """Add step-up q-values of all rows: the least of p * m / rank over this and larger p, 1 at most."""
    one = Window.partitionBy(F.lit(1))
    rows = df.withColumns({"_m": F.count(F.lit(1)).over(one), "_rank": F.row_number().over(one.orderBy(F.asc(p)))})
    after = one.orderBy(F.desc(p), F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(after), F.lit(1.0))).drop("_m", "_rank")


def empirical(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """keys, observed, n_random, null_mean, null_sd, ratio, z and p = (1 + replicates not below) / (replicates + 1); ``null``: keys, rep, value."""
    rows = observed.join(null, keys)
    out = rows.groupBy(*keys, "observed").agg(F.count(F.lit(1)).alias("n_random"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), F.count_if(F.col("value") >= F.col("observed")).alias("_ge"))
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0))).when(F.col("observed") == F.col("null_mean"), 0.0).otherwise(float("inf"))
    return out.withColumns({"ratio": F.col("observed") / F.nullif("null_mean", F.lit(0.0)), "z": z, "p": (1 + F.col("_ge")) / (F.col("n_random") + 1)}).drop("_ge")
