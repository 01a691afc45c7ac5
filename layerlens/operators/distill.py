"""Motif rows reduced to aggregates and stratified top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signature import node_label, normalise_label

TOP_SIGNATURE, TOP_WAIST, TOP_GLOBAL, TOP_WAIST_SIGNATURE = 200, 20, 1000, 10
#: Up to this rank Spark cuts a window's groups before they are shuffled (default of ``spark.sql.optimizer.windowGroupLimitThreshold``).
GROUP_LIMIT = 1000


def with_waist(motifs: DataFrame) -> DataFrame:
    return motifs.withColumn("waist", node_label(F.col("bottleneck_area"), F.col("bottleneck_level")))


def by(motifs: DataFrame, *keys: str) -> DataFrame:
    """n_pattern, mass and mass_max by keys."""
    return motifs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pattern"), F.sum("motif_count").alias("mass"), F.max("motif_count").alias("mass_max"))


def by_signature(motifs: DataFrame) -> DataFrame:
    return by(motifs, "signature").drop("mass_max")


def by_waist(motifs: DataFrame) -> DataFrame:
    return by(with_waist(motifs), "waist")


def level_chains(motifs: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """Mass by levels of fan-in, waist and fan-out; a motif counts for each pair of its branches."""
    ins, outs = (F.array(*(F.col(f"fan_{s}_{n}_level") for n in range(k))) for s, k in (("in", k_in), ("out", k_out)))
    rows = motifs.select("motif_count", F.col("bottleneck_level").alias("level_waist"), F.explode(ins).alias("level_fan_in"), outs.alias("o"))
    rows = rows.select("motif_count", "level_waist", "level_fan_in", F.explode("o").alias("level_fan_out"))
    return rows.groupBy("level_fan_in", "level_waist", "level_fan_out").agg(F.sum("motif_count").alias("mass"))


def top(motifs: DataFrame, n: int, *keys: str, value: str = "motif_count") -> DataFrame:
    """The n rows of largest value of each key, ties by structure; of all rows without keys."""
    order = [F.desc(value), F.asc("structure_str")]
    if not keys:
        return motifs.orderBy(*order).limit(n)
    best = lambda df, *by: df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
    if n > GROUP_LIMIT:
        # few keys would sort all rows in as many tasks: take the best of each key's parts first
        parts = int(motifs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        motifs = best(motifs.withColumn("_part", F.pmod(F.xxhash64("structure_str"), F.lit(parts))), *keys, "_part").drop("_part")
    return best(motifs, *keys)


def top_summary(motifs: DataFrame) -> DataFrame:
    """hourglass_type (null: all), n, least, most and median count of a list of motifs."""
    rows = motifs.groupingSets([["hourglass_type"], []], "hourglass_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("motif_count").alias("least"), F.max("motif_count").alias("most"), F.median("motif_count").alias("median"))


def summary(motifs: DataFrame, window: str, **parameters: int) -> DataFrame:
    """One row of totals, with the parameters of the run."""
    cell = F.concat_ws("|", node_label(F.col("bottleneck_area"), F.col("bottleneck_level")), "signature")
    waist = node_label(F.col("bottleneck_area"), F.col("bottleneck_level"))
    out = motifs.agg(F.count(F.lit(1)).alias("n_pattern"), F.coalesce(F.sum("motif_count"), F.lit(0)).alias("mass"), F.count_distinct(waist).alias("n_waist"), F.count_distinct("signature").alias("n_signatures"), F.count_distinct(cell).alias("n_cells"))
    return out.withColumns({"window": F.lit(window), **{k: F.lit(v) for k, v in parameters.items()}})


def top_rows(motifs: DataFrame, n: int = 1000, min_count: int | None = None) -> DataFrame:
    """The n largest motifs of at least ``min_count``."""
    return top(motifs if min_count is None else motifs.where(F.col("motif_count") >= min_count), n)


def with_signature(motifs: DataFrame, wanted: str) -> DataFrame:
    """Motifs of one signature (an old name counts as the new one); an unknown one is an error that lists those there are."""
    rows = motifs.withColumn("signature", normalise_label(F.col("signature")))
    found = rows.where(normalise_label(F.lit(wanted)) == F.col("signature"))
    if found.isEmpty():
        raise ValueError(f"no motif has signature {wanted}; there are {sorted(r[0] for r in rows.select('signature').distinct().collect())}")
    return found


def share(df: DataFrame, value: str, name: str = "share", *keys: str) -> DataFrame:
    """Add value / sum of value (of the same keys)."""
    total = F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return df.withColumn(name, F.col(value).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))


def signature_shift(shallow: DataFrame, deep: DataFrame) -> DataFrame:
    """signature, shallow, deep, shift: shares of mass in two windows."""
    side = lambda df, name: share(by_signature(df), "mass", name).select("signature", name)
    both = side(shallow, "shallow").join(side(deep, "deep"), "signature", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("shallow", "deep")})
    return both.withColumn("shift", F.col("deep") - F.col("shallow"))
