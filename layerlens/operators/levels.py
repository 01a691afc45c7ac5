"""Level sizes, transitions between levels and coherence of categories across levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signature import direction
from ..functions.taxonomy import super_region
from ..sources.graph_tables import Graph


def sizes(graph: Graph) -> DataFrame:
    return graph.levels.where(F.col("y_level").isNotNull()).groupBy(F.col("y_level").alias("lvl")).agg(F.count(F.lit(1)).alias("n"))


def class_crosstab(graph: Graph, min_class: int = 500) -> DataFrame:
    """super_class, lvl, n and share of the class, for classes of ``min_class`` nodes or more (levels above 0)."""
    rows = graph.levels.where("y_level > 0").join(graph.classification, "root_id", "left").where(F.col("super_class").isNotNull())
    counts = rows.groupBy("super_class", F.col("y_level").alias("lvl")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("super_class"))
    return counts.withColumn("_total", total).where(F.col("_total") >= min_class).select("super_class", "lvl", "n", (F.col("n") / F.col("_total")).alias("share"))


def pivot_levels(crosstab: DataFrame, levels: list[int], key: str = "super_class") -> DataFrame:
    """One column a level; absent cells are 0."""
    return crosstab.groupBy(key).pivot("lvl", levels).agg(F.sum("n")).na.fill(0)


def _leveled(graph: Graph) -> DataFrame:
    return graph.levels.where("y_level > 0").select("root_id", F.col("y_level").alias("lvl"))


def transitions(graph: Graph) -> DataFrame:
    """l_pre, l_post, n_edges, n_syn over pairs whose ends have a level above 0."""
    pairs = graph.connections.groupBy("pre_root_id", "post_root_id").agg(F.sum("syn_count").alias("syn"))
    side = lambda key, name: _leveled(graph).select(F.col("root_id").alias(key), F.col("lvl").alias(name))
    rows = pairs.join(side("pre_root_id", "l_pre"), "pre_root_id").join(side("post_root_id", "l_post"), "post_root_id")
    return rows.groupBy("l_pre", "l_post").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("syn").alias("n_syn"))


def transition_density(moves: DataFrame, level_sizes: DataFrame) -> DataFrame:
    """Edges by possible pairs (without loops on the diagonal), times 10,000."""
    a = level_sizes.select(F.col("lvl").alias("l_pre"), F.col("n").alias("n_pre"))
    b = level_sizes.select(F.col("lvl").alias("l_post"), F.col("n").alias("n_post"))
    possible = F.when(F.col("l_pre") == F.col("l_post"), F.col("n_pre") * (F.col("n_pre") - 1)).otherwise(F.col("n_pre") * F.col("n_post"))
    return moves.join(a, "l_pre").join(b, "l_post").select("l_pre", "l_post", "n_edges", (F.col("n_edges") * 10000.0 / F.nullif(possible, F.lit(0))).alias("density"))


def chain_directions(chains: DataFrame) -> DataFrame:
    """into, out, mass: mass of level chains by direction of both steps."""
    d_in, d_out = direction(F.col("level_fan_in"), F.col("level_waist")), direction(F.col("level_waist"), F.col("level_fan_out"))
    return chains.groupBy(d_in.alias("into"), d_out.alias("out")).agg(F.sum("mass").alias("mass"))


def motif_transitions(motifs: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """side, l_from, l_to, mass, n_pattern of the motifs' edges into and out of the waist."""
    parts = [("in", F.col(f"fan_in_{n}_level"), F.col("bottleneck_level")) for n in range(k_in)] + [("out", F.col("bottleneck_level"), F.col(f"fan_out_{n}_level")) for n in range(k_out)]
    edges = F.array(*(F.struct(F.lit(s).alias("side"), a.alias("l_from"), b.alias("l_to")) for s, a, b in parts))
    rows = motifs.select("motif_count", F.explode(edges).alias("e")).select("motif_count", "e.*")
    return rows.groupBy("side", "l_from", "l_to").agg(F.sum("motif_count").alias("mass"), F.count(F.lit(1)).alias("n_pattern"))


def thresholds(graph: Graph) -> DataFrame:
    """upper, lower, threshold: midpoint between the lowest score of a level and the highest of the next."""
    ends = graph.levels.where(F.col("y_level").isNotNull()).groupBy(F.col("y_level").alias("lvl")).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    below = ends.select((F.col("lvl") - 1).alias("lvl"), F.col("high").alias("next_high"))
    return ends.join(below, "lvl").select(F.col("lvl").alias("upper"), (F.col("lvl") + 1).alias("lower"), ((F.col("low") + F.col("next_high")) / 2).alias("threshold"))


def categories(graph: Graph, column: str) -> DataFrame:
    """root_id, category, lvl of every node with a level, for ``super_class``, ``superregion`` or ``group``; nodes without a category are left out."""
    rows = graph.levels.where(F.col("y_level").isNotNull()).select("root_id", F.col("y_level").alias("lvl"))
    if column == "super_class":
        names = graph.classification.select("root_id", F.col("super_class").alias("category"))
    else:
        known = graph.neurons.where(F.col("grp").isNotNull() & (F.col("grp") != "NO_CONS"))
        names = known.select("root_id", (super_region(F.col("grp")) if column == "superregion" else F.col("grp")).alias("category"))
    return rows.join(names, "root_id").where(F.col("category").isNotNull()).select("root_id", "category", "lvl")


def coherence(rows: DataFrame, *keys: str, least: float = 0.05) -> DataFrame:
    """Per category (of each of ``keys``, such as a replicate): n, mode_level (ties: the lowest), purity, entropy, n_levels, n_levels_5pct, contiguous, spread."""
    counts = rows.groupBy(*keys, "category", "lvl").agg(F.count(F.lit(1)).alias("c"))
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "category")))
    held = F.col("p") >= least
    mean = F.sum(F.col("p") * F.col("lvl"))
    out = p.groupBy(*keys, "category").agg(
        F.sum("c").alias("n"), F.max_by("lvl", F.struct("c", -F.col("lvl"))).alias("mode_level"), F.max("p").alias("purity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.count(F.lit(1)).alias("n_levels"), F.count_if(held).alias("n_levels_5pct"), F.coalesce(F.max(F.when(held, F.col("lvl"))) - F.min(F.when(held, F.col("lvl"))) + 1, F.lit(0)).alias("_range"),
        mean.alias("_mean"), F.sum(F.col("p") * F.col("lvl") * F.col("lvl")).alias("_square"),
    )
    contiguous = (F.col("n_levels_5pct") <= 1) | (F.col("_range") == F.col("n_levels_5pct"))
    spread = F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    return out.withColumns({"contiguous": contiguous, "spread": spread}).drop("_range", "_mean", "_square")


def mutual_information(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys,) mi (bits) of category and level, and nmi (by the entropy of the level); a row for each of ``keys``, or one."""
    one = [*keys, "_one"]
    counts = rows.groupBy(*keys, "category", "lvl").agg(F.count(F.lit(1)).alias("c")).withColumn("_one", F.lit(1))
    x = counts.groupBy(*one, "category").agg(F.sum("c").alias("cx"))
    y = counts.groupBy(*one, "lvl").agg(F.sum("c").alias("cy"))
    total = counts.groupBy(*one).agg(F.sum("c").alias("n"))
    terms = counts.join(x, [*one, "category"]).join(y, [*one, "lvl"]).join(total, one)
    mi = terms.groupBy(*one).agg(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n").cast("double") / (F.col("cx").cast("double") * F.col("cy")))).alias("mi"))
    h = y.join(total, one).groupBy(*one).agg((-F.sum(F.col("cy") / F.col("n") * F.log2(F.col("cy") / F.col("n")))).alias("h"))
    return mi.join(h, one).select(*keys, "mi", (F.col("mi") / F.nullif("h", F.lit(0.0))).alias("nmi"))


def granularity(graph: Graph) -> DataFrame:
    """A row for each granularity: categories, metanodes, median_size, weighted purity, entropy, contiguous_share, nmi."""

    def one(column: str) -> DataFrame:
        rows = categories(graph, column)
        t = coherence(rows)
        w = lambda c: (F.sum(c * F.col("n")) / F.sum("n"))
        out = t.agg(F.count(F.lit(1)).alias("categories"), F.sum("n_levels").alias("metanodes"), F.median("n").alias("median_size"), w(F.col("purity")).alias("purity"), w(F.col("entropy")).alias("entropy"), w(F.col("contiguous").cast("double")).alias("contiguous_share"))
        key = F.lit(column).alias("granularity")
        return out.withColumn("granularity", F.lit(column)).join(mutual_information(rows).select(key, "nmi"), "granularity")

    return reduce(DataFrame.unionByName, map(one, ("super_class", "superregion", "group")))


def null_reference(rows: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """rep, purity (weighted by size), nmi of n copies whose levels are dealt anew among all nodes; all copies go through one plan."""
    from .nulls import permuted, replicates

    drawn = permuted(replicates(rows, n), "lvl", seed, ["rep", "root_id"], "rep")
    purity = coherence(drawn, "rep").groupBy("rep").agg((F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("purity"))
    return purity.join(mutual_information(drawn, "rep").select("rep", "nmi"), "rep")


def null_test(rows: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """measure (purity, nmi), observed, null_mean, null_sd, z, p = (1 + copies not below) / (copies + 1)."""
    from .compare import empirical

    long = lambda df, *keys: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("purity", "nmi")))).alias("x")).select(*keys, "x.*")
    seen = coherence(rows).agg((F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("purity")).withColumn("_one", F.lit(1))
    seen = long(seen.join(mutual_information(rows).withColumn("_one", F.lit(1)), "_one")).withColumnRenamed("value", "observed")
    return empirical(seen, long(null_reference(rows, n, seed), "rep"), ["measure"])
