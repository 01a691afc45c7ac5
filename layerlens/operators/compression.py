"""How many neighbours a waist gathers: nominal and realised compression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nominal(motifs: DataFrame, sizes: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """Add n_waist, n_periphery, compression, density and count_per_waist from metanode sizes (unrounded)."""
    ends = [f"fan_in_{n}" for n in range(k_in)] + [f"fan_out_{n}" for n in range(k_out)]
    rows = motifs.drop("n_waist", "n_periphery", "compression", "density", "count_per_waist")
    for e in ["bottleneck", *ends]:
        rows = rows.join(sizes.select(F.col("area").alias(f"{e}_area"), F.col("lvl").alias(f"{e}_level"), F.col("n").alias(f"_n_{e}")), [f"{e}_area", f"{e}_level"])
    of = [F.col(f"_n_{e}").cast("double") for e in ends]
    waist, count = F.col("_n_bottleneck").cast("double"), F.col("motif_count").cast("double")
    total, product = (reduce(f, of) for f in (lambda a, b: a + b, lambda a, b: a * b))
    rows = rows.withColumns({"n_waist": F.col("_n_bottleneck"), "n_periphery": total.cast("long"), "compression": total / waist, "density": count / (product * waist), "count_per_waist": count / waist})
    return rows.drop(*(f"_n_{e}" for e in ["bottleneck", *ends]))


#: Edges of the histogram of compression, half-open, the last bin closed.
EDGES = (0, 1, 2, 5, 10, 20, 50, 100, 1_000_000_000)


def histogram(df: DataFrame, value: str = "compression", edges: tuple[int, ...] = EDGES) -> DataFrame:
    """low, high, n of every bin, empty ones too."""
    bins = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    x, last = F.col(value), len(bins) - 1
    which = reduce(lambda out, b: F.when((x >= b[1]) & ((x <= b[2]) if b[0] == last else (x < b[2])), b[0]).otherwise(out), bins, F.lit(None).cast("int"))
    counts = df.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.createDataFrame(bins, "bin int, low double, high double").join(counts, "bin", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def realised(edges: DataFrame, nodes: DataFrame, patterns: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """For each pattern: recounted, n_active, n_eff, n_periphery_real (distinct nodes that touch an active waist node, by branch) and compression_real."""
    ins, outs = [f"fan_in_{n}" for n in range(k_in)], [f"fan_out_{n}" for n in range(k_out)]
    end = lambda e: F.struct(F.col(f"{e}_area").alias("area"), F.col(f"{e}_level").alias("lvl"))
    listed = lambda ends: patterns.select(F.explode(F.array(*map(end, ends))).alias("x")).select("x.area", "x.lvl").distinct()
    members = nodes.select(F.col("root_id").alias("i"), F.col("area").alias("bottleneck_area"), F.col("lvl").alias("bottleneck_level"))
    rows = patterns.select("structure_str", "bottleneck_area", "bottleneck_level", *(f"{e}_{c}" for e in [*ins, *outs] for c in ("area", "level"))).join(members, ["bottleneck_area", "bottleneck_level"])
    # only edges at metanodes of the patterns; flows are grouped once a side
    into = edges.select(F.col("post").alias("i"), F.col("pre").alias("other"), F.col("sa").alias("area"), F.col("sl").alias("lvl")).join(listed(ins), ["area", "lvl"], "left_semi")
    out = edges.select(F.col("pre").alias("i"), F.col("post").alias("other"), F.col("da").alias("area"), F.col("dl").alias("lvl")).join(listed(outs), ["area", "lvl"], "left_semi")
    flows = [side.groupBy("i", "area", "lvl").agg(F.count(F.lit(1)).alias("v")) for side in (into, out)]
    active = rows.withColumn("p", F.lit(1).cast("long"))
    for e in [*ins, *outs]:
        flow = flows[e in outs].select("i", F.col("area").alias(f"{e}_area"), F.col("lvl").alias(f"{e}_level"), "v")
        active = active.join(flow, ["i", f"{e}_area", f"{e}_level"]).withColumn("p", F.col("p") * F.col("v")).drop("v")
    counts = active.groupBy("structure_str").agg(F.sum("p").alias("recounted"), F.count(F.lit(1)).alias("n_active"), (F.sum("p").cast("double") * F.sum("p").cast("double") / F.sum(F.col("p").cast("double") * F.col("p").cast("double"))).alias("n_eff"))
    branches = [F.struct(F.lit(n).alias("branch"), F.lit(e in ins).alias("inward"), F.col(f"{e}_area").alias("area"), F.col(f"{e}_level").alias("lvl")) for n, e in enumerate([*ins, *outs])]
    exploded = active.select("structure_str", "i", F.explode(F.array(*branches)).alias("x")).select("structure_str", "i", "x.*")
    touched = exploded.join(into.withColumn("inward", F.lit(True)).union(out.withColumn("inward", F.lit(False))), ["i", "inward", "area", "lvl"])
    periphery = touched.select("structure_str", "branch", "other").distinct().groupBy("structure_str").agg(F.count(F.lit(1)).alias("n_periphery_real"))
    found = counts.join(periphery, "structure_str")
    return patterns.join(found, "structure_str").withColumn("compression_real", F.col("n_periphery_real").cast("double") / F.col("n_eff"))


def realised_by_signature(found: DataFrame, min_eff: float = 5.0) -> DataFrame:
    """signature, n, median and largest realised compression of patterns with an effective waist of ``min_eff`` or more, and the largest's structure (ties: the last by name)."""
    rows = found.where(F.col("n_eff") >= min_eff)
    best = F.max_by("structure_str", F.struct(F.round("compression_real", 9), "structure_str"))
    return rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.median("compression_real").alias("median"), F.max("compression_real").alias("largest"), best.alias("best"))
