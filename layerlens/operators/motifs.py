"""Exact counts of bow-tie motifs: k_in metanodes converge on a waist that diverges to k_out metanodes.

count(A..; B; D..) is the sum over nodes i of B of the product of the numbers of
i's neighbours in each A and D.  Neighbours are counted by metanode first, so no
instance is enumerated: flows are small, combinations of metanodes are joined by
node, and the sum over nodes is one hash aggregation with partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signature import sign, structure
from ..sources.scratch import cut
from . import dense

ENGINES = ("join", "matrix", "measured")


def flow_in(edges: DataFrame) -> DataFrame:
    """i, area, lvl, v: in-neighbours of node i in each metanode."""
    return edges.groupBy(F.col("post").alias("i"), F.col("sa").alias("area"), F.col("sl").alias("lvl")).agg(F.count(F.lit(1)).alias("v"))


def flow_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("pre").alias("i"), F.col("da").alias("area"), F.col("dl").alias("lvl")).agg(F.count(F.lit(1)).alias("v"))


def _before(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return (F.col(a[0]) < F.col(b[0])) | ((F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) < F.col(b[1])))


def branch_combinations(flow: DataFrame, k: int, area: str, level: str) -> DataFrame:
    """i, area0, level0, .. (ascending metanodes), p: product of the flows of each k metanodes of a node."""
    one = lambda n: flow.select("i", F.col("area").alias(f"{area}{n}"), F.col("lvl").alias(f"{level}{n}"), F.col("v").alias(f"v{n}"))
    out = one(0).withColumnRenamed("v0", "p")
    for n in range(1, k):
        right = one(n)
        out = out.join(right, "i").where(_before((f"{area}{n - 1}", f"{level}{n - 1}"), (f"{area}{n}", f"{level}{n}"))).withColumn("p", F.col("p") * F.col(f"v{n}")).drop(f"v{n}")
    return out


def metanode_numbers(nodes: DataFrame) -> DataFrame:
    """area, lvl, n (its nodes), mid: metanodes numbered in their order; a row a metanode, written once."""
    found = nodes.groupBy("area", "lvl").agg(F.count(F.lit(1)).alias("n"))
    return cut(found.withColumn("mid", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("area", "lvl"))))


def _combinations(flow: DataFrame, k: int, name: str) -> DataFrame:
    """i, name0.. (ascending metanode numbers), p and what else ``flow`` (i, mid, v) has: product of the flows of each k metanodes of a node."""
    out = flow.withColumnsRenamed({"mid": f"{name}0", "v": "p"})
    for n in range(1, k):
        right = flow.select("i", F.col("mid").alias(f"{name}{n}"), "v")
        out = out.join(right, "i").where(F.col(f"{name}{n - 1}") < F.col(f"{name}{n}")).withColumn("p", F.col("p") * F.col("v")).drop("v")
    return out


def numbered_flows(edges: DataFrame, nodes: DataFrame, waists: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of metanodes, and flows by number: b (the waist), i, mid, v into nodes of waists, and i, mid, v out of nodes."""
    ids = metanode_numbers(nodes)
    waist = nodes.join(ids if waists is None else ids.join(waists, ["area", "lvl"], "left_semi"), ["area", "lvl"]).select(F.col("root_id").alias("i"), F.col("mid").alias("b"))
    # partial sums first: a node of many edges has a row for each metanode
    flow = lambda i, a, l: edges.select(F.col(i).alias("i"), F.col(a).alias("area"), F.col(l).alias("lvl")).join(ids, ["area", "lvl"]).groupBy("i", "mid").agg(F.count(F.lit(1)).alias("v"))  # noqa: E731, E741
    return ids, flow("post", "sa", "sl").join(waist, "i"), flow("pre", "da", "dl")


def _star_sums(into: DataFrame, out: DataFrame, k_in: int, k_out: int) -> DataFrame:
    """b, a0.., d0.., motif_count, n_waist_active, ssq by joining combinations on their node."""
    left = _combinations(into, k_in, "a").withColumnRenamed("p", "p_in")
    right = _combinations(out.repartition("i"), k_out, "d").withColumnRenamed("p", "p_out")
    apart = reduce(lambda x, y: x & y, (F.col(f"a{n}") != F.col(f"d{m}") for n in range(k_in) for m in range(k_out)))
    keys = ["b", *(f"a{n}" for n in range(k_in)), *(f"d{m}" for m in range(k_out))]
    p = F.col("p_in") * F.col("p_out")
    return left.join(right, "i").where(apart).groupBy(keys).agg(F.sum(p).alias("motif_count"), F.count(F.lit(1)).alias("n_waist_active"), F.sum(p.cast("double") * p.cast("double")).alias("ssq"))


def waist_density(edges: DataFrame, nodes: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """area, lvl, n_nodes, star_rows, cells, density and dense of every waist (see ``dense.density``)."""
    ids, into, out = numbered_flows(edges, nodes)
    return ids.select("area", "lvl", F.col("mid").alias("b")).join(dense.density(into, out, k_in, k_out), "b").drop("b")


def bowtie_counts(edges: DataFrame, nodes: DataFrame, k_in: int = 2, k_out: int = 2, min_count: int = 10, waists: DataFrame | None = None, engine: str = "join") -> DataFrame:
    """area, lvl (the waist), a*, l*, d*, m*, motif_count, n_waist_active, ssq and the sizes of all metanodes (_n_*) of all combinations of ``min_count`` or more; ``waists`` (area, lvl): of these alone.

    Metanodes are numbered, so that what is combined, joined and summed are whole numbers; names come back at the end.  The ends of ``edges`` are in ``nodes``.
    ``engine``: ``join`` combines flows by joins, ``matrix`` by products of matrices, ``measured`` takes matrices for the waists that are dense enough and joins for all others."""
    if min(k_in, k_out, min_count) < 1:
        raise ValueError("k_in, k_out and min_count are at least 1")
    if engine not in ENGINES:
        raise ValueError(f"engine is one of {ENGINES}")
    ids, into, out = numbered_flows(edges, nodes, waists)
    sizes = ids.select(F.col("mid").alias("b"), "n")
    if engine == "measured":
        into, out = cut(into), cut(out)
        chosen = cut(dense.density(into, out, k_in, k_out).where("dense").select("b"))
        some, rest = into.join(chosen, "b", "left_semi"), into.join(chosen, "b", "left_anti")
        found = _star_sums(rest, out, k_in, k_out).unionByName(dense.star_sums(some, out, sizes, k_in, k_out))
    else:
        found = dense.star_sums(into, out, sizes, k_in, k_out) if engine == "matrix" else _star_sums(into, out, k_in, k_out)
    found = found.where(F.col("motif_count") >= min_count)
    names = [("b", "area", "lvl", "bottleneck"), *((f"a{n}", f"a{n}", f"l{n}", f"fan_in_{n}") for n in range(k_in)), *((f"d{m}", f"d{m}", f"m{m}", f"fan_out_{m}") for m in range(k_out))]
    for key, area, level, end in names:
        own = ids.select(F.col("mid").alias("_key"), F.col("area").alias(area), F.col("lvl").alias(level), F.col("n").alias(f"_n_{end}"))
        found = found.withColumnRenamed(key, "_key").join(own, "_key").drop("_key")
    return found.select(*(c for _, area, level, _ in names for c in (area, level)), "motif_count", "n_waist_active", "ssq", *(f"_n_{end}" for *_, end in names))


def motif_rows(counts: DataFrame, sizes: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """Full motif rows: names, signature, sizes and compression.  ``sizes``: area, lvl, n of every metanode, for counts that do not have them."""
    names = {"area": "bottleneck_area", "lvl": "bottleneck_level"}
    names |= {f"{a}{n}": f"fan_{side}_{n}_{c}" for side, k, cols in (("in", k_in, "al"), ("out", k_out, "dm")) for n in range(k) for a, c in zip(cols, ("area", "level"))}
    rows = sign(counts.withColumnsRenamed(names), k_in, k_out)
    ends = [f"fan_in_{n}" for n in range(k_in)] + [f"fan_out_{n}" for n in range(k_out)]
    for e in ["bottleneck", *ends]:
        rows = rows if f"_n_{e}" in rows.columns else rows.join(sizes.select(F.col("area").alias(f"{e}_area"), F.col("lvl").alias(f"{e}_level"), F.col("n").alias(f"_n_{e}")), [f"{e}_area", f"{e}_level"])
    of = lambda e: F.col(f"_n_{e}")
    n_waist, periphery = of("bottleneck"), reduce(lambda a, b: a + b, map(of, ends))
    node = lambda name: (F.col(f"{name}_area"), F.col(f"{name}_level"))
    rows = rows.withColumns({
        "n_waist": n_waist, "n_periphery": periphery, "n_waist_eff": F.round(F.col("motif_count").cast("double") * F.col("motif_count").cast("double") / F.nullif("ssq", F.lit(0.0)), 3),
        "compression": F.round(periphery / F.nullif(n_waist, F.lit(0)), 3), "k_in": F.lit(k_in), "k_out": F.lit(k_out),
        "structure_str": structure([node(e) for e in ends[:k_in]], node("bottleneck"), [node(e) for e in ends[k_in:]]),
    })
    first = ["motif_count", "hourglass_type", "signature", "fanin_sig", "fanout_sig", "n_FWD", "n_BWD", "n_LAT", "n_waist", "n_waist_active", "n_waist_eff", "n_periphery", "compression", "bottleneck_area", "bottleneck_level", "k_in", "k_out", "structure_str"]
    return rows.select(*first, *(f"{e}_{c}" for e in ends for c in ("area", "level")))


def recount(edges: DataFrame, nodes: DataFrame, patterns: DataFrame, k_in: int = 2, k_out: int = 2) -> DataFrame:
    """``patterns`` (motif rows) with recounted: only flows of their metanodes are made."""
    node = lambda n: F.struct(F.col(f"{n}_area").alias("area"), F.col(f"{n}_level").alias("lvl"))
    ins, outs = [f"fan_in_{n}" for n in range(k_in)], [f"fan_out_{n}" for n in range(k_out)]
    listed = lambda ends: patterns.select(F.explode(F.array(*map(node, ends))).alias("x")).select("x.area", "x.lvl").distinct()
    waist = patterns.select(F.col("bottleneck_area").alias("area"), F.col("bottleneck_level").alias("lvl")).distinct()
    members = nodes.join(waist, ["area", "lvl"], "left_semi").select(F.col("root_id").alias("i"), F.col("area").alias("bottleneck_area"), F.col("lvl").alias("bottleneck_level"))
    into, out = flow_in(edges).join(listed(ins), ["area", "lvl"], "left_semi"), flow_out(edges).join(listed(outs), ["area", "lvl"], "left_semi")
    keys = ["structure_str", "bottleneck_area", "bottleneck_level"]
    rows = patterns.select(*keys, *(f"{e}_{c}" for e in [*ins, *outs] for c in ("area", "level"))).join(members, ["bottleneck_area", "bottleneck_level"]).withColumn("p", F.lit(1).cast("long"))
    for e in [*ins, *outs]:
        flow = (into if e in ins else out).select("i", F.col("area").alias(f"{e}_area"), F.col("lvl").alias(f"{e}_level"), "v")
        rows = rows.join(flow, ["i", f"{e}_area", f"{e}_level"]).withColumn("p", F.col("p") * F.col("v")).drop("v")
    found = rows.groupBy("structure_str").agg(F.sum("p").alias("recounted"), F.count(F.lit(1)).alias("active"))
    return patterns.join(found, "structure_str", "left").withColumns({"recounted": F.coalesce("recounted", F.lit(0)), "active": F.coalesce("active", F.lit(0))})
