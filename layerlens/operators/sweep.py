"""Pure shapes (k, 1) and (1, k) for several k, by elementary symmetric polynomials of the flows."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .motifs import flow_in, flow_out


def symmetric(values: Column, k: int) -> Column:
    """e_0 .. e_k of an array of doubles, one pass over it."""
    zero = F.array(F.lit(1.0), *(F.lit(0.0) for _ in range(k)))
    return F.aggregate(values, zero, lambda e, v: F.array(F.lit(1.0), *(F.get(e, F.lit(j)) + v * F.get(e, F.lit(j - 1)) for j in range(1, k + 1))))


def without(e: Column, v: Column, k: int) -> list[Column]:
    """e_0 .. e_k of the array less one element v."""
    out = [F.lit(1.0)]
    for j in range(1, k + 1):
        out.append(F.get(e, F.lit(j)) - v * out[j - 1])
    return out


def _on_both_sides(ki: int, ko: int) -> Column:
    """Choices that take one metanode on both sides, from the columns shared, ei and eo."""
    return F.aggregate("shared", F.lit(0.0), lambda s, x: s + x["v"] * x["w"] * without(F.col("ei"), x["v"], ki - 1)[-1] * without(F.col("eo"), x["w"], ko - 1)[-1])


def pure_shapes(edges: DataFrame, nodes: DataFrame, kmax: int = 5) -> DataFrame:
    """area, lvl and for k of 2..kmax int_k and bro_k: counts of (k, 1) and (1, k) motifs with different metanodes, summed over the waist's nodes."""
    flows = lambda f, name: f.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("area", "lvl", F.col("v").cast("double").alias("v")))).alias(name))  # noqa: E731  at most a row for each metanode
    both = flows(flow_in(edges), "fi").join(flows(flow_out(edges), "fo"), "i").join(nodes.select(F.col("root_id").alias("i"), "area", "lvl"), "i")
    both = both.withColumns({"ei": symmetric(F.transform("fi", lambda x: x["v"]), kmax), "eo": symmetric(F.transform("fo", lambda x: x["v"]), kmax)})
    key = lambda x: F.struct(x["area"], x["lvl"])
    out_flow = F.map_from_entries(F.transform("fo", lambda x: F.struct(key(x), x["v"])))
    shared = F.filter(F.transform("fi", lambda x: F.struct(x["v"].alias("v"), F.try_element_at(F.col("_out"), key(x)).alias("w"))), lambda x: x["w"].isNotNull())
    both = both.withColumn("_out", out_flow).withColumn("shared", shared)
    columns = {}
    for k in range(2, kmax + 1):
        for name, ki, ko in ((f"int_k{k}", k, 1), (f"bro_k{k}", 1, k)):
            columns[name] = F.greatest(F.get("ei", F.lit(ki)) * F.get("eo", F.lit(ko)) - _on_both_sides(ki, ko), F.lit(0.0))
    names = list(columns)
    return both.withColumns(columns).groupBy("area", "lvl").agg(*(F.sum(c).alias(c) for c in names))


def _choose(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for j in range(k):
        out = out * (n - j)
    return F.when(n >= k, out / float(factorial(k))).otherwise(0.0)


def regimes(shapes: DataFrame, degree: DataFrame, kmax: int = 5, least: float = 0.0) -> DataFrame:
    """Add tot_int, tot_bro, total, the plain index, the index by available combinations (index_norm) and the regime."""
    ks = range(2, kmax + 1)
    total = lambda s: sum((F.col(f"{s}_k{k}") for k in ks), F.lit(0.0))
    rows = shapes.join(degree, ["area", "lvl"]).withColumns({"tot_int": total("int"), "tot_bro": total("bro")}).withColumn("total", F.col("tot_int") + F.col("tot_bro"))
    part = lambda value, ways: F.coalesce(value / F.nullif(ways, F.lit(0.0)), F.lit(0.0))
    norm_int = sum((part(F.col(f"int_k{k}"), _choose(F.col("n_in"), k) * F.col("n_out")) for k in ks), F.lit(0.0))
    norm_bro = sum((part(F.col(f"bro_k{k}"), F.col("n_in") * _choose(F.col("n_out"), k)) for k in ks), F.lit(0.0))
    index = lambda a, b: F.coalesce((a - b) / F.nullif(a + b, F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"norm_int": norm_int, "norm_bro": norm_bro}).withColumns({"index": index(F.col("tot_int"), F.col("tot_bro")), "index_norm": index(F.col("norm_int"), F.col("norm_bro"))})
    regime = F.when(F.col("index_norm") <= -0.33, "broadcast").when(F.col("index_norm") <= 0.33, "mixed").otherwise("integrative")
    return rows.withColumn("regime", regime).where(F.col("total") >= least)


def by_area(found: DataFrame) -> DataFrame:
    """area, n, index_norm weighted by total."""
    return found.groupBy("area").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("index_norm") * F.col("total")) / F.nullif(F.sum("total"), F.lit(0.0))).alias("index_norm"))


def extremes(found: DataFrame, n: int = 12) -> DataFrame:
    """side (integrative, broadcast), rank, area, lvl, index_norm: the n nodes of largest and of smallest index (ties by area and level)."""
    end = lambda order, side: found.orderBy(order, "area", "lvl").limit(n).select(F.lit(side).alias("side"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, "area", "lvl")).alias("rank"), "area", "lvl", "index_norm")  # noqa: E731  n rows
    return end(F.desc("index_norm"), "integrative").unionByName(end(F.asc("index_norm"), "broadcast"))


def area_ends(areas: DataFrame, head: int = 10, tail: int = 8, least: int = 2) -> DataFrame:
    """end (head, tail), area, n, index_norm: of areas with ``least`` nodes or more in falling order of index (ties by area), the first and the last."""
    own = areas.where(F.col("n") >= least)
    part = lambda name, n, *order: own.orderBy(*order).limit(n).select(F.lit(name).alias("end"), "area", "n", "index_norm")
    return part("head", head, F.desc("index_norm"), "area").unionByName(part("tail", tail, "index_norm", F.desc("area")))
