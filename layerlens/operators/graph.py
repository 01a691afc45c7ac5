"""Working sets, edges and metanodes (category, level) of a layered graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import super_region
from ..sources.graph_tables import Graph

NO_CONSENSUS = "NO_CONS"
GROUPINGS = ("group", "superregion", "superclass")


def parse_window(window: str) -> list[int]:
    """``1-2-3`` as levels."""
    levels = [int(x) for x in window.split("-")]
    if not levels:
        raise ValueError("a window needs a level")
    return levels


def working_set(graph: Graph, window: str | None = None, grouping: str = "group") -> DataFrame:
    """root_id, area, lvl of nodes with a category and a level in the window.  Classes keep nodes that have no group."""
    if grouping not in GROUPINGS:
        raise ValueError(f"grouping is one of {GROUPINGS}")
    if grouping == "superclass":
        nodes = graph.classification.where(F.col("super_class").isNotNull()).select("root_id", F.col("super_class").alias("area"))
    else:
        known = graph.neurons.where(F.col("grp").isNotNull() & (F.col("grp") != NO_CONSENSUS))
        nodes = known.select("root_id", (super_region(F.col("grp")) if grouping == "superregion" else F.col("grp")).alias("area"))
    levels = graph.levels.where(F.col("y_level").isNotNull())
    if window is not None:
        levels = levels.where(F.col("y_level").isin(parse_window(window)))
    return nodes.join(levels.select("root_id", F.col("y_level").cast("int").alias("lvl")), "root_id")


def edges_binary(graph: Graph) -> DataFrame:
    """pre, post: distinct pairs with a positive count."""
    return graph.connections.where("syn_count > 0").select(F.col("pre_root_id").alias("pre"), F.col("post_root_id").alias("post")).distinct()


def edges_summed(graph: Graph, least: int | None = None) -> DataFrame:
    """pre, post, syn: counts summed over places, those of ``least`` or more."""
    out = graph.connections.groupBy(F.col("pre_root_id").alias("pre"), F.col("post_root_id").alias("post")).agg(F.sum("syn_count").alias("syn"))
    return out if least is None else out.where(F.col("syn") >= least)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``nodes`` (root_id, area, lvl), with sa, sl, da, dl."""
    side = lambda key, a, l: nodes.select(F.col("root_id").alias(key), F.col("area").alias(a), F.col("lvl").alias(l))  # noqa: E731, E741
    return edges.join(side("pre", "sa", "sl"), "pre").join(side("post", "da", "dl"), "post")


def between_metanodes(edges: DataFrame, max_jump: int = 1) -> DataFrame:
    """Edges between different metanodes that are at most ``max_jump`` levels apart."""
    return edges.where((F.abs(F.col("sl") - F.col("dl")) <= max_jump) & ~((F.col("sa") == F.col("da")) & (F.col("sl") == F.col("dl"))))


def metanodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("area", "lvl").agg(F.count(F.lit(1)).alias("n"))


def metagraph_edges(edges: DataFrame) -> DataFrame:
    """sa, sl, da, dl, n: edges between metanodes."""
    return edges.groupBy("sa", "sl", "da", "dl").agg(F.count(F.lit(1)).alias("n"))


def metagraph_degree(metaedges: DataFrame) -> DataFrame:
    """area, lvl, n_in, n_out: neighbouring metanodes."""
    out = metaedges.groupBy(F.col("sa").alias("area"), F.col("sl").alias("lvl")).agg(F.count(F.lit(1)).alias("n_out"))
    into = metaedges.groupBy(F.col("da").alias("area"), F.col("dl").alias("lvl")).agg(F.count(F.lit(1)).alias("n_in"))
    both = out.join(into, ["area", "lvl"], "full")
    return both.select("area", "lvl", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def first_waists(degree: DataFrame, k_in: int, k_out: int, n: int) -> DataFrame:
    """The first ``n`` metanodes that have enough neighbours to be a waist."""
    return degree.where((F.col("n_in") >= k_in) & (F.col("n_out") >= k_out)).orderBy("area", "lvl").limit(n).select("area", "lvl")
