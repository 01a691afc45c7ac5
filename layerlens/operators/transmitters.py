"""Excitatory and inhibitory composition of edges, groups and motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics
from ..functions.signature import direction
from ..sources.graph_tables import Graph

CLASSES = ("E", "I", "M", "U")


def transmitter_class(nt_type: Column, score: Column, least: float = 0.5, glut_excitatory: bool = False) -> Column:
    """E, I, M (modulators) or U (unknown, or a score under ``least``)."""
    known = F.when(nt_type == "ACH", "E").when(nt_type == "GLUT", "E" if glut_excitatory else "I").when(nt_type == "GABA", "I").when(nt_type.isin("DA", "SER", "OCT"), "M").otherwise("U")
    return F.when(F.coalesce(score, F.lit(-1.0)) < least, "U").otherwise(known)


def node_classes(graph: Graph, least: float = 0.5, glut_excitatory: bool = False) -> DataFrame:
    return graph.neurons.select("root_id", "grp", transmitter_class(F.col("nt_type"), F.col("nt_type_score"), least, glut_excitatory).alias("nt"))


def directed_edges(graph: Graph, least: float = 0.5, glut_excitatory: bool = False) -> DataFrame:
    """pre, grp, direction, nt (of the source), syn of pairs whose ends have a level."""
    pairs = graph.connections.groupBy(F.col("pre_root_id").alias("pre"), F.col("post_root_id").alias("post")).agg(F.sum("syn_count").alias("syn"))
    levels = graph.levels.where(F.col("y_level").isNotNull())
    side = lambda key, name: levels.select(F.col("root_id").alias(key), F.col("y_level").alias(name))
    rows = pairs.join(side("pre", "a"), "pre").join(side("post", "b"), "post")
    nt = node_classes(graph, least, glut_excitatory).withColumnRenamed("root_id", "pre")
    return rows.join(nt, "pre", "left").select("pre", "grp", direction(F.col("a"), F.col("b")).alias("direction"), F.coalesce("nt", F.lit("U")).alias("nt"), "syn")


def by_direction(edges: DataFrame) -> DataFrame:
    """direction, nt, n_edges, n_syn and shares within the direction."""
    counts = edges.groupBy("direction", "nt").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("syn").alias("n_syn"))
    w = Window.partitionBy("direction")
    return counts.withColumns({"share_edges": F.col("n_edges") / F.sum("n_edges").over(w), "share_syn": F.col("n_syn") / F.sum("n_syn").over(w)})


def ratio_by_direction(edges: DataFrame) -> DataFrame:
    """direction, n_e, n_i, syn_e, syn_i and both E/I ratios."""
    e, i = F.col("nt") == "E", F.col("nt") == "I"
    out = edges.groupBy("direction").agg(F.count_if(e).alias("n_e"), F.count_if(i).alias("n_i"), F.coalesce(F.sum(F.when(e, F.col("syn"))), F.lit(0)).alias("syn_e"), F.coalesce(F.sum(F.when(i, F.col("syn"))), F.lit(0)).alias("syn_i"))
    return out.withColumns({"ratio_edges": F.col("n_e") / F.nullif("n_i", F.lit(0)), "ratio_syn": F.col("syn_e") / F.nullif("syn_i", F.lit(0))})


def by_group(graph: Graph, least: float = 0.5) -> DataFrame:
    """grp, lvl, n and the share of each class."""
    rows = node_classes(graph, least).where(F.col("grp").isNotNull() & (F.col("grp") != "NO_CONS")).join(graph.levels.where(F.col("y_level").isNotNull()).select("root_id", F.col("y_level").alias("lvl")), "root_id")
    return rows.groupBy("grp", "lvl").agg(F.count(F.lit(1)).alias("n"), *((F.count_if(F.col("nt") == c) / F.count(F.lit(1))).alias(f"frac_{c}") for c in CLASSES))


def _grouped(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("nt").isin("E", "I") & F.col("grp").isNotNull() & (F.col("grp") != "NO_CONS"))


def stratified(edges: DataFrame, least: int = 50) -> DataFrame:
    """Groups with ``least`` forward and backward edges: their excitatory shares and the difference."""
    fwd, bwd, e = F.col("direction") == "FWD", F.col("direction") == "BWD", F.col("nt") == "E"
    out = _grouped(edges).groupBy("grp").agg(F.count_if(fwd).alias("n_FWD"), F.count_if(bwd).alias("n_BWD"), F.count_if(fwd & e).alias("_f"), F.count_if(bwd & e).alias("_b"))
    out = out.where((F.col("n_FWD") >= least) & (F.col("n_BWD") >= least))
    out = out.select("grp", "n_FWD", "n_BWD", (F.col("_f") / F.col("n_FWD")).alias("fracE_FWD"), (F.col("_b") / F.col("n_BWD")).alias("fracE_BWD"))
    return out.withColumn("delta", F.col("fracE_FWD") - F.col("fracE_BWD"))


def kitagawa(edges: DataFrame) -> DataFrame:
    """The forward/backward gap in excitation, split into composition (which groups) and within groups; a direction that a group lacks takes the other's share."""
    fwd, bwd, e = F.col("direction") == "FWD", F.col("direction") == "BWD", F.col("nt") == "E"
    g = _grouped(edges).where(fwd | bwd).groupBy("grp").agg(F.count_if(fwd).alias("nf"), F.count_if(bwd).alias("nb"), (F.count_if(fwd & e) / F.nullif(F.count_if(fwd), F.lit(0))).alias("pf"), (F.count_if(bwd & e) / F.nullif(F.count_if(bwd), F.lit(0))).alias("pb"))
    g = g.select("nf", "nb", F.coalesce("pf", "pb").alias("pf"), F.coalesce("pb", "pf").alias("pb"))
    total = g.agg(F.sum("nf").alias("_f"), F.sum("nb").alias("_b")).withColumn("_one", F.lit(1))
    g = g.withColumn("_one", F.lit(1)).join(total, "_one")
    wf, wb = F.col("nf") / F.nullif("_f", F.lit(0)), F.col("nb") / F.nullif("_b", F.lit(0))
    out = g.agg(F.count(F.lit(1)).alias("groups"), F.sum(wf * F.col("pf")).alias("p_FWD"), F.sum(wb * F.col("pb")).alias("p_BWD"), F.sum((wf - wb) * (F.col("pf") + F.col("pb")) / 2).alias("composition"), F.sum((wf + wb) / 2 * (F.col("pf") - F.col("pb"))).alias("within"))
    return out.withColumn("gap", F.col("p_FWD") - F.col("p_BWD"))


def motif_decomposition(edges: DataFrame, nodes: DataFrame, classes: DataFrame, min_count: int = 1) -> DataFrame:
    """Counts of 2-to-2 motifs by the classes of both fan-in neurons' metanodes: waist, fan-in and fan-out metanodes, nt0, nt1 (in the order of the metanodes), motif_count.

    The class is one more key of the fan-in flow, so only classes that occur make rows."""
    from .motifs import branch_combinations, flow_out

    nt = classes.select(F.col("root_id").alias("pre"), "nt")
    flow = edges.join(nt, "pre", "left").groupBy(F.col("post").alias("i"), F.col("sa").alias("area"), F.col("sl").alias("lvl"), F.coalesce("nt", F.lit("U")).alias("nt")).agg(F.count(F.lit(1)).alias("v"))
    one = lambda n: flow.select("i", F.col("area").alias(f"a{n}"), F.col("lvl").alias(f"l{n}"), F.col("nt").alias(f"nt{n}"), F.col("v").alias(f"v{n}"))
    before = (F.col("a0") < F.col("a1")) | ((F.col("a0") == F.col("a1")) & (F.col("l0") < F.col("l1")))
    into = one(0).join(one(1), "i").where(before)
    out = branch_combinations(flow_out(edges), 2, "d", "m")
    apart = ~((F.col("a0") == F.col("d0")) & (F.col("l0") == F.col("m0"))) & ~((F.col("a0") == F.col("d1")) & (F.col("l0") == F.col("m1"))) & ~((F.col("a1") == F.col("d0")) & (F.col("l1") == F.col("m0"))) & ~((F.col("a1") == F.col("d1")) & (F.col("l1") == F.col("m1")))
    rows = into.join(out, "i").where(apart).join(nodes.select(F.col("root_id").alias("i"), "area", "lvl"), "i")
    return rows.groupBy("area", "lvl", "a0", "l0", "a1", "l1", "d0", "m0", "d1", "m1", "nt0", "nt1").agg(F.sum(F.col("v0") * F.col("v1") * F.col("p")).alias("motif_count")).where(F.col("motif_count") >= min_count)


def fan_in_kind(nt0: Column, nt1: Column) -> Column:
    return F.when((nt0 == "U") | (nt1 == "U"), "with_U").when((nt0 == "E") & (nt1 == "E"), "all_E").when((nt0 == "I") & (nt1 == "I"), "all_I").otherwise("mixed")


def kinds_by_signature(parts: DataFrame) -> DataFrame:
    """signature, kind, mass and share of decomposed motifs."""
    from ..functions.signature import branch

    ins = [direction(F.col(f"l{n}"), F.col("lvl")) for n in range(2)]
    outs = [direction(F.col("lvl"), F.col(f"m{n}")) for n in range(2)]
    rows = parts.groupBy(F.concat_ws("->", branch(ins), branch(outs)).alias("signature"), fan_in_kind(F.col("nt0"), F.col("nt1")).alias("kind")).agg(F.sum("motif_count").alias("mass"))
    return rows.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("signature")))


def direction_tests(ratio: DataFrame) -> dict[str, float]:
    """Tests of direction against excitation on ``ratio_by_direction``: chi-square over all directions, Fisher's over forward and backward."""
    n = {r["direction"]: (r["n_e"], r["n_i"]) for r in ratio.collect()}  # three rows
    cell = lambda d: n.get(d, (0, 0))
    chi, freedom, p = statistics.chi_square([list(cell(d)) for d in ("FWD", "LAT", "BWD")])
    odds, p_fisher = statistics.fisher(*cell("FWD"), *cell("BWD"))
    return {"chi2": chi, "freedom": freedom, "p_chi2": p, "odds": odds, "p_fisher": p_fisher}


def waist_shares(parts: DataFrame) -> DataFrame:
    """area, lvl (the waist), type (signature), e (mass-weighted excitatory share of the fan-in), mass."""
    from ..functions.signature import branch

    ins = [direction(F.col(f"l{n}"), F.col("lvl")) for n in range(2)]
    outs = [direction(F.col("lvl"), F.col(f"m{n}")) for n in range(2)]
    excitatory = ((F.col("nt0") == "E").cast("int") + (F.col("nt1") == "E").cast("int")) / 2.0
    return parts.groupBy("area", "lvl", F.concat_ws("->", branch(ins), branch(outs)).alias("type")).agg((F.sum(excitatory * F.col("motif_count")) / F.sum("motif_count")).alias("e"), F.sum("motif_count").alias("mass"))


def waist_pairs(rows: DataFrame) -> DataFrame:
    """area, lvl, type_a, ea, type_b, eb of waists that have both signatures; ``rows``: ``waist_shares``."""
    a = rows.select("area", "lvl", F.col("type").alias("type_a"), F.col("e").alias("ea"))
    b = rows.select("area", "lvl", F.col("type").alias("type_b"), F.col("e").alias("eb"))
    return a.join(b, ["area", "lvl"]).where("type_a < type_b")


def within_waist(parts: DataFrame) -> DataFrame:
    """type_a, type_b, n_waists, mean_delta: for waists that have both signatures, the difference of their mass-weighted excitatory shares of fan-in."""
    return waist_pairs(waist_shares(parts)).groupBy("type_a", "type_b").agg(F.count(F.lit(1)).alias("n_waists"), F.avg(F.col("ea") - F.col("eb")).alias("mean_delta"))


def paired_tests(parts: DataFrame) -> DataFrame:
    """type_a, type_b, n, statistic, z: signed ranks of the differences within waists."""
    return statistics.wilcoxon(waist_pairs(waist_shares(parts)), "ea", "eb", "type_a", "type_b")


def excitation_gap(parts: DataFrame) -> DataFrame:
    """One row: raw (mass-weighted excitatory share of fan-in, forward less backward motifs), n and parity (the mean difference in waists that have both); null without such motifs."""
    rows = waist_shares(parts).where(F.col("type").isin("FWD->FWD", "BWD->BWD"))
    of = lambda t, x: F.sum(F.when(F.col("type") == t, x))
    share = lambda t: of(t, F.col("e") * F.col("mass")) / of(t, F.col("mass"))
    raw = rows.agg((share("FWD->FWD") - share("BWD->BWD")).alias("raw")).withColumn("_one", F.lit(1))
    pairs = waist_pairs(rows).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("eb") - F.col("ea")).alias("parity")).withColumn("_one", F.lit(1))
    return raw.join(pairs, "_one").drop("_one")
