"""Whole analyses: result tables by name, and their distilled artefacts on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics
from ..operators import compare, compression, distill, graph, levels, motifs, paths, transmitters
from ..sources.artefacts import write_summary, write_table
from ..sources.graph_tables import Graph
from ..sources.scratch import cut


def search(g: Graph, window: str = "1-2-3", grouping: str = "group", k_in: int = 2, k_out: int = 2, max_jump: int = 1, min_count: int = 10, limit: int | None = None, engine: str = "join") -> DataFrame:
    """All motif rows; ``limit``: only the first waists that have enough neighbours; ``engine``: see ``motifs.bowtie_counts``."""
    nodes = graph.working_set(g, window, grouping)
    edges = graph.between_metanodes(graph.with_ends(graph.edges_binary(g), nodes), max_jump)
    waists = graph.first_waists(graph.metagraph_degree(graph.metagraph_edges(edges)), k_in, k_out, limit) if limit else None
    return motifs.motif_rows(motifs.bowtie_counts(edges, nodes, k_in, k_out, min_count, waists, engine), graph.metanodes(nodes), k_in, k_out)


def distilled(found: DataFrame, window: str, k_in: int = 2, k_out: int = 2, top_signature: int = distill.TOP_SIGNATURE, top_waist: int = distill.TOP_WAIST, top_global: int = distill.TOP_GLOBAL, top_waist_signature: int = distill.TOP_WAIST_SIGNATURE, **parameters: int) -> dict[str, DataFrame]:
    """Aggregates, top lists and the summary of motif rows; nothing is lost if there are no rows, tables are then empty."""
    waist = ["bottleneck_area", "bottleneck_level"]
    return {
        "by_signature": distill.by_signature(found), "by_waist": distill.by_waist(found), "chains": distill.level_chains(found, k_in, k_out),
        "top_per_signature": distill.top(found, top_signature, "signature"), "top_per_waist": distill.top(found, top_waist, *waist),
        "top_per_waist_signature": distill.top(found, top_waist_signature, *waist, "signature"), "top_global": distill.top(found, top_global),
        "summary": distill.summary(found, window, k_in=k_in, k_out=k_out, top_signature=top_signature, top_waist=top_waist, top_global=top_global, top_waist_signature=top_waist_signature, **parameters),
    }


def write_distilled(found: DataFrame, root: str, window: str, fmt: str = "parquet", gzip: bool = False, rows_too: bool = False, **parameters: int) -> dict[str, str]:
    """Write all distilled tables; the motif rows are checkpointed once, and written only if asked for."""
    found = cut(found)
    tables = distilled(found, window, **parameters)
    out = {n: write_summary(t, root, window) if n == "summary" else write_table(t, root, window, n, fmt, gzip) for n, t in tables.items()}
    if rows_too:
        out["motifs"] = write_table(found, root, window, "motifs", fmt, gzip, partition_by=["signature"])
    return out


def signature_report(found: DataFrame, n: int = 50) -> dict[str, DataFrame]:
    return {"summary": distill.share(distill.by_signature(found), "mass"), "by_type": distill.by(found, "signature", "hourglass_type"), "top": distill.top(found, n, "signature")}


def compression_report(found: DataFrame, sizes: DataFrame, min_waist: int = 20, n: int = 50) -> dict[str, DataFrame]:
    rows = compression.nominal(found, sizes)
    large = rows.where(F.col("n_waist") >= min_waist)
    return {"histogram": compression.histogram(rows), "top_count": distill.top(rows, n, "signature"), "top_compression": distill.top(large, n, "signature", value="compression"), "top_density": distill.top(large, n, "signature", value="density"), "best": distill.top(large, 1, "signature", value="compression")}


def level_report(g: Graph, found: DataFrame | None = None) -> dict[str, DataFrame]:
    moves = levels.transitions(g)
    out = {"classes": levels.class_crosstab(g), "transitions": moves, "density": levels.transition_density(moves, levels.sizes(g)), "granularity": levels.granularity(g), "thresholds": levels.thresholds(g)}
    if found is not None:
        chains = distill.level_chains(found)
        out |= {"chains": distill.share(chains, "mass"), "directions": distill.share(levels.chain_directions(chains), "mass"), "motif_transitions": levels.motif_transitions(found)}
    return out


def transmitter_report(g: Graph, least_score: float = 0.5, glut_excitatory: bool = False, strat_min: int = 50) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Tables, and tests of direction against excitation (chi-square, Fisher) and of the paired groups (Wilcoxon)."""
    edges = transmitters.directed_edges(g, least_score, glut_excitatory)
    ratio, paired = transmitters.ratio_by_direction(edges), transmitters.stratified(edges, strat_min)
    tables = {"by_direction": transmitters.by_direction(edges), "ratio": ratio, "stratified": paired, "kitagawa": transmitters.kitagawa(edges), "by_group": transmitters.by_group(g, least_score)}
    w = statistics.wilcoxon(paired, "fracE_FWD", "fracE_BWD").first()
    return tables, {**transmitters.direction_tests(ratio), "n_groups": w["n"], "wilcoxon": w["statistic"], "p_wilcoxon": w["p"]}


def core_report(g: Graph, tau: float = 0.9, least: int = 5, routing: str = "levels", hops: int = 5, sources: tuple[str, ...] = paths.SOURCES, targets: tuple[str, ...] = paths.TARGETS, max_core: int = 300, max_flat_core: int = 4000) -> dict[str, DataFrame]:
    edges = cut(paths.forward_edges(g, least, routing))
    first, last = paths.ends(g, sources, targets)
    core = paths.tau_core(edges, first, last, tau, hops, max_core)
    flat = paths.flat_core(edges, first, last, tau, hops, max_flat_core)
    return {"core": core, "flat": flat, "curve": paths.hourglass_curve(core, flat), "by_group": paths.core_by_group(core, g)}


def micro_macro_report(both: DataFrame, keys: list[str], k: int = 20) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Ranks side by side; overlap of the k best with its hypergeometric p, and Spearman's rho with p by Student's t."""
    overlap, rho = compare.top_overlap(both, keys, k), compare.spearman(both)
    return {"ranks": compare.ranked(both), "overlap": overlap, "spearman": rho}, {**compare.overlap_test(overlap), **compare.spearman_test(rho)}


def check_values(spark: SparkSession, claimed: dict[str, float], found: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """name, claimed, found, passed: documented numbers against data."""
    rows = [(k, float(v), float(found[k]) if k in found else None, k in found and abs(float(found[k]) - float(v)) <= tolerance * max(1.0, abs(float(v)))) for k, v in claimed.items()]
    return spark.createDataFrame(rows, "name string, claimed double, found double, passed boolean")
