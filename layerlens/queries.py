"""Registered queries over the order graph, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import oracles as S
from .functions import signature, statistics, taxonomy
from .operators import compare, compression, distill, graph, levels, motifs, nulls, paths, patterns, states, sweep, transmitters, validation, within_area
from .sources.artefacts import load_table, write_summary, write_table
from .sources.graph_tables import Graph, order_graph, read_csv_table
from .sources.scratch import cut, shared_folder

WINDOW, DEEP, HOPS = "1-2-3", "3-4-5", S.HOPS
Query = Callable[[Graph], DataFrame]


def rd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.withColumns({f.name: F.round(f"`{f.name}`", digits) for f in df.schema if isinstance(f.dataType, DoubleType)})


class Run:
    """What most queries start from."""

    def __init__(self, g: Graph, grouping: str = "group", window: str | None = WINDOW):
        self.g, self.nodes = g, graph.working_set(g, window, grouping)
        self.edges = graph.between_metanodes(graph.with_ends(graph.edges_binary(g), self.nodes))
        self.sizes = graph.metanodes(self.nodes)

    def motifs(self, k_in: int = 2, k_out: int = 2, min_count: int = 1, engine: str = "join") -> DataFrame:
        return motifs.motif_rows(motifs.bowtie_counts(self.edges, self.nodes, k_in, k_out, min_count, engine=engine), self.sizes, k_in, k_out)

    def top_patterns(self, n: int = 20) -> DataFrame:
        return distill.top(distill.with_waist(self.motifs()), n, "waist").drop("waist")

    def parts(self) -> DataFrame:
        return transmitters.motif_decomposition(self.edges, self.nodes, transmitters.node_classes(self.g))

    def degree(self) -> DataFrame:
        return graph.metagraph_degree(graph.metagraph_edges(self.edges))


def _paths(g: Graph, routing: str = "levels") -> tuple[DataFrame, DataFrame, DataFrame]:
    return (paths.forward_edges(g, routing=routing), *paths.ends(g))


def _central(g: Graph, routing: str = "levels") -> DataFrame:
    e, s, t = _paths(g, routing)
    return paths.centrality(paths.path_counts(e, s, HOPS), paths.path_counts(e, t, HOPS, backward=True), HOPS)


def _totals(g: Graph, routing: str = "levels") -> DataFrame:
    e, s, t = _paths(g, routing)
    return paths.total_paths(paths.path_counts(e, s, HOPS), t)


def _unbounded(g: Graph) -> DataFrame:
    """v, layer, log10_n: paths of any length from the sources along falling scores."""
    e, s, _ = _paths(g, "score")
    return paths.settled(e, s).where("m > 0").select("v", "layer", paths.log10_count(F.col("m"), F.col("e")).alias("log10_n"))


def _both(g: Graph) -> DataFrame:
    run = Run(g)
    micro = run.motifs().groupBy(F.col("bottleneck_area").alias("area"), F.col("bottleneck_level").alias("lvl")).agg(F.sum("motif_count").alias("micro"))
    macro = _central(g).join(run.nodes.withColumnRenamed("root_id", "v"), "v").groupBy("area", "lvl").agg(F.sum("p").alias("macro"))
    return compare.side_by_side(micro, macro, ["area", "lvl"])


def _profiles(g: Graph) -> DataFrame:
    members = within_area.membership(g)
    edges = within_area.area_edges(g, members)
    # areas whose nodes all lack neighbours on a side have an empty profile
    return within_area.profile(within_area.signature_counts(within_area.neighbour_counts(edges)))


#: Replicates of every null, of the validation of motifs, and rounds of swaps (a round proposes one swap for each two edges).
REPLICATES, VALIDATED, ROUNDS = 20, 100, 20


def _core(g: Graph, tau: float = 0.9, routing: str = "levels", **kw) -> DataFrame:
    return paths.tau_core(*_paths(g, routing), tau=tau, hops=HOPS, **kw)


def _flat(g: Graph, tau: float = 0.9, routing: str = "levels") -> DataFrame:
    return paths.flat_core(*_paths(g, routing), tau=tau, hops=HOPS)


def _curve_null(g: Graph, n: int = REPLICATES, taus: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """tau, rep (-1: the graph itself), core, flat, h, p: the hourglass curve against graphs whose nodes keep their in-degrees and draw predecessors anew; p counts replicates with an h as large.  All replicates go through the same jobs."""
    e, s, t = _paths(g)
    drawn = nulls.rewired_by_order(nulls.replicates(e, n), g.levels.select("root_id", F.col("y_level").alias("lvl")))
    edges = cut(e.withColumn("rep", F.lit(-1)).unionByName(drawn))
    first, last = (nulls.replicates(x, n, -1) for x in (s, t))
    core, flat = (f(edges, first, last, tau=max(taus), hops=HOPS) for f in (paths.tau_core, paths.flat_core))
    rows = cut(paths.hourglass_curve(core, flat, taus, n))
    seen = rows.where("rep < 0").select("tau", F.col("h").alias("_h"))
    null = rows.where("rep >= 0").join(seen, "tau").groupBy("tau").agg(((1 + F.count_if(F.col("h") >= F.col("_h"))) / (1 + F.count("h"))).alias("p"))
    return rows.join(null, "tau", "left")


def _label_null_shares(g: Graph, n: int = REPLICATES) -> tuple[DataFrame, DataFrame]:
    """Profiles of areas (area, signature, n, share), and signature shares (area, rep, signature, value) with their levels dealt anew."""
    every = within_area.drawn_profiles(g, n)
    return every.where("rep < 0").drop("rep"), every.where("rep >= 0").select("area", "rep", "signature", F.col("share").alias("value"))


def _label_null(g: Graph) -> DataFrame:
    """Observed signature shares of areas against levels dealt anew."""
    real, null = _label_null_shares(g)
    return compare.empirical(real.select("area", "signature", F.col("share").alias("observed")), null, ["area", "signature"])


def _flows(edges: DataFrame, *keys: str) -> list[DataFrame]:
    """Flows into and out of nodes, for each of ``keys`` (such as a replicate)."""
    return [edges.groupBy(*keys, F.col(i).alias("i"), F.col(a).alias("area"), F.col(l).alias("lvl")).agg(F.count(F.lit(1)).alias("v")) for i, a, l in (("post", "sa", "sl"), ("pre", "da", "dl"))]  # noqa: E741


def _pattern_counts(run: Run, top: DataFrame, flows: list[DataFrame]) -> DataFrame:
    """structure_str, rep, value: counts of the motifs ``top`` (with rep) in replicates of the flows in and out; motifs without any are left out."""
    members = run.nodes.select(F.col("root_id").alias("i"), F.col("area").alias("bottleneck_area"), F.col("lvl").alias("bottleneck_level"))
    rows = top.join(members, ["bottleneck_area", "bottleneck_level"]).withColumn("p", F.lit(1).cast("long"))
    for e in ("fan_in_0", "fan_in_1", "fan_out_0", "fan_out_1"):
        flow = flows["out" in e].select("rep", "i", F.col("area").alias(f"{e}_area"), F.col("lvl").alias(f"{e}_level"), "v")
        rows = rows.join(flow, ["rep", "i", f"{e}_area", f"{e}_level"]).withColumn("p", F.col("p") * F.col("v")).drop("v")
    return rows.groupBy("structure_str", "rep").agg(F.sum("p").alias("value"))


def _null_counts(g: Graph, which: str, n: int = VALIDATED) -> DataFrame:
    """Counts of the 20 largest motifs of each signature against a null of n replicates: A swaps, B blocks, C alignment."""
    run = Run(g)
    top, edges = cut(distill.top(run.motifs(), 20, "signature")), cut(run.edges)
    if which == "C":
        out = validation.aligned_counts(top, [motifs.flow_in(edges), motifs.flow_out(edges)], run.nodes, n)
    elif which == "A":
        out = validation.swapped_counts(top, edges, run.nodes, n, ROUNDS)
    else:
        out = validation.block_counts(top, edges, run.nodes, n)
    return cut(nulls.replicates(top.select("structure_str", "signature", F.col("motif_count").alias("observed")), n).join(out, ["structure_str", "rep"], "left").withColumn("value", F.coalesce("value", F.lit(0))))


def _mixing(g: Graph) -> DataFrame:
    """rounds, kept, ratio: how far swaps have mixed the graph: edges still there, and the median ratio of swapped to real counts of the 20 largest motifs of each waist."""
    run = Run(g)
    top, edges = nulls.replicates(cut(run.top_patterns()), 1), cut(run.edges)

    def ratio(drawn: DataFrame) -> float | None:
        between = graph.between_metanodes(graph.with_ends(drawn, run.nodes)).withColumn("rep", F.lit(0))
        counts = top.join(_pattern_counts(run, top, _flows(between, "rep")), ["structure_str", "rep"], "left")
        return counts.agg(F.median(F.coalesce("value", F.lit(0)) / F.col("motif_count")).alias("r")).first()["r"]

    return nulls.mixing(edges.select("pre", "post"), measure=ratio).withColumnRenamed("measured", "ratio")


def _validation(g: Graph, which: str) -> DataFrame:
    every = _null_counts(g, which)
    keys = ["structure_str", "signature"]
    return compare.q_values(compare.empirical(every.select(*keys, "observed").distinct(), every.select(*keys, "rep", "value"), keys))


def _validation_signatures(g: Graph, which: str) -> DataFrame:
    """signature, n, median, least and most ratio of real to mean null counts of its motifs, and share of them with q under 0.05."""
    rows = _validation(g, which)
    return rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("ratio"), F.min("ratio").alias("least"), F.max("ratio").alias("most"), F.avg((F.col("q") < 0.05).cast("double")).alias("significant"))


#: name: (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    REGISTRY[name] = (query, sql)


def oracle_of(name: str) -> str | None:
    return REGISTRY[name][1]


# tables and edges
add("neurons_view", lambda g: g.neurons, S.q(S.VIEWS, "SELECT * FROM neurons"))
add("levels_view", lambda g: rd(g.levels, 9), S.q(S.VIEWS, S.rounded("SELECT * FROM levels", "score", digits=9)))
add("classification_view", lambda g: g.classification, S.q(S.VIEWS, "SELECT * FROM classification"))
add("connections_view", lambda g: g.connections, S.q(S.VIEWS, "SELECT * FROM connections"))
add("working_set", lambda g: Run(g).nodes, S.q(S.work(), "SELECT root_id, area, lvl FROM work"))
add("grouping_superclass", lambda g: Run(g, "superclass").sizes, S.q(S.work("superclass"), "SELECT area, lvl, n FROM sizes"))
add("grouping_superregion", lambda g: Run(g, "superregion").sizes, S.q(S.work("superregion"), "SELECT area, lvl, n FROM sizes"))
add("edges_bin", graph.edges_binary, S.q(S.VIEWS, "SELECT pre, post FROM ebin"))
add("edges_sum_min_syn", lambda g: graph.edges_summed(g, 5), S.q(S.VIEWS, "SELECT * FROM esyn WHERE syn >= 5"))
add("edges_syn_all", graph.edges_summed, S.q(S.VIEWS, "SELECT * FROM esyn"))
add("superregion_map", lambda g: g.neurons.where("grp IS NOT NULL AND grp <> 'NO_CONS'").select("grp").distinct().select("grp", taxonomy.super_region(F.col("grp")).alias("region"), taxonomy.super_region_label(taxonomy.super_region(F.col("grp"))).alias("label"), taxonomy.macro_area(F.col("grp")).alias("macro")),
    S.q(S.VIEWS, "SELECT DISTINCT grp, array_to_string(r, '.') AS region, array_to_string(list_transform(r, lambda x: CASE x WHEN 'OL' THEN 'Optic Lobe' WHEN 'AL' THEN 'Antennal Lobe' WHEN 'MB' THEN 'Mushroom Body' ELSE 'Lateral Horn' END), ' + ') AS label, substring(regexp_extract(grp, '^[^._]+'), 1, 3) AS macro FROM region"))
_PLACES = "known(place, region, name) AS (VALUES " + ", ".join(f"('{p}', '{r}', '{taxonomy.NAMES[r]}')" for r, places in taxonomy.PLACES.items() for p in places) + ")"
_USED = "used AS (SELECT unnest(string_split(grp, '.')) AS place, 1.0::DOUBLE / len(string_split(grp, '.')) AS w FROM region)"
add("place_table", lambda g: rd(taxonomy.place_table(g.neurons)), S.q(f"{S.VIEWS}, {_PLACES}, {_USED}", "SELECT place, region, name, round(coalesce(SUM(w), 0), 6) AS n FROM known LEFT JOIN used USING (place) GROUP BY ALL"))
_CHECKED = f"""{S.VIEWS}, {_PLACES}, {_USED}, data AS (SELECT DISTINCT 'connections' AS source, regexp_replace(neuropil, '_(L|R)$', '') AS place FROM connections WHERE neuropil IS NOT NULL UNION SELECT 'neurons', place FROM used),
apart AS (SELECT source, place, 'data' AS side FROM data WHERE place NOT IN (SELECT place FROM known) UNION ALL SELECT s.source, k.place, 'table' FROM (SELECT DISTINCT source FROM data) s, known k WHERE (s.source, k.place) NOT IN (SELECT (source, place) FROM data))"""
add("place_check", lambda g: taxonomy.place_check(g.neurons, g.connections), S.q(_CHECKED, "SELECT source, place, side FROM apart"))
add("places_known", lambda g: taxonomy.places_known(taxonomy.place_check(g.neurons, g.connections)), S.q(_CHECKED, "SELECT source, COUNT(*) FILTER (side = 'data') = 0 AS known FROM apart GROUP BY source"))
add("neuropil_counts", lambda g: rd(taxonomy.place_counts(g.neurons)), S.q(S.VIEWS, "SELECT place, round(SUM(w), 6) AS n FROM (SELECT unnest(string_split(grp, '.')) AS place, 1.0::DOUBLE / len(string_split(grp, '.')) AS w FROM region) GROUP BY place"))
# metagraph and flows
add("metanodes", lambda g: Run(g).sizes, S.q(S.work(), "SELECT area, lvl, n FROM sizes"))
add("metagraph_edges", lambda g: graph.metagraph_edges(Run(g).edges), S.q(S.work(), "SELECT * FROM meta"))
add("metagraph_degree", lambda g: Run(g).degree(), S.q(S.work(), "SELECT area, lvl, SUM(i)::BIGINT AS n_in, SUM(o)::BIGINT AS n_out FROM (SELECT da AS area, dl AS lvl, 1 AS i, 0 AS o FROM meta UNION ALL SELECT sa, sl, 0, 1 FROM meta) GROUP BY ALL"))
add("metagraph_top", lambda g: graph.metagraph_edges(Run(g).edges).orderBy(F.desc("n"), "sa", "sl", "da", "dl").limit(60), S.q(S.work(), "SELECT * FROM meta ORDER BY n DESC, sa, sl, da, dl LIMIT 60"))
add("first_waists", lambda g: graph.first_waists(Run(g).degree(), 2, 2, 5), S.q(S.work(), "SELECT i.area, i.lvl FROM (SELECT da AS area, dl AS lvl FROM meta GROUP BY ALL HAVING COUNT(*) >= 2) i JOIN (SELECT sa AS area, sl AS lvl FROM meta GROUP BY ALL HAVING COUNT(*) >= 2) o USING (area, lvl) ORDER BY 1, 2 LIMIT 5"))
add("flow_in", lambda g: motifs.flow_in(Run(g).edges), S.q(S.work(), "SELECT * FROM fin"))
add("flow_out", lambda g: motifs.flow_out(Run(g).edges), S.q(S.work(), "SELECT * FROM fout"))
# motifs
for _name, _kw in {"bowtie_2x2": {}, "bowtie_2x1": {"k_out": 1}, "bowtie_1x2": {"k_in": 1}, "bowtie_3x1": {"k_in": 3, "k_out": 1}, "bowtie_2x2_min_count": {"min_count": 10}}.items():
    add(_name, lambda g, kw=_kw: Run(g).motifs(**kw), S.motif("SELECT * FROM mot", **_kw))
for _name, _engine, _kw in (("bowtie_dense", "matrix", {}), ("bowtie_dense_3x1", "matrix", {"k_in": 3, "k_out": 1}), ("bowtie_measured", "measured", {})):
    add(_name, lambda g, engine=_engine, kw=_kw: Run(g).motifs(engine=engine, **kw), S.motif("SELECT * FROM mot", **_kw))
add("waist_density", lambda g: rd((lambda r: motifs.waist_density(r.edges, r.nodes))(Run(g)), 9), S.q(S.work() + """,
wide AS (SELECT w.area, w.lvl, w.root_id AS i, x.n AS x, y.n AS y FROM work w JOIN (SELECT i, COUNT(*) AS n FROM fin GROUP BY i) x ON x.i = w.root_id JOIN (SELECT i, COUNT(*) AS n FROM fout GROUP BY i) y ON y.i = w.root_id WHERE x.n >= 2 AND y.n >= 2),
met_in AS (SELECT d.area, d.lvl, COUNT(DISTINCT (f.area, f.lvl)) AS n FROM wide d JOIN fin f USING (i) GROUP BY d.area, d.lvl),
met_out AS (SELECT d.area, d.lvl, COUNT(DISTINCT (f.area, f.lvl)) AS n FROM wide d JOIN fout f USING (i) GROUP BY d.area, d.lvl),
measured AS (SELECT area, lvl, COUNT(*) AS n_nodes, CAST(SUM(x * (x - 1) / 2 * y * (y - 1) / 2) AS DOUBLE) AS star_rows, any_value(CAST(a.n * (a.n - 1) / 2 * b.n * (b.n - 1) / 2 AS DOUBLE)) AS cells FROM wide JOIN met_in a USING (area, lvl) JOIN met_out b USING (area, lvl) GROUP BY area, lvl)""",
    "SELECT *, round(star_rows / (n_nodes * cells), 9) AS density, star_rows / (n_nodes * cells) >= 0.02 AND star_rows >= 4 * cells AS dense FROM measured"))
for _name, _grouping in {"bowtie_superclass": "superclass", "bowtie_superregion": "superregion"}.items():
    add(_name, lambda g, grouping=_grouping: Run(g, grouping).motifs(min_count=2), S.motif("SELECT * FROM mot", grouping=_grouping, min_count=2))
add("recount", lambda g: (lambda r: motifs.recount(r.edges, r.nodes, r.top_patterns()).select("structure_str", "motif_count", "recounted", "active"))(Run(g)),
    S.motif("SELECT structure_str, motif_count, motif_count AS recounted, n_waist_active AS active FROM (SELECT *, row_number() OVER (PARTITION BY bottleneck_area, bottleneck_level ORDER BY motif_count DESC, structure_str) AS k FROM mot) WHERE k <= 20"))
def _limited(g: Graph, n: int = 5) -> DataFrame:
    """Motifs of the first n metanodes that can be a waist: only these metanodes' nodes are combined."""
    run = Run(g)
    chosen = graph.first_waists(run.degree(), 2, 2, n)
    return motifs.motif_rows(motifs.bowtie_counts(run.edges, run.nodes, 2, 2, 1, chosen), run.sizes, 2, 2)


add("bowtie_first_waists", _limited, S.motif("SELECT * FROM mot WHERE (bottleneck_area, bottleneck_level) IN (SELECT (area, lvl) FROM (SELECT i.area, i.lvl FROM (SELECT da AS area, dl AS lvl FROM meta GROUP BY ALL HAVING COUNT(*) >= 2) i JOIN (SELECT sa AS area, sl AS lvl FROM meta GROUP BY ALL HAVING COUNT(*) >= 2) o USING (area, lvl) ORDER BY 1, 2 LIMIT 5))"))
# signatures
add("signature_summary", lambda g: rd(distill.share(distill.by_signature(Run(g).motifs()), "mass")).withColumn("meaning", signature.meaning(F.col("signature"))),
    S.motif("SELECT signature, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, round(SUM(motif_count)::DOUBLE / SUM(SUM(motif_count)) OVER (), 6) AS share, CASE signature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in signature.MEANINGS.items()) + " ELSE '' END AS meaning FROM mot GROUP BY signature"))
add("signature_by_type", lambda g: distill.by(Run(g).motifs(), "signature", "hourglass_type"), S.motif("SELECT signature, hourglass_type, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, MAX(motif_count) AS mass_max FROM mot GROUP BY ALL"))
add("signature_by_waist", lambda g: distill.by(distill.with_waist(Run(g).motifs()), "waist", "signature"), S.motif("SELECT bottleneck_area || 'L' || bottleneck_level AS waist, signature, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, MAX(motif_count) AS mass_max FROM mot GROUP BY ALL"))
add("legacy_labels", lambda g: Run(g).motifs().select(F.regexp_replace(F.regexp_replace(F.regexp_replace("signature", "FWD", "FF"), "BWD", "FB"), "LAT", "lat").alias("old"), "signature").distinct().withColumn("new", signature.normalise_label(F.col("old"))),
    S.motif("SELECT DISTINCT replace(replace(replace(signature, 'FWD', 'FF'), 'BWD', 'FB'), 'LAT', 'lat') AS old, signature, signature AS new FROM mot"))
add("signature_shift", lambda g: rd(distill.signature_shift(Run(g).motifs(), Run(g, window=DEEP).motifs())),
    f"WITH a AS ({S.motif('SELECT signature, SUM(motif_count)::DOUBLE / SUM(SUM(motif_count)) OVER () AS s FROM mot GROUP BY 1')}), b AS ({S.motif('SELECT signature, SUM(motif_count)::DOUBLE / SUM(SUM(motif_count)) OVER () AS s FROM mot GROUP BY 1', window='(3,4,5)')}) SELECT coalesce(a.signature, b.signature) AS signature, round(coalesce(a.s, 0), 6) AS shallow, round(coalesce(b.s, 0), 6) AS deep, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS shift FROM a FULL JOIN b USING (signature)")
# distillation
add("agg_signature", lambda g: distill.by_signature(Run(g).motifs()), S.motif("SELECT signature, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass FROM mot GROUP BY signature"))
add("agg_waist", lambda g: distill.by_waist(Run(g).motifs()), S.motif("SELECT bottleneck_area || 'L' || bottleneck_level AS waist, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, MAX(motif_count) AS mass_max FROM mot GROUP BY ALL"))
_CHAINS = "SELECT level_fan_in, level_waist, level_fan_out, SUM(motif_count)::BIGINT AS mass FROM (SELECT motif_count, bottleneck_level AS level_waist, unnest([fan_in_0_level, fan_in_1_level, fan_in_0_level, fan_in_1_level]) AS level_fan_in, unnest([fan_out_0_level, fan_out_0_level, fan_out_1_level, fan_out_1_level]) AS level_fan_out FROM mot) GROUP BY ALL"
add("agg_chain", lambda g: distill.level_chains(Run(g).motifs()), S.motif(_CHAINS))
add("top_chains", lambda g: rd(distill.share(distill.level_chains(Run(g).motifs()), "mass")).orderBy(F.desc("mass"), "level_fan_in", "level_waist", "level_fan_out").limit(8), S.motif(f"SELECT *, round(mass::DOUBLE / SUM(mass) OVER (), 6) AS share FROM ({_CHAINS}) ORDER BY mass DESC, 1, 2, 3 LIMIT 8"))
_TOP = "SELECT structure_str, motif_count, signature FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY motif_count DESC, structure_str) AS k FROM mot) WHERE k <= {1}"
_short = lambda df: df.select("structure_str", "motif_count", "signature")
add("top_per_signature", lambda g: _short(distill.top(Run(g).motifs(), distill.TOP_SIGNATURE, "signature")), S.motif(_TOP.format("signature", 200)))
add("top_per_waist", lambda g: _short(distill.top(Run(g).motifs(), distill.TOP_WAIST, "bottleneck_area", "bottleneck_level")), S.motif(_TOP.format("bottleneck_area, bottleneck_level", 20)))
add("top_per_waist_signature", lambda g: _short(distill.top(Run(g).motifs(), distill.TOP_WAIST_SIGNATURE, "bottleneck_area", "bottleneck_level", "signature")), S.motif(_TOP.format("bottleneck_area, bottleneck_level, signature", 10)))
add("top_per_type", lambda g: _short(distill.top(Run(g).motifs(), 2000, "hourglass_type")), S.motif(_TOP.format("hourglass_type", 2000)))
add("top_global", lambda g: _short(distill.top(Run(g).motifs(), distill.TOP_GLOBAL)), S.motif("SELECT structure_str, motif_count, signature FROM mot ORDER BY motif_count DESC, structure_str LIMIT 1000"))
add("top_filtered", lambda g: _short(distill.top_rows(Run(g).motifs(), 100, 3)), S.motif("SELECT structure_str, motif_count, signature FROM mot WHERE motif_count >= 3 ORDER BY motif_count DESC, structure_str LIMIT 100"))
add("top_summary", lambda g: distill.top_summary(distill.top_rows(Run(g).motifs(), 100, 3)), S.motif("SELECT hourglass_type, COUNT(*) AS n, MIN(motif_count) AS least, MAX(motif_count) AS most, median(motif_count)::DOUBLE AS median FROM (SELECT * FROM mot WHERE motif_count >= 3 ORDER BY motif_count DESC, structure_str LIMIT 100) GROUP BY GROUPING SETS ((hourglass_type), ())"))
add("summary", lambda g: distill.summary(Run(g).motifs(), WINDOW, k_in=2, k_out=2, max_jump=1, min_count=1),
    S.motif("SELECT COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, COUNT(DISTINCT bottleneck_area || 'L' || bottleneck_level) AS n_waist, COUNT(DISTINCT signature) AS n_signatures, COUNT(DISTINCT bottleneck_area || 'L' || bottleneck_level || '|' || signature) AS n_cells, '1-2-3' AS \"window\", 2 AS k_in, 2 AS k_out, 1 AS max_jump, 1 AS min_count FROM mot"))
# states that add: two parts of the rows are distilled apart, stored and merged
def _merged_state(g: Graph) -> DataFrame:
    rows = cut(Run(g).motifs())
    return states.merged(*(cut(states.state(rows.where(F.pmod(F.xxhash64("structure_str"), F.lit(2)) == n))) for n in (0, 1)))


add("state_sums", lambda g: _merged_state(g).where("structure_str IS NULL").select("kind", "key", "n", "mass", "most"),
    S.motif(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS key, COUNT(*) AS n, SUM(motif_count)::BIGINT AS mass, MAX(motif_count) AS most FROM {rows} GROUP BY 2" for kind, key, rows in (
        ("signature", "signature", "mot"), ("waist", "bottleneck_area || 'L' || bottleneck_level", "mot"), ("cell", "bottleneck_area || 'L' || bottleneck_level || '|' || signature", "mot"), ("type", "signature || '|' || hourglass_type", "mot"),
        ("chain", "i || '>' || bottleneck_level || '>' || o", "(SELECT *, unnest([fan_in_0_level, fan_in_1_level, fan_in_0_level, fan_in_1_level]) AS i, unnest([fan_out_0_level, fan_out_0_level, fan_out_1_level, fan_out_1_level]) AS o FROM mot)")))))
add("state_tops", lambda g: _merged_state(g).where("structure_str IS NOT NULL").select("kind", "key", "structure_str", "motif_count"),
    S.motif(" UNION ALL ".join(f"SELECT 'top_{kind}' AS kind, key, structure_str, motif_count FROM (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY motif_count DESC, structure_str) AS k FROM mot) WHERE k <= {states.TOPS[kind]}" for kind, key in (
        ("signature", "signature"), ("waist", "bottleneck_area || 'L' || bottleneck_level"), ("cell", "bottleneck_area || 'L' || bottleneck_level || '|' || signature"), ("all", "''")))))
add("state_summary", lambda g: states.tables(_merged_state(g))["summary"], S.motif("SELECT COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, COUNT(DISTINCT bottleneck_area || 'L' || bottleneck_level) AS n_waist, COUNT(DISTINCT signature) AS n_signatures, COUNT(DISTINCT bottleneck_area || 'L' || bottleneck_level || '|' || signature) AS n_cells FROM mot"))
# compression
_NOMINAL = "SELECT structure_str, mot.n_waist, n_periphery, n_periphery::DOUBLE / n_waist AS compression, motif_count / (i0.n::DOUBLE * i1.n * o0.n * o1.n * n_waist) AS density, motif_count::DOUBLE / n_waist AS count_per_waist, signature FROM mot" + "".join(f" JOIN sizes {a}{n} ON {a}{n}.area = fan_{s}_{n}_area AND {a}{n}.lvl = fan_{s}_{n}_level" for a, s in (("i", "in"), ("o", "out")) for n in (0, 1))
_nominal = lambda g: (lambda r: compression.nominal(r.motifs(), r.sizes))(Run(g))
add("compression_nominal", lambda g: rd(_nominal(g).select("structure_str", "n_waist", "n_periphery", "compression", "density", "count_per_waist", "signature"), 9), S.motif(S.rounded(_NOMINAL, "compression", "density", "count_per_waist", digits=9)))
add("compression_hist", lambda g: compression.histogram(_nominal(g)),
    S.motif(f"SELECT low, high, COUNT(c) AS n FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in zip(compression.EDGES, compression.EDGES[1:]))}) b(low, high) LEFT JOIN (SELECT compression AS c FROM ({_NOMINAL})) ON c >= low AND (c < high OR (high = 1000000000 AND c <= high)) GROUP BY ALL"))
add("compression_top", lambda g: _nominal(g).withColumn("r", F.round("compression", 9)).transform(lambda d: distill.top(d.where("n_waist >= 3"), 5, "signature", value="r")).select("signature", "structure_str"),
    S.motif(f"SELECT signature, structure_str FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY round(compression, 9) DESC, structure_str) AS k FROM ({_NOMINAL}) WHERE n_waist >= 3) WHERE k <= 5"))
_real = lambda g: (lambda r: compression.realised(r.edges, r.nodes, cut(r.top_patterns())))(Run(g))
_REAL = """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bottleneck_area, bottleneck_level ORDER BY motif_count DESC, structure_str) AS k FROM mot) WHERE k <= 20),
act AS (SELECT t.*, w.root_id AS i, a.v * b.v * c.v * d.v AS p FROM top t JOIN work w ON w.area = bottleneck_area AND w.lvl = bottleneck_level
  JOIN fin a ON a.i = w.root_id AND a.area = fan_in_0_area AND a.lvl = fan_in_0_level JOIN fin b ON b.i = w.root_id AND b.area = fan_in_1_area AND b.lvl = fan_in_1_level
  JOIN fout c ON c.i = w.root_id AND c.area = fan_out_0_area AND c.lvl = fan_out_0_level JOIN fout d ON d.i = w.root_id AND d.area = fan_out_1_area AND d.lvl = fan_out_1_level),
per AS (SELECT structure_str, COUNT(DISTINCT (br, o)) AS n_periphery_real FROM (
  SELECT structure_str, 0 AS br, pre AS o FROM act JOIN e ON post = i AND sa = fan_in_0_area AND sl = fan_in_0_level UNION ALL SELECT structure_str, 1, pre FROM act JOIN e ON post = i AND sa = fan_in_1_area AND sl = fan_in_1_level
  UNION ALL SELECT structure_str, 2, post FROM act JOIN e ON pre = i AND da = fan_out_0_area AND dl = fan_out_0_level UNION ALL SELECT structure_str, 3, post FROM act JOIN e ON pre = i AND da = fan_out_1_area AND dl = fan_out_1_level) GROUP BY 1),
realised AS (SELECT structure_str, any_value(signature) AS signature, CAST(SUM(p) AS BIGINT) AS recounted, COUNT(*) AS n_active, CAST(SUM(p) AS DOUBLE) * CAST(SUM(p) AS DOUBLE) / SUM(CAST(p AS DOUBLE) * p) AS n_eff FROM act GROUP BY 1),
done AS (SELECT *, n_periphery_real / n_eff AS compression_real FROM realised JOIN per USING (structure_str))"""
add("compression_realized", lambda g: rd(_real(g).select("structure_str", "signature", "recounted", "n_active", "n_eff", "n_periphery_real", "compression_real")), S.q(S.bowtie() + _REAL, S.rounded("SELECT * FROM done", "n_eff", "compression_real")))
add("compression_by_signature", lambda g: rd(compression.realised_by_signature(_real(g), 1.0)),
    S.q(S.bowtie() + _REAL, S.rounded("SELECT signature, COUNT(*) AS n, median(compression_real) AS median, MAX(compression_real) AS largest, arg_max(structure_str, (round(compression_real, 9), structure_str)) AS best FROM done WHERE n_eff >= 1 GROUP BY signature", "median", "largest")))
# levels
add("level_sizes", levels.sizes, S.q(S.VIEWS, "SELECT y_level AS lvl, COUNT(*) AS n FROM levels GROUP BY ALL"))
_CLASS = "SELECT super_class, y_level AS lvl, COUNT(*) AS n FROM classification JOIN levels USING (root_id) WHERE y_level > 0 GROUP BY ALL"
add("level_class_crosstab", lambda g: rd(levels.class_crosstab(g, 100)), S.q(S.VIEWS, f"SELECT super_class, lvl, n, round(n / t, 6) AS share FROM (SELECT *, SUM(n) OVER (PARTITION BY super_class) AS t FROM ({_CLASS})) WHERE t >= 100"))
add("level_class_pivot", lambda g: levels.pivot_levels(levels.class_crosstab(g, 0), [1, 2, 3, 4, 5]), S.q(S.VIEWS, "SELECT super_class, " + ", ".join(f"COALESCE(SUM(n) FILTER (lvl = {x}), 0)::BIGINT AS \"{x}\"" for x in range(1, 6)) + f" FROM ({_CLASS}) GROUP BY 1"))
_MOVES = "SELECT a.y_level AS l_pre, b.y_level AS l_post, COUNT(*) AS n_edges, SUM(syn)::BIGINT AS n_syn FROM esyn JOIN levels a ON a.root_id = pre JOIN levels b ON b.root_id = post WHERE a.y_level > 0 AND b.y_level > 0 GROUP BY ALL"
add("transition_edges", levels.transitions, S.q(S.VIEWS, _MOVES))
add("transition_density", lambda g: rd(levels.transition_density(levels.transitions(g), levels.sizes(g))), S.q(S.VIEWS, f"SELECT l_pre, l_post, n_edges, round(n_edges * 10000.0::DOUBLE / CASE WHEN l_pre = l_post THEN x.n * (x.n - 1) ELSE x.n * y.n END, 6) AS density FROM ({_MOVES}) JOIN (SELECT y_level AS l, COUNT(*) AS n FROM levels GROUP BY 1) x ON x.l = l_pre JOIN (SELECT y_level AS l, COUNT(*) AS n FROM levels GROUP BY 1) y ON y.l = l_post"))
add("chain_direction", lambda g: levels.chain_directions(distill.level_chains(Run(g).motifs())), S.motif(f"SELECT {S.arrow('level_fan_in', 'level_waist')} AS \"into\", {S.arrow('level_waist', 'level_fan_out')} AS out, SUM(mass)::BIGINT AS mass FROM ({_CHAINS}) GROUP BY ALL"))
add("motif_transitions", lambda g: levels.motif_transitions(Run(g).motifs()), S.motif("SELECT side, l_from, l_to, SUM(motif_count)::BIGINT AS mass, COUNT(*) AS n_pattern FROM (" + " UNION ALL ".join([f"SELECT 'in' AS side, fan_in_{n}_level AS l_from, bottleneck_level AS l_to, motif_count FROM mot UNION ALL SELECT 'out', bottleneck_level, fan_out_{n}_level, motif_count FROM mot" for n in (0, 1)]) + ") GROUP BY ALL"))
add("level_thresholds", lambda g: rd(levels.thresholds(g)), S.q(S.VIEWS, ", ".join([]) + "SELECT a.l AS upper, (a.l + 1)::INT AS lower, round((a.low + b.high) / 2, 6) AS threshold FROM (SELECT y_level AS l, MIN(score) AS low FROM levels GROUP BY 1) a JOIN (SELECT y_level AS l, MAX(score) AS high FROM levels GROUP BY 1) b ON b.l = a.l + 1"))
for _name, _column in {"coherence_per_group": "group", "coherence_per_class": "super_class", "coherence_per_region": "superregion"}.items():
    add(_name, lambda g, c=_column: rd(levels.coherence(levels.categories(g, c))), S.q(S.VIEWS + S.coherence(_column), S.rounded("SELECT * FROM coh", "purity", "entropy", "spread")))
add("mutual_information", lambda g: rd(levels.mutual_information(levels.categories(g, "group"))), S.q(S.VIEWS + S.coherence("group"), "SELECT round(mi, 6) AS mi, round(mi / h, 6) AS nmi FROM mi, hl"))
add("granularity_summary", lambda g: rd(levels.granularity(g)),
    S.q(S.VIEWS + "".join(S.coherence(c, f"_{c}") for c in ("super_class", "superregion", "group")), S.rounded(" UNION ALL ".join(f"SELECT '{c}' AS granularity, COUNT(*) AS categories, SUM(n_levels)::BIGINT AS metanodes, median(n)::DOUBLE AS median_size, SUM(purity * n) / SUM(n) AS purity, SUM(entropy * n) / SUM(n) AS entropy, SUM(contiguous::INT * n)::DOUBLE / SUM(n) AS contiguous_share, any_value(mi / h) AS nmi FROM coh_{c}, mi_{c}, hl_{c}" for c in ("super_class", "superregion", "group")), "median_size", "purity", "entropy", "contiguous_share", "nmi")))
# transmitters
_edges = transmitters.directed_edges
add("nt_by_direction", lambda g: rd(transmitters.by_direction(_edges(g))), S.q(S.VIEWS + S.NT, "SELECT direction, nt, COUNT(*) AS n_edges, SUM(syn)::BIGINT AS n_syn, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY direction), 6) AS share_edges, round(SUM(syn)::DOUBLE / SUM(SUM(syn)) OVER (PARTITION BY direction), 6) AS share_syn FROM de GROUP BY direction, nt"))
add("nt_ratio_by_direction", lambda g: rd(transmitters.ratio_by_direction(_edges(g))),
    S.q(S.VIEWS + S.NT, "SELECT *, round(n_e / nullif(n_i, 0), 6) AS ratio_edges, round(syn_e / nullif(syn_i, 0), 6) AS ratio_syn FROM (SELECT direction, COUNT(*) FILTER (nt = 'E') AS n_e, COUNT(*) FILTER (nt = 'I') AS n_i, COALESCE(SUM(syn) FILTER (nt = 'E'), 0)::BIGINT AS syn_e, COALESCE(SUM(syn) FILTER (nt = 'I'), 0)::BIGINT AS syn_i FROM de GROUP BY 1)"))
add("nt_by_group", lambda g: rd(transmitters.by_group(g)), S.q(S.VIEWS + S.NT, "SELECT grp, y_level AS lvl, COUNT(*) AS n, " + ", ".join(f"round(COUNT(*) FILTER (nt = '{c}') / COUNT(*), 6) AS frac_{c}" for c in "EIMU") + " FROM nt JOIN levels USING (root_id) WHERE grp IS NOT NULL AND grp <> 'NO_CONS' GROUP BY ALL"))
add("nt_stratified", lambda g: rd(transmitters.stratified(_edges(g), 20)),
    S.q(S.VIEWS + S.NT, "SELECT grp, f AS n_FWD, b AS n_BWD, round(fe / f, 6) AS fracE_FWD, round(be / b, 6) AS fracE_BWD, round(fe / f - be / b, 6) AS delta FROM (SELECT grp, COUNT(*) FILTER (direction = 'FWD') AS f, COUNT(*) FILTER (direction = 'BWD') AS b, COUNT(*) FILTER (direction = 'FWD' AND nt = 'E') AS fe, COUNT(*) FILTER (direction = 'BWD' AND nt = 'E') AS be FROM dg GROUP BY 1) WHERE f >= 20 AND b >= 20"))
add("kitagawa", lambda g: rd(transmitters.kitagawa(_edges(g))),
    S.q(S.VIEWS + S.NT + """, k AS (SELECT COUNT(*) FILTER (direction = 'FWD') AS f, COUNT(*) FILTER (direction = 'BWD') AS b, COUNT(*) FILTER (direction = 'FWD' AND nt = 'E') / nullif(COUNT(*) FILTER (direction = 'FWD'), 0) AS x, COUNT(*) FILTER (direction = 'BWD' AND nt = 'E') / nullif(COUNT(*) FILTER (direction = 'BWD'), 0) AS y FROM dg WHERE direction <> 'LAT' GROUP BY grp),
k2 AS (SELECT f / SUM(f) OVER () AS wf, b / SUM(b) OVER () AS wb, coalesce(x, y) AS x, coalesce(y, x) AS y FROM k)""",
        S.rounded("SELECT COUNT(*) AS groups, SUM(wf * x) AS \"p_FWD\", SUM(wb * y) AS \"p_BWD\", SUM((wf - wb) * (x + y) / 2) AS composition, SUM((wf + wb) / 2 * (x - y)) AS within, SUM(wf * x) - SUM(wb * y) AS gap FROM k2", "p_FWD", "p_BWD", "composition", "within", "gap")))
add("motif_nt_decomposition", lambda g: Run(g).parts(), S.q(S.work() + ",\n" + S.side("fout", "pout", 2, "d", "m") + S.DECOMPOSED, "SELECT * FROM parts"))
_SIG = "(CASE WHEN {0} = {1} THEN {0} ELSE 'mix' END)"
_SIGNED = f"(SELECT *, {_SIG.format(S.arrow('l0', 'lvl').join('()'), S.arrow('l1', 'lvl').join('()'))} || '->' || {_SIG.format(S.arrow('lvl', 'm0').join('()'), S.arrow('lvl', 'm1').join('()'))} AS signature FROM parts)"
add("nt_kind_by_signature", lambda g: rd(transmitters.kinds_by_signature(Run(g).parts())),
    S.q(S.work() + ",\n" + S.side("fout", "pout", 2, "d", "m") + S.DECOMPOSED, f"SELECT *, round(mass::DOUBLE / SUM(mass) OVER (PARTITION BY signature), 6) AS share FROM (SELECT signature, CASE WHEN 'U' IN (nt0, nt1) THEN 'with_U' WHEN nt0 = 'E' AND nt1 = 'E' THEN 'all_E' WHEN nt0 = 'I' AND nt1 = 'I' THEN 'all_I' ELSE 'mixed' END AS kind, SUM(motif_count)::BIGINT AS mass FROM {_SIGNED} GROUP BY ALL)"))
add("nt_within_waist", lambda g: rd(transmitters.within_waist(Run(g).parts())),
    S.q(S.work() + ",\n" + S.side("fout", "pout", 2, "d", "m") + S.DECOMPOSED + f", t AS (SELECT area, lvl, signature, SUM(((nt0 = 'E')::INT + (nt1 = 'E')::INT) / 2.0::DOUBLE * motif_count) / SUM(motif_count) AS e FROM {_SIGNED} GROUP BY ALL)", "SELECT a.signature AS type_a, b.signature AS type_b, COUNT(*) AS n_waists, round(AVG(a.e - b.e), 6) AS mean_delta FROM t a JOIN t b ON a.area = b.area AND a.lvl = b.lvl AND a.signature < b.signature GROUP BY ALL"))
_PARTS = S.work() + ",\n" + S.side("fout", "pout", 2, "d", "m") + S.DECOMPOSED + f", t AS (SELECT area, lvl, signature, SUM(((nt0 = 'E')::INT + (nt1 = 'E')::INT) / 2.0::DOUBLE * motif_count) / SUM(motif_count) AS e, SUM(motif_count) AS mass FROM {_SIGNED} GROUP BY ALL)"
_RANKED = """SELECT {keys}, COUNT(*)::DOUBLE AS n, least(coalesce(SUM(r) FILTER (d > 0), 0), coalesce(SUM(r) FILTER (d < 0), 0)) AS statistic, COUNT(*) AS m, SUM(t * t - 1) AS ties
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r, COUNT(*) OVER (PARTITION BY {keys}, abs(d))::DOUBLE AS t FROM ({pairs}) WHERE d <> 0) GROUP BY ALL"""
_LAW = "law(n, w, ways) AS (SELECT 0, 0, 1::DOUBLE UNION ALL SELECT n + 1, x, SUM(ways) FROM (SELECT n, w + i * (n + 1) AS x, ways FROM law, range(2) t(i) WHERE n < 50) GROUP BY n + 1, x), tails AS (SELECT n, w, least(1, 2 * SUM(ways) OVER (PARTITION BY n ORDER BY w) / pow(2, n)) AS p FROM law)"
_NORMAL = "(1 - 2 * least(abs(z), 40) / 6000 / sqrt(2 * pi()) * (SELECT SUM(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(least(abs(z), 40) * i / 2000, 2) / 2)) FROM range(2001) s(i)))"
_RANKS = "SELECT {keys}, n, statistic, round(z, 6) AS z, round(CASE WHEN ties = 0 AND n <= 50 THEN (SELECT p FROM tails WHERE tails.n = t.n AND tails.w = t.statistic) ELSE " + _NORMAL + " END, 6) AS p FROM (SELECT *, (statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM (" + _RANKED + ")) t"
add("nt_paired_tests", lambda g: rd(transmitters.paired_tests(Run(g).parts())), S.q(_PARTS + ",\n" + _LAW, recursive=True, body=_RANKS.format(keys="type_a, type_b", pairs="SELECT a.signature AS type_a, b.signature AS type_b, a.e - b.e AS d FROM t a JOIN t b ON a.area = b.area AND a.lvl = b.lvl AND a.signature < b.signature")))
_GAPS = ("1-2-3", "2-3-4", "3-4-5")
add("nt_gap_by_window", lambda g: rd(reduce(DataFrame.unionByName, (transmitters.excitation_gap(Run(g, window=w).parts()).withColumn("window", F.lit(w)) for w in _GAPS))),
    " UNION ALL ".join("SELECT * FROM (" + S.q(S.work(window=f"({w.replace('-', ',')})") + _PARTS[len(S.work()):], f"SELECT round((SELECT SUM(e * mass) / SUM(mass) FROM t WHERE signature = 'FWD->FWD') - (SELECT SUM(e * mass) / SUM(mass) FROM t WHERE signature = 'BWD->BWD'), 6) AS raw, COUNT(*) AS n, round(AVG(b.e - a.e), 6) AS parity, '{w}' AS \"window\" FROM t a JOIN t b ON a.area = b.area AND a.lvl = b.lvl AND a.signature = 'BWD->BWD' AND b.signature = 'FWD->FWD'") + ")" for w in _GAPS))
_row = lambda g, values, schema: g.neurons.sparkSession.createDataFrame([tuple(float(v) for v in values.values())], schema)
add("nt_direction_tests", lambda g: rd(_row(g, transmitters.direction_tests(transmitters.ratio_by_direction(_edges(g))), "chi2 double, freedom double, p_chi2 double, odds double, p_fisher double")),
    S.q(S.VIEWS + S.NT + """, k AS (SELECT direction, COUNT(*) FILTER (nt = 'E')::DOUBLE AS e, COUNT(*) FILTER (nt = 'I')::DOUBLE AS i FROM de GROUP BY 1),
s AS (SELECT SUM(e) AS se, SUM(i) AS si, SUM(e + i) AS n FROM k),
c AS (SELECT SUM((e - (e + i) * se / n) * (e - (e + i) * se / n) / ((e + i) * se / n) + (i - (e + i) * si / n) * (i - (e + i) * si / n) / ((e + i) * si / n)) AS chi2, COUNT(*) - 1.0::DOUBLE AS freedom FROM k, s WHERE e + i > 0),
f AS (SELECT SUM(e) FILTER (direction = 'FWD') AS a, SUM(i) FILTER (direction = 'FWD') AS b, SUM(e) FILTER (direction = 'BWD') AS c, SUM(i) FILTER (direction = 'BWD') AS d FROM k),
xs AS (SELECT f.*, unnest(range(greatest(0, a - d)::BIGINT, least(a + b, a + c)::BIGINT + 1))::DOUBLE AS x FROM f),
h AS (SELECT a, x, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM xs)""",
        "SELECT round(chi2, 6) AS chi2, freedom, round(exp(-chi2 / 2), 6) AS p_chi2, round(a * d / (b * c), 6) AS odds, round(least(1, (SELECT SUM(p) FROM h WHERE p <= (SELECT p FROM h WHERE x = a) * (1 + 1e-7))), 6) AS p_fisher FROM c, f"))
add("nt_group_test", lambda g: rd(statistics.wilcoxon(transmitters.stratified(_edges(g), 20), "fracE_FWD", "fracE_BWD")),
    S.q(S.VIEWS + S.NT + ",\n" + _LAW, recursive=True, body="SELECT n, statistic, z, p FROM (" + _RANKS.format(keys="one", pairs="SELECT 1 AS one, fe / f - be / b AS d FROM (SELECT grp, COUNT(*) FILTER (direction = 'FWD') AS f, COUNT(*) FILTER (direction = 'BWD') AS b, COUNT(*) FILTER (direction = 'FWD' AND nt = 'E') AS fe, COUNT(*) FILTER (direction = 'BWD' AND nt = 'E') AS be FROM dg GROUP BY 1) WHERE f >= 20 AND b >= 20") + ")"))
# sweep
_shapes = lambda g, k: (lambda r: sweep.pure_shapes(r.edges, r.nodes, k))(Run(g))


def _pure(k: int, inward: bool) -> str:
    """(k, 1) or (1, k) counts by waist, by enumeration."""
    ki, ko = (k, 1) if inward else (1, k)
    apart = " AND ".join(f"NOT (a{x} = d{y} AND l{x} = m{y})" for x in range(ki) for y in range(ko))
    name = f"{'int' if inward else 'bro'}_k{k}"
    return f"{name} AS (WITH {S.side('fin', 'pi', ki, 'a', 'l')}, {S.side('fout', 'po', ko, 'd', 'm')} SELECT area, lvl, SUM(pi.p * po.p)::DOUBLE AS v FROM pi JOIN po USING (i) JOIN work w ON w.root_id = i WHERE {apart} GROUP BY ALL)"


_KS = (2, 3, 4, 5)
_PURE = ",\n".join(_pure(k, x) for k in _KS for x in (True, False))
_COLUMNS = [f"{x}_k{k}" for k in _KS for x in ("int", "bro")]
_WAISTS = ", ws AS (SELECT DISTINCT w.area, w.lvl FROM work w JOIN fin ON fin.i = w.root_id JOIN fout ON fout.i = w.root_id), deg AS (SELECT area, lvl, SUM(x)::DOUBLE AS n_in, SUM(y)::DOUBLE AS n_out FROM (SELECT da AS area, dl AS lvl, 1 AS x, 0 AS y FROM meta UNION ALL SELECT sa, sl, 0, 1 FROM meta) GROUP BY ALL)"
_SHAPES = "SELECT area, lvl, " + ", ".join(f"coalesce({n}.v, 0) AS {n}" for n in _COLUMNS) + " FROM ws" + "".join(f" LEFT JOIN {n} USING (area, lvl)" for n in _COLUMNS)
add("sweep_pure_shapes", lambda g: rd(_shapes(g, 5)), S.q(S.work() + _WAISTS + ",\n" + _PURE, _SHAPES))
_C = {k: "(" + " * ".join(f"({{0}} - {i})" for i in range(k)) + f" / {math.factorial(k)})" for k in _KS}
_NORM = " + ".join("coalesce(int_k{k} / nullif({c} * n_out, 0), 0)".format(k=k, c=_C[k].format("n_in")) for k in _KS), " + ".join("coalesce(bro_k{k} / nullif({c} * n_in, 0), 0)".format(k=k, c=_C[k].format("n_out")) for k in _KS)
_REGIMES = f"SELECT *, coalesce((ni - nb) / nullif(ni + nb, 0), 0) AS index_norm FROM (SELECT *, {_NORM[0]} AS ni, {_NORM[1]} AS nb, {' + '.join(_COLUMNS)} AS total FROM ({_SHAPES}) JOIN deg USING (area, lvl))"
_regimes = lambda g: sweep.regimes(_shapes(g, 5), Run(g).degree(), 5)
add("sweep_regimes", lambda g: rd(_regimes(g).select("area", "lvl", "total", "index_norm", "regime")), S.q(S.work() + _WAISTS + ",\n" + _PURE, f"SELECT area, lvl, total, round(index_norm, 6) AS index_norm, CASE WHEN index_norm <= -0.33 THEN 'broadcast' WHEN index_norm <= 0.33 THEN 'mixed' ELSE 'integrative' END AS regime FROM ({_REGIMES})"))
add("regime_per_area", lambda g: rd(sweep.by_area(_regimes(g))), S.q(S.work() + _WAISTS + ",\n" + _PURE, f"SELECT area, COUNT(*) AS n, round(SUM(index_norm * total) / nullif(SUM(total), 0), 6) AS index_norm FROM ({_REGIMES}) GROUP BY 1"))
_ENDED = "SELECT area, lvl, round(index_norm, 9) AS index_norm FROM (" + _REGIMES + ")"
add("regime_extremes", lambda g: rd(sweep.extremes(_regimes(g).withColumn("index_norm", F.round("index_norm", 9)))), S.q(S.work() + _WAISTS + ",\n" + _PURE + f", r AS ({_ENDED})", " UNION ALL ".join(f"SELECT '{side}' AS side, rank::INT AS rank, area, lvl, round(index_norm, 6) AS index_norm FROM (SELECT *, row_number() OVER (ORDER BY index_norm {order}, area, lvl) AS rank FROM r) WHERE rank <= 12" for side, order in (("integrative", "DESC"), ("broadcast", "ASC")))))
_BY_AREA = f"SELECT area, COUNT(*) AS n, round(SUM(index_norm * total) / nullif(SUM(total), 0), 9) AS index_norm FROM ({_REGIMES}) GROUP BY 1 HAVING COUNT(*) >= 2"
add("regime_area_ends", lambda g: rd(sweep.area_ends(sweep.by_area(_regimes(g)).withColumn("index_norm", F.round("index_norm", 9)))), S.q(S.work() + _WAISTS + ",\n" + _PURE + f", r AS ({_BY_AREA})", " UNION ALL ".join(f"(SELECT '{end}' AS \"end\", area, n, round(index_norm, 6) AS index_norm FROM r ORDER BY r.index_norm {order} LIMIT {n})" for end, order, n in (("head", "DESC, area", 10), ("tail", "ASC, area DESC", 8)))))
# within areas
add("area_membership", within_area.membership, S.q(S.VIEWS + S.AREA, "SELECT root_id, area, lvl FROM mem"))
add("reciprocal_edges", lambda g: within_area.reciprocal(graph.edges_binary(g)), S.q(S.VIEWS, "SELECT x.pre, x.post FROM ebin x JOIN ebin y ON x.pre = y.post AND x.post = y.pre"))
add("within_area_counts", lambda g: _profiles(g).select("area", "signature", "n"), S.q(S.VIEWS + S.WITHIN, "SELECT area, signature, n FROM prof"))
add("within_area_profile", lambda g: rd(_profiles(g)), S.q(S.VIEWS + S.WITHIN, "SELECT area, signature, n, round(share, 6) AS share FROM shares"))
_ENRICHED = "SELECT *, share / nullif(expected, 0) AS enrichment FROM shares JOIN (SELECT signature, SUM(n) / SUM(SUM(n)) OVER () AS expected FROM prof GROUP BY 1) USING (signature)"
add("within_area_enrichment", lambda g: rd(within_area.enrichment(_profiles(g))), S.q(S.VIEWS + S.WITHIN, S.rounded(_ENRICHED, "share", "expected", "enrichment")))
add("within_area_characteristic", lambda g: rd(within_area.characteristic(within_area.enrichment(_profiles(g)))), S.q(S.VIEWS + S.WITHIN, f"SELECT area, signature, round(share, 6) AS share, round(enrichment, 6) AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(enrichment, 9) DESC, signature) AS k FROM ({_ENRICHED}) WHERE share >= 0.01) WHERE k = 1"))
add("within_area_flat", lambda g: rd(within_area.flat_areas(within_area.enrichment(_profiles(g)))), S.q(S.VIEWS + S.WITHIN, f"SELECT area, round(MAX(abs(ln(enrichment))), 6) AS deviation FROM ({_ENRICHED}) WHERE share >= 0.01 AND enrichment > 0 GROUP BY 1 HAVING MAX(abs(ln(enrichment))) < 0.35"))
add("within_area_census", lambda g: rd(within_area.census(g, 20)), S.q(S.VIEWS + S.WITHIN, "SELECT m.area, m.n AS n_nodes, k.n AS n_edges, t.n AS total, round(t.n / m.n, 6) AS per_node FROM (SELECT area, COUNT(*) AS n FROM mem GROUP BY 1) m JOIN (SELECT area, COUNT(*) AS n FROM ae GROUP BY 1) k USING (area) JOIN (SELECT area, SUM(n) AS n FROM prof GROUP BY 1) t USING (area) WHERE m.n >= 20"))
# paths
_TOTALS = "SELECT h, SUM(n) AS n FROM a WHERE v IN (SELECT v FROM tgt) GROUP BY h"
_SCORE = S.VIEWS + S.paths("score")
add("paths_levels", _totals, S.q(S.VIEWS + S.PATHS, _TOTALS))
add("path_centrality", _central, S.q(S.VIEWS + S.PATHS, "SELECT v, p FROM cen"))
add("paths_score", lambda g: _totals(g, "score"), S.q(_SCORE, _TOTALS))
add("path_centrality_score", lambda g: _central(g, "score"), S.q(_SCORE, "SELECT v, p FROM cen"))
add("topological_layers", lambda g: paths.topological_layers(paths.forward_edges(g, routing="score")), S.q(_SCORE + S.UNBOUNDED, "SELECT v, MAX(h)::INT AS layer FROM deep GROUP BY v", recursive=True))
add("paths_unbounded", lambda g: rd(_unbounded(g)), S.q(_SCORE + S.UNBOUNDED, "SELECT v, coalesce(layer, 0)::INT AS layer, round(log10(n), 6) AS log10_n FROM fros LEFT JOIN (SELECT v, MAX(h) AS layer FROM deep GROUP BY v) USING (v)", recursive=True))
add("centrality_unbounded", lambda g: rd(paths.unbounded_centrality(*_paths(g, "score"))), S.q(_SCORE + S.UNBOUNDED, "SELECT v, round(log10(a.n * b.n), 6) AS log10_p, round(a.n * b.n / (SELECT SUM(n) FROM fros WHERE v IN (SELECT v FROM tgt)), 6) AS share FROM fros a JOIN bacs b USING (v)", recursive=True))
add("tau_core", _core)
add("flat_core", _flat)
add("score_core", lambda g: _core(g, routing="score"))
add("hscore_curve", lambda g: paths.hourglass_curve(_core(g, tau=0.95), _flat(g, tau=0.95)))
add("hscore_random", _curve_null)
add("core_by_group", lambda g: paths.core_by_group(_core(g), g))
# comparison
add("micro_macro", lambda g: rd(compare.ranked(_both(g))).withColumns({c: F.col(c).cast("long") for c in ("rank_micro", "rank_macro")}), S.q(S.bowtie() + S.PATHS + S.BOTH, "SELECT area, lvl, micro, macro, rank() OVER (ORDER BY micro DESC) AS rank_micro, rank() OVER (ORDER BY macro DESC) AS rank_macro FROM two"))
add("topk_overlap", lambda g: rd(compare.top_overlap(_both(g), ["area", "lvl"], 10)),
    S.q(S.bowtie() + S.PATHS + S.BOTH, "SELECT (SELECT COUNT(*) FROM (SELECT area, lvl FROM two ORDER BY micro DESC, area, lvl LIMIT 10) JOIN (SELECT area, lvl FROM two ORDER BY macro DESC, area, lvl LIMIT 10) USING (area, lvl)) AS shared, COUNT(*) AS n, 10 AS k, round(100.0::DOUBLE / COUNT(*), 6) AS expected FROM two"))
add("spearman", lambda g: rd(compare.spearman(_both(g))), S.q(S.bowtie() + S.PATHS + S.BOTH, "SELECT round(corr(a, b), 6) AS rho, COUNT(*) AS n FROM (SELECT rank() OVER (ORDER BY micro) + (COUNT(*) OVER (PARTITION BY micro) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY macro) + (COUNT(*) OVER (PARTITION BY macro) - 1) / 2.0::DOUBLE AS b FROM two)"))
_LOG_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
add("topk_overlap_test", lambda g: rd(_row(g, compare.overlap_test(compare.top_overlap(_both(g), ["area", "lvl"], 10)), "shared double, p_overlap double")),
    S.q(S.bowtie() + S.PATHS + S.BOTH + ", o AS (SELECT (SELECT COUNT(*) FROM (SELECT area, lvl FROM two ORDER BY micro DESC, area, lvl LIMIT 10) JOIN (SELECT area, lvl FROM two ORDER BY macro DESC, area, lvl LIMIT 10) USING (area, lvl))::DOUBLE AS shared, COUNT(*)::DOUBLE AS n FROM two)",
        f"SELECT shared, round((SELECT SUM(exp({_LOG_CHOOSE.format('10', 'x')} + {_LOG_CHOOSE.format('(n - 10)', '(10 - x)')} - {_LOG_CHOOSE.format('n', '10')})) FROM (SELECT unnest(range(shared::BIGINT, 11))::DOUBLE AS x) WHERE n - 20 + x >= 0), 6) AS p_overlap FROM o"))
add("spearman_test", lambda g: rd(_row(g, compare.spearman_test(compare.spearman(_both(g))), "rho double, p_rho double")),
    S.q(S.bowtie() + S.PATHS + S.BOTH + ", rk AS (SELECT rank() OVER (ORDER BY micro) + (COUNT(*) OVER (PARTITION BY micro) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY macro) + (COUNT(*) OVER (PARTITION BY macro) - 1) / 2.0::DOUBLE AS b FROM two), r AS (SELECT corr(a, b) AS rho, COUNT(*)::DOUBLE - 2 AS f FROM rk), t AS (SELECT *, abs(rho) * sqrt(f / (1 - rho * rho)) AS t FROM r)",
        "SELECT round(rho, 6) AS rho, round(1 - 2 * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) * t / 6000 * (SELECT SUM(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 2000, 2) / f, -(f + 1) / 2)) FROM range(2001) s(i)), 6) AS p_rho FROM t"))
add("bh_qvalues", lambda g: rd(compare.q_values(Run(g).sizes.select("area", "lvl", (1.0 / (F.col("n") + 1)).alias("p"))), 9),
    S.q(S.work(), "SELECT area, lvl, round(p, 9) AS p, round(least(MIN(p * m / r) OVER (ORDER BY p DESC, r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 9) AS q FROM (SELECT area, lvl, p, COUNT(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM (SELECT area, lvl, 1.0::DOUBLE / (n + 1) AS p FROM sizes))"))
# patterns
_tree = lambda e, k: lambda g: patterns.tree_count(graph.edges_binary(g), e, k)
add("hom_path3", _tree(((0, 1), (1, 2), (2, 3)), 4), S.q(S.VIEWS, "SELECT COUNT(*)::DOUBLE AS n FROM ebin a JOIN ebin b ON a.post = b.pre JOIN ebin c ON b.post = c.pre"))
add("hom_star", _tree(((0, 1), (0, 2), (0, 3)), 4), S.q(S.VIEWS, "SELECT COUNT(*)::DOUBLE AS n FROM ebin a JOIN ebin b ON a.pre = b.pre JOIN ebin c ON b.pre = c.pre"))
add("hom_bowtie", _tree(((0, 2), (1, 2), (2, 3), (2, 4)), 5), S.q(S.VIEWS, "SELECT SUM(x.n::DOUBLE * x.n * y.n * y.n) AS n FROM (SELECT post AS v, COUNT(*) AS n FROM ebin GROUP BY 1) x JOIN (SELECT pre AS v, COUNT(*) AS n FROM ebin GROUP BY 1) y USING (v)"))
add("hom_reciprocal", _tree(((0, 1), (1, 0), (1, 2)), 3), S.q(S.VIEWS, "SELECT COUNT(*)::DOUBLE AS n FROM ebin a JOIN ebin b ON a.pre = b.post AND a.post = b.pre JOIN ebin c ON c.pre = a.post"))
add("hom_diamond", lambda g: patterns.diamond_count(graph.edges_binary(g)), S.q(S.VIEWS, "SELECT SUM(n::DOUBLE * n) AS n FROM (SELECT a.pre, b.post, COUNT(*) AS n FROM ebin a JOIN ebin b ON a.post = b.pre GROUP BY ALL)"))
add("hom_triangle_brute", lambda g: patterns.brute_count(graph.edges_binary(g), ((0, 1), (1, 2), (2, 0)), 3), S.q(S.VIEWS, "SELECT COUNT(*)::DOUBLE AS n FROM ebin a JOIN ebin b ON a.post = b.pre JOIN ebin c ON b.post = c.pre AND c.post = a.pre"))
_CATALOGUE = [(e, k) for k in (3, 4) for e in patterns.all_patterns(k)]


def _brute_sql(edges: patterns.Edges, k: int) -> str:
    """Homomorphisms by a join for each arc, in an order that keeps the pattern connected."""
    todo, seen, tables = list(edges), {}, []
    while todo:
        a, b = next(e for e in todo if not seen or set(e) & set(seen))
        todo.remove((a, b))
        t = f"e{len(tables)}"
        met = [f"{t}.{c} = {seen[x]}" for x, c in ((a, "pre"), (b, "post")) if x in seen]
        tables.append(f"ebin {t}" + (" ON " + " AND ".join(met) if met else ""))
        seen = {a: f"{t}.pre", b: f"{t}.post"} | seen
    return f"SELECT '{';'.join(f'{a}>{b}' for a, b in edges)}' AS pattern, {k} AS nodes, COUNT(*)::DOUBLE AS n FROM {' JOIN '.join(tables)}"


add("pattern_counts", lambda g: patterns.pattern_counts(graph.edges_binary(g), _CATALOGUE), S.q(S.VIEWS.replace("ebin AS (", "ebin AS MATERIALIZED ("), " UNION ALL ".join(_brute_sql(e, k) for e, k in _CATALOGUE)))
_COUNTED = REGISTRY["pattern_counts"]
add("pattern_catalogue", lambda g: patterns.catalogue(g.neurons.sparkSession).join(_COUNTED[0](g), ["pattern", "nodes"]), f"SELECT c.*, p.n FROM ({S.CATALOGUE}) c JOIN ({_COUNTED[1]}) p USING (pattern, nodes)")
# nulls
add("null_edge_swap", lambda g: nulls.swapped(graph.edges_binary(g), ROUNDS))
add("null_block", lambda g: nulls.block_rewired(Run(g).edges, Run(g).nodes))
add("null_alignment", lambda g: nulls.aligned(motifs.flow_in(Run(g).edges), Run(g).nodes, REPLICATES))
add("null_label_perm", _label_null)
add("null_levels", lambda g: levels.null_reference(levels.categories(g, "group"), REPLICATES))
add("null_levels_test", lambda g: levels.null_test(levels.categories(g, "group"), REPLICATES))
add("null_mixing", _mixing)
add("null_indegree", lambda g: nulls.rewired_by_order(paths.forward_edges(g), g.levels.select("root_id", F.col("y_level").alias("lvl"))))
add("validation_blocks", lambda g: _validation(g, "B"))
add("validation_alignment", lambda g: _validation(g, "C"))
add("validation_swaps", lambda g: _validation(g, "A"))
add("validation_signatures", lambda g: _validation_signatures(g, "B"))
_null_enriched = lambda g: within_area.enrichment(*_label_null_shares(g))
add("within_area_null_enrichment", lambda g: rd(_null_enriched(g)))
add("within_area_null_characteristic", lambda g: rd(within_area.characteristic(_null_enriched(g))))
add("within_area_null_flat", lambda g: rd(within_area.flat_areas(_null_enriched(g))))
# what nulls leave as it is
_DEGREES = "SELECT v, SUM(i)::BIGINT AS n_in, SUM(o)::BIGINT AS n_out FROM (SELECT post AS v, 1 AS i, 0 AS o FROM {0} UNION ALL SELECT pre, 0, 1 FROM {0}) GROUP BY v"
_ends = lambda e: e.select(F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.lit(i).alias("i"), F.lit(o).alias("o")) for v, i, o in (("post", 1, 0), ("pre", 0, 1)))))).select("col.*")
add("null_edge_swap_degrees", lambda g: _ends(nulls.swapped(graph.edges_binary(g), ROUNDS).distinct()).groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")), S.q(S.VIEWS, _DEGREES.format("ebin")))
add("null_block_sizes", lambda g: graph.metagraph_edges(nulls.block_rewired(Run(g).edges, Run(g).nodes).distinct()), S.q(S.work(), "SELECT * FROM meta"))
_waist = lambda g: Run(g).nodes.select(F.col("root_id").alias("i"), F.col("area").alias("wa"), F.col("lvl").alias("wl"))
add("null_alignment_values", lambda g: nulls.aligned(motifs.flow_in(Run(g).edges), Run(g).nodes, 2).join(_waist(g), "i").groupBy("rep", "wa", "wl", "area", "lvl", "v").agg(F.count_distinct("i").alias("n")),
    S.q(S.work(), "SELECT rep::INT AS rep, w.area AS wa, w.lvl AS wl, fin.area, fin.lvl, v, COUNT(*) AS n FROM fin JOIN work w ON w.root_id = fin.i, range(2) r(rep) GROUP BY ALL"))
add("null_label_levels", lambda g: nulls.permuted_levels(within_area.membership(g), 2).groupBy("rep", "area", "lvl").agg(F.count_distinct("root_id").alias("n")), S.q(S.VIEWS + S.AREA, "SELECT rep::INT AS rep, area, lvl, COUNT(*) AS n FROM mem, range(2) r(rep) GROUP BY ALL"))
add("null_indegree_degrees", lambda g: REGISTRY["null_indegree"][0](g).distinct().join(g.levels.select(F.col("root_id").alias("pre"), F.col("y_level").alias("a")), "pre").join(g.levels.select(F.col("root_id").alias("post"), F.col("y_level").alias("b")), "post").where("a < b").groupBy("post").agg(F.count(F.lit(1)).alias("n")),
    S.q(S.VIEWS + S.PATHS, "SELECT post, COUNT(*) AS n FROM fe GROUP BY post"))


# sources and sinks: written to the shared folder and read back
def _place(g: Graph) -> tuple[SparkSession, str]:
    spark = g.neurons.sparkSession
    return spark, f"{shared_folder(spark)}/layerlens-artefacts-{uuid.uuid4().hex}"


def _from_csv(g: Graph, table: str, rows: DataFrame, gzip: bool = False) -> DataFrame:
    spark, root = _place(g)
    return read_csv_table(spark, write_table(rows, root, WINDOW, table, "csv", gzip), table)


def _appended(g: Graph) -> DataFrame:
    spark, root = _place(g)
    for odd in (0, 1):
        path = write_table(g.classification.where(F.col("root_id") % 2 == odd), root, WINDOW, "classification", "csv", append=odd == 1)
    return read_csv_table(spark, path, "classification")


def _by_key(g: Graph) -> DataFrame:
    spark, root = _place(g)
    write_table(Run(g).motifs(), root, WINDOW, "motifs", partition_by=["signature"])
    return distill.by_signature(load_table(spark, root, WINDOW, "motifs"))


def _as_csv(g: Graph) -> DataFrame:
    (spark, root), rows = _place(g), distill.by_waist(Run(g).motifs())
    write_table(rows, root, WINDOW, "by_waist", "csv", gzip=True)
    return load_table(spark, root, WINDOW, "by_waist", "csv", rows.schema)


def _as_json(g: Graph) -> DataFrame:
    (spark, root), rows = _place(g), REGISTRY["summary"][0](g)
    return spark.read.schema(rows.schema).json(write_summary(rows, root, WINDOW))


def _old_artefact(g: Graph) -> DataFrame:
    spark, root = _place(g)
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace("signature", "FWD", "FF"), "BWD", "FB"), "LAT", "lat")
    write_table(distill.by_signature(Run(g).motifs()).withColumn("signature", old), root, WINDOW, "by_signature")
    return load_table(spark, root, WINDOW, "by_signature")


add("csv_scan", lambda g: _from_csv(g, "neurons", g.neurons.withColumnRenamed("grp", "group")), S.q(S.VIEWS, "SELECT * FROM neurons"))
add("csv_projection", lambda g: _from_csv(g, "connections", g.connections.select(F.lit("x").alias("other"), "syn_count", "neuropil", "post_root_id", "pre_root_id")).select("pre_root_id", "syn_count"), S.q(S.VIEWS, "SELECT pre_root_id, syn_count::INT AS syn_count FROM connections"))
add("csv_parts", lambda g: _from_csv(g, "connections", g.connections.repartition(16)).groupBy("neuropil").agg(F.count(F.lit(1)).alias("n"), F.sum("syn_count").alias("syn")), S.q(S.VIEWS, "SELECT neuropil, COUNT(*) AS n, SUM(syn_count)::BIGINT AS syn FROM connections GROUP BY 1"))
add("csv_gzip", lambda g: _from_csv(g, "levels", g.levels, True), S.q(S.VIEWS, "SELECT root_id, score, y_level FROM levels"))
add("csv_append", _appended, S.q(S.VIEWS, "SELECT * FROM classification"))
add("sink_per_key", _by_key, oracle_of("agg_signature"))
add("csv_table", _as_csv, oracle_of("agg_waist"))
add("json_summary", _as_json, oracle_of("summary"))
add("catalog_old_labels", _old_artefact, oracle_of("agg_signature"))
add("waist_labels", lambda g: (lambda label: Run(g).sizes.select(label.alias("waist"), *(c.alias(n) for c, n in zip(signature.parse_node_label(label), ("area", "lvl")))))(signature.node_label(F.col("area"), F.col("lvl"))), S.q(S.work(), "SELECT area || 'L' || lvl AS waist, area, lvl FROM sizes"))
add("signature_filter", lambda g: distill.by_waist(distill.with_signature(cut(Run(g).motifs()), "mix->FF")), S.motif("SELECT bottleneck_area || 'L' || bottleneck_level AS waist, COUNT(*) AS n_pattern, SUM(motif_count)::BIGINT AS mass, MAX(motif_count) AS mass_max FROM mot WHERE signature = 'mix->FWD' GROUP BY ALL"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(order_graph(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
