"""Bow-ties of five distinct nodes inside each area, by signature, in closed form from nine counts a node.

A node's neighbours fall into nine disjoint classes: at a lower, the same or a
higher level, and only sending to it, only receiving from it, or both.  Two
senders are drawn from the classes that send; what is left of the classes that
receive, less the mutual neighbours already drawn, is where two receivers come
from.  So all five nodes differ by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import tokens
from ..sources.graph_tables import Graph
from ..sources.scratch import cut, drop
from . import nulls
from .graph import edges_binary

BRANCHES = ("FWD", "LAT", "BWD", "mix")
SIGNATURES = tuple(f"{a}->{b}" for a in BRANCHES for b in BRANCHES)


def membership(graph: Graph) -> DataFrame:
    """area, root_id, lvl: a node is in every area that its group names."""
    rows = graph.neurons.where(F.col("grp").isNotNull() & (F.col("grp") != "NO_CONS")).select("root_id", F.explode(F.array_distinct(tokens(F.col("grp")))).alias("area"))
    return rows.join(graph.levels.where(F.col("y_level").isNotNull()).select("root_id", F.col("y_level").alias("lvl")), "root_id")


def area_edges(graph: Graph, members: DataFrame) -> DataFrame:
    """area, pre, post, l_pre, l_post: edges with both ends in the area; loops do not count."""
    side = lambda key, name: members.select("area", F.col("root_id").alias(key), F.col("lvl").alias(name))
    edges = edges_binary(graph).where("pre <> post")
    return edges.join(side("pre", "l_pre"), "pre").join(side("post", "l_post"), ["area", "post"])


def reciprocal(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges whose reverse is there too."""
    back = edges.select(*keys, F.col("post").alias("pre"), F.col("pre").alias("post")).distinct()
    return edges.join(back, [*keys, "pre", "post"], "left_semi")


PLACES = ("low", "level", "high")
#: Direction of an edge from, and to, a neighbour at each place.
SENDS = dict(zip(PLACES, ("FWD", "LAT", "BWD")))
RECEIVES = dict(zip(PLACES, ("BWD", "LAT", "FWD")))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """area, i and the sizes of the nine classes of its neighbours: from_*, to_* and both_* for each of ``PLACES``."""
    ends = F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"l_{i}").alias("own"), F.col(f"l_{j}").alias("other"), F.lit(w).alias("way")) for i, j, w in (("post", "pre", 1), ("pre", "post", 2))))
    pairs = edges.select("area", F.explode(ends).alias("x")).select("area", "x.*").groupBy("area", "i", "j", "own", "other").agg(F.sum("way").alias("way"))
    place = F.when(F.col("other") < F.col("own"), "low").when(F.col("other") > F.col("own"), "high").otherwise("level")
    size = lambda way, at: F.count_if((F.col("way") == way) & (F.col("place") == at)).cast("double")
    return pairs.withColumn("place", place).groupBy("area", "i").agg(*(size(w, at).alias(f"{name}_{at}") for w, name in ((1, "from"), (2, "to"), (3, "both")) for at in PLACES))


def drawn_counts(edges: DataFrame, n: int, bits: int) -> DataFrame:
    """area, i, rep and the nine counts of ``neighbour_counts`` for each of n packed draws of levels; ``edges``: code (named area after it), pre, post, d_pre, d_post."""
    names = [f"{name}_{at}" for name in ("from", "to", "both") for at in PLACES]
    ends = F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"d_{i}").alias("own"), F.col(f"d_{j}").alias("other"), F.lit(w).alias("way")) for i, j, w in (("post", "pre", 1), ("pre", "post", 2))))
    rows = edges.select("code", F.explode(ends).alias("x")).select("code", "x.*").repartition("code", "i").sortWithinPartitions("code", "i", "j")

    def counts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code, i, j = (table.column(c).to_numpy() for c in ("code", "i", "j"))
        node = np.concatenate([[True], (code[1:] != code[:-1]) | (i[1:] != i[:-1])])
        pair = np.flatnonzero(node | np.concatenate([[True], j[1:] != j[:-1]]))
        way = np.add.reduceat(table.column("way").to_numpy(), pair)
        own, other = (nulls.unpack(nulls.byte_rows(table.column(c).combine_chunks()), n, bits)[pair] for c in ("own", "other"))
        kind = ((way - 1) * 3)[:, None].astype(np.int8) + 1 + (other > own) - (other < own)
        start = np.flatnonzero(node[pair])
        found = [np.add.reduceat(kind == k, start, axis=0, dtype=np.int64).ravel().astype(float) for k in range(len(names))]
        first = pair[start]
        head = [np.repeat(code[first], n), np.repeat(i[first], n), np.tile(np.arange(n, dtype=np.int32), len(first))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*head, *found)], names=["area", "i", "rep", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a node that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            code, i = (batch.column(c).to_numpy() for c in ("code", "i"))
            if held and (held[-1].column("code")[-1].as_py(), held[-1].column("i")[-1].as_py()) != (code[0], i[0]):
                yield from counts(pa.Table.from_batches(held))
                held = []
            new = np.flatnonzero((code[1:] != code[:-1]) | (i[1:] != i[:-1]))
            if len(new):
                yield from counts(pa.Table.from_batches([*held, batch.slice(0, new[-1] + 1)]))
                held, batch = [], batch.slice(new[-1] + 1)
            held.append(batch)
        if held:
            yield from counts(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "area int, i long, rep int, " + ", ".join(f"{c} double" for c in names))


def drawn_profiles(graph: Graph, n: int, seed: int = 42) -> DataFrame:
    """area, rep, signature, n, share of areas whose levels are dealt anew n times; rep -1 has the real ones.

    An edge is read once for all draws: its ends carry theirs, packed."""
    drawn, areas, _, bits = nulls.level_draws(membership(graph), n, seed)
    drawn, spark = cut(drawn), graph.neurons.sparkSession
    side = lambda key: drawn.select("code", F.col("root_id").alias(key), F.col("drawn").alias(f"d_{key}"))
    edges = edges_binary(graph).where("pre <> post").join(side("pre"), "pre").join(side("post"), ["code", "post"])
    cell = (F.col("area") * (n + 1) + F.col("rep")).alias("area")
    counts = drawn_counts(edges, n + 1, bits)
    found = cut(profile(signature_counts(counts.select(cell, *(c for c in counts.columns if c not in ("area", "rep"))))))
    drop(drawn)
    names = spark.createDataFrame(list(enumerate(areas)), "code int, name string")
    found = found.withColumns({"code": F.floor(F.col("area") / (n + 1)).cast("int"), "rep": (F.col("area") % (n + 1) - 1).cast("int")}).join(F.broadcast(names), "code")
    return found.select(F.col("name").alias("area"), "rep", "signature", "n", "share")


def _branch(a: str, b: str) -> str:
    return a if a == b else "mix"


def _sender_pairs() -> dict[tuple[str, ...], dict[str, Column]]:
    """Number of pairs of senders by the places of the mutual ones among them, and by branch."""
    kinds = [(name, at) for name in ("from", "both") for at in PLACES]
    out: dict[tuple[str, ...], dict[str, Column]] = {}
    for n, (x, p) in enumerate(kinds):
        for y, q in kinds[n:]:
            one, two = F.col(f"{x}_{p}"), F.col(f"{y}_{q}")
            ways = one * (one - 1) / 2 if (x, p) == (y, q) else one * two
            used = tuple(at for name, at in ((x, p), (y, q)) if name == "both")
            own, branch = out.setdefault(used, {}), _branch(SENDS[p], SENDS[q])
            own[branch] = own[branch] + ways if branch in own else ways
    return out


def _receiver_pairs(used: tuple[str, ...]) -> dict[str, Column]:
    """Number of pairs of receivers by branch when mutual neighbours at the places ``used`` are taken."""
    left = {at: F.col(f"to_{at}") + F.col(f"both_{at}") - used.count(at) for at in PLACES}
    out = {RECEIVES[at]: n * (n - 1) / 2 for at, n in left.items()}
    low, level, high = left.values()
    return out | {"mix": low * level + level * high + low * high}


def signature_counts(counts: DataFrame) -> DataFrame:
    """area, i and the 16 counts."""
    total = {s: F.lit(0.0) for s in SIGNATURES}
    for used, senders in _sender_pairs().items():
        receivers = _receiver_pairs(used)
        for a, ways in senders.items():
            for b, rest in receivers.items():
                # without senders of the kind there is nothing left to count
                total[f"{a}->{b}"] += F.when(ways > 0, ways * rest).otherwise(0.0)
    return counts.select("area", "i", *(total[s].alias(s) for s in SIGNATURES))


def profile(per_node: DataFrame) -> DataFrame:
    """area, signature, n, share."""
    sums = per_node.groupBy("area").agg(*(F.sum(f"`{s}`").alias(s) for s in SIGNATURES))
    stacked = F.explode(F.array(*(F.struct(F.lit(s).alias("signature"), F.col(f"`{s}`").alias("n")) for s in SIGNATURES)))
    rows = sums.select("area", stacked.alias("x")).select("area", "x.*")
    return rows.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("area")), F.lit(0.0)))


def enrichment(areas: DataFrame, null: DataFrame | None = None) -> DataFrame:
    """Add expected and the ratio of the area's share to it.

    Expected is the mean share of the same area and signature over the replicates
    of ``null`` (area, signature, value), if given, else the signature's share of
    all areas together."""
    if null is not None:
        expected = null.groupBy("area", "signature").agg(F.avg("value").alias("expected"))
        return areas.join(expected, ["area", "signature"]).withColumn("enrichment", F.col("share") / F.nullif("expected", F.lit(0.0)))
    total = areas.groupBy("signature").agg(F.sum("n").alias("_n"))
    whole = total.withColumn("expected", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))).select("signature", "expected")
    return areas.join(whole, "signature").withColumn("enrichment", F.col("share") / F.nullif("expected", F.lit(0.0)))


def characteristic(enriched: DataFrame, least: float = 0.01) -> DataFrame:
    """area, signature, enrichment: the most enriched signature with a share of ``least`` or more."""
    rows = enriched.where(F.col("share") >= least)
    best = F.row_number().over(Window.partitionBy("area").orderBy(F.desc(F.round("enrichment", 9)), "signature"))
    return rows.withColumn("_rank", best).where("_rank = 1").select("area", "signature", "share", "enrichment")


def census(graph: Graph, least: int = 200) -> DataFrame:
    """area, n_nodes, n_edges, total and total per node of areas with ``least`` nodes or more."""
    members = membership(graph)
    sizes = members.groupBy("area").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)
    edges = area_edges(graph, members.join(sizes.select("area"), "area", "left_semi"))
    totals = profile(signature_counts(neighbour_counts(edges))).groupBy("area").agg(F.sum("n").alias("total"))
    out = sizes.join(edges.groupBy("area").agg(F.count(F.lit(1)).alias("n_edges")), "area").join(totals, "area")
    return out.withColumn("per_node", F.col("total") / F.col("n_nodes"))


def flat_areas(enriched: DataFrame, least: float = 0.01, limit: float = 0.35) -> DataFrame:
    """area, deviation: areas whose common signatures all lie within ``limit`` of the expected share (natural logarithm)."""
    rows = enriched.where((F.col("share") >= least) & (F.col("enrichment") > 0))
    return rows.groupBy("area").agg(F.max(F.abs(F.log("enrichment"))).alias("deviation")).where(F.col("deviation") < limit)
