"""Paths from sources to targets, of bounded or of any length, path centrality and cores that cover them.

Bounded counts are kept by node and number of hops; a hop is one join with the
edges and one sum.  Edges go strictly forward, so walks are paths.  Counts are
doubles: they pass 2**63 on large graphs.  Counts of any length pass 2**1024 too;
``settled`` keeps them as a mantissa and an exponent.

Tables may have a column ``rep``: replicates are counted and covered side by side
in the same jobs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.graph_tables import Graph
from ..sources.scratch import cut, drop, scratch_path
from .graph import edges_summed

SOURCES, TARGETS = ("sensory",), ("motor", "descending")


def forward_edges(graph: Graph, least: int = 5, routing: str = "levels") -> DataFrame:
    """pre, post: pairs with ``least`` contacts whose ends have a level, from lower to higher level (or from higher to lower score)."""
    if routing not in ("levels", "score"):
        raise ValueError("routing is levels or score")
    levels = graph.levels.where(F.col("y_level").isNotNull())
    value = F.col("y_level") if routing == "levels" else -F.col("score")
    side = lambda key, name: levels.select(F.col("root_id").alias(key), value.alias(name))
    return edges_summed(graph, least).join(side("pre", "a"), "pre").join(side("post", "b"), "post").where("a < b").select("pre", "post")


def ends(graph: Graph, sources: tuple[str, ...] = SOURCES, targets: tuple[str, ...] = TARGETS) -> tuple[DataFrame, DataFrame]:
    """Source and target nodes (v) that have a level; a node of both kinds is a source."""
    rows = graph.levels.where(F.col("y_level").isNotNull()).select("root_id").join(graph.classification, "root_id")
    pick = lambda names: rows.where(F.col("super_class").isin(*names)).select(F.col("root_id").alias("v")).distinct()
    first = pick(sources)
    return first, pick(targets).join(first, "v", "left_anti")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("rep",) if c in df.columns]


def path_counts(edges: DataFrame, start: DataFrame, hops: int, backward: bool = False) -> DataFrame:
    """(rep,) v, h, n: paths of h hops from the start nodes to v (``backward``: from v to them)."""
    near, far, keys = *(("post", "pre") if backward else ("pre", "post")), _keys(edges)
    now, out = start.select(*keys, "v", F.lit(1.0).alias("n")), []
    out.append(now.withColumn("h", F.lit(0)))
    for h in range(1, hops + 1):
        now = now.join(edges.withColumnRenamed(near, "v"), [*keys, "v"]).groupBy(*keys, F.col(far).alias("v")).agg(F.sum("n").alias("n"))
        out.append(now.withColumn("h", F.lit(h)))
    return reduce(DataFrame.unionByName, out).select(*keys, "v", "h", "n")


def total_paths(a: DataFrame, targets: DataFrame) -> DataFrame:
    """(rep,) h, n: paths that end in a target, by length."""
    keys = _keys(a)
    return a.join(targets, [*keys, "v"], "left_semi").groupBy(*keys, "h").agg(F.sum("n").alias("n"))


def centrality(a: DataFrame, b: DataFrame, hops: int) -> DataFrame:
    """(rep,) v, p: source-to-target paths of at most ``hops`` hops through v."""
    keys = [*_keys(a), "v"]
    right = b.select(*keys, F.col("h").alias("h2"), F.col("n").alias("n2"))
    return a.join(right, keys).where(F.col("h") + F.col("h2") <= hops).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n2")).alias("p"))


#: Most central nodes that one job condenses a network to, and heaviest ends of each kind of the flat network that one job weighs against each other.
FOLLOWED, FOLLOWED_ENDS = 512, 2048


class _Cover:
    """Greedy covers of all replicates: what is chosen, and how much of the whole it covers."""

    def __init__(self, whole: dict[int, float], tau: float, most: int):
        self.whole, self.tau, self.most = whole, tau, most
        self.chosen: dict[int, list[tuple]] = {rep: [] for rep, n in whole.items() if n}
        self.covered = {rep: 0.0 for rep in self.chosen}
        self.open = set(self.chosen) if most > 0 else set()

    def extend(self, rep: int, picks: Iterator[tuple], bound: tuple | None) -> None:
        """Certain picks of one job; a replicate without any is done.

        ``picks``: (node, gain) of candidates in turn; ``bound``: (-gain, node) of the
        first node that is no candidate.  Gains only fall, so a pick before the bound
        is certain, and the first one is the best of all."""
        own, whole, before = self.chosen[rep], self.whole[rep], len(self.chosen[rep])
        for node, gain in picks:
            if gain <= 0 or (len(own) > before and bound is not None and (-gain, node) >= bound):
                break
            self.covered[rep] += gain / whole
            own.append((len(own) + 1, node, gain, gain / whole, self.covered[rep]))
            if self.covered[rep] >= self.tau - 1e-12 or len(own) >= self.most:
                break
        if len(own) == before or self.covered[rep] >= self.tau - 1e-12 or len(own) >= self.most:
            self.open.discard(rep)

    def rows(self) -> list[tuple]:
        return [(rep, *r, bool(r[4] >= self.tau - 1e-12)) for rep, own in self.chosen.items() for r in own]


def _with_rep(*tables: DataFrame) -> list[DataFrame]:
    return [t if "rep" in t.columns else t.withColumn("rep", F.lit(0)) for t in tables]


def _best(df: DataFrame, value: str, n: int, *order: str) -> dict[int, list]:
    """The ``n`` rows of largest ``value`` of each replicate, in order."""
    first = Window.partitionBy("rep").orderBy(F.desc(value), *order)
    rows = df.where(F.col(value) > 0).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n).orderBy("rep", "_k").collect()
    out = defaultdict(list)
    for r in rows:
        out[r["rep"]].append(r)
    return out


def _marked(spark: SparkSession, picked: dict[int, list[int]]) -> DataFrame:
    """rep, v, c: the picked nodes of each replicate, by place in its list."""
    return F.broadcast(spark.createDataFrame([(rep, v, c) for rep, own in picked.items() for c, v in enumerate(own)], "rep int, v long, c int"))


def _between(edges: DataFrame, free: DataFrame, near: DataFrame, far: DataFrame, hops: int) -> DataFrame:
    """rep, h, a, b, n: paths of h hops from ``near`` to ``far`` (rep, v, c; a and b are their c) whose inner nodes have edges in ``free``.

    A path of h hops meets in its middle, so that no end is followed further than half of it."""
    keys = ["rep", "v"]
    step = lambda now, over, at, to, c: now.join(over.withColumnRenamed(at, "v"), keys).groupBy("rep", F.col(to).alias("v"), c).agg(F.sum("n").alias("n"))
    ahead = [near.select("rep", "v", F.col("c").alias("a"), F.lit(1.0).alias("n"))]
    for h in range(-(-hops // 2)):
        ahead.append(step(ahead[-1], free if h else edges, "pre", "post", "a"))
    back = [far.select("rep", "v", F.col("c").alias("b"), F.lit(1.0).alias("n"))]
    for _ in range(hops // 2):
        back.append(step(back[-1], free, "post", "pre", "b"))
    left = reduce(DataFrame.unionByName, [x.withColumn("h1", F.lit(h)) for h, x in enumerate(ahead) if h])
    right = reduce(DataFrame.unionByName, [x.withColumn("h2", F.lit(h)).withColumnRenamed("n", "n2") for h, x in enumerate(back)])
    met = left.join(right, keys).where((F.col("h1") == F.col("h2")) | (F.col("h1") == F.col("h2") + 1))
    return met.groupBy("rep", (F.col("h1") + F.col("h2")).alias("h"), "a", "b").agg(F.sum(F.col("n") * F.col("n2")).alias("n"))


def _each(df: DataFrame, reps: set[int]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Columns of the rows of each replicate; one replicate at a time is on the driver."""
    rows = cut(df)
    for rep in sorted(reps):
        found = rows.where(F.col("rep") == rep).toArrow()
        yield rep, {c: found.column(c).to_numpy() for c in found.column_names}
    drop(rows)


def _condensed(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int, candidates: dict[int, list[int]]) -> DataFrame:
    """rep, kind, h, a, b, n: the network between the candidates (a, b: places among them).

    Kind 0: paths of h hops from a to b, 1: from sources to b, 2: from a to targets, all of them without a candidate inside."""
    marked = _marked(edges.sparkSession, candidates)
    own = lambda c: F.broadcast(marked.select("rep", F.col("v").alias(c)))
    out, into = edges.join(own("pre"), ["rep", "pre"], "left_anti"), edges.join(own("post"), ["rep", "post"], "left_anti")
    at = lambda df, kind: df.join(marked, ["rep", "v"]).select("rep", F.lit(kind).alias("kind"), "h", F.col("c").alias("a"), F.col("c").alias("b"), "n")
    among = _between(edges, out, marked, marked, hops).withColumn("kind", F.lit(0))
    return among.unionByName(at(path_counts(out, sources, hops), 1)).unionByName(at(path_counts(into, targets, hops, backward=True), 2))


def _central_picks(nodes: list[int], hops: int, kind: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, float]]:
    """(node, gain) of the condensed network (``nodes`` ascend): each of largest centrality after the paths of those before are gone."""
    size, gone = len(nodes), np.zeros(len(nodes), bool)
    arcs = [(a[own], b[own], n[own]) for own in ((kind == 0) & (h == x) for x in range(hops + 1))]
    starts, ends = np.zeros((hops + 1, size)), np.zeros((hops + 1, size))
    for out, k in ((starts, 1), (ends, 2)):
        out[h[kind == k], a[kind == k]] = n[kind == k]

    def counts(first: np.ndarray, near: int, far: int) -> np.ndarray:
        out = first.copy()
        out[:, gone] = 0
        for x in range(1, hops + 1):
            for y in range(1, x + 1):
                arc = arcs[y]
                if len(arc[2]):
                    out[x] += np.bincount(arc[far], arc[2] * out[x - y][arc[near]], size)
            out[x][gone] = 0
        return out

    while not gone.all():
        into, onward = counts(starts, 0, 1), counts(ends, 1, 0)
        gain = (into * np.cumsum(onward, axis=0)[::-1]).sum(axis=0)
        best = int(np.argmax(gain))
        yield nodes[best], float(gain[best])
        gone[best] = True
        keep = [(arc[0] != best) & (arc[1] != best) for arc in arcs]
        arcs = [tuple(x[own] for x in arc) for arc, own in zip(arcs, keep)]


def _whole(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int) -> dict[int, float]:
    return {r["rep"]: r["n"] for r in total_paths(path_counts(edges, sources, hops), targets).groupBy("rep").agg(F.sum("n").alias("n")).collect()}


def tau_core(edges: DataFrame, sources: DataFrame, targets: DataFrame, tau: float = 0.9, hops: int = 5, max_core: int = 300, followed: int = FOLLOWED) -> DataFrame:
    """(rep,) rank, v, centrality, marginal, coverage, reached: nodes of largest centrality (ties: smallest id), each chosen after the paths of those before are gone.

    A job condenses the network to the ``followed`` most central nodes: what paths
    lead from one to the next, from sources and to targets, without another of them
    inside.  That is enough to choose on for as long as the best of them beats every
    other node; then the chosen ones are taken out and the rest is counted anew.
    Only the condensed network of one replicate is on the driver.
    """
    keys, spark = _keys(edges), edges.sparkSession
    edges, sources, targets = own = [cut(t) for t in _with_rep(edges, sources, targets)]
    cover = _Cover(_whole(*own, hops), tau, max_core)
    while cover.open:
        gone = spark.createDataFrame([(rep, r[1]) for rep in cover.open for r in cover.chosen[rep]], "rep int, gone long")
        still = lambda df, c: df.where(F.col("rep").isin(*cover.open)).join(F.broadcast(gone.withColumnRenamed("gone", c)), ["rep", c], "left_anti")  # noqa: B023, E731
        left, first, last = cut(still(still(edges, "pre"), "post")), still(sources, "v"), still(targets, "v")
        p = centrality(path_counts(left, first, hops), path_counts(left, last, hops, backward=True), hops)
        best = _best(p, "p", followed + 1, "v")
        cover.open &= set(best)
        nodes = {rep: sorted(r["v"] for r in best[rep][:followed]) for rep in cover.open}
        for rep, found in _each(_condensed(left, first, last, hops, nodes), cover.open) if nodes else ():
            rest = best[rep][followed:]
            cover.extend(rep, _central_picks(nodes[rep], hops, *(found[c] for c in ("kind", "h", "a", "b", "n"))), (-rest[0]["p"], rest[0]["v"]) if rest else None)
        drop(left)
    drop(*own)
    out = spark.createDataFrame(cover.rows(), "rep int, rank int, v long, centrality double, marginal double, coverage double, reached boolean")
    return out if keys else out.drop("rep")


def _end_picks(near: list[tuple[int, float]], far: list[tuple[int, float]], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[tuple[int, int], float]]:
    """((kind, end), gain) of sources ``near`` (0) and targets ``far`` (1), which have ascending ids and the gains they start with; n paths lead from a to b."""
    gains = np.array([g for _, g in (*near, *far)])
    # what each has in common with those of the other kind: both ways round, by end
    ends, other, shared = np.concatenate([a, b + len(near)]), np.concatenate([b + len(near), a]), np.concatenate([n, n])
    order = np.argsort(ends, kind="stable")
    other, shared, start = other[order], shared[order], np.searchsorted(ends[order], np.arange(len(gains) + 1))
    while len(gains):
        best = int(np.argmax(gains))
        yield ((0, near[best][0]) if best < len(near) else (1, far[best - len(near)][0])), float(gains[best])
        own = slice(start[best], start[best + 1])
        gains[other[own]] -= shared[own]
        gains[best] = -np.inf


def flat_core(edges: DataFrame, sources: DataFrame, targets: DataFrame, tau: float = 0.9, hops: int = 5, max_core: int = 4000) -> DataFrame:
    """(rep,) rank, v, kind, gain, coverage, reached: sources and targets that cover most paths of the flat network (ties: sources first, then smallest id).

    A source weighs the paths to the targets that are left, a target those from the
    sources that are left: one propagation each way, restricted to the ends left.
    No weight of a pair is needed but those between the ``FOLLOWED_ENDS`` heaviest
    ends of each kind, by which one job chooses as ``tau_core`` does."""
    keys, spark = _keys(edges), edges.sparkSession
    edges, sources, targets = own = [cut(t) for t in _with_rep(edges, sources, targets)]
    # a path of no hop joins no two ends
    cover = _Cover(_whole(*own, hops), tau, max_core)
    while cover.open:
        gone = spark.createDataFrame([(rep, *r[1]) for rep in cover.open for r in cover.chosen[rep]], "rep int, k int, v long")
        still = lambda df, k: df.where(F.col("rep").isin(*cover.open)).join(F.broadcast(gone.where(F.col("k") == k).drop("k")), ["rep", "v"], "left_anti")  # noqa: B023, E731
        left, first, last = edges.where(F.col("rep").isin(*cover.open)), still(sources, 0), still(targets, 1)
        gain = lambda start, own, back, k: path_counts(left, start, hops, back).join(own, ["rep", "v"], "left_semi").groupBy("rep", "v").agg(F.sum("n").alias("g")).withColumn("k", F.lit(k))  # noqa: B023, E731
        best = [_best(gain(last, first, True, 0), "g", FOLLOWED_ENDS + 1, "v"), _best(gain(first, last, False, 1), "g", FOLLOWED_ENDS + 1, "v")]
        cover.open &= set(best[0]) | set(best[1])
        heavy = [{rep: sorted((r["v"], r["g"]) for r in best[k][rep][:FOLLOWED_ENDS]) for rep in cover.open} for k in (0, 1)]
        near, far = (_marked(spark, {rep: [v for v, _ in own] for rep, own in x.items()}) for x in heavy)
        for rep, found in _each(_between(left, left, near, far, hops).groupBy("rep", "a", "b").agg(F.sum("n").alias("n")), cover.open):
            rest = [(-r["g"], (k, r["v"])) for k in (0, 1) for r in best[k][rep][FOLLOWED_ENDS:]]
            cover.extend(rep, _end_picks(heavy[0][rep], heavy[1][rep], *(found[c] for c in "abn")), min(rest, default=None))
    drop(*own)
    rows = [(rep, rank, v, ("source", "target")[k], gain, coverage, reached) for rep, rank, (k, v), gain, _, coverage, reached in cover.rows()]
    out = spark.createDataFrame(rows, "rep int, rank int, v long, kind string, gain double, coverage double, reached boolean")
    return out if keys else out.drop("rep")


def hourglass_curve(core: DataFrame, flat: DataFrame, taus: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), reps: int = 0) -> DataFrame:
    """(rep,) tau, core, flat, h = 1 - core / flat: sizes at which each core first covers tau; null where it never does.  ``reps``: of cores with replicates -1 (the graph itself) to reps - 1."""
    keys, spark = _keys(core), core.sparkSession
    grid = spark.createDataFrame([(r, t) for r in range(-1, reps) for t in taus], "rep int, tau double")
    grid = grid if keys else grid.where("rep < 0").drop("rep")
    covers = F.col("coverage") >= F.col("tau") - 1e-12

    def size(df: DataFrame, name: str) -> DataFrame:
        met = df.join(F.broadcast(grid), keys if keys else covers)  # a row for each replicate and tau
        return met.where(covers).groupBy(*keys, "tau").agg(F.min("rank").alias(name))

    out = grid.join(size(core, "core"), [*keys, "tau"], "left").join(size(flat, "flat"), [*keys, "tau"], "left")
    return out.withColumn("h", 1 - F.col("core") / F.col("flat"))


def core_by_group(core: DataFrame, graph: Graph) -> DataFrame:
    """grp (null too), n, coverage, first_rank of the core's nodes."""
    rows = core.join(graph.neurons.select(F.col("root_id").alias("v"), "grp"), "v", "left")
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("marginal").alias("coverage"), F.min("rank").alias("first_rank"))


#: A count is m * 2**(512 e); m stays under 2**256 but for one sum.
BLOCK = 512


def _scaled(m: Column, e: Column, top: Column) -> Column:
    """m * 2**(512 (e - top)) for e <= top; two blocks below the top nothing of a double is left."""
    return F.when(e == top, m).when(e == top - 1, m * 2.0**-BLOCK).otherwise(0.0)


def _normal(m: Column, e: Column) -> tuple[Column, Column]:
    over, under = m >= 2.0 ** (BLOCK // 2), (m < 2.0 ** -(BLOCK // 2)) & (e > 0)
    return F.when(over, m * 2.0**-BLOCK).when(under, m * 2.0**BLOCK).otherwise(m), F.when(over, e + 1).when(under, e - 1).otherwise(e)


def log10_count(m: Column, e: Column) -> Column:
    """Decimal logarithm of a count, null for 0."""
    return F.when(m > 0, F.log10(m) + e * F.lit(BLOCK * 0.30102999566398120))


def settled(edges: DataFrame, start: DataFrame | None = None, backward: bool = False, max_layers: int = 100_000) -> DataFrame:
    """v, layer, m, e: nodes by the longest path that leads to them, and the number m * 2**(512 e) of paths of any length from the start nodes; an error if edges go round.

    ``backward``: of the edges turned round.  Each node holds how many of its edges
    are still to come.  The nodes that wait for none are the frontier: each of
    their edges meets its end once, lowers its number and adds to its count; the
    ends that wait for none then are the next frontier.  Edges behind the frontier
    are left out once they are half of what is stored, so that later rounds do not
    read them again.
    """
    spark = edges.sparkSession
    near, far = ("post", "pre") if backward else ("pre", "post")
    stored = cut(edges.select(F.col(near).alias("pre"), F.col(far).alias("post")))
    need = stored.groupBy(F.col("post").alias("v")).agg(F.count(F.lit(1)).alias("need"))
    nodes = stored.select(F.col("pre").alias("v")).union(stored.select("post")).distinct().join(need, "v", "left")
    one = F.lit(0.0)
    if start is not None:
        nodes = nodes.join(start.select("v", F.lit(1.0).alias("_one")), "v", "full")  # a start node without edges counts too
        one = F.coalesce("_one", F.lit(0.0))
    state = nodes.select("v", F.coalesce("need", F.lit(0)).cast("long").alias("need"), one.alias("m"), F.lit(0).alias("e"))
    schema, paths, layer, live = "v long, need long, m double, e int, layer int", [], 0, None
    while True:
        path = scratch_path(spark)
        state.withColumns({"layer": F.lit(layer), "done": (F.col("need") == 0).cast("int")}).write.option("compression", "zstd").partitionBy("done").parquet(path)
        rows = spark.read.schema(schema + ", done int").parquet(path)
        found = rows.agg(F.count_if(F.col("done") == 1).alias("ready"), F.count_if(F.col("done") == 0).alias("wait"), F.sum(F.when(F.col("done") == 0, F.col("need"))).alias("live")).first()
        if paths:
            drop(f"{paths[-1]}/done=0")
        paths.append(path)
        if not found["wait"]:
            break
        if not found["ready"]:
            raise RuntimeError("the graph has a cycle")
        if layer >= max_layers:
            raise RuntimeError("too many layers")
        frontier, waiting = rows.where("done = 1").select("v", "m", "e"), rows.where("done = 0").select("v", "need", "m", "e")
        if live is not None and 2 * found["live"] <= live:
            # an edge is still to come if its end waits and its own node is not behind the frontier
            ahead = waiting.select("v").union(frontier.select("v")).withColumnRenamed("v", "pre")
            fewer = cut(stored.join(ahead, "pre", "left_semi"))
            drop(stored)
            stored, live = fewer, found["live"]
        live = live or found["live"]
        sums = stored.join(frontier.withColumnRenamed("v", "pre"), "pre").groupBy("post", "e").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
        sums = sums.groupBy("post").agg(F.sum("n").alias("n"), F.max("e").alias("_top"), F.collect_list(F.struct("e", "m")).alias("_each"))  # a few exponents a node
        sums = sums.select(F.col("post").alias("v"), "n", "_top", F.aggregate("_each", F.lit(0.0), lambda x, y: x + _scaled(y["m"], y["e"], F.col("_top"))).alias("_sum"))
        top = F.greatest("e", F.coalesce("_top", F.lit(0)))
        both = waiting.join(sums, "v", "left").withColumn("_e", top)
        both = both.withColumn("_m", _scaled(F.col("m"), F.col("e"), F.col("_e")) + F.coalesce(_scaled(F.col("_sum"), F.col("_top"), F.col("_e")), F.lit(0.0)))
        m, e = _normal(F.col("_m"), F.col("_e"))
        state, layer = both.select("v", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"), m.alias("m"), e.cast("int").alias("e")), layer + 1
    drop(stored)
    return spark.read.schema(schema).parquet(*(f"{p}/done=1" for p in paths)).select("v", "layer", "m", "e")


def topological_layers(edges: DataFrame, max_layers: int = 100_000) -> DataFrame:
    """v, layer: nodes by the longest path that leads to them; an error if edges go round."""
    return settled(edges, max_layers=max_layers).select("v", "layer")


def unbounded_centrality(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """v, log10_p, share: source-to-target paths of any length through v, and their share of all."""
    a, b = settled(edges, sources), settled(edges, targets, backward=True)
    right = b.select("v", F.col("m").alias("m2"), F.col("e").alias("e2"))
    m, e = _normal(F.col("m") * F.col("m2"), F.col("e") + F.col("e2"))
    through = a.join(right, "v").where("m > 0 AND m2 > 0").select("v", m.alias("m"), e.alias("e"))
    # a row for each exponent of the counts at targets: the total is two numbers
    ends = {r["e"]: r["m"] for r in a.where("m > 0").join(targets, "v", "left_semi").groupBy("e").agg(F.sum("m").alias("m")).collect()}
    top = max(ends, default=0)
    whole = math.log10(sum(m * 2.0 ** (BLOCK * (e - top)) for e, m in ends.items() if e >= top - 1)) + top * BLOCK * math.log10(2) if ends else 0.0
    size = log10_count(F.col("m"), F.col("e"))
    return through.select("v", size.alias("log10_p"), F.pow(F.lit(10.0), size - whole).alias("share"))
