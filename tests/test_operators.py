"""Operators on hand-made and random graphs against enumeration."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.functions import signature, statistics, taxonomy
from layerlens.operators import compare, dense, distill, graph, levels, motifs, nulls, paths, patterns, states, sweep, validation, within_area
from layerlens.plans import analyses
from layerlens.sources import artefacts
from layerlens.sources.graph_tables import Graph, read_csv_graph


def make(spark, nodes, edges):
    """nodes: id -> (area, level); edges: (pre, post) or (pre, post, place, count)."""
    edges = [(*e, "x", 10) if len(e) == 2 else e for e in edges]
    return Graph(
        spark.createDataFrame([(i, a, None, None) for i, (a, _) in nodes.items()], "root_id long, grp string, nt_type string, nt_type_score double"),
        spark.createDataFrame([(i, a) for i, (a, _) in nodes.items()], "root_id long, super_class string"),
        spark.createDataFrame([(i, -float(v or 0), v) for i, (_, v) in nodes.items()], "root_id long, score double, y_level int"),
        spark.createDataFrame(edges, "pre_root_id long, post_root_id long, neuropil string, syn_count int"),
    )


def bowties(spark, nodes, edges, k_in=2, k_out=2, min_count=1, engine="join"):
    found = analyses.search(make(spark, nodes, edges), "1-2-3", k_in=k_in, k_out=k_out, min_count=min_count, engine=engine)
    return {r["structure_str"]: (r["motif_count"], r["n_waist_active"], r["n_waist_eff"]) for r in found.collect()}


def star(waists=1):
    """In-metanodes of 2 and 3 nodes, out-metanodes of 1 and 4, and the waist nodes that all of them touch."""
    nodes = {i: ("A", 1) for i in (1, 2)} | {i: ("B", 1) for i in (3, 4, 5)} | {6: ("C", 3)} | {i: ("D", 3) for i in (7, 8, 9, 10)}
    edges = []
    for w in range(100, 100 + waists):
        nodes[w] = ("W", 2)
        edges += [(i, w) for i in range(1, 6)] + [(w, i) for i in range(6, 11)]
    return nodes, edges


def test_hand_graphs(spark):
    name = "[AL1, BL1] -> WL2 -> [CL3, DL3]"
    assert bowties(spark, *star()) == {name: (24, 1, 1.0)}
    assert bowties(spark, *star(2)) == {name: (48, 2, 2.0)}
    nodes, edges = star()
    assert bowties(spark, {**nodes, 6: ("A", 1)}, edges) == {}  # shared category on both sides
    assert bowties(spark, {k: (a, 1 if v == 2 else v) for k, (a, v) in nodes.items()}, edges) == {}  # a jump of two levels
    assert bowties(spark, nodes, [*edges, (100, 100), (1, 100, "y", 3)]) == {name: (24, 1, 1.0)}
    assert bowties(spark, {**nodes, 1: (None, 1), 2: ("NO_CONS", 1)}, edges) == {}
    assert bowties(spark, nodes, edges, min_count=25) == {}
    with pytest.raises(ValueError):
        bowties(spark, nodes, edges, min_count=0)


def test_bowties_against_enumeration(spark):
    rng = random.Random(11)
    for k_in, k_out in ((2, 2), (3, 1), (1, 2)):
        nodes = {i: (rng.choice("ABC"), rng.choice((1, 2, 3))) for i in range(16)}
        edges = [(a, b) for a in nodes for b in nodes if rng.random() < 0.3]
        kept = {(a, b) for a, b in edges if nodes[a] != nodes[b] and abs(nodes[a][1] - nodes[b][1]) <= 1}
        want = {}
        for w in nodes:
            ins, outs = [a for a, b in kept if b == w], [b for a, b in kept if a == w]
            for x in itertools.combinations(sorted(ins), k_in):
                for y in itertools.combinations(sorted(outs), k_out):
                    fi, fo = sorted(nodes[i] for i in x), sorted(nodes[i] for i in y)
                    if len(set(fi)) == k_in and len(set(fo)) == k_out and not set(fi) & set(fo):
                        show = lambda some: "[" + ", ".join(f"{a}L{v}" for a, v in some) + "]"
                        key = f"{show(fi)} -> {nodes[w][0]}L{nodes[w][1]} -> {show(fo)}"
                        want[key] = want.get(key, 0) + 1
        for engine in ("join", "matrix") if k_in == 3 else ("join",):
            assert {k: v[0] for k, v in bowties(spark, nodes, edges, k_in, k_out, engine=engine).items()} == want


@pytest.mark.parametrize("block, tile", [(1024, 512), (3, 2)])
def test_matrices(spark, monkeypatch, block, tile):
    """Counts, active nodes and squares of matrices are those of joins, however blocks and tiles are cut; the measured choice is the threshold's."""
    rng = random.Random(5)
    nodes = {i: ("W", 2) for i in range(12)} | {i: (rng.choice("ABCDE"), rng.choice((1, 3))) for i in range(100, 160)}
    nodes |= {i: ("V", 2) for i in range(20, 24)}
    edges = [(a, w) for a in range(100, 130) for w in range(12) if rng.random() < 0.9] + [(w, d) for d in range(130, 160) for w in range(12) if rng.random() < 0.9]
    edges += [(a, w) for w in range(20, 24) for a in rng.sample(range(100, 160), 3)] + [(w, a) for w in range(20, 24) for a in rng.sample(range(100, 160), 3)]
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "TILE", tile)
    want = bowties(spark, nodes, edges)
    assert want and bowties(spark, nodes, edges, engine="matrix") == want
    monkeypatch.setattr(dense, "LEAST_DENSITY", 0.5)
    assert bowties(spark, nodes, edges, engine="measured") == want
    g = make(spark, nodes, edges)
    working = graph.working_set(g, "1-2-3")
    between = graph.between_metanodes(graph.with_ends(graph.edges_binary(g), working))
    assert {r["area"]: r["dense"] for r in motifs.waist_density(between, working).collect() if r["area"] in "WV"} == {"W": True, "V": False}
    assert bowties(spark, {}, [], engine="matrix") == bowties(spark, nodes, [], engine="measured") == {}
    with pytest.raises(ValueError):
        bowties(spark, nodes, edges, engine="other")


def test_matrices_of_large_counts():
    """Past 2**53 counts stay exact, past 2**63 they are an error."""
    one = lambda *v: (np.array([0, len(v)]), np.arange(len(v)), np.array(v))
    far = lambda *v: (np.array([0, len(v)]), np.arange(len(v)) + 10, np.array(v))
    n = 2**29 + 1
    assert [x[2].tolist() for x in dense.block_counts(one(n, n), far(3, 1), 2, 2)] == [[3 * n * n]]
    with pytest.raises(OverflowError):
        list(dense.block_counts(one(2**20, 2**20), far(2**20, 2**20), 2, 2))


def test_sums_of_distilled_tables(spark, sf):
    from layerlens.queries import Run
    from layerlens.sources.graph_tables import order_graph

    rows = Run(order_graph(spark, sf)).motifs()
    total = rows.agg(F.sum("motif_count")).first()[0]
    assert distill.level_chains(rows).agg(F.sum("mass")).first()[0] == 4 * total
    assert distill.by_signature(rows).agg(F.sum("mass")).first()[0] == distill.by_waist(rows).agg(F.sum("mass")).first()[0] == total


def test_states_add(spark, sf):
    """Parts merged in any order give the tables of all rows; an empty part changes nothing."""
    from layerlens.queries import Run
    from layerlens.sources.graph_tables import order_graph
    from layerlens.sources.scratch import cut

    rows = cut(Run(order_graph(spark, sf)).motifs())
    lengths = {"signature": 30, "all": 70}
    parts = [cut(states.state(rows.where(F.col("motif_count") % 3 == n), tops=lengths)) for n in range(3)]
    want = {"by_signature": distill.by_signature(rows), "by_waist": distill.by_waist(rows), "chains": distill.level_chains(rows), "top_per_signature": distill.top(rows, 30, "signature"), "top_per_waist": distill.top(rows, 20, "bottleneck_area", "bottleneck_level"), "top_global": distill.top(rows, 70)}
    one = cut(states.merged(states.merged(parts[2], parts[0], tops=lengths), parts[1], states.state(rows.where("false"), tops=lengths), tops=lengths))
    got = states.tables(one)
    for name, df in want.items():
        assert sorted(map(str, df.select(got[name].columns).collect())) == sorted(map(str, got[name].collect())), name


def test_pattern_counts_against_enumeration(spark):
    """All patterns of 3 and 4 nodes, on a graph with loops and mutual edges."""
    rng = random.Random(3)
    arcs = {(a, b) for a in range(6) for b in range(6) if rng.random() < 0.35}
    df = spark.createDataFrame(sorted(arcs), "pre long, post long")
    some = [(e, k) for k in (3, 4) for e in patterns.all_patterns(k)]
    got = {r["pattern"]: r["n"] for r in patterns.pattern_counts(df, some).collect()}
    for e, k in some:
        want = sum(all((m[a], m[b]) in arcs for a, b in e) for m in itertools.product(range(6), repeat=k))
        assert got[";".join(f"{a}>{b}" for a, b in e)] == want, e


def test_exact_laws(spark):
    """Signed ranks by all signs, and Fisher's p by all tables."""
    rows = [(float(d), 0.0) for d in (1, -2, 3, 4, -5, 6, 7)]
    r = statistics.wilcoxon(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    less = sum(min(w, 28 - w) <= r["statistic"] for w in (sum(i + 1 for i in range(7) if m >> i & 1) for m in range(128)))
    assert abs(r["p"] - min(1.0, less / 128)) < 1e-12
    rng = random.Random(4)
    for _ in range(300):
        a, b, c, d = (rng.randrange(rng.choice((2, 9, 60))) for _ in range(4))
        n, ways = a + b + c + d, {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        assert abs(statistics.fisher(a, b, c, d)[1] - sum(w for w in ways.values() if w <= ways[a]) / math.comb(n, a + c)) < 1e-9


def test_within_area_against_enumeration(spark):
    rng = random.Random(7)
    for _ in range(3):
        n = rng.randrange(7, 10)
        levels = {i: rng.randrange(1, 5) for i in range(n)}
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        arcs, want = set(edges), {}
        way = lambda a, b: "FWD" if levels[a] < levels[b] else "BWD" if levels[a] > levels[b] else "LAT"  # noqa: B023, E731
        for w in range(n):
            for x in itertools.combinations([i for i in range(n) if (i, w) in arcs], 2):
                for y in itertools.combinations([i for i in range(n) if (w, i) in arcs], 2):
                    if len({*x, *y, w}) == 5:
                        a, b = {way(i, w) for i in x}, {way(w, i) for i in y}
                        key = "->".join(next(iter(s)) if len(s) == 1 else "mix" for s in (a, b))
                        want[key] = want.get(key, 0) + 1
        g = make(spark, {i: ("Q", v) for i, v in levels.items()}, [*edges, (0, 0)])
        members = within_area.membership(g)
        rows = within_area.profile(within_area.signature_counts(within_area.neighbour_counts(within_area.area_edges(g, members)))).collect()
        assert {r["signature"]: r["n"] for r in rows if r["n"]} == want and len(rows) == 16


def test_pure_shapes_against_enumeration(spark):
    rng = random.Random(3)
    nodes = {i: (rng.choice("ABCDE"), 2) for i in range(30)} | {50: ("W", 2), 51: ("W", 2)}
    edges = [(i, w) for i in range(30) for w in (50, 51) if rng.random() < 0.5] + [(w, i) for i in range(30) for w in (50, 51) if rng.random() < 0.5]
    g = make(spark, nodes, edges)
    work = graph.working_set(g)
    found = sweep.pure_shapes(graph.between_metanodes(graph.with_ends(graph.edges_binary(g), work)), work, 4).where("area = 'W'").first()
    for k in (2, 3, 4):
        total = {"int": 0, "bro": 0}
        for w in (50, 51):
            v, u = {}, {}
            for a, b in set(edges):
                if b == w:
                    v[nodes[a][0]] = v.get(nodes[a][0], 0) + 1
                if a == w:
                    u[nodes[b][0]] = u.get(nodes[b][0], 0) + 1
            for name, ins, outs, ki, ko in (("int", v, u, k, 1), ("bro", v, u, 1, k)):
                for x in itertools.combinations(sorted(ins), ki):
                    for y in itertools.combinations(sorted(outs), ko):
                        if not set(x) & set(y):
                            total[name] += math.prod(ins[i] for i in x) * math.prod(outs[i] for i in y)
        assert (found[f"int_k{k}"], found[f"bro_k{k}"]) == (total["int"], total["bro"])


def all_paths(edges, sources, targets, hops, gone=()):
    out, todo = [], [[s] for s in sources if s not in gone]
    while todo:
        p = todo.pop()
        if p[-1] in targets:
            out.append(p)
        if len(p) <= hops:
            todo += [[*p, b] for a, b in edges if a == p[-1] and b not in gone]
    return out


def test_paths_and_cores_against_enumeration(spark, monkeypatch):
    rng = random.Random(5)
    n, hops = 10, 3
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
    sources, targets = [0, 1, 2], [7, 8, 9]
    df = spark.createDataFrame(edges, "pre long, post long")
    s, t = (spark.createDataFrame([(i,) for i in x], "v long") for x in (sources, targets))
    every = all_paths(edges, sources, targets, hops)
    a, b = paths.path_counts(df, s, hops), paths.path_counts(df, t, hops, backward=True)
    assert paths.total_paths(a, t).agg(F.sum("n")).first()[0] == len(every)
    want = {v: sum(v in p for p in every) for v in range(n)}
    assert {r["v"]: r["p"] for r in paths.centrality(a, b, hops).collect()} == {k: v for k, v in want.items() if v}
    gone, core = [], paths.tau_core(df, s, t, tau=0.8, hops=hops, max_core=10).collect()
    for r in core:
        left = all_paths(edges, sources, targets, hops, gone)
        through = {v: sum(v in p for p in left) for v in range(n)}
        assert r["v"] == max(through, key=lambda v: (through[v], -v)) and r["centrality"] == through[r["v"]]
        gone.append(r["v"])
        assert abs(r["coverage"] - (1 - len(all_paths(edges, sources, targets, hops, gone)) / len(every))) < 1e-12
    assert core[-1]["reached"]
    pairs = {(x, y): sum(p[0] == x and p[-1] == y for p in every) for x in sources for y in targets}
    for followed in (24, 2):
        monkeypatch.setattr(paths, "FOLLOWED_ENDS", followed)
        flat, left, covered = paths.flat_core(df, s, t, tau=0.8, hops=hops).collect(), dict(pairs), 0
        for r in flat:
            ends = {(0, v): sum(w for (x, _), w in left.items() if x == v) for v in sources} | {(1, v): sum(w for (_, y), w in left.items() if y == v) for v in targets}
            k, v = min(ends, key=lambda e: (-ends[e], e))
            assert (r["v"], r["kind"], r["gain"]) == (v, ("source", "target")[k], ends[k, v])
            left, covered = {p: w for p, w in left.items() if p[k] != v}, covered + ends[k, v]
            assert abs(r["coverage"] - covered / len(every)) < 1e-12
        assert flat[-1]["reached"]
    both = nulls.replicates(df, 2).where("rep = 0 OR pre <> 0"), *(nulls.replicates(x, 2) for x in (s, t))
    for core_of, want in ((paths.tau_core, core), (paths.flat_core, flat)):
        got = core_of(*both, tau=0.8, hops=hops).orderBy("rep", "rank").collect()
        assert [r["v"] for r in got if r["rep"] == 0][: len(want)] == [r["v"] for r in want]
        alone = core_of(df.where("pre <> 0"), s, t, tau=0.8, hops=hops).orderBy("rank").collect()
        assert [r["v"] for r in got if r["rep"] == 1] == [r["v"] for r in alone]
    curve = {r["tau"]: r for r in paths.hourglass_curve(spark.createDataFrame(core), spark.createDataFrame(flat), (0.5, 0.999)).collect()}
    assert curve[0.5]["core"] == min(r["rank"] for r in core if r["coverage"] >= 0.5)
    layers = {r["v"]: r["layer"] for r in paths.topological_layers(df).collect()}
    assert all(layers[a] < layers[b] for a, b in edges)
    with pytest.raises(RuntimeError):
        paths.topological_layers(spark.createDataFrame([(1, 2), (2, 1)], "pre long, post long"))


def chains(spark, n):
    """n apart chains 100 + i > i > 200 + i: all nodes and ends weigh the same."""
    edges = spark.createDataFrame([e for i in range(n) for e in ((100 + i, i), (i, 200 + i))], "pre long, post long")
    return edges, *(spark.createDataFrame([(k + i,) for i in range(n)], "v long") for k in (100, 200))


def counted_calls(monkeypatch, name):
    calls, real = [], getattr(paths, name)
    monkeypatch.setattr(paths, name, lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_equal_ends_are_chosen_together(spark, monkeypatch):
    monkeypatch.setattr(paths, "FOLLOWED_ENDS", 8)
    calls = counted_calls(monkeypatch, "path_counts")
    got = paths.flat_core(*chains(spark, 16), tau=1.0, hops=3).collect()
    assert [(r["rank"], r["kind"], r["v"], r["gain"]) for r in got] == [(i + 1, "source", 100 + i, 1.0) for i in range(16)] and got[-1]["reached"]
    assert len(calls) <= 1 + 2 * 2


def test_equal_nodes_are_chosen_together(spark, monkeypatch):
    calls = counted_calls(monkeypatch, "path_counts")
    got = paths.tau_core(*chains(spark, 16), tau=1.0, hops=3, followed=8).collect()
    assert [(r["rank"], r["v"], r["centrality"]) for r in got] == [(i + 1, i, 1.0) for i in range(16)] and got[-1]["reached"]
    assert len(calls) <= 1 + 2 * 4


def test_condensed_network_against_enumeration(spark):
    rng = random.Random(11)
    n, hops = 12, 4
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.45]
    sources, targets, gone = [0, 1, 2], [9, 10, 11], []
    df, (s, t) = spark.createDataFrame(edges, "pre long, post long"), (spark.createDataFrame([(x,) for x in side], "v long") for side in (sources, targets))
    for r in paths.tau_core(df, s, t, tau=1.0, hops=hops, followed=4).collect():
        through = {v: sum(v in p for p in all_paths(edges, sources, targets, hops, gone)) for v in range(n)}
        assert r["v"] == max(through, key=lambda v: (through[v], -v)) and r["centrality"] == through[r["v"]]
        gone.append(r["v"])
    assert not all_paths(edges, sources, targets, hops, gone)


def test_paths_of_any_length(spark):
    rng = random.Random(8)
    n, sources, targets = 14, [0, 1, 99], [11, 12, 13]
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
    df, (s, t) = spark.createDataFrame(edges, "pre long, post long"), (spark.createDataFrame([(x,) for x in side], "v long") for side in (sources, targets))
    every = all_paths(edges, sources, targets, n)
    ends = {v: sum(p[-1] == v for p in every) for v in targets}
    got = {r["v"]: r for r in paths.settled(df, s).collect()}
    assert {v: got[v]["m"] for v in targets} == ends and got[99]["m"] == 1 and all(r["e"] == 0 for r in got.values())
    through = {v: sum(v in p for p in every) for v in range(n)}
    found = {r["v"]: r for r in paths.unbounded_centrality(df, s, t).collect()}
    assert {v: round(10 ** r["log10_p"]) for v, r in found.items()} == {v: k for v, k in through.items() if k}
    assert all(abs(r["share"] - through[v] / len(every)) < 1e-9 for v, r in found.items())
    depth = {v: max((len(p) - 1 for x in range(n) for p in all_paths(edges, [x], [v], n)), default=0) for v in range(n)}
    assert {r["v"]: r["layer"] for r in paths.topological_layers(df).collect()} == {v: depth[v] for e in edges for v in e}


def test_counts_past_doubles(spark):
    """Few layers, many paths: counts of 2**600 come in at once, and meet small ones."""
    rows = spark.createDataFrame([(1, 2.0**200, 2), (1, 2.0**200, 1), (1, 1.0, 0)], "v long, m double, e int")
    top = F.lit(2)
    m, e = paths._normal(rows.select(F.sum(paths._scaled(F.col("m"), F.col("e"), top))).first()[0] * F.lit(1.0), top)
    got = spark.range(1).select(m.alias("m"), e.alias("e"), paths.log10_count(m, e).alias("l")).first()
    assert got["e"] == 2 and abs(got["l"] - (1024 + 200) * 0.3010299956639812) < 1e-9
    wide = 46  # 2**6 edges a step, by repetition
    edges = spark.range(wide - 1).select(F.col("id").alias("pre"), (F.col("id") + 1).alias("post")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(2**6)))).drop("_k")
    out = {r["v"]: r for r in paths.settled(edges, spark.range(1).select(F.col("id").alias("v"))).collect()}
    assert out[wide - 1]["layer"] == wide - 1 and abs(math.log2(out[wide - 1]["m"]) + 512 * out[wide - 1]["e"] - 6 * (wide - 1)) < 1e-9


def test_bijection(spark):
    """One-to-one for every size, and the first k images are any k as often."""
    sizes = [*range(1, 40), 997, 4097]
    df = spark.createDataFrame([(n, k) for n in sizes for k in (1, 2)], "n long, k int")
    got = nulls.counted(df, F.col("n"), "j").select("n", "k", nulls.bijection(F.col("j"), F.col("n"), "k").alias("y")).groupBy("n", "k").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count_distinct("y").alias("d")).collect()
    assert len(got) == 2 * len(sizes) and all((r["a"], r["b"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in got)
    pairs = spark.range(6000).select("id", *(nulls.bijection(F.lit(j), F.lit(7).cast("long"), F.col("id")).alias(f"y{j}") for j in (0, 1))).groupBy("y0", "y1").count().collect()
    assert len(pairs) == 42 and sum((r["count"] - 6000 / 42) ** 2 / (6000 / 42) for r in pairs) < 75  # 41 degrees of freedom: one in a thousand is higher


def test_patterns(spark):
    shapes = [(k, patterns.shape(e, k)) for k in (3, 4) for e in patterns.all_patterns(k)]
    count = lambda k, *names: sum(x == k and s in names for x, s in shapes)
    assert (count(3, "path"), count(3, "cyclic")) == (6, 7)
    assert (count(4, "path"), count(4, "star", "path"), count(4, "cyclic")) == (15, 25, 174) and len(shapes) == 212
    assert patterns.treewidth(((0, 1), (1, 2), (2, 0)), 3) == 2 and patterns.treewidth(((0, 1), (1, 2)), 3) == 1
    rng = random.Random(2)
    edges = [(a, b) for a in range(6) for b in range(6) if a != b and rng.random() < 0.4]
    df = spark.createDataFrame(edges, "pre long, post long")
    arcs = set(edges)
    for k in (3, 4):
        some = [e for e in patterns.all_patterns(k) if patterns.shape(e, k) != "cyclic"]
        for e in rng.sample(some, 4):
            want = sum(all((m[a], m[b]) in arcs for a, b in e) for m in itertools.product(range(6), repeat=k))
            assert patterns.tree_count(df, e, k).first()["n"] == want == patterns.brute_count(df, e, k).first()["n"]
    with pytest.raises(ValueError):
        patterns.tree_count(df, ((0, 1), (1, 2), (2, 0)), 3)


def test_nulls_keep_what_they_should(spark):
    rng = random.Random(9)
    nodes = {i: (rng.choice("AB"), rng.choice((1, 2))) for i in range(60)}
    edges = [(a, b) for a in nodes for b in nodes if a != b and rng.random() < 0.2]
    g = make(spark, nodes, edges)
    work = graph.working_set(g)
    df = spark.createDataFrame(edges, "pre long, post long")
    got = [(r["pre"], r["post"]) for r in nulls.swapped(df, 4).collect()]
    degree = lambda e, i: sorted((x, sum(y[i] == x for y in e)) for x in {y[i] for y in e})
    assert len(set(got)) == len(got) == len(edges) and all(a != b for a, b in got) and set(got) != set(edges)
    assert degree(got, 0) == degree(edges, 0) and degree(got, 1) == degree(edges, 1)
    between = graph.between_metanodes(graph.with_ends(df, work))
    block = lambda x: sorted(map(tuple, graph.metagraph_edges(x).collect()))
    drawn = nulls.block_rewired(between, work)
    assert block(drawn) == block(between) and drawn.select("pre", "post").distinct().count() == between.count()
    flow = motifs.flow_in(between)
    areas = {i: n for i, n in nodes.items()}
    values = lambda rows: sorted((areas[r["i"]], r["area"], r["lvl"], r["v"]) for r in rows)
    aligned = nulls.aligned(flow, work, 2).collect()
    for rep in (0, 1):
        own = [r for r in aligned if r["rep"] == rep]
        assert values(own) == values(flow.collect()) and len({(r["i"], r["area"], r["lvl"]) for r in own}) == len(own)
    members = within_area.membership(g)
    perm = nulls.permuted_levels(members, 3).collect()
    want = sorted((r["area"], r["lvl"]) for r in members.collect())
    assert all(sorted((r["area"], r["lvl"]) for r in perm if r["rep"] == k) == want for k in range(3))
    levels = g.levels.select("root_id", F.col("y_level").alias("lvl"))
    up = df.join(levels.withColumnRenamed("root_id", "pre").withColumnRenamed("lvl", "a"), "pre").join(levels.withColumnRenamed("root_id", "post").withColumnRenamed("lvl", "b"), "post").where("a < b").select("pre", "post")
    got = [(r["pre"], r["post"]) for r in nulls.rewired_by_order(up, levels).collect()]
    assert degree(got, 1) == degree([tuple(r) for r in up.collect()], 1) and all(nodes[a][1] < nodes[b][1] for a, b in got) and len(set(got)) == len(got)


def test_swaps_of_several_parts(spark, monkeypatch):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(2000)} - {(i, i) for i in range(200)})
    monkeypatch.setattr(nulls, "PART", 256)
    both = nulls.replicates(spark.createDataFrame(edges, "pre long, post long"), 2)
    assert nulls.parts_of(both, "rep") > 4
    got = nulls.swapped(both, 9, keys=("rep",)).collect()
    for rep in (0, 1):
        own = [(r["pre"], r["post"]) for r in got if r["rep"] == rep]
        assert len(set(own)) == len(own) == len(edges) and all(a != b for a, b in own) and len(set(own) & set(edges)) < len(edges) / 5
        assert all(Counter(e[i] for e in own) == Counter(e[i] for e in edges) for i in (0, 1))
    assert {(r["pre"], r["post"]) for r in got if r["rep"] == 0} != {(r["pre"], r["post"]) for r in got if r["rep"] == 1}


def test_profiles_of_drawn_levels(spark):
    """Each draw's profile is what its levels give edge by edge, the first that of the real levels; an edge is read once for all draws."""
    rng = random.Random(6)
    nodes = {i: (rng.choice(("ME", "ME.LO", "AL")), rng.randint(1, 5)) for i in range(40)}
    g = make(spark, nodes, [(a, b) for a in nodes for b in nodes if rng.random() < 0.3])
    members = within_area.membership(g)
    drawn = nulls.permuted_levels(members, 2, seed=7).collect()
    assert len({(r["rep"], r["area"], r["root_id"]) for r in drawn}) == len(drawn) == 2 * members.count()
    got = {(r["area"], r["rep"], r["signature"]): (r["n"], r["share"]) for r in within_area.drawn_profiles(g, 2, seed=7).collect()}
    assert len({tuple(v[0] for k, v in sorted(got.items()) if k[1] == rep) for rep in (-1, 0, 1)}) == 3
    for rep in (-1, 0, 1):
        own = members if rep < 0 else spark.createDataFrame([(r["area"], r["root_id"], r["lvl"]) for r in drawn if r["rep"] == rep], "area string, root_id long, lvl int")
        want = within_area.profile(within_area.signature_counts(within_area.neighbour_counts(within_area.area_edges(g, own)))).collect()
        assert {(r["area"], rep, r["signature"]): (r["n"], r["share"]) for r in want} == {k: v for k, v in got.items() if k[1] == rep}


def test_images_are_one_to_one():
    for size in (1, 2, 7, 100, 1237):
        assert sorted(nulls.images(np.arange(size), size, np.random.default_rng(size))) == list(range(size))


def test_pattern_counts_of_several_blocks(spark, monkeypatch):
    """Small blocks and steps give the counts of one block, and no table of pairs is written."""
    rng = random.Random(12)
    edges = [(10 * a, 10 * b) for a in range(14) for b in range(14) if a != b and rng.random() < 0.5]
    df = spark.createDataFrame(edges, "pre long, post long")
    some = [(e, 4) for e in patterns.all_patterns(4)][::9] + [(patterns.all_patterns(4)[-1], 4), (((0, 1), (1, 2), (2, 0)), 3)]
    widest, real = [], patterns.cut
    monkeypatch.setattr(patterns, "cut", lambda t: widest.append(len(t.columns)) or real(t))
    want = {r["pattern"]: r["n"] for r in patterns.pattern_counts(df, some).collect()}
    assert widest == [3]
    monkeypatch.setattr(patterns, "BLOCK", 40)
    monkeypatch.setattr(patterns, "CHUNK", 30)
    assert {r["pattern"]: r["n"] for r in patterns.pattern_counts(df, some).collect()} == want
    for e, k in some[-3:]:
        assert want[";".join(f"{a}>{b}" for a, b in e)] == patterns.brute_count(df, e, k).first()["n"]


def test_validation_counts(spark, monkeypatch):
    """Counts by flows alone equal counts of whole graphs, and their mean is what the null expects."""
    rng = random.Random(3)
    nodes = {i: ("ABC"[i % 3], i // 3 % 3 + 1) for i in range(45)}
    edges = [(a, b) for a in nodes for b in nodes if a != b and rng.random() < 0.4]
    g = make(spark, nodes, edges)
    work = graph.working_set(g).localCheckpoint()
    between = graph.between_metanodes(graph.with_ends(spark.createDataFrame(edges, "pre long, post long"), work)).localCheckpoint()
    rows = motifs.motif_rows(motifs.bowtie_counts(between, work, 2, 2, 1), graph.metanodes(work), 2, 2).orderBy(F.desc("motif_count"), "structure_str").limit(4).localCheckpoint()
    one = lambda df, n=1: {(r["structure_str"], r["rep"]): r["value"] for r in df.collect() if r["rep"] < n}
    real = {(r["structure_str"], 0): r["motif_count"] for r in rows.collect()}
    assert one(validation.swapped_counts(rows, between, work, 1, 0)) == real
    monkeypatch.setattr(nulls, "PART", 64)
    assert one(validation.swapped_counts(rows, between, work, 1, 0)) == real
    flows, every = [motifs.flow_in(between), motifs.flow_out(between)], between.collect()
    ends = [("fan_in_0", 0), ("fan_in_1", 0), ("fan_out_0", 1), ("fan_out_1", 1)]
    for found in (validation.block_counts(rows, between, work, 200), validation.aligned_counts(rows, flows, work, 200)):
        found = found.collect()
        assert len(found) == 4 * 200
        for r in rows.collect():
            mean, expected = sum(x["value"] for x in found if x["structure_str"] == r["structure_str"]) / 200, 5.0
            for e, side in ends:
                ends_of = lambda x: ((x["sa"], x["sl"]), (x["da"], x["dl"]))
                own = [x for x in every if (ends_of(x)[side], ends_of(x)[1 - side]) == ((r[f"{e}_area"], r[f"{e}_level"]), (r["bottleneck_area"], r["bottleneck_level"]))]
                expected *= len(own) / 5
            assert abs(mean / expected - 1) < 0.15


def test_statistics(spark):
    assert abs(statistics.hypergeometric_tail(3, 660, 20, 20) - 0.0195) < 2e-4
    chi, freedom, p = statistics.chi_square([[10, 20], [20, 10]])
    assert (round(chi, 4), freedom, round(p, 6)) == (6.6667, 1, 0.009823)
    odds, p = statistics.fisher(8, 2, 1, 5)
    assert odds == 20 and abs(p - 0.034965) < 1e-5
    rows = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5), (3.0, 4.0), (5.0, 2.0), (4.0, 4.0), (1.5, 0.25)], "a double, b double")
    w = statistics.wilcoxon(rows, "a", "b").first()
    assert (w["n"], w["statistic"]) == (5.0, 1.5)
    keyed = rows.crossJoin(spark.createDataFrame([("u",), ("v",)], "k string"))
    assert sorted(tuple(r) for r in statistics.wilcoxon(keyed, "a", "b", "k").collect()) == [("u", *w), ("v", *w)]
    assert statistics.wilcoxon(rows.limit(0), "a", "b").first()["n"] == 0 and statistics.wilcoxon(keyed.limit(0), "a", "b", "k").count() == 0
    assert [round(statistics.student(t, n), 5) for t, n in ((2, 10), (-2, 5), (0, 3), (12.7062, 1), (4.30265, 2))] == [0.07339, 0.10194, 1.0, 0.05, 0.05]
    q = {r["p"]: r["q"] for r in compare.q_values(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")).collect()}
    assert {k: round(v, 6) for k, v in q.items()} == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5}
    rho = compare.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (4.0, 9.0)], "micro double, macro double")).first()["rho"]
    assert abs(rho - 0.316228) < 1e-6


def test_null_levels_and_mixing(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 2 + 1) for i in range(200)], "root_id long, category string, lvl int")
    got = levels.null_reference(rows, 2).collect()
    assert all(0.5 <= r["purity"] < 0.65 and 0 <= r["nmi"] < 0.1 for r in got) and len(got) == 2
    test = {r["measure"]: r for r in levels.null_test(rows, 4).collect()}
    assert test["nmi"]["observed"] == test["purity"]["observed"] == 1.0 and {r["p"] for r in test.values()} == {0.2}
    assert levels.mutual_information(rows).first()["nmi"] == 1.0 and {r["purity"] for r in levels.coherence(rows).collect()} == {1.0}
    rng = random.Random(1)
    df = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b and rng.random() < 0.2], "pre long, post long")
    kept = [r["kept"] for r in nulls.mixing(df, (1, 4)).collect()]
    assert 1 > kept[0] > kept[1]


def test_signature_filter(spark):
    df = spark.createDataFrame([("FF->FB", 1), ("LAT->LAT", 2)], "signature string, n int")
    assert [r["n"] for r in distill.with_signature(df, "FWD->BWD").collect()] == [1]
    with pytest.raises(ValueError, match="LAT->LAT"):
        distill.with_signature(df, "BWD->BWD")


def test_labels_and_places(spark):
    df = spark.createDataFrame([("FF->lat", "FB", 1, "lateral"), ("FB->FF", "FBX", 2, "pure_FF")], "signature string, area string, n_FF int, hourglass_type string")
    rows = signature.normalise_labels(df).collect()
    assert [(r["signature"], r["area"], r["n_FWD"], r["hourglass_type"]) for r in rows] == [("FWD->LAT", "FB", 1, "LAT"), ("BWD->FWD", "FBX", 2, "pure_FWD")]
    labels = spark.createDataFrame([("LOL3",), ("AL.LHL2",)], "w string").select(*signature.parse_node_label(F.col("w"))).collect()
    assert [tuple(r) for r in labels] == [("LO", 3), ("AL.LH", 2)]
    groups = spark.createDataFrame([("LO.PLP",), ("ME.LO",), ("XX",), (".",), ("MB_CA",)], "g string").select(taxonomy.super_region(F.col("g")), taxonomy.super_region_label(taxonomy.super_region(F.col("g"))), taxonomy.macro_area(F.col("g"))).collect()
    assert [tuple(r) for r in groups] == [("OL.VLNP", "Optic Lobe + Ventrolateral Neuropils", "LO"), ("OL", "Optic Lobe", "ME"), ("UNK", "Unassigned", "XX"), ("UNK", "Unassigned", "UNK"), ("MB", "Mushroom Body", "MB")]
    assert sum(map(len, taxonomy.PLACES.values())) == 44


def test_csv_sources_and_artefacts(spark, tmp_path):
    (tmp_path / "neurons.csv").write_text("root_id,group,nt_type,nt_type_score,x\n720575940600000001,ME,ACH,0.9,1\n2,NA,,nan,2\n")
    (tmp_path / "classification.csv").write_text("root_id,super_class\n2,sensory\n")
    (tmp_path / "levels.csv").write_text("root_id,score,y_level\n720575940600000001,0.5,2.0\n2,0.25,\n")
    (tmp_path / "connections.csv").write_text("pre_root_id,post_root_id,neuropil,syn_count\n720575940600000001,2,ME_L,5\n")
    g = read_csv_graph(spark, *(str(tmp_path / f"{n}.csv") for n in ("neurons", "classification", "levels", "connections")))
    assert [tuple(r) for r in g.neurons.orderBy("root_id").collect()] == [(2, None, None, None), (720575940600000001, "ME", "ACH", 0.9)]
    assert [tuple(r) for r in g.levels.orderBy("root_id").collect()] == [(2, 0.25, None), (720575940600000001, 0.5, 2)]
    found = analyses.search(make(spark, *star()), "1-2-3", min_count=1)
    written = analyses.write_distilled(found, str(tmp_path / "out"), "1-2-3", rows_too=True, min_count=1)
    assert artefacts.load_table(spark, str(tmp_path / "out"), "1-2-3", "by_waist").first()["mass"] == 24
    assert spark.read.json(written["summary"]).first()["n_pattern"] == 1
    with pytest.raises(artefacts.MissingArtefact):
        artefacts.load_table(spark, str(tmp_path / "out"), "3-4-5", "by_waist")
    none = analyses.write_distilled(found.where("false"), str(tmp_path / "none"), "1-2-3", fmt="csv", gzip=True)
    assert len(none) == 8


def test_reports(spark, sf):
    from layerlens.sources.graph_tables import order_graph

    g = order_graph(spark, sf)
    tables, tests = analyses.transmitter_report(g, strat_min=20)
    assert 0 <= tests["p_chi2"] <= 1 and 0 <= tests["p_fisher"] <= 1 and 0 <= tests["p_wilcoxon"] <= 1
    k = tables["kitagawa"].first()
    assert abs(k["composition"] + k["within"] - k["gap"]) < 1e-12
    assert {r["passed"] for r in analyses.check_values(spark, {"a": 1.0}, {"a": 1.0}).collect()} == {True}
    core = analyses.core_report(g, tau=0.2, hops=2, max_core=3, max_flat_core=3)
    assert core["core"].count() >= 1 and core["curve"].count() == 6


def test_top_of_few_keys_and_summary(spark):
    rows = [("ab"[i % 2], (i * 7919) % 997, f"s{i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "hourglass_type string, motif_count long, structure_str string").repartition(3)
    want = sorted(r for t in "ab" for r in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[1], r[2]))[:1500])
    assert sorted(map(tuple, distill.top(df, 1500, "hourglass_type").collect())) == want
    assert {r["hourglass_type"]: r["n"] for r in distill.top_summary(df).collect()} == {"a": 3000, "b": 3000, None: 6000}
