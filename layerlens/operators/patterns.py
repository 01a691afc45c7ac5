"""Small directed patterns: catalogue, shapes, and homomorphism counts by messages along trees and by tables of bags."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .nulls import among

Edges = tuple[tuple[int, int], ...]


def connected(edges: Edges, k: int) -> bool:
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in edges:
            for y in ((b,) if a == x else ()) + ((a,) if b == x else ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    return len(seen) == k


def canonical(edges: Edges, k: int) -> Edges:
    """The least of a pattern's relabellings."""
    return min(tuple(sorted((p[a], p[b]) for a, b in edges)) for p in permutations(range(k)))


def all_patterns(k: int) -> list[Edges]:
    """Connected patterns without loops on k nodes, one of each kind."""
    arcs = [(a, b) for a in range(k) for b in range(k) if a != b]
    found = {canonical(e, k) for n in range(k - 1, len(arcs) + 1) for e in combinations(arcs, n) if connected(e, k)}
    return sorted(found, key=lambda e: (len(e), e))


def skeleton(edges: Edges) -> set[tuple[int, int]]:
    return {(min(e), max(e)) for e in edges}


def shape(edges: Edges, k: int) -> str:
    """path, star, tree or cyclic, by the undirected skeleton."""
    lines = skeleton(edges)
    if len(lines) != k - 1:
        return "cyclic"
    degree = [sum(x in line for line in lines) for x in range(k)]
    if max(degree) <= 2:
        return "path"
    return "star" if max(degree) == k - 1 else "tree"


def treewidth(edges: Edges, k: int) -> int:
    """Least width of an elimination order (exact for so few nodes)."""
    lines = skeleton(edges)
    best = k
    for order in permutations(range(k)):
        near = {x: {y for line in lines if x in line for y in line if y != x} for x in range(k)}
        width = 0
        for x in order:
            own = near.pop(x)
            width = max(width, len(own))
            for y in own:
                near[y] = (near[y] | own) - {x, y}
        best = min(best, width)
    return best


def catalogue(spark: SparkSession, max_nodes: int = 4) -> DataFrame:
    """pattern, nodes, edges, shape, treewidth, factorises (its count is a product along a tree)."""
    rows = [(";".join(f"{a}>{b}" for a, b in e), k, len(e), shape(e, k), treewidth(e, k), shape(e, k) != "cyclic") for k in range(3, max_nodes + 1) for e in all_patterns(k)]
    return spark.createDataFrame(rows, "pattern string, nodes int, edges int, shape string, treewidth int, factorises boolean")


def tree_count(graph: DataFrame, edges: Edges, k: int) -> DataFrame:
    """n: homomorphisms of a tree-shaped pattern into the graph (pre, post).

    Each leaf sends its number of matches to its parent: one join and one sum an edge.  A pair of opposite edges runs over mutual edges."""
    if shape(edges, k) == "cyclic":
        raise ValueError("the pattern is no tree")
    near = {x: sorted({y for e in edges if x in e for y in e if y != x}) for x in range(k)}
    arcs = set(edges)

    def step(child: int, parent: int) -> DataFrame:
        """c, p: pairs of graph nodes that child and parent may match."""
        down, up = (parent, child) in arcs, (child, parent) in arcs
        one = graph.select(F.col("post").alias("c"), F.col("pre").alias("p")) if down else graph.select(F.col("pre").alias("c"), F.col("post").alias("p"))
        return one.join(graph.select(F.col("pre").alias("c"), F.col("post").alias("p")), ["c", "p"], "left_semi") if down and up else one

    def message(x: int, parent: int | None) -> DataFrame | None:
        """v, n: matches of the part below x that put x on v; None where any v has one."""
        out = None
        for y in near[x]:
            if y != parent:
                below, pairs = message(y, x), step(y, x)
                own = pairs.withColumn("n", F.lit(1.0)) if below is None else pairs.join(below.withColumnRenamed("v", "c"), "c")
                own = own.groupBy(F.col("p").alias("v")).agg(F.sum("n").alias("n"))
                out = own if out is None else out.join(own.withColumnRenamed("n", "n2"), "v").select("v", (F.col("n") * F.col("n2")).alias("n"))
        return out

    return message(0, None).agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))


def diamond_count(graph: DataFrame) -> DataFrame:
    """n: a>b>d and a>c>d, the sum of squares of two-step paths (b and c may be the same)."""
    two = graph.select(F.col("pre").alias("a"), F.col("post").alias("m")).join(graph.select(F.col("pre").alias("m"), F.col("post").alias("d")), "m")
    ways = two.groupBy("a", "d").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return ways.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("n"))


def cover(edges: Edges, k: int) -> tuple[int, ...]:
    """The least set of nodes that every edge touches: those outside it have no edge among them."""
    return next(c for n in range(1, k) for c in combinations(range(k), n) if all(set(e) & set(c) for e in edges))


def _relation(arcs: set[tuple[int, int]], a: int, b: int) -> int:
    """0: a to b, 1: b to a, 2: both ways."""
    return 2 if (a, b) in arcs and (b, a) in arcs else 0 if (a, b) in arcs else 1


#: Neighbour rows of the nodes of one block, and steps of two edges that are expanded at once.
BLOCK, CHUNK = 1 << 19, 1 << 21
#: Kinds of neighbour (1: to it, 2: from it, 3: both ways) that each relation holds for: 0 to it, 1 from it, 2 both ways.
HOLDS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 1]], float)


def _expanded(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of rows: the run of each row, and the row."""
    run = np.repeat(np.arange(len(length)), length)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)


def _bag_sums(own: tuple[np.ndarray, ...], near: tuple[np.ndarray, ...], closed: list[list], complete: list[list]) -> np.ndarray:
    """Sums over pairs (u, v) with a common neighbour: the products of two columns of c (9) and d (3), then ``closed``, then ``complete`` patterns.

    ``own``: u, x, kind of the nodes of a block; ``near``: x, v, kind (seen from v) of the neighbours of these x."""
    u, x, t = (c[np.lexsort((own[1], own[0]))] for c in own)
    nx, nv, nt = (c[np.argsort(near[0], kind="stable")] for c in near)
    names, v = np.unique(nv, return_inverse=True)
    low, high = np.searchsorted(nx, x), np.searchsorted(nx, x, "right")
    node = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    degree = np.add.reduceat(HOLDS[t], node, axis=0)
    local = np.cumsum(np.concatenate([[0], (u[1:] != u[:-1]).astype(np.int64)]))
    # the row of a neighbour of a node, by both
    place = np.minimum(np.searchsorted(names, x), len(names) - 1)
    code = local * len(names) + place
    apart = names[place] != x
    code[apart] = -1
    by = np.argsort(code, kind="stable")
    ordered, steps = code[by], np.cumsum(high - low)
    gram, rest, row, law = np.zeros((12, 12)), np.zeros(len(closed) + len(complete)), 0, np.kron(HOLDS[1:], HOLDS[1:])
    ends = np.append(node[1:], len(u))
    while row < len(u):
        done = steps[row - 1] if row else 0
        k = max(np.searchsorted(steps[ends - 1], done + CHUNK, "right"), np.searchsorted(ends, row, "right") + 1)
        stop = ends[min(k, len(ends)) - 1]
        arc, at = _expanded(low[row:stop], (high - low)[row:stop])
        arc += row
        key = local[arc] * len(names) + v[at]
        each = np.sort(key * 9 + (t[arc].astype(np.int64) - 1) * 3 + nt[at] - 1)
        by_key = each // 9
        first = np.flatnonzero(np.concatenate([[True], by_key[1:] != by_key[:-1]])) if len(each) else np.zeros(0, np.int64)
        many, pair = np.diff(np.append(first, len(each))), by_key[first]
        # most pairs have one common neighbour: sums by its kind are enough
        one = first[many == 1]
        kinds, d = each[one] % 9, degree[by_key[one] // len(names)]
        gram[:9, :9] += law.T @ (np.bincount(kinds, minlength=9)[:, None] * law)
        gram[:9, 9:] += law.T @ np.stack([np.bincount(kinds, d[:, r], 9) for r in range(3)], axis=1)
        next_to = np.flatnonzero(np.isin(ordered[np.searchsorted(ordered, local[row] * len(names)) : np.searchsorted(ordered, (local[stop - 1] + 1) * len(names))], pair, assume_unique=True))
        next_to += np.searchsorted(ordered, local[row] * len(names))
        beside = np.searchsorted(pair, ordered[next_to])

        def bags(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """c and d of some pairs."""
            of, rows = _expanded(first[which], many[which])  # noqa: B023
            seen = np.bincount(of * 9 + each[rows] % 9, minlength=9 * len(which)).reshape(-1, 9).astype(float)  # noqa: B023
            return seen @ law, degree[pair[which] // len(names)]  # noqa: B023

        c, d = bags(np.flatnonzero(many > 1))
        gram[:9] += c.T @ np.concatenate([c, d], axis=1)
        c, d = bags(beside)
        columns = {"c": c, "d": d, "r": HOLDS[t[by][next_to]]}
        for n, factors in enumerate(closed):
            rest[n] += reduce(lambda p, q: p * q, (columns[f][:, k] for f, k in factors)).sum()
        if complete and len(next_to):
            held = np.flatnonzero(among(key, ordered[next_to]))
            rest[len(closed) :] += _complete_sums(arc[held], by[np.searchsorted(ordered, key[held])], nt[at[held]], t, complete)
        row = stop
    return np.concatenate([gram.ravel(), rest])


def _complete_sums(a: np.ndarray, b: np.ndarray, k: np.ndarray, t: np.ndarray, complete: list[list]) -> np.ndarray:
    """Sums of the complete patterns: triangles among the neighbours of a node.

    ``a``, ``b``: rows (of kind ``t``) of two neighbours of a node that are neighbours themselves, both ways round; ``k``: the kind of the first, seen from the second."""
    order = np.lexsort((b, a))
    a, b, k = a[order], b[order], k[order]
    full = a * len(t) + b
    out = np.zeros(len(complete))
    low, high = np.searchsorted(a, a), np.searchsorted(a, a, "right")
    for x in range(0, len(a), 4096):
        one, two = _expanded(low[x : x + 4096], (high - low)[x : x + 4096])
        one += x
        want = b[one] * len(t) + b[two]
        f = np.minimum(np.searchsorted(full, want), len(full) - 1)
        fit = np.flatnonzero(full[f] == want)
        one, two, three = one[fit], two[fit], f[fit]
        # v, w, x are a[one], b[one], b[two]; a kind seen from the far end holds the other way round
        back = np.array([1, 0, 2])
        kinds = {"uv": HOLDS[t[a[one]]], "uw": HOLDS[t[b[one]]], "ux": HOLDS[t[b[two]]], "vw": HOLDS[k[one]][:, back], "vx": HOLDS[k[two]][:, back], "wx": HOLDS[k[three]][:, back]}
        for n, factors in enumerate(complete):
            out[n] += reduce(lambda p, q: p * q, (kinds[c][:, r] for c, r in factors)).sum()
    return out


def pattern_counts(graph: DataFrame, patterns: list[tuple[Edges, int]]) -> DataFrame:
    """pattern, nodes, n: homomorphisms of each pattern (connected, with a cover of three nodes at most) into the graph (pre, post).

    Variables outside the cover are eliminated first: those that touch one node of
    it become a degree of that node, those that touch two a number of common
    neighbours of the pair, by direction.  A pattern is then one sum over the nodes,
    the adjacent pairs or the pairs, with the product of its bags.  Pairs with a
    common neighbour are not written: a task has the neighbours of a block of nodes
    and theirs, and sums over their pairs.  Blocks are ranges of ids, since nodes with
    ids close together often share neighbours; that decides no more than how many rows
    move.  Only complete patterns have a cover of three; they are triangles among the
    neighbours of a node.
    """
    arc = lambda u, v, o, i: graph.select(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    near = arc("pre", "post", 1, 0).unionByName(arc("post", "pre", 0, 2)).groupBy("u", "v").agg((F.max("o") + F.max("i")).cast("byte").alias("t"))
    near = cut(near)
    holds = lambda r: F.col("t").bitwiseAND(F.lit((1, 2, 3)[r]).cast("byte")) == (1, 2, 3)[r]
    degree = near.groupBy("u").agg(*(F.count_if(holds(r)).cast("double").alias(f"d{r}") for r in range(3)))
    turned = lambda r: (1, 0, 2)[r]
    plain: dict[str, list[tuple[str, int, Column]]] = {"node": [], "adjacent": []}
    pairs, closed, complete, named = [], [], [], {"pair": [], "closed": [], "complete": []}
    for edges, k in patterns:
        arcs, core = set(edges), cover(edges, k)
        touches = lambda x, y: (x, y) in arcs or (y, x) in arcs  # noqa: B023, E731
        name = (";".join(f"{a}>{b}" for a, b in edges), k)
        if len(core) == 3:
            (u, v, w), others = core, [x for x in range(k) if x not in core]
            if k != 4 or not all(touches(a, b) for a, b in combinations(range(k), 2)):
                raise ValueError("only the complete patterns of four nodes have a cover of three")
            complete.append([(c, _relation(arcs, a, b)) for c, a, b in (("uv", u, v), ("uw", u, w), ("vw", v, w), ("ux", u, others[0]), ("vx", v, others[0]), ("wx", w, others[0]))])
            named["complete"].append(name)
            continue
        commons, degrees = [], []
        for x in (x for x in range(k) if x not in core):
            at = [n for n, c in enumerate(core) if touches(c, x)]
            own = [_relation(arcs, core[n], x) for n in at]
            commons += [tuple(own)] if len(at) == 2 else []
            degrees += [(at[0], own[0])] if len(at) == 1 else []
        joined = _relation(arcs, *core) if len(core) == 2 and touches(*core) else None
        if not commons:
            factors = [F.col(f"{'uv'[end]}_d{r}") for end, r in degrees] + ([] if joined is None else [holds(joined).cast("double")])
            plain["node" if len(core) == 1 else "adjacent"].append((*name, reduce(lambda a, b: a * b, factors)))
            continue
        if any(end == 1 for end, _ in degrees):  # a sum over all pairs is the same with the pair turned round, and then its degree is of the first
            commons, joined = [(s, r) for r, s in commons], None if joined is None else turned(joined)
        columns = [("c", 3 * r + s) for r, s in commons] + [("d", r) for _, r in degrees]
        if joined is None:
            pairs.append(tuple(k + 9 * (c == "d") for c, k in columns))
            named["pair"].append(name)
        else:
            closed.append([*columns, ("r", joined)])
            named["closed"].append(name)
    ends = lambda v: degree.select(F.col("u").alias(v), *(F.col(f"d{r}").alias(f"{v}_d{r}") for r in range(3)))
    out = []
    for kind, own in plain.items():
        for a in range(0, len(own), 40):  # sums of one aggregation
            table = ends("u") if kind == "node" else near.join(ends("u"), "u").join(ends("v"), "v")
            row = table.agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(f"n{i}") for i, (_, _, n) in enumerate(own[a : a + 40])))
            rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(k).alias("nodes"), F.col(f"n{i}").alias("n")) for i, (p, k, _) in enumerate(own[a : a + 40])))
            out.append(row.select(F.explode(rows).alias("x")).select("x.*"))
    listed = [*named["pair"], *named["closed"], *named["complete"]]
    if listed:
        out.append(_blocked(near, pairs, closed, complete, listed))
    return reduce(DataFrame.unionByName, out)


def _blocked(near: DataFrame, pairs: list[tuple], closed: list[list], complete: list[list], listed: list[tuple[str, int]]) -> DataFrame:
    """pattern, nodes, n of patterns that need pairs with a common neighbour, summed over blocks of nodes."""
    blocks = -(-near.count() // BLOCK)
    cuts = sorted(set(near.approxQuantile("u", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    wide = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="u", outputCol="block") if cuts else None
    own = wide.transform(near).withColumn("block", F.col("block").cast("int")) if wide else near.withColumn("block", F.lit(0))
    around = own.select("block", F.col("v").alias("a")).distinct().join(near.select(F.col("v").alias("a"), F.col("u").alias("b"), "t"), "a")
    rows = own.select("block", F.lit(True).alias("own"), F.col("u").alias("a"), F.col("v").alias("b"), "t").unionByName(around.withColumn("own", F.lit(False)))

    def run(group: pa.Table) -> pa.Table:
        side, columns = group.column("own").to_numpy(), [group.column(c).to_numpy() for c in "abt"]
        sums = _bag_sums(tuple(c[side] for c in columns), tuple(c[~side] for c in columns), closed, complete)
        gram = sums[:144].reshape(12, 12)
        return pa.table({"k": pa.array(range(len(listed)), pa.int32()), "n": pa.array([*(gram[p] for p in pairs), *sums[144:]], pa.float64())})

    sums = rows.groupBy("block").applyInArrow(run, "k int, n double").groupBy("k").agg(F.sum("n").alias("n"))
    names = near.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(listed)], "k int, pattern string, nodes int")
    return names.join(sums, "k", "left").select("pattern", "nodes", F.coalesce("n", F.lit(0.0)).alias("n"))


def brute_count(graph: DataFrame, edges: Edges, k: int) -> DataFrame:
    """n: homomorphisms by joining the edge list once for each edge, in an order that keeps the pattern connected."""
    todo, out, known = list(edges), None, set()
    while todo:
        a, b = next((e for e in todo if not known or known & set(e)))
        todo.remove((a, b))
        own = graph.select(F.col("pre").alias(f"x{a}"), F.col("post").alias(f"x{b}"))
        out = own if out is None else out.join(own, sorted(f"x{x}" for x in {a, b} & known))
        known |= {a, b}
    return out.agg(F.count(F.lit(1)).cast("double").alias("n"))
