"""Counts of a few chosen motifs in many randomised graphs.

A motif of a waist is a sum over the waist's nodes of the product of four flows, so
of a randomised graph only these flows are made: arrays with a number for each node
of the waist.  Work is dealt by replicate and waist.  The chosen motifs, the sizes
of their metanodes and blocks and the values of their flows are on the driver; no
edges are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop
from .nulls import draw, numbered, parts_of, replicates, swap_rounds, swapped

INTO, OUT = 0, 1
ENDS = ("fan_in_0", "fan_in_1", "fan_out_0", "fan_out_1")
COUNTS = "structure_str string, rep int, value long"


def generator(*key) -> np.random.Generator:
    """Random numbers of their own for each key, the same again whenever it is made."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=16).digest(), "little"))


class Chosen:
    """Chosen motifs (rows of ``top``) by waist, and the flows they need: (side, waist, metanode)."""

    def __init__(self, top: DataFrame):
        self.motifs: dict[tuple, list[tuple[str, list[tuple]]]] = defaultdict(list)
        node = lambda r, e: (r[f"{e}_area"], r[f"{e}_level"])
        for r in top.select("structure_str", *(f"{e}_{c}" for e in ("bottleneck", *ENDS) for c in ("area", "level"))).collect():
            waist = node(r, "bottleneck")
            self.motifs[waist].append((r["structure_str"], [(int("out" in e), waist, node(r, e)) for e in ENDS]))
        self.waists = sorted(self.motifs)
        self.flows = {f for own in self.motifs.values() for _, four in own for f in four}

    def blocks(self) -> set[tuple]:
        """(from, to) of the blocks of edges that make the flows."""
        return {(m, b) if side == INTO else (b, m) for side, b, m in self.flows}

    def sums(self, waist: tuple, flow: Callable[[tuple], np.ndarray]) -> list[tuple[str, int]]:
        """Counts of the motifs of a waist; ``flow`` gives the flow of a key, and is asked once for each."""
        held: dict[tuple, np.ndarray] = {}
        for _, four in self.motifs[waist]:
            held.update({f: flow(f) for f in four if f not in held})
        return [(name, int(np.prod([held[f] for f in four], axis=0, dtype=np.int64).sum())) for name, four in self.motifs[waist]]


def _counts(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    names, reps, values = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(reps, pa.int32()), pa.array(values, pa.int64())], names=["structure_str", "rep", "value"])


def _by_waist(spark, chosen: Chosen, n: int, flow: Callable[[int, tuple], np.ndarray]) -> DataFrame:
    """structure_str, rep, value: a row for each replicate and waist is dealt out, whose flows ``flow`` draws."""
    waists, size = chosen.waists, len(chosen.waists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                rep, waist = x // size, waists[x % size]
                yield _counts([(name, rep, value) for name, value in chosen.sums(waist, lambda f: flow(rep, f))])  # noqa: B023

    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    return spark.range(0, n * size, numPartitions=max(1, min(parts, n * size))).mapInArrow(run, COUNTS)


def _sizes(nodes: DataFrame) -> dict[tuple, int]:
    return {(r["area"], r["lvl"]): r["n"] for r in nodes.groupBy("area", "lvl").agg(F.count(F.lit(1)).alias("n")).collect()}


def block_counts(top: DataFrame, edges: DataFrame, nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """structure_str, rep, value: counts of the motifs ``top`` in graphs whose blocks of edges are dealt anew, as many among all pairs, without repeats.

    The edges of a block are a function of seed, replicate and block, so both of its metanodes see the same."""
    chosen, size = Chosen(top), _sizes(nodes)
    wanted = chosen.blocks()
    rows = edges.groupBy("sa", "sl", "da", "dl").agg(F.count(F.lit(1)).alias("k")).collect()  # a row for each pair of metanodes
    k = {b: r["k"] for r in rows if (b := ((r["sa"], r["sl"]), (r["da"], r["dl"]))) in wanted}

    def flow(rep: int, key: tuple) -> np.ndarray:
        side, waist, other = key
        block = (other, waist) if side == INTO else (waist, other)
        width = size[block[1]]
        cells = generator(seed, rep, *block).choice(size[block[0]] * width, k.get(block, 0), replace=False, shuffle=False)
        return np.bincount(cells % width if side == INTO else cells // width, minlength=size[waist])

    return _by_waist(top.sparkSession, chosen, n, flow)


def aligned_counts(top: DataFrame, flows: list[DataFrame], nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """structure_str, rep, value: counts of the motifs ``top`` when the values of each flow (i, area, lvl, v, into and out of nodes), zeros too, are dealt anew among the waist's nodes."""
    chosen, size, spark = Chosen(top), _sizes(nodes), top.sparkSession
    need = spark.createDataFrame([(side, *b, *m) for side, b, m in chosen.flows], "side int, wa string, wl int, area string, lvl int")
    waist = nodes.select(F.col("root_id").alias("i"), F.col("area").alias("wa"), F.col("lvl").alias("wl"))
    held = [f.join(waist, "i").withColumn("side", F.lit(side)).join(F.broadcast(need), ["side", "wa", "wl", "area", "lvl"], "left_semi") for side, f in enumerate(flows)]
    # of a flow that is dealt anew, no more than how often each value occurs is needed
    law = defaultdict(list)
    for r in held[0].unionByName(held[1]).groupBy("side", "wa", "wl", "area", "lvl", "v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect():
        law[r["side"], (r["wa"], r["wl"]), (r["area"], r["lvl"])].append((r["v"], r["n"]))

    def flow(rep: int, key: tuple) -> np.ndarray:
        values, out = np.array(law.get(key, []), np.int64).reshape(-1, 2), np.zeros(size[key[1]], np.int64)
        out[generator(seed, rep, *key).choice(len(out), values[:, 1].sum(), replace=False)] = np.repeat(values[:, 0], values[:, 1])
        return out

    return _by_waist(spark, chosen, n, flow)


#: Groups of replicates, each of which one task swaps after each other if the edges are one part.
TOGETHER = 24


def swapped_counts(top: DataFrame, edges: DataFrame, nodes: DataFrame, n: int, rounds: int, seed: int = 42, max_jump: int = 1) -> DataFrame:
    """structure_str, rep, value: counts of the motifs ``top`` in graphs after rounds of swaps of ``edges`` (pre, post; both in ``nodes``).

    Nodes are numbered by metanode, so that a swapped edge shows what flow it belongs
    to.  Of each graph only the places of the flows needed go on, a list for each flow."""
    chosen, spark = Chosen(top), edges.sparkSession
    size = _sizes(nodes)
    order = sorted(size)
    start = np.concatenate([[0], np.cumsum([size[m] for m in order])])
    first = spark.createDataFrame([(*m, int(x)) for m, x in zip(order, start)], "area string, lvl int, start long")
    number = numbered(nodes.select("root_id", "area", "lvl"), draw(seed, "root_id"), "area", "lvl", name="place").join(F.broadcast(first), ["area", "lvl"]).select("root_id", (F.col("start") + F.col("place")).alias("x"))
    rows = edges.select("pre", "post")
    for c in ("pre", "post"):
        rows = rows.join(number.select(F.col("root_id").alias(c), F.col("x").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    rows = cut(rows)
    of = {m: x for x, m in enumerate(order)}
    needed = {(side, of[b], of[m]): (side, b, m) for side, b, m in chosen.flows}

    def places(rep: int, pre: np.ndarray, post: np.ndarray) -> list[tuple]:
        """rep, side, b, m, places in b of the edges of each flow that is needed."""
        s, d, out = np.searchsorted(start, pre, "right") - 1, np.searchsorted(start, post, "right") - 1, []
        block = s * len(order) + d
        by = np.argsort(block, kind="stable")
        low, high = (np.searchsorted(block[by], np.arange(len(order) ** 2), x) for x in ("left", "right"))
        for side, b, m in needed:
            k = m * len(order) + b if side == INTO else b * len(order) + m
            if high[k] > low[k] and b != m and abs(order[b][1] - order[m][1]) <= max_jump:
                own = by[low[k] : high[k]]
                out.append((rep, side, b, m, ((post if side == INTO else pre)[own] - start[b]).astype("<i4").tobytes()))
        return out

    kept, schema = ["rep", "side", "b", "m", "places"], "rep int, side int, b int, m int, places binary"
    types = [pa.int32()] * 4 + [pa.binary()]
    packed = lambda found: pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names=kept)

    if parts_of(rows) == 1:

        def run(group: pa.Table) -> pa.Table:
            pre, post, at, found = *(group.column(c).to_numpy() for c in ("pre", "post")), group.column("at")[0].as_py(), []
            for rep in range(at, n, TOGETHER):
                found += places(rep, *swap_rounds(pre, post, rounds, generator(seed, rep)))
            return packed(found)

        flows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(min(TOGETHER, n) - 1)))).groupBy("at").applyInArrow(run, schema)
    else:

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rep, pre, post = (batch.column(c).to_numpy() for c in ("rep", "pre", "post"))
                for r in np.unique(rep):
                    yield from packed(places(int(r), pre[rep == r], post[rep == r])).to_batches()

        flows = swapped(replicates(rows, n), rounds, seed, keys=("rep",)).select("rep", "pre", "post").mapInArrow(listed, schema)

    def counts(group: pa.Table) -> pa.Table:
        rep, b, lists = group.column("rep")[0].as_py(), group.column("b")[0].as_py(), defaultdict(list)
        for side, m, own in zip(*(group.column(c).to_pylist() for c in ("side", "m", "places"))):
            lists[needed[side, b, m]].append(np.frombuffer(own, "<i4"))
        full = lambda key: np.bincount(np.concatenate(lists[key]), minlength=size[order[b]]) if key in lists else np.zeros(size[order[b]], np.int64)
        return pa.Table.from_batches([_counts([(name, rep, value) for name, value in chosen.sums(order[b], full)])])

    out = cut(flows.groupBy("rep", "b").applyInArrow(counts, COUNTS))
    drop(rows)
    return out
