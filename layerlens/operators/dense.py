"""Bow-tie counts of waists whose nodes share most metanodes, as products of matrices.

The star join makes a row for each node and combination.  Where a waist's nodes
meet the same combinations again and again, blocks of its nodes are matrices
instead: a column is the product of a combination's flows, and the product of
the in-columns with the out-columns holds the counts of all pairs at once.
Spark deals nodes to blocks, so that no waist is one group, and adds what the
blocks found.  Blocks and tiles of combinations bound the memory of a task,
whatever the size of a waist.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of a block and combinations of a tile: a tile's counts are 2 MB, its columns 4 MB a side.
BLOCK, TILE = 1024, 512
#: A waist is dense if that share of its nodes' possible combinations occurs, and each possible one so often.
LEAST_DENSITY, LEAST_REPEATS = 0.02, 4


def _choose(n: Column, k: int) -> Column:
    """Number of ways to take ``k`` of ``n``; 0 where n < k."""
    return reduce(lambda x, j: x * (n - j) / (j + 1), range(k), F.lit(1.0))


def density(into: DataFrame, out: DataFrame, k_in: int, k_out: int) -> DataFrame:
    """b, n_nodes, star_rows, cells, density, dense of every waist.

    ``into``: b, i, mid, v; ``out``: i, mid, v.  n_nodes have neighbours enough on both sides; star_rows are the rows that the star
    join would make before overlaps go, cells the pairs of combinations of the metanodes that any of these nodes meet, density
    star_rows for each node and cell.  Waists without such nodes have no row."""
    wide = lambda flow, name, *more: flow.groupBy(*more, "i").agg(F.count(F.lit(1)).alias(name))
    nodes = wide(into, "x", "b").where(F.col("x") >= k_in).join(wide(out, "y").where(F.col("y") >= k_out), "i")
    rows = nodes.groupBy("b").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(_choose(F.col("x"), k_in) * _choose(F.col("y"), k_out)).alias("star_rows"))
    met = lambda flow, name: nodes.select("b", "i").join(flow.select("i", "mid"), "i").select("b", "mid").distinct().groupBy("b").agg(F.count(F.lit(1)).alias(name))
    found = rows.join(met(into, "x"), "b").join(met(out, "y"), "b").withColumn("cells", _choose(F.col("x"), k_in) * _choose(F.col("y"), k_out))
    found = found.withColumn("density", F.col("star_rows") / (F.col("n_nodes") * F.col("cells")))
    chosen = (F.col("density") >= LEAST_DENSITY) & (F.col("star_rows") >= LEAST_REPEATS * F.col("cells"))
    return found.select("b", "n_nodes", "star_rows", "cells", "density", chosen.alias("dense"))


def _tiles(flows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Combinations of ``k`` columns that some node has, and their products, ``TILE`` at a time."""
    every = itertools.combinations(range(flows.shape[1]), k)
    while some := list(itertools.islice(every, TILE)):
        combos = np.array(some)
        products = reduce(np.multiply, (flows[:, combos[:, j]] for j in range(k)))
        met = products.any(axis=0)
        if met.any():
            yield combos[met], products[:, met]


def _matrix(at: np.ndarray, mid: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metanodes of a block's nodes and the nodes' flows, a column each; ``at``: offsets of nodes."""
    mids, column = np.unique(mid, return_inverse=True)
    out = np.zeros((len(at) - 1, len(mids)), dtype=np.int64)
    out[np.repeat(np.arange(len(at) - 1), np.diff(at)), column] = v
    return mids, out


def block_counts(into: tuple[np.ndarray, ...], out: tuple[np.ndarray, ...], k_in: int, k_out: int) -> Iterator[tuple[np.ndarray, ...]]:
    """in-metanodes, out-metanodes, count, active nodes and sum of squares of all pairs of combinations without a common metanode.

    ``into`` and ``out``: offsets of nodes, metanodes, flows.  Counts are exact: doubles are used up to 2**53, whole numbers beyond, and past 2**63 it raises."""
    (mids_in, flow_in), (mids_out, flow_out) = _matrix(*into), _matrix(*out)
    if not (flow_in.any() and flow_out.any()):
        return
    largest = float(flow_in.max()) ** k_in * float(flow_out.max()) ** k_out * len(flow_in)
    if largest >= 2.0**63:
        raise OverflowError("counts of a block may pass 64 bits")
    kind = np.float64 if largest < 2.0**53 else np.int64
    for left, p in _tiles(flow_in.astype(kind), k_in):
        p_real, p_some = p.astype(np.float64), (p > 0).astype(np.float64)
        for right, q in _tiles(flow_out.astype(kind), k_out):
            q_real = q.astype(np.float64)
            active = p_some.T @ (q > 0)
            a, d = np.nonzero(active)
            ends_in, ends_out = mids_in[left[a]], mids_out[right[d]]
            apart = (ends_in[:, :, None] != ends_out[:, None, :]).all(axis=(1, 2))
            a, d = a[apart], d[apart]
            if len(a):
                yield ends_in[apart], ends_out[apart], (p.T @ q)[a, d].astype(np.int64), active[a, d].astype(np.int64), ((p_real * p_real).T @ (q_real * q_real))[a, d]


def star_sums(into: DataFrame, out: DataFrame, sizes: DataFrame, k_in: int, k_out: int) -> DataFrame:
    """b, a0.., d0.., motif_count, n_waist_active, ssq of all waists in ``into``, by matrices.

    ``sizes``: b, n (nodes of each waist), by which nodes are dealt to blocks.  A node's row holds its flows, so it is bounded by the number of metanodes."""
    ends = [*(f"a{n}" for n in range(k_in)), *(f"d{n}" for n in range(k_out))]
    listed = lambda flow, side, *more: flow.groupBy(*more, "i").agg(F.collect_list("mid").alias(f"{side}_mid"), F.collect_list("v").alias(f"{side}_v"))
    nodes = listed(into, "in", "b").where(F.size("in_mid") >= k_in).join(listed(out, "out").where(F.size("out_mid") >= k_out), "i")
    part = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / BLOCK))
    dealt = nodes.join(sizes.select("b", "n"), "b").withColumn("part", part).repartition("b", "part").sortWithinPartitions("b", "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy()
            cuts = np.flatnonzero(np.diff(b)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                for first in range(low, high, BLOCK):
                    yield from cells(batch.slice(first, min(BLOCK, high - first)), int(b[first]))

    def cells(block: pa.RecordBatch, waist: int) -> Iterator[pa.RecordBatch]:
        sides = []
        for side in ("in", "out"):
            mid, v = block.column(f"{side}_mid"), block.column(f"{side}_v")
            at = np.concatenate([[0], np.cumsum(mid.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sides.append((at, mid.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)))
        for a, d, n, active, squares in block_counts(*sides, k_in, k_out):
            columns = [np.full(len(n), waist), *a.T, *d.T, n, active]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(squares)], ["b", *ends, "motif_count", "n_waist_active", "ssq"])

    schema = ", ".join(f"{c} long" for c in ["b", *ends, "motif_count", "n_waist_active"]) + ", ssq double"
    found = dealt.select("b", "in_mid", "in_v", "out_mid", "out_v").mapInArrow(count, schema)
    return found.groupBy("b", *ends).agg(*(F.sum(c).alias(c) for c in ("motif_count", "n_waist_active", "ssq")))
