"""Connected components without a hot key.

1. Every task joins the edges it reads (union-find) and names each node's root in
   that task, so a node of many edges reaches the shuffle once a task.
2. A node with several roots links them.  Nodes met by one task only are done.
3. The roots' graph, small by then, is settled by alternating stars: first every
   larger neighbour of a node moves to the node's smallest neighbour, then every
   smaller one; a forest of stars remains after about a logarithm of its depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import release
from .storage import materialise

#: Nodes that a task joins at once.
CHUNK = 1 << 18


def _first(value: str, key: str) -> F.Column:
    """Smallest value of a key: the first in order, so that no group is held."""
    return F.first(value).over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _forest(edges: DataFrame) -> DataFrame:
    """node, root: for every run of edges in a task, each node and the smallest node that the run joins it with."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def close() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in up]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], own) for i in range(2)], ["node", "root"])

        own = pa.int64() if kind == "bigint" else pa.binary()
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) >= CHUNK:
                yield close()
        if up:
            yield close()
        release()

    return edges.mapInArrow(run, f"node {kind}, root {kind}")


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    """u, v: each node of ``edges`` but the smallest of its component, and that one."""
    for _ in range(rounds):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = both.withColumn("m", F.least("u", _first("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", _first("v", "u")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("top")).where("down > 1 OR (down = 1 AND top = 0)").isEmpty():
            return edges
    raise ValueError("components did not settle")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 64) -> DataFrame:
    """node, component (its smallest node) for every node of an edge between two nodes."""
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    forest = materialise(_forest(edges), "forest")
    roots = materialise(forest.repartition("node").distinct().withColumn("top", _first("root", "node")), "roots")
    own = roots.where("root = top").select("node", "top")
    several = roots.where("root <> top").select(F.col("root").alias("u"), F.col("top").alias("v"))
    if several.isEmpty():
        return own.withColumnRenamed("top", "component")
    higher = _settled(several, rounds).select(F.col("u").alias("top"), F.col("v").alias("component"))
    return materialise(own.join(higher, "top", "left").select("node", F.coalesce("component", "top").alias("component")), "labels")
