"""Randomised copies of graphs and flows, drawn by shuffles of seeded hashes.

Every draw is a function of seed, replicate and row, so a lost task draws the
same again.  No replicate passes through one task: ranks are made by numbering
within hash buckets and adding the sizes of the buckets before.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop

#: Fewest hash buckets that a numbering is split over; there are four for each shuffle partition.
BUCKETS = 64


def draw(seed: int, *columns: str | Column) -> Column:
    """A uniform number in [0, 1) of seed and columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def counted(df: DataFrame, n: Column, name: str, step: int = 4096) -> DataFrame:
    """Each row once for each 0..n-1 (``n`` may be 0), in two steps, so that no array is longer than a few thousand up to some ten million."""
    runs = df.withColumn("_n", n.cast("long")).where("_n > 0").withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))))
    return runs.withColumn(name, F.explode(F.sequence(F.col("_a"), F.least(F.col("_a") + step, F.col("_n")) - 1))).drop("_n", "_a")


def numbered(df: DataFrame, order: Column, *keys: str, name: str = "rank") -> DataFrame:
    """Add ranks 0, 1, .. within keys in the order of ``order``, a number in [0, 1); ties by nothing, so it should not tie."""
    buckets = max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_order", order).withColumn("_bucket", F.floor(F.col("_order") * buckets).cast("int"))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_order"))
    rows = rows.withColumn("_own", within).join(starts, [*keys, "_bucket"])
    return rows.withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_order", "_bucket", "_own", "_start")


def permuted(df: DataFrame, value: str, seed: int, ids: list[str], *keys: str) -> DataFrame:
    """``df`` with the values of ``value`` dealt anew among the rows of the same keys; ``ids`` name a row."""
    to = numbered(df.drop(value), draw(seed, F.lit("to"), *ids), *keys)
    of = numbered(df.select(*keys, *(F.col(i).alias(f"_{i}") for i in ids if i not in keys), value), draw(seed, F.lit("from"), *(f"_{i}" if i not in keys else i for i in ids)), *keys)
    return to.join(of.select(*keys, "rank", value), [*keys, "rank"]).select(df.columns)


def replicates(df: DataFrame, n: int, first: int = 0) -> DataFrame:
    """``df`` once for each rep of ``first``..n-1."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(n - 1))))


def images(x: np.ndarray, size: int, random: np.random.Generator) -> np.ndarray:
    """``bijection`` of the numbers ``x`` of 0 .. size - 1, with shifts drawn by ``random``."""
    width = math.isqrt(max(0, size - 1)) + 1
    height = -(-size // width)
    along, down = random.integers(0, width, (MIXES // 2, height)), random.integers(0, height, (MIXES // 2, width))

    def once(p: np.ndarray) -> np.ndarray:
        row, column = np.divmod(p, width)
        for a, d in zip(along, down):
            column = (column + a[row]) % width
            row = (row + d[column]) % height
        return row * width + column

    out = once(x)
    while len(far := np.flatnonzero(out >= size)):
        out[far] = once(out[far])
    return out


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small numbers as rows of bytes."""
    return np.packbits(((values[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(values), -1), axis=1)


def unpack(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    return (np.unpackbits(data, axis=1)[:, : n * bits].reshape(len(data), n, bits) << np.arange(bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint16)


def level_draws(members: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, list[str], list[int], int]:
    """Levels dealt anew among the members of each area (area, root_id, lvl), n times: a table code, root_id, drawn, its areas by code, the levels, and the bits of one.

    ``drawn`` packs n + 1 places among the levels, of which the first is the member's own.  A member's
    number is mapped one-to-one for each draw, and the level that has the image's place is its new one, so nothing is dealt or sorted a draw."""
    found = defaultdict(dict)
    for r in members.groupBy("area", "lvl").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each area and level
        found[r["area"]][r["lvl"]] = r["n"]
    areas, levels = sorted(found), sorted({x for own in found.values() for x in own})
    bits, place, code = max(1, (len(levels) - 1).bit_length()), {x: k for k, x in enumerate(levels)}, {a: k for k, a in enumerate(areas)}
    upto = [np.cumsum([found[a].get(x, 0) for x in levels]) for a in areas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area = np.array([code[a] for a in batch.column("area").to_pylist()], np.int32)
            out = np.zeros((len(area), n + 1), np.uint16)
            out[:, 0] = [place[x] for x in batch.column("lvl").to_pylist()]
            rank = batch.column("rank").to_numpy()
            for a in np.unique(area):
                own = np.flatnonzero(area == a)
                for rep in range(n):
                    at = images(rank[own], int(upto[a][-1]), np.random.default_rng((seed, rep, zlib.crc32(areas[a].encode()))))
                    out[own, rep + 1] = np.searchsorted(upto[a], at, "right")
            yield pa.RecordBatch.from_arrays([pa.array(area), batch.column("root_id"), pa.array([r.tobytes() for r in pack(out, bits)], pa.binary())], names=["code", "root_id", "drawn"])

    rows = numbered(members.select("area", "root_id", "lvl"), draw(seed, "area", "root_id"), "area").select("area", "root_id", "lvl", F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(run, "code int, root_id long, drawn binary"), areas, levels, bits


def permuted_levels(members: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """rep, area, root_id, lvl: levels dealt anew among the members of each area; the graph stays."""
    rows, areas, levels, bits = level_draws(members, n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = unpack(byte_rows(batch.column("drawn")), n + 1, bits)[:, 1:]
            each = np.repeat(np.arange(len(drawn)), n)
            area = np.array(areas, object)[batch.column("code").to_numpy()[each]]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(drawn))), pa.array(area, pa.string()), pa.array(batch.column("root_id").to_numpy()[each]), pa.array(np.array(levels, np.int32)[drawn.ravel()])], names=["rep", "area", "root_id", "lvl"])

    return rows.mapInArrow(run, "rep int, area string, root_id long, lvl int")


def byte_rows(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def aligned(flow: DataFrame, nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """rep, i, area, lvl, v: each (waist, metanode) flow keeps its values, zeros too, but they are dealt anew among the waist's nodes."""
    waist = nodes.select(F.col("root_id").alias("i"), F.col("area").alias("wa"), F.col("lvl").alias("wl"))
    held = flow.join(waist, "i").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = ["rep", "wa", "wl", "area", "lvl"]
    values = numbered(held, draw(seed, *keys, "i"), *keys).drop("i")
    # each key's values go to the first places of its own random order of the waist's nodes: rank r of key k is place (r * step + shift) mod size
    size = waist.groupBy("wa", "wl").agg(F.count(F.lit(1)).alias("_size"))
    order = numbered(waist, draw(seed + 1, "i"), "wa", "wl", name="_place")
    dealt = values.join(size, ["wa", "wl"]).withColumn("_place", _shuffled(F.col("rank"), F.col("_size"), seed, *keys))
    return dealt.join(order, ["wa", "wl", "_place"]).select("rep", "i", "area", "lvl", "v")


def _shuffled(x: Column, size: Column, seed: int, *keys: str) -> Column:
    """A one-to-one map of 0..size-1 of its own for each key: multiplied by a prime that does not divide the size, and shifted."""
    primes = [1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121]
    pick = F.array(*(F.lit(p) for p in primes))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), *keys), F.lit(len(primes))).cast("int")
    usable = F.filter(F.concat(F.slice(pick, start + 1, F.lit(len(primes))), pick), lambda p: size % p != 0)
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), *keys), size)
    return (x * F.get(usable, F.lit(0)) + shift) % size


#: Rounds of the mixing network of ``bijection``, and steps of its walk: a grid of side a has fewer than a places too many, and a step of a long walk falls on one with a chance under 1 / a.
MIXES, STEPS = 12, 64


def bijection(x: Column, size: Column, *key: str | Column) -> Column:
    """A keyed one-to-one map of 0 .. size - 1.

    Numbers are places of the least grid that is nearly square.  A round shifts each row of it by a hash of key, round and row, or each column; these
    maps are one-to-one.  What lands beyond ``size`` walks on until it is back."""
    width = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("long")
    height = F.floor((size + width - 1) / width).cast("long")
    shift = lambda n, side, room: F.pmod(F.xxhash64(*key, n, side), room)

    def mixed(p: Column, n: Column) -> Column:
        row, column = F.floor(p / width).cast("long"), p % width
        along = row * width + F.pmod(column + shift(n, row, width), width)
        return F.when(n % 2 == 0, along).otherwise(F.pmod(row + shift(n, column, height), height) * width + column)

    once = lambda y: F.aggregate(F.sequence(F.lit(0), F.lit(MIXES - 1)), y, mixed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once(x.cast("long")), lambda y, _: F.when(y >= size, once(y)).otherwise(y))


def block_rewired(edges: DataFrame, nodes: DataFrame, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges (keys, pre, post, sa, sl, da, dl) dealt anew in each block of two metanodes, for each of ``keys`` (such as a replicate): as many, among all its pairs, without repeats.

    A block of k edges takes the images of 0..k-1 under a bijection of its pairs of its own: nothing is drawn twice, rejected or sorted."""
    block = [*keys, "sa", "sl", "da", "dl"]
    size = lambda a, l, n: nodes.groupBy(F.col("area").alias(a), F.col("lvl").alias(l)).agg(F.count(F.lit(1)).alias(n))  # noqa: E731, E741
    blocks = edges.groupBy(*block).agg(F.count(F.lit(1)).alias("k")).join(size("sa", "sl", "ns"), ["sa", "sl"]).join(size("da", "dl", "nd"), ["da", "dl"])
    # rows of a block are dealt out before they are mapped, a large block in many parts
    rows = counted(blocks, F.col("k"), "j").repartition(*block, F.floor(F.col("j") / 65536))
    cell = bijection(F.col("j"), F.col("ns") * F.col("nd"), F.lit(seed), *block)
    node = lambda a, l, key, place: numbered(nodes.select(F.col("area").alias(a), F.col("lvl").alias(l), F.col("root_id").alias(key)), draw(seed + 2, key), a, l, name=place)  # noqa: E731, E741
    rows = rows.withColumn("cell", cell).withColumns({"_s": F.floor(F.col("cell") / F.col("nd")).cast("long"), "_d": F.col("cell") % F.col("nd")})
    return rows.join(node("sa", "sl", "pre", "_s"), ["sa", "sl", "_s"]).join(node("da", "dl", "post", "_d"), ["da", "dl", "_d"]).select("pre", "post", *block)


#: Edges that one task swaps among each other, and rounds before they are dealt out anew.
PART, DEAL = 1 << 20, 4


def parts_of(edges: DataFrame, *keys: str) -> int:
    """Parts that the edges of the same ``keys`` are dealt to, so that each has about ``PART``."""
    most = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return max(1, -(-(most or 0) // PART))


def among(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the codes are among others: a table of hashes rules most out, and the rest are looked up."""
    bits = max(10, int(len(others) * 16).bit_length())
    slot = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[slot(others)] = True
    out = table[slot(codes)]
    some = np.flatnonzero(out)
    table[:] = False
    table[slot(codes[some])] = True
    out[some] = np.isin(codes[some], others[table[slot(others)]])
    return out


def swap_rounds(pre: np.ndarray, post: np.ndarray, rounds: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges after rounds of swaps a>b, c>d to a>d, c>b of edges paired at random; one is made if both new edges are new and no other pair proposes them.  The order of rows makes no difference."""
    names, ids = np.unique(np.concatenate([pre, post]), return_inverse=True)
    a, b = ids[: len(pre)].astype(np.int64), ids[len(pre) :].astype(np.int64)
    code = np.sort(a * len(names) + b)
    half = len(code) // 2
    for _ in range(rounds):
        code = code[random.permutation(len(code))]
        (a, b), (c, d) = (np.divmod(code[x : x + half], len(names)) for x in (0, half))
        fit = np.flatnonzero((a != c) & (b != d) & (a != d) & (c != b))
        one, two = a[fit] * len(names) + d[fit], c[fit] * len(names) + b[fit]
        both = np.concatenate([one, two])
        by = np.sort(both)
        twice = by[1:][by[1:] == by[:-1]]
        bad = among(both, code)
        if len(twice):
            bad |= among(both, twice)
        done = ~(bad[: len(fit)] | bad[len(fit) :])
        code[fit[done]], code[half + fit[done]] = one[done], two[done]
    a, b = np.divmod(code, len(names)) if len(names) else (code, code)
    return names[a], names[b]


def swapped(edges: DataFrame, rounds: int = 20, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges (keys, pre, post) after rounds of swaps a>b, c>d to a>d, c>b within the same ``keys`` (such as a replicate): degrees stay, no loops and no repeats arise.

    Edges are dealt to parts by a hash of their first node, or of their second.  A swap
    of two edges of a part makes edges that belong to it too, so whether they are new is
    known there: a task makes several rounds, then edges are dealt anew."""
    own = [*keys, "pre", "post"]
    rows = start = cut(edges.select(own))
    parts, schema = parts_of(start, *keys), start.select(own).schema

    def deal(count: int, at: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, group: pa.Table) -> pa.Table:
            mixed = hashlib.blake2b(repr((seed, at, *(k.as_py() for k in key))).encode(), digest_size=16).digest()
            pre, post = swap_rounds(group.column("pre").to_numpy(), group.column("post").to_numpy(), count, np.random.default_rng(int.from_bytes(mixed, "little")))
            columns = {"pre": pa.array(pre), "post": pa.array(post)}
            return pa.table({c: columns[c] if c in columns else group.column(c) for c in own})

        return run

    for at in range(0, rounds, DEAL if parts > 1 else max(1, rounds)):
        count = min(DEAL, rounds - at) if parts > 1 else rounds
        part = F.pmod(F.xxhash64(F.lit(seed + at), *keys, "post" if at // DEAL % 2 else "pre"), F.lit(parts)).cast("int")
        rows = rows.withColumn("_part", part).groupBy(*keys, "_part").applyInArrow(deal(count, at), schema)
    out = cut(rows)
    drop(start)
    return out


def rewired_by_order(edges: DataFrame, levels: DataFrame, seed: int = 42, tries: int = 4) -> DataFrame:
    """(rep,) pre, post: each node keeps its in-degree (up to the number of nodes below it) and draws its predecessors uniformly among nodes of lower levels.

    ``levels``: root_id, lvl.  Edges with a column ``rep`` are drawn anew for each.  Predecessors are distinct; a few draws more than needed are made, so that a node seldom falls short."""
    keys = [c for c in ("rep",) if c in edges.columns]
    counts = levels.groupBy("lvl").agg(F.count(F.lit(1)).alias("_n"))
    below = counts.withColumn("pool", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("lvl").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = numbered(levels, draw(seed, "root_id"), "lvl", name="_inner").join(below.select("lvl", F.col("pool").alias("_start")), "lvl").select((F.col("_start") + F.col("_inner")).alias("place"), F.col("root_id").alias("pre"))
    need = edges.groupBy(*keys, "post").agg(F.count(F.lit(1)).alias("d")).join(levels.withColumnRenamed("root_id", "post"), "post").join(below, "lvl").where("pool > 0")
    crowded = F.col("d") * 2 > F.col("pool")
    rows = counted(need.withColumn("_crowded", crowded), F.when(crowded, F.col("pool")).otherwise(F.col("d") * tries + 8), "j")
    place = F.when(F.col("_crowded"), F.col("j")).otherwise(F.floor(draw(seed + 1, *keys, "post", "j") * F.col("pool")).cast("long"))
    rows = rows.withColumn("place", place).groupBy(*keys, "post", "d", "place").agg(F.min("j").alias("j"))
    rows = numbered(rows, draw(seed + 2, *keys, "post", "place"), *keys, "post").where(F.col("rank") < F.col("d"))
    return rows.join(order, "place").select(*keys, "pre", "post")


def mixing(edges: DataFrame, rounds: tuple[int, ...] = (1, 5, 10, 20), seed: int = 42, measure: Callable[[DataFrame], float | None] | None = None) -> DataFrame:
    """rounds, kept, measured: share of the edges that are still there after so many rounds of swaps, and ``measure`` of the edges then."""
    total, now, rows = edges.count(), edges, []
    for before, after in zip((0, *rounds), rounds):
        now = swapped(now, after - before, seed + 1000 * before)
        rows.append((after, now.join(edges, ["pre", "post"], "left_semi").count() / max(1, total), measure(now) if measure else None))
    return edges.sparkSession.createDataFrame(rows, "rounds int, kept double, measured double")
