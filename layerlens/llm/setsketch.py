"""Near duplicates of word-shingle sets by SetSketch registers.

Each distinct set is a node (named by a 128-bit hash of the set, so copies fold
into one node however many there are).  A register is the minimum over the set
of independent exponential variables, kept as a truncated logarithm of base
``BASE``: minima merge by taking the larger register, and two sets agree in a
register with a probability close to their Jaccard similarity.

1. Registers are generated as one Poisson process an element, so a set costs
   about ``registers * log(registers)`` steps beside one for each element.
2. Bands of registers name buckets.  With 40 bands of 5 a pair at 0.8 shares
   none with a probability of 1e-7.
3. A node's degree is the sum of its buckets' sizes.  In each bucket every node is
   paired with the hub, the node of largest degree (copies of one text are further
   from each other than from it).  Register comparisons and set sizes give the
   likelihood of the similarity, jointly for both orders of each register; pairs
   whose maximum lies far under the threshold go.
4. The rest is verified on the full sets; links join components.  Then, only in
   buckets that hold several components, all pairs across components are compared,
   blockwise on sketches, and those that may be links on full sets.  Pairs within
   one component are never looked at, so large groups of near copies cost little
   more than their size, and no pair is capped away.

Hot keys: buckets of more than one in ``SHARE`` nodes are found in a sample of
names (which only spreads work, and decides nothing), so their number is bounded;
their rows are dealt by bucket and node, and their hubs' sketches and texts are
repeated as often as they are dealt.  Nodes and components of as many rows get
their results by a broadcast of as bounded a size.

Null texts and texts without words have empty sets and are linked with nothing.
A set of a text shorter than a shingle is its whole sequence.  Rows may repeat
ids; null ids are kept and never name a component that has another id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SPACED, U, Words, gram_hash, mix, release, slices
from .components import connected_components
from .storage import discarding, join_values, materialise

BASE, SCALE, BANDS, ROWS = 1.001, 30.0, 40, 5
REGISTERS = BANDS * ROWS
#: Nodes and shingles in a block of the blockwise comparison; standard deviations under the threshold at which an estimate still counts.
BLOCK, WEIGHT, MARGIN = 256, 1 << 20, 5.5
#: A key with more than one in ``SHARE`` of all rows is hot; rows that are never worth splitting; names that the search for hot buckets looks at.
SHARE, ROOM, SAMPLE = 1000, 256, 20_000


def row_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, by row, then hash."""
    h, where = words.grams(size)
    row = words.rows()
    rows, hashes = [row[where]], [h]
    n = np.diff(words.at)
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            rows.append(short)
            hashes.append(gram_hash([words.hash[words.at[short] + i] for i in range(k)]))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def set_names(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit hash (two words) of each row's set."""
    size, out = np.bincount(rows, minlength=n), np.zeros((n, 2), dtype=np.uint64)
    at = np.concatenate([[0], np.cumsum(size)])
    for k, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ U(salt)))])
        out[:, k] = mix((sums[at[1:]] - sums[at[:-1]]) + size.astype(np.uint64))
    return size, out


def sketches(rows: np.ndarray, hashes: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers (uint16).  Points of rate m on a line for each element, each given to one register: the register's first point is exponential of rate 1."""
    size = np.bincount(rows, minlength=n)
    out = np.full(n * m, np.inf)
    todo, reach = size > 0, math.log(m) + 10
    while todo.any():
        own = todo[rows]
        row, seed = rows[own], hashes[own]
        limit = reach / np.maximum(size, 1)
        x, j = np.zeros(len(row)), 0
        while len(row):
            j += 1
            r = mix(seed + U(j * 0x9E3779B97F4A7C15 % (1 << 64)))
            x = x - np.log(((r >> U(32)).astype(np.float64) + 0.5) * 2.0**-32) / m
            keep = x <= limit[row]
            row, seed, x = row[keep], seed[keep], x[keep]
            np.minimum.at(out, row * m + (((r[keep] & U(0xFFFFFFFF)) * U(m)) >> U(32)).astype(np.int64), x)
        todo = (size > 0) & np.isinf(out.reshape(n, m)).any(axis=1)
        reach *= 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(np.where(np.isinf(out), SCALE, out) / SCALE) / math.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(n, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """n x BANDS bucket names."""
    n = len(registers)
    parts = registers.reshape(n * BANDS, ROWS).astype(np.uint64)
    band = np.tile(np.arange(BANDS, dtype=np.uint64), n)
    return gram_hash([band, *parts.T]).reshape(n, BANDS)


def _greater(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def likeliest(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Similarity of greatest likelihood, given how many registers of u are larger and smaller than v's, and both set sizes (golden-section search)."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    same = m - more - less

    def log_likelihood(j):
        p, q = (np.clip(_greater(np.maximum(z, 0)), 1e-12, 1) for z in (u - v * j, v - u * j))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (math.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - g * (high - low), low + g * (high - low)
        left = log_likelihood(a) > log_likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def least_estimate(threshold: float, m: int = REGISTERS) -> float:
    return threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / m)


def read_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, n_shingles, node (null for empty sets) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            rows, hashes = row_sets(Words(batch.column(1), SPACED), size)
            n, names = set_names(rows, hashes, batch.num_rows)
            registers = sketches(rows, hashes, batch.num_rows)
            full = (n > 0).tolist()
            node = [x.tobytes() if ok else None for x, ok in zip(names, full)]
            sketch = [x.tobytes() if ok else None for x, ok in zip(registers, full)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary())], ["key", "n_shingles", "node", "sketch"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_shingles long, node binary, sketch binary")


def _node_texts(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """node and a text with that set, for the wanted nodes (node, first): only rows with a wanted first id are named again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, hashes = row_sets(Words(batch.column(0), SPACED), size)
            n, names = set_names(rows, hashes, batch.num_rows)
            full = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array([names[i].tobytes() for i in full.tolist()], pa.binary()), batch.column(0).take(pa.array(full))], ["node", "text"])

    wanted = materialise(wanted, "wanted")
    firsts = wanted.select("first").distinct()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    named = rows.join(firsts, F.col("key").eqNullSafe(F.col("first")), "left_semi").select("text").mapInArrow(run, "node binary, text string")
    return named.groupBy("node").agg(F.first("text").alias("text")).join(wanted.select("node"), "node", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, hubs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` (v a hub) with 100 * intersection >= percent * union of the full sets of their ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_u"):
            n = batch.num_rows
            sets = [row_sets(Words(batch.column(c), SPACED), size) for c in ("text_u", "text_v")]
            rows, hashes = (np.concatenate(x) for x in zip(*sets))
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            twice = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
            both = np.bincount(rows[1:][twice], minlength=n)
            union = np.bincount(rows, minlength=n) - both
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(100 * both >= percent * union))

    side = lambda rows, c: rows.withColumnsRenamed({"node": c, "text": f"text_{c}"})
    both = _dealt(pairs.select("u", "v").join(side(texts, "u"), "u"), hubs).join(side(_repeated(texts, hubs), "v"), ["v", "salt"])
    return both.mapInArrow(run, "u binary, v binary")


def _dealt(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs with a salt that spreads those of a hot hub (``hubs``: node, spread)."""
    found = pairs.join(F.broadcast(hubs.withColumnRenamed("node", "v")), "v", "left")
    return found.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("u"), "spread"), F.lit(0))).drop("spread")


def _repeated(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows of nodes, those of hot hubs once for each salt."""
    found = rows.join(F.broadcast(hubs), "node", "left")
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")


def _estimate(pairs: DataFrame, nodes: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """Distinct pairs u, v (v a hub), those of an estimate of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("sketch_u", "sketch_v"))
            sizes = [batch.column(c).to_numpy() for c in ("n_u", "n_v")]
            j = likeliest((a > b).sum(axis=1), (a < b).sum(axis=1), *sizes)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(j >= least))
        release()

    side = lambda rows, c: rows.withColumnsRenamed({"node": c, "n_shingles": f"n_{c}", "sketch": f"sketch_{c}"})
    own = nodes.select("node", "n_shingles", "sketch")
    one = pairs.groupBy("u").agg(F.collect_set("v").alias("vs")).join(side(own, "u"), "u")  # a node is in ``BANDS`` buckets
    both = _dealt(one.withColumn("v", F.explode("vs")).drop("vs"), hubs).join(side(_repeated(own, hubs), "v"), ["v", "salt"])
    return both.mapInArrow(run, "u binary, v binary")


def _group_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for c in ("bucket", "i", "k"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _close(members: DataFrame, nodes: DataFrame, least: float, most: float) -> DataFrame:
    """Rows bucket, i, k, part, node, component of the nodes in the buckets of ``members`` (bucket, node, n_shingles, component) that have a pair across components of an estimate of ``least`` or more, in the pair's first bucket; i and k are the blocks that meet."""
    each = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    each = each.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / WEIGHT)))
    mixed = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max_by("blocks", F.struct("n", "component")).alias("whole"),
                                       F.sum("w").alias("w"), F.max_by("n", F.struct("n", "component")).alias("n_main"), F.max_by("w", F.struct("n", "component")).alias("w_main")).where("components > 1")
    rest = F.ceil(F.greatest((F.col("n") - F.col("n_main")) / BLOCK, (F.col("w") - F.col("w_main")) / WEIGHT))
    mixed = materialise(mixed.select("bucket", "n", F.struct("main", "whole", rest.alias("rest")).alias("value")), "mixed")
    rows = join_values(members, mixed, ["bucket"], "node", most).where("value IS NOT NULL")
    # blocks of the bucket's largest component come after the others' and meet only those; every other block meets all blocks, and itself, once
    main, rest, whole = F.col("component") == F.col("value.main"), F.col("value.rest"), F.col("value.whole")
    rows = rows.withColumn("own", F.when(main, rest + F.pmod(F.xxhash64("node"), whole)).otherwise(F.pmod(F.xxhash64("node"), rest)))
    rows = rows.withColumn("meets", F.when(main, rest).otherwise(rest + whole)).select("bucket", "node", "component", "own", "meets")
    rows = rows.join(nodes.select("node", "n_shingles", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1)))
    rows = rows.select("bucket", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("k"), F.col("own").cast("int").alias("part"), "node", "component", "n_shingles", "sketch")

    def compare(table: pa.Table) -> pa.RecordBatch:
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(table.num_rows, -1)
        size, part = table.column("n_shingles").to_numpy().astype(float), table.column("part").to_numpy()
        bucket, i, k = (table.column(c).to_numpy() for c in ("bucket", "i", "k"))
        component = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
        at = _group_starts(table)
        band = (band_keys(registers[at]).view(np.int64) == bucket[at, None]).argmax(axis=1)
        need = REGISTERS * (least - 0.03)  # two sets agree in a register as often as they are similar
        found, us, vs = np.zeros(table.num_rows, dtype=bool), [], []

        def estimate() -> None:
            x, y = np.concatenate(us), np.concatenate(vs)
            j = likeliest((registers[x] > registers[y]).sum(axis=1), (registers[x] < registers[y]).sum(axis=1), size[x], size[y])
            found[x[j >= least]] = found[y[j >= least]] = True
            us.clear()
            vs.clear()

        for a, b, own in zip(at.tolist(), np.append(at[1:], table.num_rows).tolist(), band.tolist()):
            rows = np.arange(a, b)
            if i[a] == k[a]:
                sides = ((x, rows[x - a + 1 :]) for x in range(a, b - 1))
            else:
                one, other = rows[part[a:b] == i[a]], rows[part[a:b] == k[a]]
                few, many = (one, other) if len(one) < len(other) else (other, one)
                sides = ((x, many) for x in few.tolist())
            for x, others in sides:
                others = others[component[others] != component[x]]
                same = registers[others] == registers[x]
                # each pair once: in the first of its buckets
                near = (same.sum(axis=1) >= need) & ~same[:, : own * ROWS].reshape(len(others), own, ROWS).all(axis=2).any(axis=1)
                if near.any():
                    vs.append(others[near])
                    us.append(np.full(len(vs[-1]), x))
                    if len(us) >= 256:
                        estimate()
        if us:
            estimate()
        out = table.select(["bucket", "i", "k", "part", "node", "component"]).filter(pa.array(found)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups (of two blocks at most) go on; the last one of a batch waits for the next."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cut = int(_group_starts(table)[-1])
            if cut:
                yield compare(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield compare(held)
        release()

    return rows.repartition("bucket", "i", "k").sortWithinPartitions("bucket", "i", "k").mapInArrow(groups, "bucket long, i int, k int, part int, node binary, component binary")


def _linked(close: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components u, v with a link between them among the rows of ``close``, by full sets; of a group as many as join what it joins."""

    def link(table: pa.Table) -> pa.Table:
        rows, hashes = row_sets(Words(table.column("text"), SPACED), size)
        names, hashes = np.unique(hashes, return_inverse=True)
        n, part = np.bincount(rows, minlength=table.num_rows), table.column("part").to_numpy()
        at, marks, us, vs = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(names), dtype=np.int64), [], []
        both = table.column("i")[0].as_py() == table.column("k")[0].as_py()
        component = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
        for a in range(table.num_rows - 1):
            marks[hashes[at[a] : at[a + 1]]] = 1
            shared = np.add.reduceat(marks[hashes[at[a + 1] :]], at[a + 1 : -1] - at[a + 1])
            marks[hashes[at[a] : at[a + 1]]] = 0
            near = a + 1 + np.flatnonzero(100 * shared >= percent * (n[a] + n[a + 1 :] - shared))
            for b in near.tolist():
                if component[a] != component[b] and (both or part[a] != part[b]):
                    us.append(a)
                    vs.append(b)
                    component[component == component[b]] = component[a]
        names = table.column("component")
        return pa.table({"u": names.take(pa.array(us, pa.int64())), "v": names.take(pa.array(vs, pa.int64()))})

    return close.join(texts, "node").groupBy("bucket", "i", "k").applyInArrow(link, "u binary, v binary")


def _crowded(banded: DataFrame, total: int) -> DataFrame:
    """bucket, guess (of its size) and spread (parts to deal it to) of buckets that may be hot; at most ``BANDS * SAMPLE / 10`` rows, from names that say nothing of texts."""
    share = min(1.0, SAMPLE / max(total, 1))
    sample = banded.where(F.xxhash64("node") < F.lit(int(2.0**64 * share - 2.0**63) if share < 1 else (1 << 63) - 1))
    counts = sample.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(10, SAMPLE * share / SHARE / 2))
    guess = F.ceil(F.col("n") / share)
    rows = counts.select("bucket", guess.alias("guess"), F.ceil(guess / max(ROOM, total / SHARE)).alias("spread")).toArrow()
    return banded.sparkSession.createDataFrame(rows)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id that links reach, its own included) and kept of every row."""
    sets = materialise(read_sets(docs, key, text, size), "sets")
    most = max(ROOM, sets.count() / SHARE)
    with discarding():
        ids = materialise(_classes(docs, sets, size, percent, key, text), "ids", keep=True)
    out = join_values(sets.select("key", "n_shingles", "node"), ids, ["node"], "key", most)
    own = F.coalesce("value", "key")
    return out.select(F.col("key").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("key") == own, F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, sets: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """node, n (rows with the node's set) and value (smallest id that links reach) of every set."""
    least = least_estimate(percent / 100)
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node")
    nodes = materialise(nodes.agg(F.min("key").alias("first"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")), "nodes")
    total = sets.count()
    most = max(ROOM, total / SHARE)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1))
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([node, pa.array(names.ravel().view(np.int64))], ["node", "bucket"])
        release()

    banded = nodes.select("node", "sketch").mapInArrow(buckets, "node binary, bucket long")
    crowded = _crowded(banded, total)
    rows = banded.join(F.broadcast(crowded), "bucket", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), "spread"), F.lit(0)))
    rows = rows.withColumn("n", F.coalesce("guess", F.count(F.lit(1)).over(Window.partitionBy("bucket", "salt")))).where("n > 1")
    rows = rows.withColumn("degree", F.sum("n").over(Window.partitionBy("node")))
    members = materialise(rows.select("bucket", "salt", "node", "n", "degree", "spread"), "members")
    # the hub of a bucket dealt to several parts is that of all parts
    tops = members.where("spread IS NOT NULL").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"), F.first("spread").alias("spread")).toArrow()
    tops = docs.sparkSession.createDataFrame(tops)
    hubs = tops.groupBy(F.col("hub").alias("node")).agg(F.max("spread").alias("spread"))
    order = Window.partitionBy("bucket", "salt").orderBy(F.desc("degree"), F.desc("node")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = members.withColumn("top", F.first("node").over(order)).join(F.broadcast(tops.select("bucket", "hub")), "bucket", "left")
    pairs = pairs.select(F.col("node").alias("u"), F.coalesce("hub", "top").alias("v")).where("u <> v")
    stars = materialise(_estimate(pairs, nodes, hubs, least), "stars")
    stored = lambda names: _node_texts(docs, key, text, size, nodes.select("node", "first").join(names, "node", "left_semi"))
    texts = materialise(stored(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "node-texts")
    found = connected_components(verify(stars, texts, hubs, size, percent))
    named = nodes.select("node", "first", "n_shingles", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    open_ = members.where("n > 2").select("bucket", "node").join(named.select("node", "n_shingles", "component"), "node")
    close = materialise(_close(open_, nodes, least, most), "close")
    missing = close.select("node").distinct().join(texts.select("node"), "node", "left_anti")
    texts = texts.union(materialise(stored(missing), "node-texts"))
    merged = connected_components(_linked(close, texts, size, percent)).select(F.col("component").alias("value"), F.col("node").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    merged = materialise(merged.join(sizes, "component"), "merged")
    named = materialise(join_values(named, merged, ["component"], "node", most).withColumn("component", F.coalesce("value", "component")).drop("value"), "named")
    smallest = materialise(named.groupBy("component").agg(F.min("first").alias("value"), F.count(F.lit(1)).alias("n")).where("n > 1"), "smallest")
    return join_values(named, smallest, ["component"], "node", most).select("node", F.col("copies").alias("n"), F.coalesce("value", "first").alias("value"))
