"""Packing of token sequences: cutting-stock column generation.

A document's ids are cut into full sequences and a remainder.  Remainders are the
items of a cutting-stock problem: only the histogram of their lengths matters, a
number for each length under ``size``, however many documents there are.

1. Each task tokenizes its documents and numbers them by length of remainder; the
   counts of tasks before make these numbers ranks over all documents.
2. A linear program over patterns (multisets of lengths that fill a sequence
   exactly) fills as many sequences as the histogram allows.  Patterns come from a
   knapsack: by the program's prices a dynamic program over 1..``size`` finds, for
   each first length, the cheapest way to fill the rest.  The program is solved
   by a revised simplex method that starts from exact sums of the longest lengths
   left, which use up a length each; it may stop at any pivot.
3. Counts of patterns are rounded down, then up while lengths are left; what is
   left is filled by exact subset sums of the longest length left.  No document
   has been cut so far, and all these sequences are full.
4. Lengths that no exact sum holds go one after another through full sequences and
   are cut at their borders; the last sequence is parted at powers of two.  So no
   sequence needs padding.
5. Each remainder finds its place by length and rank: a slot of a pattern is a
   range of ranks.

The driver holds the histogram and the patterns.  Rows keep a null key and repeat
as they come; a null text is empty and has the end id only; an empty table has no
pieces.  Very long texts are cut like others.  Other columns are left out, so
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytechunks import encoded_blocks, encodes_chunks, split_chunks, tokenizer
from .bytewords import release, slices, text_buffer
from .storage import materialise

#: Characters in a block, a single longer text aside; bytes of ids in a batch of rows.
BLOCK, BATCH = 12 << 20, 4 << 20
#: Pivots of the simplex method at most, pivots by columns of one knapsack, and the share of full sequences that is good enough.
PIVOTS, ROUND, ENOUGH = 1000, 60, 0.9999


def tokenised(docs: DataFrame, path: str, size: int, end_id: int, key: str, text: str) -> DataFrame:
    """row, part, key, tokens, rem, local (earlier rows of the part with this remainder), before (full sequences earlier in the part) and ids (narrow little-endian) of every row."""
    split = split_chunks if encodes_chunks(path) else lambda t: [" " + t]
    kind = id_kind(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, full_before, seen = TaskContext.get().partitionId(), 0, 0, np.zeros(size, np.int64)
        for keys, counts, flat in encoded_blocks(batches, path, BLOCK, split):
            tokens = counts + 1
            whole = np.insert(flat.astype(kind), np.cumsum(counts), end_id)
            rem, full = tokens % size, tokens // size
            order = np.argsort(rem, kind="stable")
            first = np.searchsorted(rem[order], rem)
            local = np.empty(len(rem), dtype=np.int64)
            local[order] = np.arange(len(rem))
            local += seen[rem] - first
            seen += np.bincount(rem, minlength=size)
            before = full_before + np.cumsum(full) - full
            full_before += int(full.sum())
            cuts = np.concatenate([[0], np.cumsum(tokens)])
            width = whole.itemsize
            group = (cuts[:-1] * width) // BATCH
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                values = binary(whole[cuts[a] : cuts[b]], (cuts[a : b + 1] - cuts[a]) * width)
                own = np.arange(row + a, row + b, dtype=np.int64) + (part << 36)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(b - a, part, np.int32)), pa.array(keys[a:b], pa.int64()), pa.array(tokens[a:b]), pa.array(rem[a:b]), pa.array(local[a:b]), pa.array(before[a:b]), values], columns)
            row += len(keys)
        release()

    columns = ["row", "part", "key", "tokens", "rem", "local", "before", "ids"]
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "row long, part int, key long, tokens long, rem long, local long, before long, ids binary")


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of the bytes of ``data``, parted at ``ends`` (the first is 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(tokenizer(path).get_vocab_size(), end_id) < 1 << 16 else "<u4"


def _cheapest(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least price of a multiset of lengths with each exact sum up to ``size``, and the length taken last."""
    least, last = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=np.int64)
    least[0] = 0
    for s in range(1, size + 1):
        n = np.searchsorted(lengths, s, side="right")
        if n:
            cost = least[s - lengths[:n]] + price[:n]
            last[s] = cost.argmin()
            least[s] = cost[last[s]]
    return least, last


def fill_by_sums(lengths: np.ndarray, demand: np.ndarray, size: int, whole: bool = True) -> list[tuple[dict[int, int], float, int]]:
    """Patterns, their counts and (unless ``whole``) a length that each uses up, by exact sums of the longest length left."""
    out, as_list, left = [], lengths.tolist(), demand.tolist()
    for i in range(len(as_list) - 1, -1, -1):
        while left[i] >= 1 and (pattern := _exact_sum(as_list, [int(x) for x in left], i, size)):
            n, r = min((left[j] // k if whole else left[j] / k, j) for j, k in pattern.items())
            for j, k in pattern.items():
                left[j] -= n * k
            if not whole:
                left[r] = 0
            out.append((pattern, n, r))
    return out


def fill_by_program(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[dict[int, int], float]]:
    """Patterns (number of each index into ``lengths``) and their counts in a packing of many full sequences.

    The first basis has a pattern for each length that exact sums use up (none of the later ones holds it, so the basis is regular) and the unused items of the others."""
    m = len(lengths)
    basis: list[dict[int, int] | None] = [None] * m  # None: unused items of a length
    first, worth = np.eye(m), np.zeros(m)
    for pattern, _, r in fill_by_sums(lengths, demand, size, whole=False):
        basis[r], worth[r] = pattern, 1
        first[:, r] = 0
        first[list(pattern), r] = list(pattern.values())
    inverse = np.linalg.inv(first)
    x, price = np.maximum(inverse @ demand, 0), worth @ inverse
    bound, done, pivots = float((lengths * demand).sum()) / size, float(worth @ x), 0
    while pivots < PIVOTS and done < ENOUGH * bound:
        least, last = _cheapest(lengths, np.maximum(price, 1e-9 * lengths), size)
        fresh = []
        for i, l in enumerate(lengths.tolist()):
            s, own = size - l, {i: 1}
            if not np.isfinite(least[s]) or 1 - price[i] - least[s] <= 1e-7:
                continue
            while s:
                own[int(last[s])] = own.get(int(last[s]), 0) + 1
                s -= int(lengths[last[s]])
            fresh.append(own)
        if not fresh and price.min() >= -1e-7:
            break
        columns = np.zeros((len(fresh), m))
        for n, own in enumerate(fresh):
            columns[n, list(own)] = list(own.values())
        improved = False
        for _ in range(ROUND):
            profit = np.append(1 - columns @ price, -price.min())  # the last: to leave items of a length unused
            n = int(profit.argmax())
            if profit[n] <= 1e-7 or pivots >= PIVOTS:
                break
            entering = fresh[n] if n < len(fresh) else None
            d = inverse[:, int(price.argmin())].copy() if entering is None else inverse[:, list(entering)] @ columns[n, list(entering)]
            able = np.flatnonzero(d > 1e-9)
            if not len(able):
                break
            ratio = x[able] / d[able]
            close = able[ratio <= ratio.min() + 1e-9]
            r = int(close[d[close].argmax()])
            step = max(0.0, x[r] / d[r])
            own = inverse[r] / d[r]
            inverse -= np.outer(d, own)
            inverse[r] = own
            x = np.maximum(x - step * d, 0)
            x[r] = step
            price = price + profit[n] * own
            basis[r] = entering
            done += step * profit[n]
            pivots, improved = pivots + 1, True
        if not improved:
            break
    return [(p, float(v)) for p, v in zip(basis, x) if p is not None and v > 1e-9]


def _exact_sum(lengths: list[int], left: list[int], first: int, size: int) -> dict[int, int] | None:
    """Numbers of each length (index), one of ``first`` among them, that fill ``size`` exactly."""
    goal, reach, trail = size - lengths[first], 1, []
    every = (1 << (goal + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        n, bit = min(left[i] - (i == first), goal // lengths[i]), 1
        while n > 0:  # any number up to n, as a sum of powers of two and a rest
            take = min(bit, n)
            trail.append((reach, i, take))
            reach |= (reach << (lengths[i] * take)) & every
            n, bit = n - take, 2 * bit
        if reach >> goal & 1:
            break
    if not reach >> goal & 1:
        return None
    out = {first: 1}
    for before, i, take in reversed(trail):
        if goal and not before >> goal & 1:
            out[i] = out.get(i, 0) + take
            goal -= lengths[i] * take
    return out


@dataclass
class Plan:
    """Slots by length and rank: ``key`` (length << 40 | first rank), ``each`` (0: in the stream), ``sequence`` and ``place`` (offset in the sequence, or position in the stream); counts of sequences of patterns; tokens of the stream."""

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    place: np.ndarray
    size: int
    packed: int
    stream: int

    def edges(self) -> list[int]:
        """Ends of the stream's last sequences: its rest, parted at powers of two."""
        whole, out = self.stream // self.size * self.size, []
        for bit in range(self.size.bit_length() - 1, -1, -1):
            if self.stream - whole >> bit & 1:
                out.append((out[-1] if out else whole) + (1 << bit))
        return out

    @property
    def sequences(self) -> int:
        return self.packed + self.stream // self.size + len(self.edges())

    def places(self, length: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Pieces (length, sequence, offset) of remainders."""
        at = np.searchsorted(self.key, (length << 40) | rank, side="right") - 1
        own = rank - (self.key[at] & ((1 << 40) - 1))
        each = self.each[at]
        held = np.maximum(each, 1)
        sequence, place = self.sequence[at] + own // held, self.place[at] + own % held * length
        position = self.place[at] + own * length
        ends, whole = self.edges(), self.stream // self.size
        out = []
        for n, s, p, e, x in zip(length.tolist(), sequence.tolist(), place.tolist(), each.tolist(), position.tolist()):
            if e:
                out.append([(n, s, p)])
                continue
            pieces, stop = [], x + n
            while x < stop:
                if x < whole * self.size:
                    number, start, end = x // self.size, x // self.size * self.size, (x // self.size + 1) * self.size
                else:
                    i = int(np.searchsorted(ends, x, side="right"))
                    number, start, end = whole + i, ends[i - 1] if i else whole * self.size, ends[i]
                pieces.append((min(stop, end) - x, self.packed + number, x - start))
                x = min(stop, end)
            out.append(pieces)
        return out


def plan_packing(histogram: dict[int, int], size: int) -> Plan:
    """A plan for so many remainders of each length (1 to ``size`` - 1)."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    slots: list[tuple[int, int, int, int]] = []
    packed = 0

    def take(pattern: dict[int, int], n: int) -> None:
        nonlocal packed
        n = min(n, *(int(left[i]) // k for i, k in pattern.items()))
        if n <= 0:
            return
        offset = 0
        for i, k in sorted(pattern.items(), reverse=True):
            slots.append(((int(lengths[i]) << 40) | int(used[i]), k, packed, offset))
            used[i] += n * k
            left[i] -= n * k
            offset += int(lengths[i]) * k
        packed += n

    if len(lengths):
        found = fill_by_program(lengths, left, size)
        for pattern, x in found:
            take(pattern, int(x + 1e-6))
        for pattern, x in sorted(found, key=lambda p: int(p[1] + 1e-6) - p[1]):
            take(pattern, 1)
    for pattern, n, _ in fill_by_sums(lengths, left, size):
        take(pattern, n)
    stream = 0
    for i in range(len(lengths)):
        if left[i]:
            slots.append(((int(lengths[i]) << 40) | int(used[i]), 0, 0, stream))
            stream += int(lengths[i]) * int(left[i])
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
    return Plan(*table.T, size, packed, stream)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit) of every piece."""
    kind, spark = id_kind(path, end_id), docs.sparkSession
    rows = materialise(tokenised(docs, path, size, end_id, key, text), "tokenised")
    counts = rows.where("rem > 0").groupBy("rem", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    starts = materialise(counts.select("rem", "part", "n", earlier(Window.partitionBy("rem"))), "starts")
    histogram = {r["rem"]: r["n"] for r in starts.groupBy("rem").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    plan = plan_packing(histogram, size)
    shared = spark.sparkContext.broadcast(plan)  # a row for each pattern and length in it: bounded by ``size``
    base = plan.sequences

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.int64())
        for batch in batches:
            length, local, start = (batch.column(c).to_numpy() for c in ("rem", "local", "start"))
            found: list[list] = [[]] * batch.num_rows
            held = np.flatnonzero(length)
            for i, x in zip(held.tolist(), shared.value.places(length[held], (start + local)[held])):
                found[i] = x
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("first"), *(pa.array([[p[i] for p in x] for x in found], item) for i in range(3))], ["at", "first", "lengths", "sequences", "offsets"])

    # places are found on narrow rows, so that ids are dealt once
    parts = rows.groupBy("part").agg(F.sum(F.col("tokens") - F.col("rem")).alias("n"))  # a row for each partition written
    parts = parts.select("part", (F.floor(earlier(Window.partitionBy(F.lit(1))) / size) + base).alias("first"))
    narrow = rows.select("row", "part", "rem", "local", "before").join(starts.select("rem", "part", "start"), ["rem", "part"], "left").join(parts, "part")
    narrow = narrow.select("row", "rem", "local", F.coalesce("start", F.lit(0)).alias("start"), (F.col("first") + F.col("before")).alias("first"))
    placed = narrow.mapInArrow(place, "at long, first long, lengths array<long>, sequences array<long>, offsets array<long>")
    out = rows.select("row", "key", "tokens", "ids").join(placed, F.col("row") == F.col("at")).select("key", "tokens", "first", "lengths", "sequences", "offsets", "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in slices(batches, "ids", BATCH):
            tokens, first = (batch.column(c).to_numpy() for c in ("tokens", "first"))
            full, many = tokens // size, pc.list_value_length(batch.column("lengths")).to_numpy()
            doc = np.repeat(np.arange(len(tokens)), full + many)
            at = np.cumsum(full + many) - full - many
            n = np.arange(len(doc)) - at[doc]
            cut = n >= full[doc]  # remainders follow a row's full sequences, in the order of their lists
            length, sequence, offset = np.full(len(doc), size), first[doc] + n, np.zeros(len(doc), np.int64)
            for x, c in ((length, "lengths"), (sequence, "sequences"), (offset, "offsets")):
                x[cut] = batch.column(c).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(length)])
            start = ends[:-1] - (np.cumsum(tokens) - tokens)[doc]
            ids = text_buffer(batch.column("ids"))[0].view(kind).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), *map(pa.array, (start, length, tokens[doc], sequence, offset)), binary(ids, 4 * ends)], names)

    return out.mapInArrow(pieces, f"`{key}` long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
