"""Benchmark decontamination: prefix-filtered set join at full containment.

An item's windows are its runs of ``window`` words (one shorter window if it has
fewer).  A window is the set of its word shingles.  Asking for all of them, the
necessary prefix of a window in rarity order is its rarest shingle, so a
document can only hold the window where it holds that shingle.  Shingles are
ranked by document frequency over the whole corpus (first pass).  The second
pass probes each document's shingles against the prefix shingles, places the
window by the shingle's offset in it (positional bound), drops places that
leave the document (length bound) and verifies the run word by word.

Both passes are narrow: documents are never shuffled.  Only benchmark windows
are broadcast, in blocks of about ``MAX_WINDOWS`` by the hash of item and words,
so a long item spreads over them too; a larger benchmark takes more passes, one
after another (see ``contamination``).  A block reaches the driver as Arrow
columns and stays in arrays.

Words are compared by 64-bit hashes, all words of a window one by one.  Null
texts have no words; items without words are skipped; items with equal ids
count once, with the windows of all their texts.  Empty tables give empty
results or rows without hits; rows that repeat get equal results; very long
texts are one row of word hashes, never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, gram_hash, slices
from .storage import discarding, materialise

#: Windows of ten words that one block holds; other windows count by their words.
MAX_WINDOWS = 1_000_000
SHINGLE = 5


class Windows:
    """Distinct windows of a block, by number: word hashes, items and shingles, all in arrays."""

    def __init__(self, rows: pa.Table):
        """``rows``: words (binary, 8 bytes a word) and owners (list of item ids)."""
        words, owners = rows.column("words").cast(pa.large_binary()).combine_chunks(), rows.column("owners").combine_chunks()
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        self.length = np.diff(at) // 8
        self.flat = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64) if len(words) else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum(owners.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.items, self.owner = np.unique(owners.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        cut: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)  # size: hashes, windows, offsets
        for length in np.unique(self.length).tolist():
            own, k = np.flatnonzero(self.length == length), min(SHINGLE, length)
            for offset in range(length - k + 1):
                h = gram_hash([self.flat[self.first[own] + offset + i] for i in range(k)])
                cut[k].append((h, own.astype(np.int32), np.full(len(own), offset, dtype=np.int32)))
        self.shingles = {k: tuple(np.concatenate(c) for c in zip(*v)) for k, v in cut.items()}
        self.known = {k: np.unique(v[0]) for k, v in self.shingles.items()}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def rank(self, frequency: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle by the frequencies of the known ones; ties go to the smaller hash, then the first place."""
        for k, (h, window, offset) in self.shingles.items():
            df = frequency[k][np.searchsorted(self.known[k], h)]
            order = np.lexsort((offset, h, df, window))
            chosen = order[np.concatenate([[True], np.diff(window[order]) != 0])]
            chosen = chosen[df[chosen] > 0]  # a shingle that no document has rules its windows out
            chosen = chosen[np.argsort(h[chosen], kind="stable")]
            keys, at = np.unique(h[chosen], return_index=True)
            self.prefix[k] = (keys, np.concatenate([at, [len(chosen)]]), window[chosen].astype(np.int64), offset[chosen].astype(np.int64))
        self.shingles, self.known = {}, {}


def _look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``h`` of hashes that ``keys`` (sorted) has, and their places in ``keys``."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = 20
    table = np.zeros(1 << bits, dtype=bool)  # most hashes end here, without a search
    table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    ok = keys[at] == h[maybe]
    return maybe[ok], at[ok]


def benchmark_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, size and word hashes (little-endian bytes) of every window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), ALNUM)
            out = []
            for key, a, b in zip(batch.column(0).to_pylist(), words.at[:-1].tolist(), words.at[1:].tolist()):
                n = min(window, b - a)
                out += [(key, n, words.hash[i : i + n].tobytes()) for i in range(a, b - n + 1)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["item", "size", "words"])

    return benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), text).mapInArrow(cut, "item long, size int, words binary")


def _shingle_frequency(docs: DataFrame, text: str, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Number of documents with each of the ``known`` shingles, which are broadcast; at most a row for each comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.items()}
        for batch in slices(batches, "text"):
            words = Words(batch.column(0), ALNUM)
            row = words.rows()
            for k, keys in known.items():
                h, where = words.grams(k)
                places, at = _look_up(keys, h)
                pairs = np.unique(row[where[places]] * len(keys) + at) if len(at) else at
                totals[k] += np.bincount(pairs % max(1, len(keys)), minlength=len(keys))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(known[k][some].view(np.int64)), pa.array(n[some])], ["k", "h", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    size, h, n = (found.column(c).to_numpy() for c in ("k", "h", "n"))
    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.items()}
    for k, keys in known.items():
        own = size == k
        out[k][np.searchsorted(keys, h[own].astype(np.int64).view(np.uint64))] = n[own]
    return out


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:n]) > 0


def _hold(windows: DataFrame, docs: DataFrame, text: str) -> Windows:
    """Windows (item, words) in arrays, each with its rarest shingle among the documents."""
    held = Windows(windows.groupBy("words").agg(F.collect_set("item").alias("owners")).toArrow())
    held.rank(_shingle_frequency(docs, text, held.known))
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """Add n_words, n_hit, items (array, ascending), n_items and contaminated to ``docs``; columns of these names are replaced.

    One block of windows is probed as the result is read.  A benchmark of more blocks is probed here, one at a time: a block's hits are written
    and its broadcast is destroyed before the next is built, so neither the plan nor what executors hold grows with the benchmark."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, window)
    total = windows.agg(F.sum("size").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (10 * MAX_WINDOWS)))
    rows = docs.drop("n_words", "_hit_places", "items", "n_hit", "n_items", "contaminated")
    if blocks == 1:
        found = _probed(rows, text, spark.sparkContext.broadcast(_hold(windows, docs, text)))
    else:
        with discarding():
            found = materialise(_in_blocks(rows, text, windows, blocks), "contamination", keep=True)
    return found.withColumns({"n_hit": F.size("_hit_places").cast("long"), "n_items": F.size("items").cast("long"), "contaminated": F.size("_hit_places") > 0}).drop("_hit_places")


def _in_blocks(rows: DataFrame, text: str, windows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with n_words, _hit_places and items of all blocks, whose hits meet by a number of the written rows."""
    spark, row = rows.sparkSession, "_row"
    while row in {c.lower() for c in rows.columns}:
        row += "_"
    windows = materialise(windows, "windows")
    nothing = spark.sparkContext.broadcast(Windows(pa.table({"words": pa.array([], pa.binary()), "owners": pa.array([], pa.list_(pa.int64()))})))
    rows = materialise(_probed(rows, text, nothing).drop("_hit_places", "items").withColumn(row, F.monotonically_increasing_id()), "documents")
    found = []
    for block in range(blocks):
        held = _hold(windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block), rows, text)
        shared = spark.sparkContext.broadcast(held)
        found.append(materialise(_probed(rows.select(row, text), text, shared).where(F.size("_hit_places") > 0).select(row, "_hit_places", "items"), "hits"))
        shared.destroy()
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(merged("_hit_places"), merged("items"))
    none = {"_hit_places": F.coalesce("_hit_places", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<long>"))}
    return rows.join(every, row, "left").drop(row).withColumns(none)


def _probed(rows: DataFrame, text: str, shared) -> DataFrame:
    """``rows`` with n_words, _hit_places (places of words inside a window, ascending) and items (ascending) for one broadcast block of windows."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_words long, _hit_places array<int>, items array<long>"])
    return rows.mapInArrow(_probe(text, shared), schema)


def _probe(text: str, shared):
    """Second pass for one block of windows."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Windows = shared.value
        for batch in slices(batches, text):
            words = Words(batch.column(text), ALNUM)
            row, n, starts, wins = words.rows(), len(words), [], []
            for k, (keys, at, window, offset) in held.prefix.items():
                h, where = words.grams(k)
                places, key = _look_up(keys, h)
                many = at[key + 1] - at[key]
                entry = np.repeat(at[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                place, w = np.repeat(where[places], many), window[entry]
                start, size = place - offset[entry], held.length[w]
                ok = (start >= words.at[row[place]]) & (start + size <= words.at[row[place] + 1])
                start, w, size = start[ok], w[ok], size[ok]
                for length in np.unique(size):
                    same = size == length
                    s, v = start[same], w[same]
                    for i in range(length):
                        equal = words.hash[s + i] == held.flat[held.first[v] + i]
                        s, v = s[equal], v[equal]
                    starts.append(s)
                    wins.append(v)
            start, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, wins))
            hit = _covered(start, start + held.length[win] if len(win) else start, n)
            pairs = np.unique(row[start] * (len(held.length) + 1) + win) if len(win) else win
            doc, win = pairs // (len(held.length) + 1), pairs % (len(held.length) + 1)
            many = held.owner_at[win + 1] - held.owner_at[win]
            owner = held.owner[np.repeat(held.owner_at[win] - (np.cumsum(many) - many), many) + np.arange(many.sum())] if len(win) else win
            pairs = np.unique(np.repeat(doc, many) * (len(held.items) + 1) + owner) if len(owner) else owner
            at = np.searchsorted(pairs // (len(held.items) + 1), np.arange(batch.num_rows + 1))
            ids = held.items[pairs % (len(held.items) + 1)] if len(pairs) else pairs
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int64()))
            places = np.flatnonzero(hit)
            cuts = np.searchsorted(places, words.at)
            own = places - np.repeat(words.at[:-1], np.diff(cuts))
            hits = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(words.at), pa.int64()), hits, lists], [*batch.schema.names, "n_words", "_hit_places", "items"])

    return probe
