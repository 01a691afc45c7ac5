"""Hard negatives for contrastive training: a vector-approximation file with exact windows.

A row is an integer vector with a label; its score with an anchor is their inner
product.  An anchor's positives are its best rows of its own label, and for each
positive the hard negatives are the best rows of other labels whose score lies in
a window under the positive's.

1. Each dimension is parted into at most ``CELLS`` cells of about as many rows of
   a sample (the ``SAMPLE`` rows of lowest hash).  A row's approximation is the
   cell of each component, a byte a dimension.  The outermost cells reach to the
   least and the greatest component of all rows, so every row lies in its cells.
2. For an anchor, a table of a dimension gives the least and the greatest product
   with a component of each cell.  Sums of table entries bound the score of every
   row from both sides without reading its vector.
3. A row is scored exactly only if its bounds leave it a place: its upper bound
   has to reach the worst row kept so far (or the window's lower end), its lower
   bound must not pass the window's upper end.  Rows that bounds alone place
   within a window raise the least that counts before any exact score is known.
   So the answer is that of brute force, whatever the cells; a poor sample only
   makes more rows be scored.

Anchors go out in blocks of at most ``BLOCK_BYTES`` of vectors (broadcast), each
block twice over the file: once for positives, once for the windows.  Each task
keeps k rows an anchor, and k a window, which are written before the next block.
More anchors take more passes.

Rows with a null id, a null label, a null vector or a null or non-finite component
take no part; neither do vectors of another length than the most frequent one
(ties: the shorter), empty vectors, and vectors whose squared integer length
passes 2**53, up to which all scores are exact.  Rows with the anchor's id are not
its partners.  Rows that repeat an anchor row are answered once, repeated partners
count as often as they stand there; ties go to the smaller id.  An anchor without
positives, and a positive whose window is empty, give no rows; so does an empty
table.  Zero vectors take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import release
from .storage import discarding, lowest_hashes, materialise

CELLS, SAMPLE, BLOCK_BYTES, LARGEST = 64, 20_000, 16 << 20, 2.0**53
#: Rows that are looked at together.
ROWS = 8192


@dataclass
class Cells:
    """marks: upper ends of all but the last cell, by dimension; least and most: ends of all components."""

    marks: list[np.ndarray]
    least: np.ndarray
    most: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Cells of the rows of ``x``, a column a dimension."""
        return np.stack([np.searchsorted(m, x[:, d], side="left") for d, m in enumerate(self.marks)], axis=1).astype(np.uint8)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """dims x CELLS: least and greatest component of each cell; integers between marks, so a cell starts one after the mark before."""
        dims = len(self.marks)
        low, high = np.zeros((dims, CELLS)), np.zeros((dims, CELLS))
        for d, m in enumerate(self.marks):
            n = len(m) + 1
            low[d, :n] = np.concatenate([[self.least[d]], m + 1])
            high[d, :n] = np.concatenate([m, [self.most[d]]])
        return low, high


def quantised(vector: str, scale: float) -> Column:
    """Components times ``scale``, rounded down, as doubles."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def usable(vectors: DataFrame, scale: float, key: str, label: str, vector: str) -> DataFrame:
    """vec_id, label and vector (whole doubles) of the rows that take part."""
    far = 2.0**53 / scale  # beyond it a component alone is too long
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(far))
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, number)
    rows = vectors.where(ok).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), quantised(vector, scale).alias("vector"))
    return rows.where(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) <= LARGEST)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def approximate(vectors: DataFrame, scale: float = 256.0, key: str = "vec_id", label: str = "label", vector: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Cells | None]:
    """The file: vec_id, label, vector (whole doubles) and cells (a byte a dimension) of every row that takes part, and its cells."""
    rows = usable(vectors, scale, key, label, vector)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.withColumn("cells", F.lit(b"")), None
    dims = sizes["n"]
    rows = rows.where(F.size("vector") == dims)
    chosen = lowest_hashes(rows.select("vector", F.xxhash64("vec_id", "vector").alias("h")), "h", sample).toArrow().combine_chunks()
    x = matrix(chosen.column("vector").chunk(0), dims)
    marks = [np.unique(np.quantile(x[:, d], np.arange(1, CELLS) / CELLS, method="lower")) for d in range(dims)]

    def task_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(least), pa.array(most)], ["d", "least", "most"])

    ends = rows.select("vector").mapInArrow(task_ends, "d int, least double, most double").groupBy("d").agg(F.min("least"), F.max("most")).orderBy("d").collect()  # a row a dimension
    cells = Cells(marks, *(np.array([r[i] for r in ends]) for i in (1, 2)))
    shared = vectors.sparkSession.sparkContext.broadcast(cells)  # CELLS marks a dimension

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.encode(matrix(batch.column("vector"), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "label", "vector", "cells"])

    return materialise(rows.mapInArrow(encode, "vec_id long, label long, vector array<double>, cells binary"), "approximations"), cells


class _Batches:
    """Rows of the file by ``ROWS``: ids, labels, vectors and cells (a row a dimension, ready to index tables)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], dims: int):
        self.batches, self.dims = batches, dims

    def __iter__(self):
        for batch in self.batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                codes = np.frombuffer(b"".join(part.column("cells").to_pylist()), dtype=np.uint8).reshape(part.num_rows, self.dims)
                yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vector"), self.dims), np.ascontiguousarray(codes.T).astype(np.intp)
        release()


class _Bounds:
    """Tables of one anchor."""

    def __init__(self, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        a, b = q[:, None] * low, q[:, None] * high
        self.under, self.over = np.minimum(a, b), np.maximum(a, b)
        # sums of ends may pass 2**53, where they are rounded
        self.slack = len(q) * 2.0**-52 * np.maximum(np.abs(self.under), np.abs(self.over)).max(axis=1).sum()

    @staticmethod
    def _sum(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(codes.shape[1])
        for t, c in zip(tables, codes):
            total += t[c]
        return total

    def upper(self, codes: np.ndarray) -> np.ndarray:
        return self._sum(self.over, codes) + self.slack

    def lower(self, codes: np.ndarray) -> np.ndarray:
        return self._sum(self.under, codes) - self.slack


class _Kept:
    """The k best rows so far: scores, ids, and the least score that still counts."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]
        if len(best) == self.k:
            self.floor = max(self.floor, self.score[-1])


def _best_partners(shared, cells: Cells, k: int):
    """The k best rows of the anchor's label in a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, raw = shared.value
        low, high = cells.ends()
        kept = [_Kept(k) for _ in names]
        for ids, label, x, codes in _Batches(batches, raw.shape[1]):
            for mark in np.unique(label):
                rows = np.flatnonzero(label == mark)
                own, own_x, own_codes = ids[rows], x[rows], codes[:, rows]
                for q in np.flatnonzero(labels == mark).tolist():
                    upper = _Bounds(raw[q], low, high).upper(own_codes)
                    open_ = (upper >= kept[q].floor) & (own != names[q])
                    if len(kept[q].ids) < k and open_.sum() > 4 * k:  # the rows of largest bounds first, so that few others stay open
                        at = np.argpartition(-np.where(open_, upper, -np.inf), 2 * k)[: 2 * k]
                        kept[q].add(own_x[at] @ raw[q], own[at])
                        open_[at] = False
                        open_ &= upper >= kept[q].floor
                    at = np.flatnonzero(open_)
                    if len(at):
                        kept[q].add(own_x[at] @ raw[q], own[at])
        yield _rows(range(len(names)), kept)

    return scan


def _rows(numbers, kept: list[_Kept]) -> pa.RecordBatch:
    n = [len(x.ids) for x in kept]
    number = np.repeat(np.array(numbers, dtype=np.int64), n)
    ids, score = (np.concatenate([getattr(x, c) for x in kept]) if kept else np.zeros(0) for c in ("ids", "score"))
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.int64))], ["number", "vec_id", "score"])


def _best_in_windows(shared, cells: Cells, k: int):
    """The k best rows of other labels in each window of a partition; windows: anchor, least and greatest score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, raw, anchors, floors, tops = shared.value
        low, high = cells.ends()
        kept = [_Kept(k, f) for f in floors]
        at = np.searchsorted(anchors, np.arange(len(names) + 1))
        for ids, label, x, codes in _Batches(batches, raw.shape[1]):
            for q, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                if a == b:
                    continue
                bounds = _Bounds(raw[q], low, high)
                upper = bounds.upper(codes)
                rows = np.flatnonzero((upper >= min(w.floor for w in kept[a:b])) & (label != labels[q]) & (ids != names[q]))
                if not len(rows):
                    continue
                upper, lower = upper[rows], bounds.lower(codes[:, rows])
                enters, need = [], np.zeros(len(rows), dtype=bool)
                for w in range(a, b):
                    floor = kept[w].floor
                    sure = lower[(lower >= floor) & (upper <= tops[w])]  # these lie in the window, so k of them bar all that cannot reach the k-th
                    if len(sure) >= k:
                        floor = max(floor, np.partition(sure, -k)[-k])
                    enters.append((upper >= floor) & (lower <= tops[w]))
                    need |= enters[-1]
                open_ = np.flatnonzero(need)
                if not len(open_):
                    continue
                score, own = x[rows[open_]] @ raw[q], ids[rows[open_]]
                for w, enter in zip(range(a, b), enters):
                    ok = enter[open_] & (score >= kept[w].floor) & (score <= tops[w])
                    if ok.any():
                        kept[w].add(score[ok], own[ok])
        yield _rows(range(len(kept)), kept)

    return scan


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@discarding()
def hard_negatives(file: DataFrame, cells: Cells | None, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor row.

    ``file``, ``cells``: of ``approximate``; ``anchors``: rows of the file.  A negative's score is at least ``least`` and at most ``most`` hundredths of its positive's."""
    spark = file.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if cells is None:
        return spark.createDataFrame([], schema)
    dims = len(cells.marks)
    asked = materialise(anchors.select("vec_id", "label", "vector").distinct(), "anchors")
    blocks = max(1, -(-asked.count() * 8 * dims // BLOCK_BYTES))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        names, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        raw = matrix(rows.column("vector").chunk(0), dims)
        shared = spark.sparkContext.broadcast((names, labels, raw))
        near = file.mapInArrow(_best_partners(shared, cells, positives), "number long, vec_id long, score long")
        best = materialise(_merged(near, positives).select("number", "vec_id", "score"), "positives")
        best = best.orderBy("number", F.desc("score"), "vec_id").toArrow().combine_chunks()  # ``positives`` rows an anchor
        shared.destroy()
        if not best.num_rows:
            continue
        number, partner, score = (best.column(c).to_numpy() for c in ("number", "vec_id", "score"))
        floors, tops = -((-least * score) // 100), most * score // 100
        shared = spark.sparkContext.broadcast((names, labels, raw, number, floors.astype(float), tops.astype(float)))
        inside = materialise(_merged(file.mapInArrow(_best_in_windows(shared, cells, negatives), "number long, vec_id long, score long"), negatives), "negatives")
        shared.destroy()
        windows = pa.table({"number": np.arange(len(number)), "anchor_id": names[number], "positive_id": partner, "positive_score": score})
        named = inside.select("number", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(spark.createDataFrame(windows), "number")
        found.append(materialise(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives", keep=True))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema))
