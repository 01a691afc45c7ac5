"""Nearest neighbours by cosine: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

1. Vectors are scaled to length 1, so cosine is an inner product.  A vector is
   cut into subspaces of ``SUB`` dimensions with 16 centres each, four bits a
   subspace.  Codebooks and codes minimise the anisotropic loss: the part of the
   residual that is parallel to the vector costs ``eta`` times as much as the
   rest, since it is what moves large inner products.  Codebooks are fitted on
   the ``SAMPLE`` rows of lowest hash; every row is encoded and indexed.
2. A query scans the codes with tables of its inner products with the centres
   (two four-bit codes share one byte and one 256-entry table, sums are 16-bit).
3. The best of the scan are scored exactly, then every row whose scan score plus
   residual length could still reach the k-th best.  Residual lengths bound the
   error, so the answer is that of brute force, whatever the codebooks.

The index is scanned where it lies: queries are written once, dealt into blocks of
about ``QUERY_BLOCK``, and go out a block at a time (broadcast, of bounded size).
Each task keeps k rows a query, and these are written; then the block leaves driver
and executors, so neither holds more than one.  The written rows are merged by
query.  More queries take more passes.

Ids name rows: null ids, and vectors that are null, zero, of another length than
``dims`` (the most frequent length) or hold null or non-finite components take no
part.  Rows with the query's own id are not its neighbours; a repeated query row
is answered once for each distinct vector.  With fewer candidates than k all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discarding, lowest_hashes, materialise

SUB, CENTRES, SAMPLE, QUERY_BLOCK, THRESHOLD = 2, 16, 20_000, 8192, 0.2
#: Scan scores scored exactly before the bound is applied.
FIRST = 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / lengths(x)[:, None]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last: equal rows always give equal bits."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def cosines(query: np.ndarray, query_length: float, x: np.ndarray, x_lengths: np.ndarray) -> np.ndarray:
    return dots(x, query[None, :]) / (query_length * x_lengths)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; rows out of the range of squares are scaled by a power of two, which changes no cosine."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    most = np.abs(x).max(axis=1, initial=0)
    far = np.flatnonzero((most > 1e100) | (most < 1e-100))
    if len(far):
        x = x.copy()
        x[far] = np.ldexp(x[far], -np.frexp(most[far])[1][:, None])
    return x


@dataclass
class Codebook:
    """centres: subspaces x CENTRES x SUB; eta: weight of the parallel part of the residual."""

    centres: np.ndarray
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut into subspaces, padded with zeros."""
        s = len(self.centres)
        out = np.zeros((len(x), s * SUB))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), s, SUB)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes of unit vectors by coordinate descent: a subspace's choice depends on the parallel residual that the others leave."""
        parts = self.split(x)
        rows, s = np.arange(len(x)), len(self.centres)
        plain = np.stack([((parts[:, i, None, :] - self.centres[i]) ** 2).sum(axis=2) for i in range(s)], axis=1)
        along = np.stack([((parts[:, i, None, :] - self.centres[i]) * parts[:, i, None, :]).sum(axis=2) for i in range(s)], axis=1)
        codes = plain.argmin(axis=2)
        parallel = along[rows[:, None], np.arange(s), codes].sum(axis=1)
        for _ in range(sweeps):
            for i in range(s):
                rest = parallel - along[rows, i, codes[:, i]]
                codes[:, i] = (plain[:, i] + (self.eta - 1) * (rest[:, None] + along[:, i]) ** 2).argmin(axis=1)
                parallel = rest + along[rows, i, codes[:, i]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray, dims: int) -> np.ndarray:
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)[:, :dims]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte; an odd last one stands alone."""
        low, high = codes[:, 0::2], codes[:, 1::2]
        out = low.copy()
        out[:, : high.shape[1]] |= high << 4
        return out

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        """16-bit tables by packed byte, their step, offset and greatest error of a sum."""
        inner = (self.split(query[None, :])[0][:, None, :] * self.centres).sum(axis=2)
        if len(inner) % 2:
            inner = np.concatenate([inner, np.zeros((1, CENTRES))])
        pairs = (inner[1::2, :, None] + inner[0::2, None, :]).reshape(len(inner) // 2, CENTRES * CENTRES)
        low = pairs.min(axis=1)
        step = max(float((pairs - low[:, None]).max()) / (65535 // len(pairs)), 1e-12)
        return np.floor((pairs - low[:, None]) / step).astype(np.uint16), step, float(low.sum()), step * len(pairs)


def fit_codebook(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 7) -> Codebook:
    """Codebook of unit vectors; ``threshold``: the inner products that count (the weight follows from it and the dimension)."""
    dims = x.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    s = -(-dims // SUB)
    book = Codebook(np.zeros((s, CENTRES, SUB)), eta)
    parts, rng = book.split(x), np.random.default_rng(seed)
    for i in range(s):
        book.centres[i] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), i]
    for _ in range(rounds):
        codes = book.encode(x, sweeps=1)
        residual = parts - book.centres[np.arange(s), codes]
        along = (residual * parts).sum(axis=2)
        parallel = along.sum(axis=1)
        for i in range(s):
            p, rest = parts[:, i], parallel - along[:, i]
            right = p * (1 + (eta - 1) * (rest + (p**2).sum(axis=1)))[:, None]
            for c in range(CENTRES):
                own = codes[:, i] == c
                n = int(own.sum())
                if n:
                    left = n * np.eye(SUB) + (eta - 1) * p[own].T @ p[own]
                    book.centres[i, c] = np.linalg.solve(left, right[own].sum(axis=0))
                else:
                    book.centres[i, c] = p[rng.integers(len(p))]
    return book


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector of rows that can take part, of any one length."""
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    ok = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(key).cast("long").alias("vec_id"), v.alias("vector"))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Codebook | None, int]:
    """Table of vec_id, vector, codes and reach (length of the residual), its codebook and the dimension."""
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.withColumns({"codes": F.lit(b""), "reach": F.lit(0.0)}), None, 0
    dims = sizes["n"]
    rows = rows.where(F.size("vector") == dims)
    chosen = lowest_hashes(rows.select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64("vec_id", "vector").alias("h")), "h", sample).toArrow().combine_chunks()
    book = fit_codebook(unit(matrix(chosen.column("v").chunk(0), dims)))
    shared = vectors.sparkSession.sparkContext.broadcast(book)  # 16 centres a subspace

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = unit(matrix(part.column("vector"), dims))
                codes = shared.value.encode(x)
                reach = lengths(x - shared.value.decode(codes, dims))
                packed = shared.value.pack(codes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(reach)], ["vec_id", "vector", "codes", "reach"])

    kind = rows.schema["vector"].dataType.simpleString()
    return materialise(rows.mapInArrow(encode, f"vec_id long, vector {kind}, codes binary, reach double"), "vectors"), book, dims


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


@discarding()
def search(index: DataFrame, book: Codebook | None, dims: int, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k nearest."""
    spark, schema = index.sparkSession, "query_id long, query long, vec_id long, score double"
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialise(usable(queries, key, vector).where(F.size("vector") == dims).select("vec_id", F.col("vector").cast("array<double>").alias("vector")).distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        raw = matrix(rows.column("vector").chunk(0), dims)
        shared = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), raw))
        own = index.mapInArrow(_scan(shared, book, dims, k), schema).withColumn("query", F.col("query") + F.lit(block << 32))
        found.append(materialise(own, "nearest", keep=True))
        shared.destroy()  # what it gave is written, so no task asks for it again
    found = reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scan(shared, book: Codebook, dims: int, k: int):
    """The k best rows of a partition for each query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        units, sizes = unit(raw), lengths(raw)
        tables = [book.tables(q) for q in units]
        score, ids = [np.zeros(0)] * len(names), [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_id, reach = batch.column("vec_id").to_numpy(), batch.column("reach").to_numpy()
            x = matrix(batch.column("vector"), dims)
            long = lengths(x)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(len(vec_id), -1).T)
            for q, (table, step, low, error) in enumerate(tables):
                total = np.zeros(len(vec_id), dtype=np.uint16)
                for t, c in zip(table, codes):
                    total += np.take(t, c)
                near = total * step + low
                open_ = vec_id != names[q]
                top = np.flatnonzero(open_)
                if len(top) > FIRST:
                    top = top[np.argpartition(-near[top], FIRST)[:FIRST]]
                first = np.concatenate([score[q], cosines(raw[q], sizes[q], x[top], long[top])])
                if len(first) >= k:
                    least = np.partition(first, -k)[-k]
                    open_ &= near + (reach + (error + 1e-9)) >= least
                at = np.flatnonzero(open_)
                s, i = np.concatenate([score[q], cosines(raw[q], sizes[q], x[at], long[at])]), np.concatenate([ids[q], vec_id[at]])
                best = _best(s, i, k)
                score[q], ids[q] = s[best], i[best]
        n = np.array([len(i) for i in ids], dtype=np.int64)
        query = np.repeat(np.arange(len(names)), n)
        yield pa.RecordBatch.from_arrays([pa.array(names[query], pa.int64()), pa.array(query, pa.int64()), pa.array(np.concatenate(ids) if len(ids) else [], pa.int64()), pa.array(np.concatenate(score) if len(score) else [], pa.float64())], ["query_id", "query", "vec_id", "score"])

    return scan
