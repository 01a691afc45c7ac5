"""Words of Arrow string columns as byte spans and 64-bit hashes, computed with numpy.

A word is a maximal run of bytes of a class.  ASCII letters are folded to lower
case.  All separators are ASCII, so working on UTF-8 bytes gives the same words
as working on code points.  Hashes are polynomial prefix sums over random byte
values, so a whole batch costs a few passes over its bytes, whatever the number
of words.  Such sums collide for some made-up words of a thousand letters, so
words of ``LONG`` bytes or more are hashed one by one with a hash that is not linear.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C1B
_STEP = 1 << 20
LONG = 256


def release() -> None:
    """Give freed memory back at the end of a task: Python workers outlive tasks, and an executor's limit counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _class(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: ``[^\x20\x09-\x0D]+``
SPACED = _class(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)[_FOLD] * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _STEP)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, U(base))
            x[0] = U(1)
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit changes about half of the output bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = _STEP) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``limit`` bytes of text (one row may have more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
    release()


class Words:
    """``start``/``end``: byte spans of words; ``hash``: of the folded word; ``at``: n + 1 word offsets of rows."""

    def __init__(self, column: pa.Array, kind: np.ndarray):
        self.data, self.offsets = text_buffer(column)
        n = len(self.data)
        flags = np.zeros(n + 1, dtype=np.int8)
        flags[:n] = kind[self.data]
        inside = flags[:n]
        first = inside.astype(bool)
        first[1:] &= inside[:-1] == 0
        edges = self.offsets[1:-1]
        edges = edges[edges < n]
        first[edges] = inside[edges] > 0
        last = inside.astype(bool)
        last[:-1] &= inside[1:] == 0
        before = edges[edges > 0] - 1
        last[before] = inside[before] > 0
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        for i in np.flatnonzero(self.end - self.start >= LONG).tolist():
            self.hash[i] = xxhash.xxh3_64_intdigest(self.word(i))
        self.at = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().lower()

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and the word each starts at; runs never cross rows."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = gram_hash([self.hash[i : i + n] for i in range(k)])
        room = np.repeat(self.at[1:], np.diff(self.at))[:n]
        where = np.flatnonzero(np.arange(n) + k <= room)
        return h[where], where


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of word hashes, all of one length."""
    h = np.full(len(parts[0]), U(len(parts)))
    for p in parts:
        h = (h ^ p) * U(_BASE)
        h = h ^ (h >> U(29))
    return mix(h)
