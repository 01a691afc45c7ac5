"""Alignment of two tokenizers over one text: union-find over overlapping tokens, and corpus-wide counts of aligned pairs.

Both tokenizers spell the same bytes (a blank and the text).  Tokens are the nodes
of a bipartite graph with a link where the byte ranges of a token of each side
overlap; its connected components are the least groups of tokens that spell the
same bytes on both sides.

1. Both tokenizers encode a chunk (``bytechunks``) alone and end a token where it
   ends, so no link leaves a chunk: union-find runs once for each distinct chunk
   of a block of documents, and a document's groups are those of its chunks.
2. Each block writes the pairs of ids that its links hold with their number, and
   its documents as chunk numbers.  Spark adds the pairs up over all blocks and
   finds each B id's largest count.
3. Counts go back to the blocks that hold the pair.  Pairs of more than one in
   ``SHARE`` of these rows are broadcast (so they are few); others are joined.  A
   block adds up the counts by chunk and then by document.

Texts that are null or empty, or whose tokens spell other bytes (with either
tokenizer), have no tokens: all numbers are 0 and the groups are ''.  Rows may
repeat and keys may be null, each row is aligned; an empty table gives an empty
result.  Very long texts make a block of their own.  Other columns are left out,
so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytechunks import CALL, blocks, byte_level_tokens, chunk_ids, chunk_text, encodes_chunks, sums
from .bytewords import release
from .pieces import MARK, check_model, pack, planes, processor, unpack, unplanes
from .storage import join_values, materialise

#: Chunks in a generation of those that a worker remembers: it holds the other tokenizer too.
KEPT = 150_000
#: Characters in a block, a single longer text aside; a pair in more than one in ``SHARE`` of all (block, pair) rows is hot, but none in ``ROOM`` blocks or less.
BLOCK, SHARE, ROOM = 4 << 20, 1000, 256


@lru_cache(maxsize=2)
def piece_tokens(model: str) -> list[bytes]:
    sp = processor(model)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.vocab_size())]


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest node) of each of ``n`` nodes joined by links a - b: union by the smaller root, and paths halved, for all links at once until nothing moves."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return up
        np.minimum.at(up, x, low)
        np.minimum.at(up, y, low)
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions in a and b, in order) and the group of each token of both sides, for two tokenizations with byte lengths ``a`` and ``b`` of the same text."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    # between two ends lies a piece of one token of each side
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    root = components(i, len(a) + j, len(a) + len(b))
    # roots are A tokens, groups lie in their order
    group = np.cumsum(root[: len(a)] == np.arange(len(a))) - 1
    return i, j, group[root[: len(a)]], group[root[len(a) :]]


def _list(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def _joined(values: pa.Array, counts: np.ndarray, between: str) -> pa.Array:
    """Runs of ``values`` (of ``counts`` each) as one string each."""
    return pc.binary_join(_list(np.cumsum(counts), values), between)


def _spelled(flat: np.ndarray, counts: np.ndarray, tokens: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their byte lengths and their number by text, and whether they spell the text."""
    lengths = np.array([len(x) for x in tokens], dtype=np.int64)[flat]
    whole = b"".join([tokens[i] for i in flat.tolist()])
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    same = np.array([whole[x:y] == t for x, y, t in zip(ends, ends[1:], texts)], dtype=bool)
    same[np.repeat(np.arange(len(texts)), counts)[lengths == 0]] = False
    return flat, lengths, counts, same


def _aligned(names: list[str], path: str, model: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: its groups as text, numbers of A tokens, B tokens, groups and links (a row each), the pairs (a << 32 | b) of all links, and whether both tokenizers spell it (else it has no tokens)."""
    texts = [chunk_text(n) for n in names]
    raw = [t.encode() for t in texts]
    a, long_a, many_a, same_a = _spelled(*chunk_ids(path, names, True, KEPT), byte_level_tokens(path), raw)
    # a chunk's first blank is the marker that the model puts before a text
    pieces = [x for n in range(0, len(texts), CALL) for x in processor(model).encode([t[1:] for t in texts[n : n + CALL]], num_threads=1)]
    flat = np.fromiter(chain.from_iterable(pieces), dtype=np.int64)
    b, long_b, many_b, same_b = _spelled(flat, np.array([len(x) for x in pieces], dtype=np.int64), piece_tokens(model), raw)
    known = same_a & same_b
    rows = np.arange(len(names))
    own_a, own_b = np.repeat(known, many_a), np.repeat(known, many_b)
    row_a, row_b = np.repeat(rows, many_a)[own_a], np.repeat(rows, many_b)[own_b]
    a, b = a[own_a], b[own_b]
    i, j, group_a, group_b = groups_of(long_a[own_a], long_b[own_b])
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    first = np.searchsorted(group_a, np.arange(n_groups))  # groups lie in the order of their first A token
    text_a, text_b = (_joined(pc.cast(pa.array(x), pa.string()), np.bincount(g, minlength=n_groups), ",") for x, g in ((a, group_a), (b, group_b)))
    by_row = np.bincount(row_a[first], minlength=len(names)) if n_groups else np.zeros(len(names), np.int64)
    groups = _joined(pc.binary_join_element_wise(text_a, text_b, "|"), by_row, ";")
    links = np.bincount(row_a[i], minlength=len(names)) if len(i) else np.zeros(len(names), np.int64)
    numbers = np.stack([np.where(known, many_a, 0), np.where(known, many_b, 0), by_row, links]).astype(np.int64)
    return groups, numbers, (a[i] << 32) | b[j], known


def align_blocks(docs: DataFrame, path: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds, written once.  block, pair, n: links of a block that hold a pair of ids; block, data: documents and chunks of a block, packed."""
    check_model(model)
    if not encodes_chunks(path):
        raise ValueError("tokenizer A is not byte-level with the usual parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for keys, numbers, names in blocks(batches, BLOCK, prefix=" "):
            block += 1
            groups, counts, pairs, known = _aligned(names, path, model)
            numbers = [x[:0] if bad else x for x, bad in zip(numbers, (sums(1 - known.astype(np.int64), numbers) > 0).tolist())]
            flat = np.concatenate(numbers)
            often = np.bincount(flat, minlength=len(names))
            # chunks that only texts without tokens have give no links
            pairs = pairs[np.repeat(often > 0, counts[3])]
            counts[:, often == 0] = 0
            own, at = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(own), dtype=np.int64)
            np.add.at(n, at, np.repeat(often, counts[3]))
            nulls = np.array([k is None for k in keys], dtype=np.uint8)
            data = pack(np.array([k or 0 for k in keys], dtype=np.int64), nulls, np.array([len(x) for x in numbers], dtype=np.uint32), planes(flat), counts.astype(np.uint32), planes(at), pc.binary_length(groups).to_numpy().astype(np.uint32), "".join(groups.to_pylist()).encode())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own) + 1, block, np.int64)), pa.array([None, *own.tolist()], pa.int64()), pa.array(np.concatenate([[0], n])), pa.array([data] + [None] * len(own), pa.binary())], columns)
            del groups, counts, pairs, flat, numbers, names, own, at, data
            release()
        release()

    columns = ["block", "pair", "n", "data"]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(run, "block long, pair long, n long, data binary"), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n (blocks that hold it), count (links corpus-wide) and best (whether no A id has more links with this B id)."""
    counts = blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b)))


def align(docs: DataFrame, path: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``) of every row.

    ``path``: byte-level tokenizer A; ``model``: SentencePiece model B."""
    written = align_blocks(docs, path, model, key, text)
    counts = materialise(pair_counts(written), "pairs")
    pairs = written.where("pair IS NOT NULL").select("block", "pair")
    most = max(ROOM, pairs.count() / SHARE)
    values = counts.select("pair", "n", F.struct("count", "best").alias("value"))
    back = join_values(pairs, values, ["pair"], "block", most).select(F.col("block").alias("to"), "pair", "value.count", "value.best")

    def join_back(docs: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        count, best = (found.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        out = []
        for data in docs.column("data"):
            keys, nulls, many, flat, counts, at, lengths, joined = unpack(data.as_py(), np.int64, np.uint8, np.uint32, np.uint8, np.uint32, np.uint8, np.uint32, bytes)
            flat, at, counts = unplanes(flat).astype(np.int64), unplanes(at).astype(np.int64), counts.astype(np.int64).reshape(4, -1)
            cuts = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
            numbers = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            chunk_ends = np.cumsum(counts[3])
            by_chunk = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], chunk_ends])]) for x in (best, count)]
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            groups = pa.Array.from_buffers(pa.string(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(joined)])
            texts = _joined(groups.take(pa.array(flat)), many.astype(np.int64), ";")
            values = [sums(x, numbers) for x in (*counts, *by_chunk)]
            out.append(pa.table([pa.array(keys, pa.int64(), mask=nulls.astype(bool)), *map(pa.array, values), texts], names=names))
        release()
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.string() if n == "groups" else pa.int64()) for n in names})

    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    left = written.where("data IS NOT NULL").select("block", "data")
    return left.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(join_back, f"`{key}` long, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups string")
