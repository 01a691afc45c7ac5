"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary has the whitespace marker after another character, so
no merge crosses the place where a marked word starts.  A chunk is a run of
markers with the characters up to the next marker.  Work goes in blocks of
documents:

1. each block writes its distinct chunks, dealt by hash into buckets;
2. each bucket segments every distinct chunk once, however many blocks have it,
   and sends the ids back to the blocks;
3. each block's chunks stream through a task before its documents, whose ids are
   looked up by chunk position, a payload of documents at a time.

What is shuffled are packed payloads: a block's documents as chunk numbers (most
frequent first) and, for each bucket, its chunks once.

Texts are decoded by chunk and joined by blanks, which equals decoding all ids
of a document at once for models that pass ``check_model``.

Null texts count as empty; an empty text has only the end id.  Rows may repeat,
each is encoded.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import release
from .storage import text_buckets

#: Bytes of text in a block and in one of its document payloads, a single longer document aside.
BLOCK_BYTES, PAYLOAD_BYTES = 24 << 20, 2 << 20
#: Chunks decoded at a time.
DECODED = 20_000
MARK = "▁"


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless chunks of this model can be encoded alone."""
    sp = processor(model)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size())):
        raise ValueError("a piece crosses a whitespace marker")
    if sp.encode("a  b ") != sp.encode("a") + sp.encode(" b") + [sp.piece_to_id(MARK)]:
        raise ValueError("the model normalises white space across chunks")


def split_chunks(text: str) -> list[str]:
    """Chunks of a text, each without its first marker."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return re.findall(r" ( *[^ ]*)", " " + text) if "  " in text or text[0] == " " else text.split(" ")


def pack(*arrays: bytes | np.ndarray) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def unpack(data: bytes, *kinds: type) -> list:
    data = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(data[at : at + size] if kind is bytes else np.frombuffer(data, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """uint32 numbers as four byte planes: the high ones are nearly empty and compress away."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def unplanes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel()


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[np.ndarray], list[str], np.ndarray]]:
    """Block id, document ids, chunk ranks by document, chunks by rank, counts by rank."""

    def close():
        words = list(seen)
        flat = np.concatenate(numbers)
        counts = np.bincount(flat, minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        return (part << 24) + block, keys, [rank[x] for x in numbers], [words[i] for i in order.tolist()], counts[order]

    part, block, size, keys, numbers, seen = 0, 0, 0, [], [], _Numbered()
    for batch in batches:
        part = batch.column(2)[0].as_py() if batch.num_rows else part
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            chunks = split_chunks(text)
            keys.append(key)
            numbers.append(np.fromiter(map(seen.__getitem__, chunks), dtype=np.uint32, count=len(chunks)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield close()
                block, size, keys, numbers, seen = block + 1, 0, [], [], _Numbered()
    if keys:
        yield close()
    del keys, numbers, seen
    release()


def _check(words: list[str], flat: int) -> int:
    return zlib.crc32("\n".join(words[:1000]).encode("utf-8", "surrogatepass") + struct.pack("<2q", len(words), flat))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", end_id: int | None = None, decoded: bool = True) -> DataFrame:
    """``key``, ids array<int> and, if asked for, decoded string of every row of ``docs``; ``end_id`` closes the ids and is not decoded."""
    check_model(model)
    buckets = text_buckets(docs, text)  # buckets stay small however many blocks there are
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))  # of the input: tasks of a union are numbered on
    mark_id = processor(model).piece_to_id(MARK)

    def doc_rows(batches):
        for block, keys, numbers, words, _ in _blocks(batches):
            check, a = _check(words, sum(map(len, numbers))), 0
            while a < len(keys):
                b, size = a, 0
                while b < len(keys) and (size < PAYLOAD_BYTES // 6 or b == a):
                    size += len(numbers[b])
                    b += 1
                nulls = np.array([k is None for k in keys[a:b]], dtype=np.uint8)
                data = pack(np.array([k or 0 for k in keys[a:b]], dtype=np.int64), nulls, np.array([len(x) for x in numbers[a:b]], dtype=np.uint32), planes(np.concatenate(numbers[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1], pa.int32()), pa.array([check]), pa.array([data], pa.binary())], ["block", "kind", "check", "data"])
                a = b

    def word_rows(batches):
        for block, _, numbers, words, counts in _blocks(batches):
            check, coded = _check(words, int(counts.sum())), [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, coded), dtype=np.uint32, count=len(coded)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for n in range(buckets):
                ranks = order[cuts[n] : cuts[n + 1]]
                if len(ranks):
                    chosen = [coded[i] for i in ranks.tolist()]
                    out.append((n, pack(planes(np.diff(ranks, prepend=0)), np.array([len(c) for c in chosen], dtype=np.uint32), b"".join(chosen))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([check] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "block", "check", "data"])

    def segment(table: pa.Table) -> pa.Table:
        """Ids of the chunks of one bucket, each segmented once."""
        sp, known, out = processor(model), {b"": np.array([mark_id], dtype=np.uint32)}, []
        for data in table.column("data"):
            ranks, lengths, joined = unpack(data.as_py(), np.uint8, np.uint32, bytes)
            at = np.cumsum(lengths) - lengths
            chunks = [joined[a : a + n] for a, n in zip(at.tolist(), lengths.tolist())]
            new = [c for c in chunks if c not in known]
            for c, ids in zip(new, sp.encode([c.decode() for c in new], num_threads=1)):
                known[c] = np.array(ids, dtype=np.uint32)
            ids = [known[c] for c in chunks]
            out.append(pack(ranks, np.array([len(x) for x in ids], dtype=np.uint32), planes(np.concatenate(ids))))
        ids = pa.array(out, pa.binary())
        del known, out
        release()
        return pa.table({"block": table.column("block"), "kind": pa.array([0] * len(ids), pa.int32()), "check": table.column("check"), "data": ids})

    def looked_up(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of the chunks of one block: all ids, by rank their place and number in these, and the decoded chunks."""
        sp, ranks, counts, flats = processor(model), [], [], []
        for data in payloads:
            r, n, f = unpack(data, np.uint8, np.uint32, np.uint8)
            ranks.append(np.cumsum(unplanes(r)))
            counts.append(n)
            flats.append(unplanes(f))
        ranks, counts, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ranks, counts, flats))
        flat, counts = flat.astype(np.int32), counts.astype(np.int64)
        at = np.cumsum(counts) - counts
        first, many = np.zeros_like(at), np.zeros_like(counts)
        first[ranks], many[ranks] = at, counts
        texts: list[str] = []
        if decoded:
            for i in range(0, len(first), DECODED):
                texts += sp.decode([flat[a : a + n].tolist() for a, n in zip(first[i : i + DECODED].tolist(), many[i : i + DECODED].tolist())])
        return flat, first, many, texts

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids, and decoded texts if asked for, of the documents of each block, whose chunks come before its documents."""
        own, check, payloads, held = None, None, [], None
        for batch in batches:
            for block, kind, found, data in zip(*(batch.column(c) for c in ("block", "kind", "check", "data"))):
                block, found = block.as_py(), found.as_py()
                if block != own:
                    own, check, payloads, held = block, found, [], None
                if found != check:
                    raise ValueError("the input was dealt differently when it was read again")
                if kind.as_py() == 0:
                    payloads.append(data.as_py())
                    continue
                if held is None:
                    held, payloads = looked_up(payloads), []
                flat, first, many, texts_of = held
                keys, nulls, lengths, numbers = unpack(data.as_py(), np.int64, np.uint8, np.uint32, np.uint8)
                numbers = unplanes(numbers)
                if len(numbers) and int(numbers.max()) >= len(many):
                    raise ValueError("the input was dealt differently when it was read again")
                n = many[numbers]
                upto = np.cumsum(n)
                ids = flat[np.repeat(first[numbers] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
                cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                ends = np.concatenate([[0], upto])[cuts]
                if end_id is not None:
                    ids = np.insert(ids, ends[1:], np.int32(end_id))
                    ends = ends + np.arange(len(ends))
                columns = [pa.array(keys, pa.int64(), mask=nulls.astype(bool)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array([" ".join([texts_of[i] for i in numbers[a:b].tolist()]) for a, b in zip(cuts, cuts[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])
        del held, payloads
        release()

    left = rows.mapInArrow(doc_rows, "block long, kind int, check long, data binary")
    words = rows.mapInArrow(word_rows, "bucket int, block long, check long, data binary")
    right = words.groupBy("bucket").applyInArrow(segment, "block long, kind int, check long, data binary")
    dealt = right.union(left).repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(join_back, f"`{key}` long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and text of id arrays; null arrays decode to the empty text."""

    def texts(batches):
        sp = processor(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(texts, f"`{key}` long, text string")
