"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file set is three Parquet tables in one folder: ``dictionary`` (hash, bytes),
``blocks`` (part, block, first token of the block within its part, dictionary
hash, offset index, frames) and ``parts`` (tokens before each part).  A frame is
one document's id array (little-endian; the narrowest width that holds the
vocabulary); the index gives each document's id, frame end and token count, so a
short document is read by one slice and one frame.  Blocks lie in ascending
document order.

The dictionary is trained on the id arrays of a bounded sample (``SAMPLE_DOCS``
documents of lowest hash, ``SAMPLE_BYTES`` of ids each at most); it only affects
sizes.  Null texts count as empty.  Equal document ids are ordered by a hash of
their text; null ids come first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import _VALUES, LONG, _powers, mix, slices, text_buffer
from .storage import lowest_hashes

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 << 10
#: Bytes of text in a block, a single longer document aside; distinct words a worker remembers.
BLOCK_TEXT, CACHE_WORDS = 2 << 20, 400_000
#: Classes of bytes.  Texts with any other byte are encoded whole by the tokenizer.
SPACE, LETTER, DIGIT, MARK, LEAD, TRAIL, OTHER = range(7)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[list(b"\t\n\x0b\x0c\r ")] = SPACE
CLASS[[c for c in range(0x21, 0x7F)]] = MARK
CLASS[list(b"0123456789")] = DIGIT
CLASS[[c for c in range(0x80) if chr(c).isalpha()]] = LETTER
CLASS[0x80:0xC0] = TRAIL
CLASS[0xC3] = LEAD


#: Fixed value: how the tokenizer whose words this module parts itself splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def parts_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits by ``SPLIT``, with no added tokens but ``<|..|>``; texts of others are encoded whole by the library."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = [s["type"] for s in (rules.get("normalizer") or {}).get("normalizers", [])]
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(parts) == 2 and parts[0].get("pattern") == {"Regex": SPLIT} and parts[0].get("invert") and parts[1]["type"] == "ByteLevel" and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space", True)
    return steps == ["NFC", "Replace", "Lowercase"] and bool(split) and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Ids of a word by its hash, encoded by the tokenizer when first met."""

    def __init__(self, path: str, kind: str):
        super().__init__()
        self.path, self.kind = path, kind

    def learn(self, names: list[int], words: list[str]) -> None:
        """Encode words, many at a time: between spaces each is one word to the tokenizer."""
        t = tokenizer(self.path)
        runs = [(names[a : a + 256], words[a : a + 256]) for a in range(0, len(names), 256)]
        for a in range(0, len(runs), 32):
            some = runs[a : a + 32]
            for (own, _), e in zip(some, t.encode_batch([" ".join(w) for _, w in some], add_special_tokens=False)):
                raw, width = np.array(e.ids, dtype=self.kind).tobytes(), np.dtype(self.kind).itemsize
                cuts = (np.searchsorted(np.array(e.word_ids), np.arange(len(own) + 1)) * width).tolist()
                for h, x, y in zip(own, cuts, cuts[1:]):
                    self[h] = raw[x:y]


@lru_cache(maxsize=4)
def word_ids(path: str, kind: str) -> WordIds:
    return WordIds(path, kind)


def plain_rows(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Rows whose words this module can part as the tokenizer does: ASCII and Latin-1 letters, digits, ASCII marks and white space, no apostrophe before a letter, no control string."""
    n = len(data)
    bad = kind == OTHER
    lead, trail = kind == LEAD, kind == TRAIL
    bad[1:] |= trail[1:] & (~lead[:-1] | (data[1:] == 0x97) | (data[1:] == 0xB7))
    if n:
        bad[0] |= trail[0]
        word = (kind == LETTER) | lead
        bad[:-1] |= (data[:-1] == 0x27) & word[1:] | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    upto = np.concatenate([[0], np.cumsum(bad)])
    return upto[offsets[1:]] == upto[offsets[:-1]]


def encode_block(column: pa.Array, path: str, kind: str, end_id: int) -> list[bytes]:
    """Serialized ids of each text, with the end id; null counts as empty.

    A tokenizer of ``parts_words`` lower-cases, parts runs of letters, single
    digits and runs of marks, drops white space and merges inside these only.  So
    a text's ids are its words' ids in order, and each distinct word is encoded
    once.  Texts with a word of ``LONG`` bytes or more are encoded whole, as the
    hashes that name words are safe for shorter ones only.
    """
    data, offsets = text_buffer(column)
    n, cache, end = len(data), word_ids(path, kind), np.array([end_id], dtype=kind)
    classes = CLASS[data]
    plain = plain_rows(data, offsets, classes) & parts_words(path)
    trail = classes == TRAIL
    classes[trail | (classes == LEAD)] = LETTER
    first = classes != SPACE
    first[1:] &= (classes[1:] != classes[:-1]) | (classes[1:] == DIGIT)
    edges = offsets[1:-1]
    edges = edges[edges < n]
    first[edges] = classes[edges] != SPACE
    start = np.flatnonzero(first)
    # a word ends where the next begins or white space follows
    stops = np.flatnonzero((classes == SPACE) | first)
    stop = np.append(stops, n)[np.searchsorted(stops, start, side="right")] if len(start) else start
    plain[np.searchsorted(offsets, start[stop - start >= LONG], side="right") - 1] = False
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    low[trail & (data <= 0x9E)] += 32
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[low] * up[:n], out=sums[1:])
    h = mix((sums[stop] - sums[start]) * down[start])
    own = np.repeat(plain, np.diff(np.searchsorted(start, offsets)))
    start, stop, h = start[own], stop[own], h[own]
    names, at, which = np.unique(h, return_index=True, return_inverse=True)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    hashes = names.tolist()
    new = [i for i, x in enumerate(hashes) if x not in cache]
    raw = low.tobytes()
    cache.learn([hashes[i] for i in new], [raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), stop[at[new]].tolist())])
    pieces = [cache[x] for x in hashes]
    width = end.itemsize
    many = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // width
    flat, place = np.frombuffer(b"".join(pieces), dtype=kind), np.cumsum(many) - many
    count = many[which]
    upto = np.cumsum(count)
    ids = flat[np.repeat(place[which] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
    cuts = (np.concatenate([[0], upto])[np.searchsorted(start, offsets)] * width).tolist()
    tail, out = end.tobytes(), []
    odd = [column[i].as_py() or "" for i in np.flatnonzero(~plain).tolist()]
    whole = iter(tokenizer(path).encode_batch_fast(odd, add_special_tokens=False) if odd else [])
    for ok, a, b in zip(plain.tolist(), cuts, cuts[1:]):
        out.append((ids[a:b] if ok else np.array(next(whole).ids, dtype=kind).tobytes()) + tail)
    return out


def encode_texts(texts: list[str], path: str, kind: str, end_id: int) -> list[bytes]:
    return encode_block(pa.array(texts, pa.string()), path, kind, end_id)


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(tokenizer(path).get_vocab_size(), end_id) < 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, path: str, kind: str, end_id: int, key: str, text: str) -> bytes:
    """Dictionary from a bounded sample; empty if the sample is too small to train on."""
    chosen = lowest_hashes(docs.select(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_BYTES).alias("text"), F.xxhash64(key, text).alias("h")), "h", SAMPLE_DOCS)
    samples = [x[:SAMPLE_BYTES] for x in encode_texts([r["text"] for r in chosen.collect()], path, kind, end_id)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_dict_id=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


BLOCKS = "part int, block int, first_token long, tokens long, n_docs int, dictionary_hash string, id_bytes int, doc_ids array<long>, frame_ends array<long>, token_counts array<long>, frames binary"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Tokenize every row and write the file set."""
    import hashlib

    spark, kind = docs.sparkSession, id_kind(path, end_id)
    dictionary = train_dictionary(docs, path, kind, end_id, key, text)
    mark = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    width = np.dtype(kind).itemsize

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, part, first = _compressor(shared.value).compress, TaskContext.get().partitionId(), 0
        for block, batch in enumerate(slices(batches, "text", BLOCK_TEXT)):
            raw = encode_block(batch.column(1), path, kind, end_id)
            frames, counts = [squeeze(x) for x in raw], [len(x) // width for x in raw]
            row = {"part": part, "block": block, "first_token": first, "tokens": sum(counts), "n_docs": len(raw), "dictionary_hash": mark, "id_bytes": width, "doc_ids": batch.column(0).to_pylist(), "frame_ends": np.cumsum([len(f) for f in frames]).tolist(), "token_counts": counts, "frames": b"".join(frames)}
            first += row["tokens"]
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("tokens", pa.int64()), ("n_docs", pa.int32()), ("dictionary_hash", pa.string()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("frame_ends", pa.list_(pa.int64())), ("token_counts", pa.list_(pa.int64())), ("frames", pa.binary())])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(partitions, F.col("key").asc_nulls_first(), "tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie").select("key", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(mark, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    totals = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, id_bytes and raw ids (little-endian bytes) of every document."""
    stored = spark.read.schema("hash string, bytes binary").parquet(f"{folder}/dictionary").first()
    shared = spark.sparkContext.broadcast((stored["hash"], bytes(stored["bytes"])))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, dictionary = shared.value
        expand = _decompressor(dictionary).decompress
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary_hash"] != mark:
                    raise ValueError("a block was written with another dictionary")
                ends, counts = [0, *r["frame_ends"]], np.array(r["token_counts"], dtype=np.int64)
                raw = [expand(r["frames"][a:b]) for a, b in zip(ends, ends[1:])]
                starts = r["start"] + r["first_token"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array([r["id_bytes"]] * len(raw), pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "id_bytes", "ids"])

    parts = spark.read.schema("part int, tokens long, start long").parquet(f"{folder}/parts")  # a row for each partition written
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").join(F.broadcast(parts.select("part", "start")), "part")
    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, id_bytes int, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: one block row, one slice, one frame."""
    stored = spark.read.schema("hash string, bytes binary").parquet(f"{folder}/dictionary").first()
    expand = _decompressor(bytes(stored["bytes"])).decompress
    at = F.array_position("doc_ids", F.lit(doc_id)).cast("int")
    rows = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(at > 0).collect()
    out = []
    for r in rows:
        ends = [0, *r["frame_ends"]]
        out += [np.frombuffer(expand(bytes(r["frames"][ends[i] : ends[i + 1]])), dtype=f"<u{r['id_bytes']}").tolist() for i, k in enumerate(r["doc_ids"]) if k == doc_id]
    return out


def id_crc32(raw: bytes, id_bytes: int) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(raw if id_bytes == 4 else np.frombuffer(raw, dtype=f"<u{id_bytes}").astype("<u4").tobytes())


def with_crc(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read_token_files`` gives."""

    def crc(batches):
        for batch in batches:
            sums = [id_crc32(x, w) for x, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
