"""Texts as runs of chunks that a tokenizer encodes alone, so that each distinct chunk of a block is encoded once.

A cut lies before each blank that follows no blank and leads to a character other
than white space.  A byte-level pre-tokenizer ends its parts at such a blank: it
starts the next word, and no run of white space holds it.  SentencePiece models of
``pieces.check_model`` have no piece across the start of a run of markers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT, TIGHT = re.compile(r"(?<! ) (?=\S)"), re.compile(r" (?!\S)")
#: Chunks that the library encodes in one call; words in one text.
CALL, RUN = 20_000, 256
#: Chunks in a generation of those that a worker remembers, about 200 bytes each.
KEPT = 400_000
#: Chunks, and their characters, beyond which a worker numbers them anew.
NUMBERED, SPELT = 1 << 20, 32 << 20


def split_chunks(text: str) -> list[str]:
    """Names of the chunks: what follows the blank, or a blank and the whole first chunk if that starts without a cut."""
    if not text:
        return []
    parts = CUT.split(text) if TIGHT.search(text) else text.split(" ")
    if parts[0]:
        parts[0] = " " + parts[0]
        return parts
    return parts[1:]


def chunk_text(name: str) -> str:
    return name[1:] if name[:1] == " " else " " + name


@lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool = False):
    """The tokenizer of a file; ``plain``: strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


@lru_cache(maxsize=4)
def encodes_chunks(path: str) -> bool:
    """Whether chunks can be encoded alone: byte-level parts by the usual pattern, no normaliser, no template, added tokens that take no blanks with them."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    parts = rules.get("pre_tokenizer") or {}
    usual = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space", True)
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in rules.get("added_tokens", []))
    return usual and added and not rules.get("normalizer") and (rules.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"


@lru_cache(maxsize=2)
def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id; added tokens spell themselves."""
    t, values = tokenizer(path, True), byte_values()
    entries = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return [bytes(values[c] for c in x) if all(c in values for c in x) else x.encode() for x in entries]


@lru_cache(maxsize=2)
def _byte_lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in byte_level_tokens(path)], dtype=np.int64)


@lru_cache(maxsize=4)
def _known(path: str, plain: bool) -> list[dict[str, bytes]]:
    """Ids of chunks that this worker met lately: two generations, the younger one first."""
    return [{}, {}]


def chunk_ids(path: str, names: list[str], plain: bool = False, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all (distinct) chunks, one after another, and their number by chunk."""
    known = _known(path, plain)
    if len(known[0]) > kept:
        known[:] = {}, known[0]
    young, old = known
    values, new = list(map(young.get, names)), []
    for i in [i for i, v in enumerate(values) if v is None]:
        found = old.get(names[i])
        if found is None:
            new.append(i)
        else:
            values[i] = young[names[i]] = found
    if new:
        own = [names[i] for i in new]
        flat, counts = _encoded(path, own, plain)
        raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        found = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for i, v in zip(new, found):
            values[i] = v
        if len(own) <= kept and max(map(len, own)) <= 1 << 12:
            young.update(zip(own, found))
    counts = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    return np.frombuffer(b"".join(values), dtype="<i4").astype(np.int64), counts


def _encoded(path: str, names: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number by chunk from the library.

    Chunks that follow a blank and end without one are encoded many at a time, one behind the other, which is a text of just these chunks; its ids are parted by their bytes."""
    t = tokenizer(path, plain)
    odd = [i for i, n in enumerate(names) if n[0] == " " or n[-1] == " "]
    apart = set(odd)
    words = [i for i in range(len(names)) if i not in apart] if apart else range(len(names))
    ids, counts, order = [], np.zeros(len(names), dtype=np.int64), [*words, *odd]
    plain_names = [names[i] for i in words] if apart else names
    place = np.array(order[: len(words)], dtype=np.int64)
    sizes = pc.binary_length(pa.array(plain_names, pa.large_string())).to_numpy() + 1
    for a in range(0, len(words), CALL):
        runs = [" " + " ".join(plain_names[s : min(s + RUN, a + CALL)]) for s in range(a, min(a + CALL, len(words)), RUN)]
        found = list(chain.from_iterable(e.ids for e in t.encode_batch_fast(runs, add_special_tokens=False)))
        ids.append(np.array(found, dtype=np.int64))
        upto = np.searchsorted(np.cumsum(_byte_lengths(path)[ids[-1]]), np.cumsum(sizes[a : a + CALL]), side="left") + 1
        counts[place[a : a + CALL]] = np.diff(upto, prepend=0)
    for a in range(0, len(odd), CALL):
        own = odd[a : a + CALL]
        for i, e in zip(own, t.encode_batch_fast([chunk_text(names[i]) for i in own], add_special_tokens=False)):
            ids.append(np.array(e.ids, dtype=np.int64))
            counts[i] = len(e.ids)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    if odd:  # back to the order of the names
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names))
        flat = gather(flat, counts[order], place)
    return flat, counts


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], limit: int, split=split_chunks, prefix: str = "") -> Iterator[tuple[list, list[np.ndarray], list[str]]]:
    """Keys, chunk numbers by row and names by number, of runs of rows (key, text) with about ``limit`` characters, a single longer text aside; null texts are empty, and ``prefix`` stands before the others."""
    size, keys, numbers, seen = 0, [], [], _Numbered()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            chunks = split(prefix + text) if text else []
            keys.append(key)
            numbers.append(np.fromiter(map(seen.__getitem__, chunks), dtype=np.int64, count=len(chunks)))
            size += len(text)
            if size >= limit or len(keys) >= limit >> 6:
                yield keys, numbers, list(seen)
                size, keys, numbers, seen = 0, [], [], _Numbered()
    if keys:
        yield keys, numbers, list(seen)


class _Met(dict):
    """Numbers of the chunks that this worker has met, with their ids and counts; ``fresh`` ones are not encoded yet."""

    def __init__(self):
        self.flat, self.counts, self.fresh, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def encode(self, path: str, plain: bool) -> None:
        if self.fresh:
            flat, counts = _encoded(path, self.fresh, plain)
            self.size += sum(map(len, self.fresh))
            self.flat, self.counts, self.fresh = np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.counts, counts]), []


@lru_cache(maxsize=4)
def _met(path: str, plain: bool) -> list[_Met]:
    return [_Met()]


def encoded_blocks(batches: Iterator[pa.RecordBatch], path: str, limit: int, split=split_chunks, plain: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, counts of ids by row and all ids of runs of rows (key, text) with about ``limit`` characters, as ``blocks``; chunks keep their numbers, so each is looked up once where it occurs."""
    held = _met(path, plain)
    met, size, keys, numbers = held[0], 0, [], []

    def close() -> tuple[list, np.ndarray, np.ndarray]:
        met.encode(path, plain)
        every, ends = np.concatenate(numbers), np.cumsum([len(x) for x in numbers])
        upto = np.insert(np.cumsum(met.counts[every]), 0, 0)
        out = keys, np.diff(upto[ends], prepend=0), gather(met.flat, met.counts, every)
        if len(met) > NUMBERED or met.size > SPELT:
            held[0] = _Met()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            chunks = split(text) if text else []
            keys.append(key)
            numbers.append(np.fromiter(map(met.__getitem__, chunks), dtype=np.int64, count=len(chunks)))
            size += len(text)
            if size >= limit or len(keys) >= limit >> 6:
                yield close()
                met, size, keys, numbers = held[0], 0, [], []
    if keys:
        yield close()


def gather(values: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of ``counts`` each) that ``numbers`` names, one after another."""
    at = np.cumsum(counts) - counts
    n = counts[numbers]
    upto = np.cumsum(n)
    return values[np.repeat(at[numbers] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def sums(values: np.ndarray, numbers: list[np.ndarray]) -> np.ndarray:
    """Sum of ``values`` over each row's ``numbers``."""
    ends = np.cumsum([len(x) for x in numbers])
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[np.concatenate(numbers)])])
    return np.diff(upto[np.concatenate([[0], ends])])
