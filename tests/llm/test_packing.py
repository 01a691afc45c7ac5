import random
import struct
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from layerlens.llm import bytechunks, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def power_of_two(n):
    return n & (n - 1) == 0


def checked(pieces, want, size):
    """Every id of ``want`` (name: ids) in one piece, sequences without gaps or padding; counts of pieces and of sequences."""
    docs = sorted((k, list(g)) for k, g in groupby(sorted(pieces, key=lambda r: (r[0], r[1])), key=lambda r: r[0]))
    assert [k for k, _ in docs] == sorted(want)
    for k, own in docs:
        at = 0
        for _, start, length, total, _, _, ids in own:
            assert start == at and length > 0 and total == len(want[k]) and list(struct.unpack(f"<{length}I", ids)) == want[k][at : at + length]
            at += length
        assert at == len(want[k])
    sequences = [list(g) for _, g in groupby(sorted(pieces, key=lambda r: (r[4], r[5])), key=lambda r: r[4])]
    for own in sequences:
        at = 0
        for r in own:
            assert r[5] == at
            at += r[2]
        assert at <= size and power_of_two(at)
    assert [own[0][4] for own in sequences] == list(range(len(sequences)))
    assert sum(sum(r[2] for r in own) < size for own in sequences) <= size.bit_length()
    return len(pieces), len(sequences)


def test_documents(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 100000", "text")).repartition(5)
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    out = packing.pack(docs, PATH)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces, sequences = checked([tuple(r) for r in out.collect()], want, 1024)
    assert sequences <= sum(map(len, want.values())) / 1024 + 10
    # few documents are cut where they need not be: pieces beyond full sequences and one remainder each
    assert pieces - sum(-(-len(x) // 1024) for x in want.values()) <= 0.15 * len(want)


@pytest.mark.parametrize("size, texts", [(8, ["a b c"] * 7 + ["a"] * 3 + [None, ""] + ["x " * 30]), (16, ["b c"] * 5), (64, [None] * 100), (16, ["a b c d e f g h i"] * 40)])
def test_small_sequences(spark, size, texts):
    """Also texts of which no exact sums can be made: all alike, each over half a sequence."""
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, ids string").repartition(3)
    tok = tokenizers.Tokenizer.from_file(PATH)
    checked([tuple(r) for r in packing.pack(docs, PATH, size=size).collect()], {i: [*tok.encode(t or "").ids, 0] for i, t in enumerate(texts)}, size)


def test_nulls_repeats_and_nothing(spark, empty):
    assert packing.pack(empty, PATH).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, "d e f")], "doc_id long, text string")
    out = packing.pack(docs, PATH, size=4).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == [(-1, 3), (1, 2), (1, 2), (1, 4)]
    assert sum(r["length"] for r in out) == 11


def test_other_tokenizers_encode_whole_texts(spark):
    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["Hello world's END", "a  b\tc", "İI"]
    tok = tokenizers.Tokenizer.from_file(path)
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, end_id=2)
    checked([tuple(r) for r in out.collect()], {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}, 1024)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    """Ranges of ranks cover each length once, and the program comes near the bound."""
    rng, size = random.Random(seed), 64
    histogram = {n: rng.choice([0, 1, 3, 40, 700]) for n in rng.sample(range(1, size), 30)}
    histogram = {n: k for n, k in histogram.items() if k}
    plan = packing.plan_packing(histogram, size)
    ends = {}
    for n, k in histogram.items():
        for (piece,) in ([p] for ps in plan.places(np.full(k, n), np.arange(k)) for p in ps):
            assert (piece[1], piece[2]) not in ends
            ends[piece[1], piece[2]] = piece[2] + piece[0]
    by = {}
    for (s, a), b in ends.items():
        by.setdefault(s, []).append((a, b))
    assert sorted(by) == list(range(plan.sequences))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:])) and power_of_two(own[-1][1])
    bound = sum(n * k for n, k in histogram.items()) / size
    lengths = np.array(sorted(histogram))
    filled = sum(x for _, x in packing.fill_by_program(lengths, np.array([histogram[int(n)] for n in lengths]), size))
    assert plan.packed <= filled + 1e-6 <= bound + 1e-3 and plan.packed >= filled - 3


def test_program_beats_exact_sums():
    """Longest first takes 10 + 6 and leaves the rest; the program finds all full sequences."""
    lengths, demand = np.array([3, 5, 6, 10]), np.array([20, 10, 10, 10])
    greedy = sum(n for _, n, _ in packing.fill_by_sums(lengths, demand, 16))
    assert sum(x for _, x in packing.fill_by_program(lengths, demand, 16)) >= greedy


def test_crc(spark, sf):
    from layerlens.llm import queries

    out = queries.queries()["op12_packing"](spark, sf)
    row = out.where("length > 5").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    ids = [*tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0][row["start"] : row["start"] + row["length"]]
    assert row["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert dict(out.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint", "ids_crc32": "bigint"}


@pytest.mark.parametrize("numbered", [1 << 20, 40])
def test_chunks_keep_their_numbers_over_blocks(monkeypatch, numbered):
    """Ids are the library's over many blocks, and a chunk that has a number is neither looked up by name nor encoded again."""
    bytechunks._met.cache_clear()
    monkeypatch.setattr(bytechunks, "NUMBERED", numbered)
    asked, encode = [], bytechunks._encoded
    monkeypatch.setattr(bytechunks, "_encoded", lambda path, names, plain: asked.extend(names) or encode(path, names, plain))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["", "don't", "é", "日本", "<|endoftext|>", "x" * 300, *(f"w{i}" for i in range(60))]) for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "  a\n b "]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    tok, at = tokenizers.Tokenizer.from_file(PATH), 0
    for keys, counts, flat in bytechunks.encoded_blocks(iter([batch, batch]), PATH, 500):
        want = [tok.encode(texts[k] or "", add_special_tokens=False).ids for k in keys]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
        at += len(keys)
    assert at == 2 * len(texts)
    assert (len(asked) == len(set(asked))) == (numbered > 40)
    bytechunks._met.cache_clear()
