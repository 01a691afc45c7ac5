import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from layerlens.llm import alignment
from layerlens.llm.bytechunks import byte_values

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled(libraries, text):
    """Ids and bytes of both tokenizations of the whole text, or none."""
    t, sp = libraries
    if not text:
        return [], []
    letters = byte_values()
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    same = all(b"".join(x for _, x in side) == whole for side in (a, b))
    return (a, b) if same else ([], [])


def brute(libraries, rows):
    """Groups by common ends of tokens, links by overlap of ranges."""
    done, total = [], Counter()
    for key, text in rows:
        sides = spelled(libraries, text)
        spans = []
        for side in sides:
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        a, b = spans
        ends = sorted({x[1] for x in a} & {x[1] for x in b})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(i) for s, e, i in a if start <= s and e <= end) + "|" + ",".join(str(i) for s, e, i in b if start <= s and e <= end))
            start = end
        links, j = [], 0
        for s, e, i in a:
            while j < len(b) and b[j][1] <= s:
                j += 1
            n = j
            while n < len(b) and b[n][0] < e:
                links.append((i, b[n][2]))
                n += 1
        total.update(links)
        done.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((-1 if k is None else k, a, b, g, len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), text) for k, a, b, g, links, text in done))


def result(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")))) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", " \n ", "\t", "a", "word", "Word's", "don't", "123", "4.5", "é", "日本", " ", " ", "<|endoftext|>", "</s>", "<0x41>", "!?", "\x00", "\x1c", "😀", "é", "▁", "_", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("block", [6 << 20, 300])
def test_equals_brute_force(spark, sf, odd, libraries, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "ROOM", 3)  # some pairs are hot
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    docs = docs.union(spark.createDataFrame([(200000 + i, t) for i, t in enumerate(made(7, 300))], "doc_id long, text string")).repartition(4)
    assert result(alignment.align(docs, A, B)) == brute(libraries, [(r[0], r[1]) for r in docs.collect()])


def test_nothing_and_other_columns(spark, empty, libraries):
    assert alignment.align(empty, A, B).collect() == []
    rows = [(1, "same text", 3, "x"), (1, "same text", 3, "x"), (None, None, 3, "x"), (2, "a▁b", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, data string")
    assert result(alignment.align(docs, A, B)) == brute(libraries, [r[:2] for r in rows])


def test_groups_are_components():
    i, j, a, b = (x.tolist() for x in alignment.groups_of(np.array([1, 2, 3, 1]), np.array([2, 1, 4])))
    assert list(zip(i, j)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)] and (a, b) == ([0, 0, 1, 1], [0, 0, 1])
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    up = list(range(400))
    for x, y in zip(u.tolist(), v.tolist()):
        old, new = max(up[x], up[y]), min(up[x], up[y])
        up = [new if r == old else r for r in up]
    assert alignment.components(u, v, 400).tolist() == up


def test_query(spark, sf, libraries):
    from layerlens.llm import queries

    got = queries.queries()["op11_token_alignment"](spark, sf)
    want = brute(libraries, [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in want]
    assert set(names) == set(got.columns)
