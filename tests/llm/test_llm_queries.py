"""The registered queries: their SQL where there is some, brute force or the library otherwise."""

import hashlib
import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest

from layerlens.llm import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(names, rows):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, db, name):
    got = queries.queries()[name](spark, sf)
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(names, got.collect()) == rows_of(names, [dict(zip(names, r)) for r in want.fetchall()])


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_sentencepiece(spark, sf, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.queries()["op2_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        whole = [*ids, 2]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(whole), sha(" ".join(map(str, whole))), sha(sp.decode(ids)))


def test_token_files(spark, sf, texts):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.queries()["op4_token_files"](spark, sf).collect()}
    start = 0
    for key in sorted(texts):
        ids = [*tok.encode(texts[key], add_special_tokens=False).ids, 2]
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(got) == len(texts)


def test_toxicity(spark):
    """Held-out accuracy on the largest tables: the smallest hold out two toxic rows."""
    sf = "/root/testdata/sf0.1"
    ids = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall()}
    got = {r["doc_id"]: r for r in queries.queries()["op3_toxicity"](spark, sf).collect()}
    assert set(got) == ids
    for key, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    marked = duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall()
    held = [(got[k]["score"], y) for k, y in marked if k in got and got[k]["held_out"]]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert toxic and clean and sum(a > b for a in toxic for b in clean) >= 0.9 * len(toxic) * len(clean)
    assert sum(s >= 0.3 for s in clean) <= 0.02 * len(clean)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fits(kind, s):
    digits = [int(c) for c in s if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return True


def test_private_data(spark, sf, texts):
    got = queries.queries()["op6_private_data"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = {k: [m.span() for m in p.finditer(texts[r["doc_id"]]) if fits(k, m.group())] for k, p in BASE.items()}
        assert tuple(r[f"n_{k}"] for k in BASE) == tuple(len(spans[k]) for k in BASE)
        base = [f"{k}:{a}:{b}" for k in BASE for a, b in spans[k]]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(","))


def test_near_duplicates(spark, sf, texts):
    from test_near_duplicates import brute

    want = brute(sorted(texts.items()), 2)
    got = queries.queries()["op10_setsketch"](spark, sf).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_passages(spark, sf, texts):
    from test_passages import verbatim

    rows = sorted(texts.items())
    got = {r["doc_id"]: r for r in queries.queries()["op1_passage_chains"](spark, sf).collect()}
    for (key, _), need in zip(rows, verbatim(rows, 50)):
        spans = [tuple(map(int, s.split(":"))) for s in got[key]["spans"].split(",")] if key in got else []
        assert sum(b - a for a, b in spans) == (got[key]["n_repeated"] if key in got else 0)
        assert len(need & {i for a, b in spans for i in range(a, b)}) >= 0.95 * len(need)
