import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from layerlens.llm import pieces, token_files
from layerlens.llm.storage import scratch_path

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def both(spark, sf, odd):
    return odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text"))


def test_pieces_equal_the_library(spark, sf, odd):
    docs = both(spark, sf, odd)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(str((r[0], [*sp.encode(r[1] or ""), 2], sp.decode(sp.encode(r[1] or "")))) for r in docs.collect())
    out = pieces.encode(docs, PIECES, end_id=2)
    assert sorted(str((r[0], r[1], r[2])) for r in out.collect()) == want
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert sorted(str((r[0], sp.decode(sp.encode(r[1] or "")))) for r in docs.collect()) == sorted(str((r[0], r[1])) for r in back.collect())


def test_pieces_of_nothing(empty):
    assert pieces.encode(empty, PIECES, end_id=2).count() == 0


def test_pieces_clashing_columns(odd):
    assert pieces.encode(odd, PIECES, end_id=2).columns == ["doc_id", "ids", "decoded"]


def test_split_chunks_keeps_every_space():
    for text in ("", " ", "a", " a", "a ", "a  b", "   ", "a b c", "▁a"):
        assert "".join("▁" + c.replace(" ", "▁") for c in pieces.split_chunks(text)) == ("▁" + text.replace(" ", "▁") if text else "")


def test_token_files_equal_the_library(spark, sf, odd):
    docs, folder = both(spark, sf, odd), scratch_path(spark, "test-tokens")
    t = Tokenizer.from_file(WORDS)
    token_files.write_token_files(docs, folder, WORDS, end_id=2)
    got = token_files.with_crc(token_files.read_token_files(spark, folder)).orderBy("start").collect()
    ids = sorted(([r[0] if r[0] is not None else -1, [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]] for r in docs.collect()))
    want = sorted((k, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k, x in ids)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    keys = [r["doc_id"] if r["doc_id"] is not None else -1 for r in got]
    assert keys == sorted(keys)
    assert token_files.read_document(spark, folder, 1007) == [x for k, x in ids if k == 1007]


def test_token_files_of_nothing(spark, empty):
    folder = scratch_path(spark, "test-empty")
    token_files.write_token_files(empty, folder, WORDS, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_wrong_dictionary_is_an_error(spark, odd):
    folder, other = scratch_path(spark, "test-a"), scratch_path(spark, "test-b")
    token_files.write_token_files(odd, folder, WORDS, end_id=2)
    spark.createDataFrame([("x", bytearray(b""))], "hash string, bytes binary").write.parquet(f"{other}/dictionary")
    for t in ("blocks", "parts"):
        spark.read.parquet(f"{folder}/{t}").write.parquet(f"{other}/{t}")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(spark, other).collect()


def test_words_are_parted_as_the_tokenizer_does():
    rng, t = __import__("random").Random(4), Tokenizer.from_file(WORDS)
    parts = ["a", "Bc", "é", "ÀÉ", "ß", "ÿ", "×", "÷", "1", "23", ".", ",", "...", "'", "'s", "don't", "<|", "|>", "<|endoftext|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x00", "\xa0", "\x85", "-", "$%", "œ", "İ", "é", "’", "日", "º", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(6000)]
    got = token_files.encode_texts(texts, WORDS, "<u2", 2)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, dtype="<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)


def thue_morse(n, a="a", b="b"):
    """A word of 2**n letters and its complement: polynomial sums modulo 2**64 are equal."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_made_up_words_and_other_tokenizers(spark):
    from layerlens.llm.bytewords import SPACED, Words
    from layerlens.llm.passages import row_hashes

    words = [w for n in (7, 8, 10, 12) for w in thue_morse(n)]
    tok = Tokenizer.from_file(WORDS)
    assert token_files.encode_texts(words, WORDS, "<u2", 2) == [np.array([*tok.encode(w, add_special_tokens=False).ids, 2], dtype="<u2").tobytes() for w in words]
    for size in (12, 14):
        assert len(set(Words(pa.array(thue_morse(size)), SPACED).hash.tolist())) == 2
    texts = [" ".join(w) for w in thue_morse(11)]
    assert len(set(map(tuple, row_hashes(Words(pa.array(texts), SPACED)).tolist()))) == 2
    assert token_files.parts_words(WORDS) and not token_files.parts_words(public_tokenizers.path("byte_bpe_50k.json"))
    other, rows = public_tokenizers.path("byte_bpe_50k.json"), [(0, "Hello World's  A 12"), (1, None), (2, "a\nB")]
    folder = scratch_path(spark, "other-tokenizer")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, other, end_id=0)
    got = {r["doc_id"]: np.frombuffer(r["ids"], f"<u{r['id_bytes']}").tolist() for r in token_files.read_token_files(spark, folder).collect()}
    assert got == {k: [*Tokenizer.from_file(other).encode(t or "").ids, 0] for k, t in rows}


def test_ids_without_texts_a_payload_at_a_time(spark, odd, monkeypatch):
    """Documents of one block in several payloads; without decoded texts the ids are the same."""
    monkeypatch.setattr(pieces, "PAYLOAD_BYTES", 60)
    monkeypatch.setattr(pieces, "DECODED", 2)
    docs = odd.select("doc_id", "text").unionByName(spark.range(1000, 1040).selectExpr("id AS doc_id", "concat('some  words ', id, ' again') AS text"))
    full = {r["doc_id"]: r for r in pieces.encode(docs, PIECES, end_id=2).collect()}
    bare = pieces.encode(docs, PIECES, end_id=2, decoded=False)
    assert bare.columns == ["doc_id", "ids"] and {r["doc_id"]: r["ids"] for r in bare.collect()} == {k: r["ids"] for k, r in full.items()}
    sp = pieces.processor(PIECES)
    for r in docs.collect():
        ids = sp.encode(r["text"] or "")
        assert (full[r["doc_id"]]["ids"], full[r["doc_id"]]["decoded"]) == ([*ids, 2], sp.decode(ids))
