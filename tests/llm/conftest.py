import pytest

#: Texts that every text operator has to take.
ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\tc", "▁", "a▁b ▁▁c", "é" * 3, "e\u0301 caf\u0065\u0301", "İI ΑΣ σ", "\u2000x\u2003y\u00a0z",
             "<|endoftext|> x<|startoftext|>y", "don't we'll I'M", "12345 6.7", "日本語 テキスト", "😀 👩‍👩‍👧", "\x00 nul \x00", "A" * 5000, "the same text", "the same text", "word " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under ties, a null id, and extra columns whose names clash with the operators' own."""
    rows = [(i if i != 3 else None, t, "x", i % 3, i) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, key int, data int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
