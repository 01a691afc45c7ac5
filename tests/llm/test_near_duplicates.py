import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.llm import setsketch
from layerlens.llm.components import connected_components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    """n_shingles and component_id of each (id, text), by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted((-1 if k is None else k, len(sets[i]), least.get(root(i), -1)) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, sf, odd, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    assert result(setsketch.near_duplicates(docs, size=size)) == brute(rows, size)


def test_large_group_of_near_copies(spark):
    """Copies that differ in several places, a chain of drifting texts, and lookalikes under the threshold."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(250):
        t = list(base)
        for _ in range(rng.randrange(0, 12)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    drift = [word() for _ in range(100)]
    for i in range(60):
        drift[i % 100] = word()
        texts.append(" ".join(drift))
    texts += [" ".join([*base[:70], *(word() for _ in range(50))]) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    assert result(setsketch.near_duplicates(df, size=2)) == brute(rows, 2)


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    test_large_group_of_near_copies(spark)


def test_nothing(spark, empty):
    assert setsketch.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert result(setsketch.near_duplicates(blank)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    rows = np.repeat([0, 1, 2], [1000, 1000, 1500])
    hashes = np.concatenate([np.sort(pool[:1000]), np.sort(pool[500:]), np.sort(pool)])
    s = setsketch.sketches(rows, hashes, 3, 4000)
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    j = setsketch.likeliest(np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()]), np.array([1000.0]), np.array([1000.0]), 4000)
    assert abs(j[0] - 1 / 3) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
