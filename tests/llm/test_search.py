import numpy as np
import pyarrow as pa
import pytest

from layerlens.llm import anisotropic


def brute(rows, k=5):
    """Neighbours of every row whose id is divisible by 50."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            found = [(-float(anisotropic.dots(x[None], q[None])[0] / (anisotropic.lengths(q[None])[0] * anisotropic.lengths(x[None])[0])), j) for j, x in ok if j != i]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(spark, df, k=5):
    out = anisotropic.search(*anisotropic.build_index(df), df.where("vec_id % 50 = 0"), k=k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("block", [8192, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(anisotropic, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.1 if i % 2 else 2, size=8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(40)] + [(800 + i, [2.0 * x for x in rows[50][1]]) for i in range(3)]  # ties
    rows += [(900, None), (950, [0.0] * 8), (901, [float("nan")] + [1.0] * 7), (902, [None] + [1.0] * 7), (903, [1.0] * 5), (None, [1.0] * 8), (904, []), (1000, [-1.0] * 8), (905, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert found(spark, df) == brute(rows)
    assert {r[2] for r in found(spark, df, 3) if r[0] == 50} == {700, 701, 702}


def test_large_and_small_components(spark):
    rows = [(0, [1e200] * 8), (1, [1e-200] * 8), (2, [1e300, *[0.0] * 7]), (3, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r[2], round(r[3], 6)) for r in found(spark, df)] == [(1, 1.0), (2, 0.353553), (3, -1.0)]


def test_nothing_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert found(spark, none) == []
    assert found(spark, spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")) == []


def test_anisotropic_loss_lowers_parallel_error():
    rng = np.random.default_rng(2)
    x = anisotropic.unit(rng.normal(size=(3000, 32)))
    parallel = []
    for threshold in (0.0, 0.3):
        book = anisotropic.fit_codebook(x, threshold)
        codes = book.encode(x)
        residual = x - book.decode(codes, 32)
        parallel.append(np.abs((residual * x).sum(axis=1)).mean())
        table, step, low, error = book.tables(x[0])
        sums = sum(t[c].astype(int) for t, c in zip(table, book.pack(codes).T)) * step + low
        true = book.decode(codes, 32) @ x[0]
        assert ((sums <= true + 1e-9) & (true <= sums + error + 1e-9)).all()
    assert parallel[1] < 0.7 * parallel[0]


def test_list_slices():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32())).slice(1, 2)
    assert anisotropic.matrix(column, 2).tolist() == [[3.0, 4.0], [5.0, 6.0]]
