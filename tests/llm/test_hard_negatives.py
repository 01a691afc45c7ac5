import numpy as np
import pytest

from layerlens.llm import hard_negatives


def brute(rows, dims, scale=256):
    """Positives and negatives of every row whose id is divisible by 50."""
    ok = []
    for i, label, v in rows:
        if i is None or label is None or v is None or len(v) != dims or any(x is None or not np.isfinite(x) for x in v):
            continue
        e = [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]
        if sum(x * x for x in e) <= 2**53:
            ok.append((i, label, tuple(e)))
    out, seen = [], set()
    for i, label, a in ok:
        if i % 50 or (i, label, a) in seen:
            continue
        seen.add((i, label, a))
        scored = sorted((-sum(x * y for x, y in zip(a, e)), j, k) for j, k, e in ok if j != i)
        for p, j in [(-s, j) for s, j, k in scored if k == label][:5]:
            fits = [(-s, n) for s, n, k in scored if k != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def found(df, **kw):
    file, cells = hard_negatives.approximate(df)
    out = hard_negatives.hard_negatives(file, cells, file.where("vec_id % 50 = 0"), **kw)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


@pytest.mark.parametrize("block, cells, sample", [(16 << 20, 64, 20_000), (200, 4, 30)])
def test_equals_brute_force(spark, monkeypatch, block, cells, sample):
    """Also with few cells, a small sample and many blocks: answers do not depend on them."""
    for name, value in (("BLOCK_BYTES", block), ("CELLS", cells), ("SAMPLE", sample), ("ROWS", 97)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 8))
    rows = [(i, int(rng.integers(3)), (centre[i % 5] + rng.normal(scale=0.7, size=8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 3, rows[50][2]) for i in range(40)] + [rows[100], rows[100], (100, 2, [1.0] * 8), rows[7], rows[7]]  # ties, repeats, one id twice
    rows += [(2000, None, [1.0] * 8), (2050, 1, None), (2100, 1, [float("nan")] + [1.0] * 7), (2150, 1, [None] + [1.0] * 7), (None, 1, [1.0] * 8), (2200, 1, [1.0] * 5), (2250, 1, []), (2300, 1, [float("inf")] * 8)]
    rows += [(2350, 1, [1e30] * 8), (2400, 1, [0.0] * 8), (2450, 9, [1.0] * 8), (2500, 2, [-3.0] * 8), (2501, 2, [2e5] * 8)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, label int, embedding array<float>, number int, cells string").repartition(5)
    want = brute(rows, 8)
    assert len(want) > 150 and found(df) == want


def test_nothing_and_few(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(0, 1, [1.0, 2.0])], schema)) == []
    assert found(spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 0, [1.0, 1.0])], schema)) == [(0, 1, 1, 2, 327680, 196608)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(scale=50, size=(2000, 6)))
    marks = [np.unique(np.quantile(x[:200, d], np.arange(1, 8) / 8, method="lower")) for d in range(6)]
    cells = hard_negatives.Cells(marks, x.min(axis=0), x.max(axis=0))
    low, high = cells.ends()
    codes = np.ascontiguousarray(cells.encode(x).T).astype(np.intp)
    for q in x[:20]:
        b = hard_negatives._Bounds(q, low, high)
        assert (b.lower(codes) <= x @ q).all() and (x @ q <= b.upper(codes)).all()
