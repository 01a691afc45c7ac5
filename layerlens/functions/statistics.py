"""Tail probabilities of a few tests, from sums that Spark has made; no table passes through here."""

from __future__ import annotations

from functools import lru_cache
from math import atan2, comb, cos, erfc, exp, lgamma, log, log1p, pi, sin, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hypergeometric_tail(shared: int, n: int, k1: int, k2: int) -> float:
    """Probability that two random subsets of k1 and k2 of n share ``shared`` or more."""
    return sum(comb(k1, x) * comb(n - k1, k2 - x) for x in range(shared, min(k1, k2) + 1)) / comb(n, k2) if n else 1.0


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * exp(-x + a * log(x) - lgamma(a)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return exp(-x + a * log(x) - lgamma(a)) * h


def chi_square(table: list[list[float]]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of a contingency table; empty rows and columns do not count."""
    rows = [r for r in table if sum(r)]
    columns = [c for c in zip(*rows) if sum(c)]
    total = sum(map(sum, columns))
    sums = [sum(r) for r in zip(*columns)]
    value = sum((x - sum(c) * s / total) ** 2 / (sum(c) * s / total) for c in columns for x, s in zip(c, sums))
    freedom = (len(columns) - 1) * (len(sums) - 1)
    return value, freedom, gamma_tail(freedom / 2, value / 2) if freedom else 1.0


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p of a 2 x 2 table.

    Tables as unlikely as the given one lie at both ends of the range.  Each end is summed outwards from its likeliest table until terms vanish, so the cost grows with the spread of the counts, not with the counts."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    log_p = lambda x: choose(r1, x) + choose(r2, c1 - x) - choose(r1 + r2, c1)
    up = lambda x: (r1 - x) * (c1 - x) / ((x + 1) * (r2 - c1 + x + 1))  # noqa: E731  ratio of x + 1 to x
    odds = a * d / (b * c) if b * c else float("inf")
    mode = min(high, max(low, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)))
    limit, total = log_p(a) + log1p(1e-7), 0.0
    for step, end in ((-1, low), (1, high)):
        near, far = mode, end  # the first table of this end that is unlikely enough lies between
        if log_p(end) > limit:
            continue
        while near != far:
            middle = (near + far) // 2 if step > 0 else (near + far + 1) // 2
            if log_p(middle) <= limit:
                far = middle
            else:
                near = middle + step
        if near == mode and step > 0 and log_p(mode) <= limit:
            near = mode + 1 if mode < high else None  # the mode is counted below
        x, term = near, exp(log_p(near)) if near is not None else 0.0
        while term > total * 1e-18 and term > 0:
            total += term
            if x == end:
                break
            term *= up(x) if step > 0 else 1 / up(x - 1)
            x += step
    return odds, min(1.0, total)


def normal_tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def student(t: float, freedom: int) -> float:
    """Two-sided p of Student's t with a whole number of degrees of freedom: the finite sum over powers of cos(atan(t / sqrt(freedom)))."""
    angle = atan2(abs(t), sqrt(freedom))
    square, first = cos(angle) ** 2, freedom % 2
    term, total = (cos(angle) if first else 1.0), 0.0
    for n in range(first, freedom - 1, 2):
        total += term
        term *= square * (n + 1) / (n + 2)
    inside = 2 / pi * (angle + sin(angle) * total) if first else sin(angle) * total
    return min(1.0, max(0.0, 1 - inside))


#: Most differences of which the law of the signed ranks is worked out exactly.
EXACT = 50


@lru_cache(maxsize=1)
def signed_rank_law() -> list[tuple[float, float, float]]:
    """n, w and the probability that the smaller sum of signed ranks of n differences without ties is w or less, doubled: 1 at most."""
    out, ways = [], [1]
    for n in range(1, EXACT + 1):  # a subset of the ranks 1..n with sum w: with n or without it
        ways = [(ways[w] if w < len(ways) else 0) + (ways[w - n] if 0 <= w - n < len(ways) else 0) for w in range(len(ways) + n)]
        upto = 0
        for w in range(n * (n + 1) // 4 + 1):
            upto += ways[w]
            out.append((float(n), float(w), min(1.0, 2 * upto / 2**n)))
    return out


def wilcoxon(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """keys, n, statistic, z, p of the signed ranks of a - b (zeros left out, ties share ranks; keys without a difference have no row).

    p is two-sided: by the exact law up to ``EXACT`` differences without ties, else by the normal law."""
    from ..operators.compare import mean_ranks

    rows = pairs.select(*keys, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = mean_ranks(rows, "size", "r", *keys)
    ties = rows.groupBy(*keys, "size").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*keys).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0)).alias("ties")).withColumn("_one", F.lit(1))
    up, down = (F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0)) for c in (F.col("d") > 0, F.col("d") < 0))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), up.alias("up"), down.alias("down")).withColumn("_one", F.lit(1)).join(ties, ["_one", *keys])
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("ties") / 2) / 24)
    statistic = F.least("up", "down")
    z = (statistic - F.col("n") * (F.col("n") + 1) / 4) / F.nullif(spread, F.lit(0.0))
    out = out.select(*keys, "n", statistic.alias("statistic"), z.alias("z"), "ties")
    law = F.broadcast(pairs.sparkSession.createDataFrame(signed_rank_law(), "n double, statistic double, _exact double"))
    normal = F.udf(lambda x: None if x is None else min(1.0, erfc(abs(x) / sqrt(2))), "double")  # a row for each test
    exact = (F.col("ties") == 0) & (F.col("n") <= EXACT) & F.col("_exact").isNotNull()
    return out.join(law, ["n", "statistic"], "left").select(*keys, "n", "statistic", "z", F.when(exact, F.col("_exact")).otherwise(normal("z")).alias("p"))
