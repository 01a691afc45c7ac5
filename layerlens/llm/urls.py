"""URL filter: longest-match host and path rules, then a Bloom filter cascade of listed keys.

The cascade alternates Bloom filters: level 1 holds the listed keys, level 2 the
unlisted keys of the corpus that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until nothing is let through.  Built over
every key that the corpus has, it answers membership exactly, in a few bytes a
listed key, without a join on the rows.

Keys are dealt by hash to shards of about ``SHARD_KEYS`` keys, each with a cascade
of its own that one task builds.  Shards are broadcast together while they fit
``BROADCAST_BYTES``; more shards take one pass over the rows for each such group.

Nulls and urls without ``://`` have an empty host and path, fit no rule and are
judged by the cascade like any other key.  Rows may repeat, each is judged; a url
may be of any length.  An empty table gives an empty result.  Columns of ``pages``
with the names of the result (host, path, rule, verdict, listed) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .storage import materialise

#: Keys in a shard, on average; bytes of cascades that are broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 1 << 20, 64 << 20
_U = np.uint64


@dataclass
class Cascade:
    """Levels of (bits, number of hashes, packed bits); odd levels hold listed keys."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        m, k, bits = self.levels[level]
        ok = np.ones(len(h1), dtype=bool)
        for pos in positions(h1, h2, level, m, k):
            ok &= (bits[pos >> _U(6)] >> (pos & _U(63))) & _U(1) == 1
        return ok

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h1), dtype=bool)
        for level in range(len(self.levels)):
            ok = self.passes(level, h1, h2)
            out[open_ & ~ok] = level % 2 == 1
            open_ &= ok
        return out


def positions(h1: np.ndarray, h2: np.ndarray, level: int, m: int, k: int) -> Iterator[np.ndarray]:
    """k bit positions of each key; each level hashes anew."""
    x = (h1 ^ _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    step = (h2 + _U(2 * level + 1)) * _U(0xBF58476D1CE4E5B9) | _U(1)
    for i in range(k):
        yield (x + _U(i) * step) % _U(m)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, first_rate: float = 0.02, rate: float = 0.1) -> Cascade:
    """Cascade over distinct keys given by two hashes."""
    out = Cascade()
    for level in range(64):
        want = level % 2 == 0
        own = listed == want
        if not own.any():
            return out
        p = first_rate if level == 0 else rate
        m, k = max(64, ceil(-own.sum() * log(p) / log(2) ** 2)), max(1, round(-log(p) / log(2)))
        bits = np.zeros(m // 64 + 1, dtype=np.uint64)
        pos = np.concatenate([*positions(h1[own], h2[own], level, m, k)])
        np.bitwise_or.at(bits, (pos >> _U(6)).astype(np.int64), _U(1) << (pos & _U(63)))
        out.levels.append((m, k, bits))
        left = own | out.passes(level, h1, h2)  # unwanted keys that got through, and the wanted ones they have to be told from
        if not (left & ~own).any():
            return out
        h1, h2, listed = h1[left], h2[left], listed[left]
    raise ValueError("the cascade did not end: two keys share both hashes")


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """shard, n_bytes and levels (m, k, bits) of the cascade of each shard of distinct ``h1, h2, listed`` rows."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        found = build_cascade(h1, h2, table.column("listed").to_numpy())
        levels = [{"m": m, "k": k, "bits": bits.tobytes()} for m, k, bits in found.levels]
        kind = pa.list_(pa.struct([("m", pa.int64()), ("k", pa.int32()), ("bits", pa.binary())]))
        return pa.table({"shard": table.column("shard").slice(0, 1), "n_bytes": pa.array([sum(len(x["bits"]) for x in levels)], pa.int64()), "levels": pa.array([levels], kind)})

    dealt = keys.withColumn("shard", _shard(F.col("h1"), shards))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, n_bytes long, levels array<struct<m:long,k:int,bits:binary>>")


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards)).cast("int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule; ties go to the longer host, then by text. ``rules``: (verdict, rule)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/", 1)[0]), r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url", key: Column | None = None) -> DataFrame:
    """Add host, path, rule, verdict and listed to ``pages``.

    ``listed``: one column ``key`` of blocked keys (nulls and repeats are
    ignored).  ``key``: the key of a row, by its host and path; the host if not
    given.  A url that no rule fits is blocked if its key is listed.
    """
    host, path = url_parts(F.col(url))
    rows = pages.drop("host", "path", "rule", "verdict", "listed").withColumns({"host": host, "path": path})
    key = F.col("host") if key is None else key
    two = lambda c: {"_h1": F.xxhash64(c), "_h2": F.xxhash64(F.lit(7), c, F.lit("second"))}
    hashed = lambda df, c, mark: df.select(*(v.alias(n[1:]) for n, v in two(c).items()), F.lit(mark).alias("listed"))
    universe = hashed(rows, key, False).union(hashed(listed.where(F.col("key").isNotNull()), F.col("key"), True))
    keys = materialise(universe.groupBy("h1", "h2").agg(F.max("listed").alias("listed")), "url-keys")
    shards = max(1, ceil(keys.count() / SHARD_KEYS))
    built = materialise(build_shards(keys, shards), "url-cascades")
    rows = rows.withColumns({**two(key), "listed": F.lit(False)}).withColumn("_shard", _shard(F.col("_h1"), shards))
    group, size = [], 0
    for shard, n_bytes in sorted((r["shard"], r["n_bytes"]) for r in built.select("shard", "n_bytes").collect()):
        if group and size + n_bytes > BROADCAST_BYTES:
            rows = materialise(_judged(rows, built, group), "url-pass")
            group, size = [], 0
        group, size = [*group, shard], size + n_bytes
    rows = _judged(rows, built, group) if group else rows
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.drop("_h1", "_h2", "_shard").withColumns({"rule": rule, "verdict": F.coalesce(said, method)})


def _judged(rows: DataFrame, built: DataFrame, group: list[int]) -> DataFrame:
    """``rows`` with ``listed`` of those in a group of shards, whose cascades are broadcast."""
    found = built.where(F.col("shard").isin(group)).toArrow().to_pylist()
    cascades = {r["shard"]: Cascade([(x["m"], x["k"], np.frombuffer(x["bits"], dtype=np.uint64)) for x in r["levels"]]) for r in found}
    shared = rows.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf(BooleanType())
    def member(h1: pd.Series, h2: pd.Series, shard: pd.Series, before: pd.Series) -> pd.Series:
        h1, h2, shard, out = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), shard.to_numpy(), before.to_numpy().copy()
        for name, cascade in shared.value.items():
            at = np.flatnonzero(shard == name)
            out[at] = cascade.contains(h1[at], h2[at])
        return pd.Series(out)

    return rows.withColumn("listed", member("_h1", "_h2", "_shard", "listed"))
