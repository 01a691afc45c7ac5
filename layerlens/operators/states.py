"""Distillation as a state that adds: all sums and top lists of motif rows from one scan, stored, and merged with those of later rows.

A state has a row for each sum (kind, key, n, mass, most) and for each place of a
top list (kind, key, structure_str, motif_count, signature).  Tasks make partial
states of what they read, batch by batch, so a row of the search is looked at once
and only states are shuffled.  Merging adds sums of the same key and keeps the best
of the lists; it does not matter how rows were parted, or in which order states
are merged, as long as the lists have the same lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signature import node_label
from . import distill

#: Keys of a motif row that sums are kept by; chains count a row for each pair of branches.
SUMS, CHAIN = ("signature", "waist", "cell", "type"), "chain"
#: Key and length of the top lists.
TOPS = {"signature": distill.TOP_SIGNATURE, "waist": distill.TOP_WAIST, "cell": distill.TOP_WAIST_SIGNATURE, "all": distill.TOP_GLOBAL}
SCHEMA = "kind string, key string, n long, mass long, most long, structure_str string, motif_count long, signature string"
#: Rows of a partial state at which it is pressed together.
ROOM = 200_000


def _pressed(sums: pd.DataFrame, tops: pd.DataFrame, lengths: dict[str, int]) -> tuple[pd.DataFrame, pd.DataFrame]:
    sums = sums.groupby(["kind", "key"], as_index=False, sort=False).agg({"n": "sum", "mass": "sum", "most": "max"})
    tops = tops.sort_values(["motif_count", "structure_str"], ascending=[False, True], kind="stable")
    return sums, tops[tops.groupby(["kind", "key"], sort=False).cumcount() < tops["kind"].map(lengths)]


def state(motifs: DataFrame, k_in: int = 2, k_out: int = 2, tops: dict[str, int] | None = None) -> DataFrame:
    """The state of motif rows; ``tops``: other lengths of the lists."""
    kinds = TOPS | (tops or {})
    lengths = {f"top_{k}": n for k, n in kinds.items()}
    waist = node_label(F.col("bottleneck_area"), F.col("bottleneck_level"))
    level = lambda side, k: F.array(*(F.col(f"fan_{side}_{n}_level") for n in range(k)))
    chains = F.flatten(F.transform(level("in", k_in), lambda a: F.transform(level("out", k_out), lambda b: F.concat_ws(">", a.cast("string"), F.col("bottleneck_level").cast("string"), b.cast("string")))))
    rows = motifs.select("structure_str", F.col("motif_count").cast("long").alias("motif_count"), "signature", waist.alias("waist"), F.concat_ws("|", waist, "signature").alias("cell"), F.concat_ws("|", "signature", "hourglass_type").alias("type"), F.lit("").alias("all"), chains.alias(CHAIN))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            nonlocal sums, best
            out = pd.concat(_pressed(pd.concat(sums), pd.concat(best), lengths))
            sums, best = [], []
            return pa.RecordBatch.from_pandas(out.reindex(columns=names), schema=arrow, preserve_index=False)

        sums, best, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            df = batch.to_pandas()
            count = df["motif_count"]
            by = [pd.DataFrame({"kind": k, "key": df[k], "n": 1, "mass": count, "most": count}) for k in SUMS]
            links = df[[CHAIN, "motif_count"]].explode(CHAIN)
            by.append(pd.DataFrame({"kind": CHAIN, "key": links[CHAIN], "n": 1, "mass": links["motif_count"], "most": links["motif_count"]}))
            lists = [pd.DataFrame({"kind": f"top_{k}", "key": df[k], "structure_str": df["structure_str"], "motif_count": count, "signature": df["signature"]}) for k in kinds]
            s, t = _pressed(pd.concat(by), pd.concat(lists), lengths)
            sums, best, held = [*sums, s], [*best, t], held + len(s) + len(t)
            if held > ROOM:
                yield close()
                held = 0
        if sums:
            yield close()

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    arrow = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])
    return merged(rows.mapInArrow(partial, SCHEMA), tops=kinds)


def merged(*states: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """The state of all rows that ``states`` have seen."""
    lengths = {f"top_{k}": n for k, n in (TOPS | (tops or {})).items()}
    rows = reduce(DataFrame.unionByName, states)
    sums = rows.where(~F.col("kind").startswith("top_")).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.max("most").alias("most"))
    # a list without a key would sort all partial lists in one task: take the best of its parts first
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv))[F.col("kind")]
    best = rows.where(F.col("kind").startswith("top_")).withColumn("_part", F.pmod(F.xxhash64("structure_str"), F.lit(parts)))
    for keys in (["kind", "key", "_part"], ["kind", "key"]):
        best = best.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("motif_count"), "structure_str"))).where(F.col("_rank") <= most).drop("_rank")
    return sums.unionByName(best.select("kind", "key", "structure_str", "motif_count", "signature"), allowMissingColumns=True)


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """The distilled tables of a state."""
    sums = lambda kind: found.where(F.col("kind") == kind)
    top = lambda kind: sums(f"top_{kind}").select("structure_str", "motif_count", "signature")
    levels = F.split("key", ">")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    own = F.col("kind") == "signature"
    return {
        "by_signature": sums("signature").select(F.col("key").alias("signature"), F.col("n").alias("n_pattern"), "mass"),
        "by_waist": sums("waist").select(F.col("key").alias("waist"), F.col("n").alias("n_pattern"), "mass", F.col("most").alias("mass_max")),
        "chains": sums(CHAIN).select(levels[0].cast("int").alias("level_fan_in"), levels[1].cast("int").alias("level_waist"), levels[2].cast("int").alias("level_fan_out"), "mass"),
        "top_per_signature": top("signature"), "top_per_waist": top("waist"), "top_per_waist_signature": top("cell"), "top_global": top("all"),
        "summary": found.agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n_pattern"), F.coalesce(F.sum(F.when(own, F.col("mass"))), F.lit(0)).alias("mass"), count("waist").alias("n_waist"), count("signature").alias("n_signatures"), count("cell").alias("n_cells")),
    }
