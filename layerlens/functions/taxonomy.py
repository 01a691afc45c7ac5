"""Places and the super-regions they lie in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Place codes by super-region, and names of super-regions.
PLACES = {
    "OL": ["ME", "AME", "LO", "LOP", "LA"],
    "OCG": ["OCG"],
    "CX": ["FB", "EB", "PB", "NO"],
    "MB": ["MB_CA", "MB_ML", "MB_VL", "MB_PED"],
    "LX": ["BU", "LAL", "GA"],
    "SNP": ["SLP", "SIP", "SMP"],
    "INP": ["CRE", "SCL", "ICL", "IB", "ATL"],
    "AL": ["AL"],
    "LH": ["LH"],
    "VLNP": ["AOTU", "AVLP", "PVLP", "PLP", "WED"],
    "VMNP": ["VES", "EPA", "GOR", "SPS", "IPS"],
    "PENP": ["SAD", "FLA", "CAN", "PRW", "AMMC"],
    "GNG": ["GNG"],
    "UNK": ["UNASGD"],
}
NAMES = {
    "OL": "Optic Lobe", "OCG": "Ocellar Ganglion", "CX": "Central Complex", "MB": "Mushroom Body", "LX": "Lateral Complex", "SNP": "Superior Neuropils", "INP": "Inferior Neuropils",
    "AL": "Antennal Lobe", "LH": "Lateral Horn", "VLNP": "Ventrolateral Neuropils", "VMNP": "Ventromedial Neuropils", "PENP": "Periesophageal Neuropils", "GNG": "Gnathal Ganglia", "UNK": "Unassigned",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def tokens(group: Column) -> Column:
    """Places of a group; empty parts do not count."""
    return F.filter(F.split(group, r"\."), lambda t: t != "")


def super_region(group: Column) -> Column:
    """Sorted distinct super-regions of a group, dot-joined; unknown places and empty groups are UNK."""
    regions = _map({code: region for region, codes in PLACES.items() for code in codes})
    found = F.array_sort(F.array_distinct(F.transform(tokens(group), lambda t: F.coalesce(F.try_element_at(regions, t), F.lit("UNK")))))
    return F.when(F.size(found) > 0, F.concat_ws(".", found)).otherwise("UNK")


def super_region_label(code: Column) -> Column:
    names = _map(NAMES)
    return F.concat_ws(" + ", F.transform(F.split(code, r"\."), lambda c: F.coalesce(F.try_element_at(names, c), c)))


def macro_area(group: Column) -> Column:
    """First three letters or digits of a group's first part, upper case; UNK if there are none."""
    first = F.get(F.filter(F.split(group, r"[._]"), lambda t: t != ""), F.lit(0))
    short = F.regexp_replace(F.upper(F.substring(first, 1, 3)), r"[^\p{L}\p{N}]", "")
    return F.when(F.coalesce(F.length(short), F.lit(0)) > 0, short).otherwise("UNK")


def place_counts(neurons: DataFrame) -> DataFrame:
    """place, n: neurons by place; a group of several places counts in equal parts."""
    known = neurons.where(F.col("grp").isNotNull() & (F.col("grp") != "NO_CONS")).groupBy("grp").agg(F.count(F.lit(1)).alias("c"))
    parts = known.withColumn("t", tokens(F.col("grp")))
    return parts.select(F.explode("t").alias("place"), (F.col("c") / F.size("t")).alias("w")).groupBy("place").agg(F.sum("w").alias("n"))


def place_table(neurons: DataFrame) -> DataFrame:
    """place, region, name, n: all known places with the neurons there."""
    return _known(neurons.sparkSession).join(place_counts(neurons), "place", "left").select("place", "region", "name", F.coalesce("n", F.lit(0.0)).alias("n"))


def _known(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(p, r, NAMES[r]) for r, places in PLACES.items() for p in places], "place string, region string, name string"))


def place_check(neurons: DataFrame, connections: DataFrame) -> DataFrame:
    """source, place, side: places that only the data or only the table has, by the connections' places (without their side of the brain) and the neurons' groups."""
    known = _known(neurons.sparkSession).select("place")
    used = {
        "connections": connections.select(F.regexp_replace("neuropil", "_(L|R)$", "").alias("place")).where("place IS NOT NULL").distinct(),
        "neurons": place_counts(neurons).select("place"),
    }
    rows = [x.select(F.lit(source).alias("source"), "place", F.lit(side).alias("side")) for source, own in used.items() for x, side in ((own.join(known, "place", "left_anti"), "data"), (known.join(own, "place", "left_anti"), "table"))]
    return reduce(DataFrame.unionByName, rows)


def places_known(checked: DataFrame) -> DataFrame:
    """source, known: whether every place of the data is in the table, from ``place_check``."""
    return checked.groupBy("source").agg((F.count_if(F.col("side") == "data") == 0).alias("known"))
