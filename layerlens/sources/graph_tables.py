"""The four tables of a layered graph, and where they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Explicit schemas: ids may exceed 2**53, so none is ever inferred.
SCHEMAS = {
    "connections": StructType([StructField("pre_root_id", LongType()), StructField("post_root_id", LongType()), StructField("neuropil", StringType()), StructField("syn_count", IntegerType())]),
    "neurons": StructType([StructField("root_id", LongType()), StructField("group", StringType()), StructField("nt_type", StringType()), StructField("nt_type_score", DoubleType())]),
    "classification": StructType([StructField("root_id", LongType()), StructField("super_class", StringType())]),
    "levels": StructType([StructField("root_id", LongType()), StructField("score", DoubleType()), StructField("y_level", IntegerType())]),
}
#: Texts that a CSV source uses for a missing value.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A", "#NA", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]


@dataclass(frozen=True)
class Graph:
    """neurons (root_id, grp, nt_type, nt_type_score), classification (root_id, super_class), levels (root_id, score, y_level), connections (pre_root_id, post_root_id, neuropil, syn_count)."""

    neurons: DataFrame
    classification: DataFrame
    levels: DataFrame
    connections: DataFrame


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table from CSV (gzip too): columns by header name, missing-value texts as null."""
    schema = SCHEMAS[table]
    text = StructType([StructField(f.name, StringType()) for f in schema])
    header = spark.read.option("header", True).csv(path).columns
    full = StructType([StructField(c, StringType()) for c in header])
    rows = spark.read.schema(full).option("header", True).csv(path).select([f.name for f in text])
    value = lambda f: F.when(~F.trim(F.col(f"`{f.name}`")).isin(MISSING), F.trim(F.col(f"`{f.name}`")))
    number = lambda f: F.expr(f"try_cast(`_{f.name}` AS DOUBLE)").cast(f.dataType) if isinstance(f.dataType, IntegerType) else F.col(f"`_{f.name}`").cast(f.dataType)
    return rows.select(*(value(f).alias(f"_{f.name}") for f in schema)).select(*(number(f).alias("grp" if f.name == "group" else f.name) for f in schema))


def read_csv_graph(spark: SparkSession, neurons: str, classification: str, levels: str, connections: str) -> Graph:
    return Graph(*(read_csv_table(spark, p, t) for p, t in ((neurons, "neurons"), (classification, "classification"), (levels, "levels"), (connections, "connections"))))


def read_parquet_graph(spark: SparkSession, folder: str) -> Graph:
    """The four tables as ``folder/<name>.parquet``."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    neurons = read("neurons")
    return Graph(neurons.withColumnRenamed("group", "grp") if "group" in neurons.columns else neurons, read("classification"), read("levels"), read("connections"))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph over order tables: parts are nodes, a line and the next of its order an edge."""
    part, item = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    root = F.col("p_partkey").cast("long").alias("root_id")
    levels = part.select(root, (F.col("p_size").cast("double") + F.col("p_partkey").cast("double") / 1000000.0).alias("score"), (5 - F.floor((F.col("p_size") - 1) / 10.0)).cast("int").alias("y_level"))
    classes = F.when(F.col("p_type") == "ECONOMY", "sensory").when(F.col("p_type") == "LARGE", "optic").when(F.col("p_type") == "MEDIUM", "central").when(F.col("p_type") == "PROMO", "visual_projection").when(F.col("p_type") == "SMALL", "motor").otherwise("descending")
    codes = F.array(*map(F.lit, ["ME", "LO", "AL", "MB_CA", "LH"]))
    b = F.substring("p_brand", 7, 10).cast("int")
    x, y = codes[b % 5], codes[(F.floor(b / 5.0) % 5).cast("int")]
    grp = F.when(b == 25, "NO_CONS").when(b == 24, F.lit(None)).when(x == y, x).otherwise(F.concat_ws(".", F.least(x, y), F.greatest(x, y)))
    types = F.array(*map(F.lit, ["ACH", "GABA", "GLUT", "DA", "SER", "OCT"]))
    nt = F.when(F.col("p_partkey") % 7 < 6, F.get(types, (F.col("p_partkey") % 7).cast("int")))
    neurons = part.select(root, grp.alias("grp"), nt.alias("nt_type"), ((F.col("p_partkey") % 100).cast("double") / 100.0).alias("nt_type_score"))
    a = item.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").cast("long").alias("pre_root_id"), F.col("l_returnflag").alias("neuropil"), "l_quantity")
    z = item.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("post_root_id"))
    edges = a.join(z, ["l_orderkey", "l_linenumber"]).where("pre_root_id <> post_root_id")
    connections = edges.groupBy("pre_root_id", "post_root_id", "neuropil").agg(F.sum("l_quantity").cast("long").alias("syn_count"))
    return Graph(neurons, part.select(root, classes.alias("super_class")), levels, connections)
