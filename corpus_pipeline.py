"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row the stage before kept
and returns a DataFrame; all but the last return the columns of ``docs``.  Null
texts pass the filters like empty ones.  Without labelled rows of both kinds the
toxicity stage has nothing to learn from and rejects nothing; without benchmark
items nothing is contaminated; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.llm import decontamination, pieces, private_data, setsketch, toxicity
from layerlens.llm.storage import discarding, materialise

#: A document with this toxicity score or more goes.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field, trained on the labelled ones among them, does not score as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    try:
        model = toxicity.train(docs, labels)
    except toxicity.NothingToLearn:
        return docs
    return toxicity.score(docs, model).where(F.col("toxic_score") < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of smallest id; rows that repeat an id and its text stay once.

    Documents without an id are in no group and stay."""
    found = setsketch.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    kept = found.where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, benchmark).where(~F.col("contaminated")).select(docs.columns)


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of personal data in their texts replaced by their kind."""
    found = private_data.find_private_data(docs, private_data.fit(docs.select("text")))
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changed).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the end id."""
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), end_id=2, decoded=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", redact_private_data),
    ("sentencepiece", encode_pieces),
]

#: The conditional random field, the boosted trees and the tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read again, and the tables that led to it are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with discarding():
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
