import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_filters import brute_contamination, naive_spans
from test_near_duplicates import brute

from layerlens.llm import private_data, toxicity
from layerlens.llm.storage import materialise


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == columns
        kept[name] = ({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()})
        docs = out
    before, after = kept["near_duplicates"]
    groups = brute(list(before.items()), 5)
    assert set(after) == {k for k, _, c in groups if k == c}
    before, after = kept["decontamination"]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {k for k, _, hit, _ in brute_contamination(list(before.items()), items) if not hit}
    before, after = kept["private_data"]
    assert set(before) == set(after)
    assert all(after[k] == before[k] or naive_spans(before[k]) or private_data.candidates(before[k]) for k in before)
    assert not any(naive_spans(t) for t in after.values())
    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scored = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    assert set(after) == {k for k in before if scored[k] < 0.3}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = kept["private_data"][1]
    assert {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()} == {k: [*sp.encode(t), 2] for k, t in texts.items()}


def test_odd_rows(spark, sf, odd, empty):
    rows = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("x").alias("spans"), F.lit(2).alias("component_id"))
    docs = rows.union(rows.where("doc_id = 8"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf), f"test-odd-{name}")
        assert out.columns == docs.columns
        docs = out
    ids = [r["doc_id"] for r in docs.collect()]
    assert None in ids and len(ids) == len(set(ids)) and {1, 8} <= set(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
