"""Every operator and stage has a defined result for odd rows, for no rows, and beside columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonoframe.llm import decontamination, fingerprints, language_id, near_dedup, pii, quality, secret_scan, sentencepiece_bpe, substring_dedup, toxicity

KEEP = {"op5"}


def operators(spark):
    bench = spark.createDataFrame([(1, "a heron stood in the reeds at dawn and called across the marsh"), (2, None), (3, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 1), (6, 1, 0), (10, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    return {
        "op1": lambda d: quality.perplexities(d, labels.where("quality = 1")),
        "op2": lambda d: pii.spans(d),
        "op3": lambda d: secret_scan.scan(d, secret_scan.labelled_samples(bench)),
        "op4": lambda d: sentencepiece_bpe.encode_documents(d),
        "op5": lambda d: decontamination.leaks(d, bench),
        "op6": lambda d: language_id.identify(language_id.document_evidence(d)),
        "op7": lambda d: near_dedup.near_duplicates(d),
        "op8": lambda d: fingerprints.edited_likeness(d),
        "op9": lambda d: toxicity.score(d, labels, ["toxic"]),
        "op10": lambda d: substring_dedup.repeated_passages(d),
    }


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 11)])
def test_edges(spark, edge, none, op):
    apply = operators(spark)[op]
    rows = apply(edge).collect()
    assert (len(rows) == edge.count()) or op in KEEP
    assert apply(none).count() == 0


def test_no_benchmark_and_no_labels(spark, edge):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert decontamination.leaks(edge, bench).count() == 0
    assert toxicity.score(edge, labels, ["toxic"]).where("toxic").count() == 0
    assert quality.perplexities(edge, labels).where("keep").count() == edge.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, sf, edge, none, stage):
    name, apply = corpus_pipeline.STAGES[stage]
    out = apply(spark, edge, sf)
    assert out.count() <= edge.count() and apply(spark, none, sf).count() == 0
    if stage < 4:
        assert out.columns == edge.columns
        assert out.where(F.col("doc_id") == 2**62).count() == 1  # a clean document stays


def test_pipeline_stages_run_on_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]
