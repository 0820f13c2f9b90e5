import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import exact, quality, secrets, simhash

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scores(spark):
    return quality.op10_quality(spark, MEDIUM).cache()


def test_quality_rows(spark, scores):
    docs = {r.doc_id for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id").collect()}
    rows = scores.collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == docs
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy(spark, scores):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    row = scores.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.avg("quality").alias("share")).first()
    assert row.right >= 0.9 and row.right > max(row.share, 1 - row.share)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5), (None, "a b", 0.5), (3, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (99, 0), (3, None)], "doc_id long, quality int")
    assert quality.quality_scores(df, labels).count() == 5
    assert quality.quality_scores(df, labels.limit(0)).count() == 5
    assert quality.quality_scores(df.limit(0), labels).count() == 0
    assert quality.drop_low_quality(df, labels).columns == df.columns


def test_paths_are_conjunctions():
    text = "Tree 0 (weight 1.0):\n  If (feature 0 <= 2.5)\n   If (feature 3 > 1.0E-4)\n    Predict: 0.0\n   Else (feature 3 <= 1.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 2.5)\n   Predict: 1.0\n"
    assert len(quality.paths(text)) == 4
    assert (("s_upper", ">", 1e-4), ("s_words", "<=", 2.5)) in quality.paths(text)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    good = stages["quality"](spark, docs, small).cache()
    bad = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - bad
    single = stages["exact_dedup"](spark, good, small).cache()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in exact.exact_classes(good).where("kept").collect()}
    apart = stages["near_dedup"](spark, single, small).cache()
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in simhash.near_classes(single).where("doc_id = component").collect()}
    clean = stages["secrets"](spark, apart, small).cache()
    assert all(f.columns == docs.columns for f in (good, single, apart, clean))
    was = {r.doc_id: r.text for r in apart.collect()}
    for r in clean.collect():
        assert r.text == (None if was[r.doc_id] is None else secrets.masked(was[r.doc_id], "[SECRET]"))
        assert r.n_chars == (None if r.text is None else len(r.text))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean.collect()}
    pieces = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == tokens
