"""Bounds that must not change results: beyond them another plan is taken, or nothing is left out."""

import gc
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import mixing, token_store, tokens, toxicity

SF = "/root/testdata/sf0.01"


def test_a_model_of_twice_the_size_scores_alike(spark, monkeypatch):
    model = toxicity.train(spark, SF)
    monkeypatch.setattr(toxicity, "FEATURES", 2 * toxicity.FEATURES)
    assert toxicity.train(spark, SF) == model and len(model.weights) < toxicity.FEATURES // 2


def test_mixing_beyond_the_bound_on_sources(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 != 1, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    columns = ("doc_id", "size", "source_size", "target", "taken", "position")
    one = sorted(map(tuple, mixing.mix(docs).select(*columns).collect()), key=str)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).select(*columns).collect()), key=str) == one


def test_encoding_leaves_nothing_behind():
    """A worker lives for many tasks: what it holds after one doesn't grow with the number of tasks."""
    vocabulary = tokens.default_vocabulary()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "12", "x."], 4000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(range(20), pa.int64()), pa.array(texts)], ["row", "doc_id", "text"])

    def task():
        chunks = sum(len(b) for b in token_store._encoded(vocabulary, 2)(iter([batch])) if b.column("kind")[0].as_py() == "chunk")
        gc.collect()
        return chunks, sys.getallocatedblocks()

    task()
    chunks, before = task()
    for _ in range(5):
        _, after = task()
    assert chunks > 100 and after - before < chunks
