"""The sample of labelled rows: its size, and the columns that come to the driver."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hashed_text


def test_only_columns_that_enough_texts_have_are_collected(spark):
    texts = [(i, f"all of us know word{i % 3} and lone{i}") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sample = hashed_text.sample_of(docs, docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("y")), "doc_id", "text")
    found = [hashed_text.features(t.encode()) for _, t in texts]
    counts = np.bincount(np.concatenate([c for c, _ in found]), minlength=hashed_text.WIDTH)
    assert len(sample) == 30 and counts[sample.columns].min() >= hashed_text.MIN_TEXTS
    for k, (columns, values) in enumerate(found):
        at, own = slice(sample.starts[k], sample.starts[k + 1]), counts[columns] >= hashed_text.MIN_TEXTS
        assert sample.columns[at].tolist() == columns[own].tolist() and np.allclose(sample.values[at], values[own])


def test_eight_thousand_rows_are_fitted(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("y"))
    assert 7_800 < len(hashed_text.sample_of(docs, labels, "doc_id", "text")) < 8_600
