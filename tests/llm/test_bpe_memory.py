"""What the pipeline's last stage keeps in an executor's memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, queries

TEXTS = ["", None, "a", "naïve 字 <|endoftext|>x", "one two  three\n\n" * 50, "퟿́ zażółć, gęślą; jaźń! " * 9, " ", "x" * 500]


def test_ids_go_to_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    plan = corpus_pipeline.encode_bpe(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert "MapInArrow" not in plan.split("FlatMapCoGroupsInArrow")[0].replace("FlatMap", "")


@pytest.mark.parametrize("run_words", [1, 7, 1 << 18])
def test_documents_in_runs(spark, monkeypatch, run_words):
    monkeypatch.setattr(bpe, "RUN_WORDS", run_words)
    spec = queries.tokenizer_spec()
    tokenizer = bpe.tokenizer_of(spec)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.ids, r.decoded, r.n_tokens) for r in corpus_pipeline.encode_bpe(spark, docs, "").collect()}
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, tokenizer.decode(ids, skip_special_tokens=False), len(ids))
    assert len(got) == len(TEXTS) and {r[1] for r in got.values()} == {t or "" for t in TEXTS}


def test_runs_of_documents():
    assert list(bpe.runs_of(np.array([0, 3, 3, 9, 10]), 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(bpe.runs_of(np.zeros(2, np.int64), 3)) == [(0, 2)] and not list(bpe.runs_of(np.zeros(0, np.int64), 3))


def test_ranks_are_packed_a_block_at_a_time():
    numbers = np.random.default_rng(5).integers(0, 1 << 18, 1_000_000)
    tracemalloc.start()
    data = bpe.packed(numbers)
    most = [tracemalloc.get_traced_memory()[1]]
    tracemalloc.reset_peak()
    back = bpe.unpacked(data)
    most.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert (back == numbers).all() and max(most) < 4 * numbers.nbytes
