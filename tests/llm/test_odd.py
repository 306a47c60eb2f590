"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, no rows, and extra columns that bear the library's inner names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tidemark.llm import bpe, chat, hmm, mixing, neardedup, ordinal, pages, pii, quality, queries, simhash, spotsigs

INNER = (
    "_h _below _whole _plan_source _copy copies copy h below whole plan_source goal_source prefix got rest open mark class fp bands bucket node root group least any _kept _mark _gone twice "
    "_c0 _c1 _c4 _d0 _d1 _text _out place range key row n word part task chunk docs sizes data held_out base share symbols rare conv piece parts spots edited next_text edge ranges kept _id y fold "
    "columns vals id size target source_size n_words p_good level stop weight home block page_id url html"
).split()
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one"
ROWS = [(1, BODY), (2, BODY), (2, BODY), (3, BODY + " more"), (4, None), (5, ""), (6, " \t\n"), (None, BODY), (None, None), (7, "the quick brown fox jumps over the lazy dog " * 2000), (8, "é ü 字 😀 <|endoftext|>\x00 "), (9, "mail a.b@c.de 10.0.0.1\n\nx"), (10, "w" * 100_000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, "en", [None, "a", "b"][k % 3], len(t or "")) for k, (i, t) in enumerate(ROWS)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def crowded(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit("mine").alias(c) for c in INNER if c.lower() not in have))


def rows_of(df):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "spotsigs": lambda d, l: spotsigs.edited_fingerprints(d),
    "spotsigs pairs": lambda d, l: spotsigs.similar_pairs(d)[1],
    "spotsigs members": lambda d, l: spotsigs.similar_pairs(d)[0],
    "chat": lambda d, l: chat.digests(chat.format_conversations(d, "doc_id", "n_chars", "source", "text")),
    "ordinal": lambda d, l: ordinal.graded(d, ordinal.train(d, ordinal.grades_of_labels(l))),
    "hmm": lambda d, l: hmm.scores(d, states=2, passes=1),
    "quality": lambda d, l: quality.verdicts(d, l),
    "mixing": lambda d, l: mixing.mixed(d),
    "bpe": lambda d, l: bpe.digests(d, queries.tokenizer_spec()),
    "bpe ids": lambda d, l: bpe.decode(bpe.encode(d, queries.tokenizer_spec()), queries.tokenizer_spec()),
    "pages": lambda d, l: pages.extracted(d, "doc_id", "source", "text"),
    "pii": lambda d, l: pii.found(d),
}
ONE_ROW_EACH = set(OPERATORS) - {"chat", "spotsigs pairs"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(plain, labels, name):
    run = OPERATORS[name]
    want = rows_of(run(plain, labels))
    assert rows_of(run(crowded(plain), labels)) == want
    if name in ONE_ROW_EACH:
        assert len(want) == len(ROWS)
    assert run(plain.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, plain, name, stage):
    want = stage(spark, plain, SMALL)
    if name == "encode_bpe":
        assert want.count() == len(ROWS) and rows_of(stage(spark, crowded(plain), SMALL)) == rows_of(want)
        return
    table = crowded(plain)
    got = stage(spark, table, SMALL)
    assert want.columns == plain.columns and got.columns == table.columns
    assert rows_of(got.select(*plain.columns)) == rows_of(want)
    inner = [c for c in table.columns if c not in plain.columns]
    assert got.where(" OR ".join(f"`{c}` IS DISTINCT FROM 'mine'" for c in inner)).count() == 0
    assert stage(spark, table.limit(0), SMALL).count() == 0
