import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import canonical, cleanse
from tidemark.functions.cleanse import Rule

WHITE = {chr(c) for c in [*range(9, 14), *range(28, 33), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]}
TEXT = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=14) | st.text(st.sampled_from("ab @*1  　\t\u001c"), max_size=14)


def strip(x):
    while x and x[0] in WHITE:
        x = x[1:]
    while x and x[-1] in WHITE:
        x = x[:-1]
    return x


def name(x):
    return x if not x else "*" if len(x) == 1 else x[0] + "*" * (len(x) - 1)


def between(x, a, b):
    return "*" * len(x) if len(x) <= a + b else x[:a] + "*" * (len(x) - a - b) + x[len(x) - b :]


MODEL = {
    "TRIM": strip,
    "BLANK_TO_NULL": lambda x: x if strip(x) else None,
    "MASK_PHONE": lambda x: between(x, 3, 4),
    "MASK_ID_CARD": lambda x: between(x, 6, 4),
    "MASK_BANK_CARD": lambda x: "*" * len(x) if len(x) <= 8 else "*" * (len(x) - 4) + x[-4:],
    "MASK_NAME": name,
    "MASK_EMAIL": lambda x: name(x) if x.find("@") <= 0 else x[0] + "***" + x[x.find("@") :],
    "HASH_SHA256": lambda x: hashlib.sha256(x.encode()).hexdigest(),
}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_rules_agree_with_a_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for kind, model in MODEL.items():
        got = [r.x for r in cleanse.cleanse(df, "t", [Rule("T", "X", kind)]).orderBy("i").collect()]
        assert got == [model(t) for t in texts], kind


def test_no_break_space_stays(spark):
    df = spark.createDataFrame([("　 a 　",)], "x string")
    assert cleanse.cleanse(df, "t", [Rule("t", "x", "TRIM")]).first().x == " a "


def test_rules_chain_in_order_and_bad_ones_are_skipped(spark):
    df = spark.createDataFrame([(" ab-1 ", 5), (None, 6)], "x string, n int")
    rules = [Rule("t", "x", "UPPER"), Rule("t", "x", "STRIP_PREFIX", " A"), Rule("t", "x", "REGEX_REPLACE", "("), Rule("t", "x", "REGEX_REPLACE", "B", "$7"), Rule("t", "x", "STRIP_SUFFIX"), Rule("t", "n", "UPPER"), Rule("other", "x", "LOWER"), Rule("t", "gone", "LOWER"), Rule("t", "x", "TRIM")]
    assert [tuple(r) for r in cleanse.cleanse(df, "t", rules).collect()] == [("B-1", 5), (None, 6)]
    assert cleanse.hashed_columns("T", [Rule("t", "Mail", "HASH_SHA256")]) == {"mail"}
    assert cleanse.cleansed_keys("t", ["X"], rules) == {"x"}


def test_canonical_values_of_two_drivers(spark):
    df = spark.sql("SELECT cast(5.00 as decimal(10,2)) a, 5L b, true c, 1 d, timestamp_ntz'2024-01-01 10:00:00' e, '2024-01-01 10:00:00.000' f, 'x  ' g, 'x' h, 100 i, cast(100 as decimal(20,3)) j, '2024-99-01 10:00:00' k")
    row = df.select(*(canonical.canonical(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns)).first()
    assert row.a == row.b == "5" and row.c == row.d == "1" and row.e == row.f and row.g == row.h and row.i == row.j == "100" and row.k == "2024-99-01 10:00:00"
