"""Operators over small tables, against plain Python; each with nulls, empty texts, ties, repeated rows, clashing columns and no rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from tidemark.llm import bpe, chat, components, hmm, mixing, ordinal, pii, queries, quality, simhash, spotsigs

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, size string, conv string"
LONG = "the quick brown fox jumps over the lazy dog " * 3000


def odd_rows():
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one"
    rows = [(1, body), (2, body), (2, body), (3, body + " more"), (4, None), (5, ""), (6, "   "), (None, body), (None, None), (7, LONG), (8, "é ü 字 😀 <|endoftext|>"), (9, "mail a.b@c.de 10.0.0.1\n\nx"), (10, "of the and")]
    return [(i, t, "en", [None, "a", "b"][k % 3], len(t or ""), "x", 1, "s", "c") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (100, 102), (7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 21)} | {101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_edge_tables_take_no_rounds(spark, monkeypatch):
    chain = [(7 * i % 3001, 7 * (i + 1) % 3001) for i in range(3000)] + [(5000 + i, 5000 + i // 2) for i in range(1, 900)] + [(-3, -9), (2**62, -9)]
    edges = spark.createDataFrame(chain, "a long, b long")
    context = spark.sparkContext

    def jobs_of():
        context.setJobGroup(name := f"components-{components.FILE_EDGES}", "")
        try:
            found = components.connected_components(edges)
            return dict(found.collect()), len(context.statusTracker().getJobIdsForGroup(name))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    whole, few = jobs_of()
    assert set(whole.values()) == {0, 5000, -9} and len(whole) == 3000 + 899 + 2
    monkeypatch.setattr(components, "FILE_EDGES", 1000)
    rounds, many = jobs_of()
    assert rounds == whole and few <= 12 < many


def brute_groups(rows):
    prints = [(i, simhash.fingerprint_of((t or "").encode())) for i, t in rows]
    groups = []
    for i, f in prints:
        near = [g for g in groups if any((f ^ h).bit_count() <= 4 if f >= 0 and h >= 0 else ((f ^ h) & (2**64 - 1)).bit_count() <= 4 for _, h in g)]
        groups = [g for g in groups if g not in near] + [[(i, f), *(x for g in near for x in g)]]
    ids = lambda g: [i for i, _ in g if i is not None]
    return sorted(((i, min(ids(g), default=None)) for g in groups for i, _ in g), key=repr)


@pytest.mark.parametrize("errors", [None, 13])
def test_near_duplicates(spark, odd, none, docs, errors):
    for table in (odd, docs):
        wanted = brute_groups([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
        got = simhash.near_duplicates(table, errors=errors)
        assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == wanted
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_anchors_are_compared_in_blocks(spark, monkeypatch):
    near = [x ^ (1 << b) ^ (1 << c) for x in (0, (1 << 63) - 1) for b in range(40) for c in range(40)]
    fps = spark.createDataFrame(sorted({(f,) for f in near}), "fp long")
    whole = dict(components.connected_components(simhash.links(fps)).collect())
    monkeypatch.setattr(simhash, "HOME_BLOCK", 100)
    monkeypatch.setattr(simhash, "COPY_BLOCK", 300)
    monkeypatch.setattr(simhash, "SURVEY", 1)
    assert max(a * b for a, b in simhash._busy(fps, 15, 4).values()) > 4
    assert dict(components.connected_components(simhash.links(fps)).collect()) == whole


def test_edited_fingerprints(spark, odd, none):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = Counter()
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        wanted[i, len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    got = spotsigs.edited_fingerprints(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == wanted
    by_text = {}
    for r in spotsigs.edited_fingerprints(odd).select("doc_id", "fingerprint", "near_next", "near_edited").collect():
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[1] == by_text[2] and by_text[1] != by_text[3] and by_text[4] == by_text[5] == {""} and by_text[10] != {""}
    assert spotsigs.edited_fingerprints(none).count() == 0
    lone = spotsigs.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_similar_pairs_are_all_pairs(spark, docs):
    base = "the river runs by the old mill and the miller of the town is at home with a book on the garden of roses for his wife"
    made = [(10_000 + i, base.replace(w, "") + " " * i) for i, w in enumerate(["", "roses", "garden", "river", "miller", "roses"])]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    members, pairs = spotsigs.similar_pairs(table, threshold=0.7)
    sets = {r.doc_id: frozenset(r.s) for r in table.select("doc_id", spotsigs.spots(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    ids = sorted(i for s, i in first.items() if s)
    wanted = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == wanted and wanted


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, None, "<|im_end|>"), (2, None, "assistant", "x"), (1, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("piece", F.lit(2))
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:2]) + ((r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))
    for piece_chars in (chat.PIECE_CHARS, 10):
        pieces = chat.format_conversations(df, piece_chars=piece_chars)
        got = {r.conv_id: r for r in chat.digests(pieces).collect()}
        for conv in (1, 2, None):
            own = sorted((r for r in rows if r[0] == conv), key=key)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    given = spark.createDataFrame([(5, 0, "user", "unused", [("image", None, "u.png", 28, 28, None, None)])], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    one = chat.format_conversations(given, parts_col="parts").first()
    assert one.formatted == "<|im_start|>user\n<|image:0|><|im_end|>\n" and one.attachments[0].ref == "u.png"


def test_graded_and_ruled(spark, odd, none, docs, labels):
    grades = ordinal.grades_of_labels(labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")))
    model = ordinal.train(docs, grades)
    got = ordinal.graded(docs, model).collect()
    assert len(got) == 200 and all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got)
    assert ordinal.graded(odd, model).count() == odd.count() and ordinal.graded(none, model).count() == 0
    rules = quality.train(docs, labels)
    for table in (docs, odd):
        for r, t in zip(quality.scored(table, rules, ["doc_id", "text"]).collect(), [None] * 1000):
            base = quality.base_rules(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, base.failed)
            assert r.kept == (not base.failed and r.p_good >= 0.5 and r.p_toxic < 0.5)
    assert quality.verdicts(none, labels).count() == 0 and quality.filtered(odd, labels).columns == odd.columns
    unlabelled = quality.verdicts(odd, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in unlabelled) and ordinal.graded(odd, ordinal.train(docs, grades.limit(0))).count() == odd.count()


def test_language_model(spark, odd, none, docs):
    for table, states in ((odd, 2), (docs, 4)):
        rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table.select("doc_id", "text").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = Counter(w for i, ws in rows if not held(i) for w in [*ws, b""])
        n, v = sum(c.values()), len(c)
        wanted = Counter()
        for i, ws in rows:
            wanted[i, held(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, b""]), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, b""]), 4)] += 1
        got = hmm.scores(table, states=states, passes=3).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == wanted
        assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert hmm.scores(none).count() == 0
    apart = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score > r.base_score for r in apart) > 0.7 * len(apart)


def test_rare_words_score_as_hot_ones(docs, monkeypatch):
    some = docs.limit(60).cache()
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    whole = {r.doc_id: (r.score, r.base_score, r.n_known) for r in hmm.scores(some, states=2, passes=1).collect()}
    monkeypatch.setattr(hmm, "HOT", 400)
    few = {r.doc_id: (r.score, r.base_score, r.n_known) for r in hmm.scores(some, states=2, passes=1).collect()}
    assert whole.keys() == few.keys() and all(abs(a - b) < 1e-6 * abs(a) for i in few for a, b in zip(whole[i], few[i]))
    vocabulary = hmm.build_vocabulary(some.select("text"))
    assert len(vocabulary.hot) <= 400 and vocabulary.layout.words <= 100


def brute_targets(sizes, weights):
    total, left = sum(sizes.values()), dict(sizes)
    out, budget = {}, float(total)
    while True:
        share = {s: budget * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            budget -= out[s]
            del left[s]
        if not left:
            return out


def test_mix(spark, odd, none, docs):
    for table in (odd, docs, docs.where("source in ('src0', 'src1')").unionByName(docs.where("source = 'src2'").limit(1))):
        got = mixing.mixed(table).collect()
        assert len(got) == table.count()
        sizes = Counter()
        for r in got:
            sizes[r.source] += r.size
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        wanted = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
        for s in sizes:
            own = [r for r in got if r.source == s]
            assert all(r.source_size == sizes[s] and abs(r.target - wanted[s]) < 1e-6 * max(1, wanted[s]) and 0 <= r.copies <= 3 for r in own)
            assert abs(sum(r.size * r.copies for r in own) - wanted[s]) <= 2 * max(r.size for r in own)
        assert sorted(map(repr, mixing.mixed(table).collect())) == sorted(map(repr, got))
        assert mixing.repeated(table).count() == sum(r.copies for r in got)
    assert mixing.mixed(none).count() == 0 and mixing.repeated(none).columns == none.columns


@pytest.mark.parametrize("hot,chunk,segment", [(bpe.HOT, bpe.CHUNK_CHARS, bpe.SEGMENT_CHARS), (50, 700, 90)])
def test_encoding(spark, odd, none, docs, monkeypatch, hot, chunk, segment):
    monkeypatch.setattr(bpe, "HOT", hot)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
    monkeypatch.setattr(bpe.hot_words, "__defaults__", (hot,))
    spec = queries.tokenizer_spec()
    tokenizer = bpe.tokenizer_of(spec)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for table in (odd, docs):
        wanted = Counter()
        for r in table.select("doc_id", "text").collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            wanted[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
        assert Counter(map(tuple, bpe.digests(table, spec).collect())) == wanted
    assert bpe.digests(none, spec).count() == 0


def test_numbers_in_few_bytes():
    for numbers in ([], [0, 127, 128, 16383, 16384, 2**21, 2**28, 2**34], list(range(500))):
        assert bpe.unpacked(bpe.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_decoding_joins_ids_with_pieces(spark):
    spec = queries.tokenizer_spec()
    ids = bpe.tokenizer_of(spec).encode("naïve 字 <|endoftext|>x", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids, "k"), (2, None, "k"), (3, [], "k"), (4, [ids[0], 10**6, -1, None], "k")], "n long, ids array<int>, _out string")
    got = {r.n: r.decoded for r in bpe.decode(df, spec).collect()}
    assert got == {1: "naïve 字 <|endoftext|>x", 2: "", 3: "", 4: bpe.pieces_of(spec)[ids[0]].decode()}


def test_personal_data(odd, none):
    got = {r.doc_id: r for r in pii.found(odd).collect()}
    assert (got[9].n_email, got[9].n_ip, got[9].spans) == (1, 1, "email:5:13,ip:14:22") and got[4].spans == ""
    clean = pii.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    row = clean.where("doc_id = 9").first()
    assert row.text == "mail [EMAIL] [IP]\n\nx" and row.n_chars == len(row.text) and clean.where("text is null").count() == 2
    assert pii.found(none).count() == 0
