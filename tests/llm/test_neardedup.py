"""Near copies against brute force over sets of word runs and plain fingerprints."""

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.conftest import SMALL
from tidemark.llm import mixing, neardedup, pii, quality, simhash

WORDS = [f"w{i}" for i in range(60)]


def plain_fingerprint(text, k=5):
    """SimHash bit by bit, apart from the library's."""
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for x in words for w in x.replace("\t", "\n").replace("\v", "\n").replace("\f", "\n").replace("\r", "\n").split("\n") if w]
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept_by_brute_force(rows):
    """Ids that stay, for distinct ids."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and ((prints[x] ^ prints[y]).bit_count() <= 4 or sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def near(changes):
    return " ".join("x" + w if k in changes else w for k, w in enumerate(WORDS))


def test_stage_drops_all_copies_of_likeness_four_fifths(spark):
    # one word changed in the middle: 51 of 61 runs are shared, a likeness of 0.84; two words: 0.67
    made = [(1, near(())), (2, near({30})), (3, near({30, 50})), (4, near({5, 20, 40})), (5, " ".join(WORDS[:54])), (6, None), (7, ""), (8, "a b"), (9, "A  b"), (10, "a b c")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    wanted = kept_by_brute_force(made)
    assert {2, 3, 5} & wanted == set()
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect()} == wanted


def test_sample_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    made = rows + [(10**6 + k, " ".join(w if j % 47 != k % 47 else "zz" for j, w in enumerate(t.split()))) for k, (_, t) in enumerate(rows[:60]) if t]
    df = spark.createDataFrame(made, docs.schema)
    assert {r.doc_id for r in neardedup.deduplicated(df).collect()} == kept_by_brute_force(made)


@pytest.mark.parametrize("block", [neardedup.BLOCK, 7])
def test_blocks_of_a_bucket_change_nothing(spark, monkeypatch, block):
    made = [(k * 60 + i, near({i, (i * 7 + k) % 60})) for k in range(2) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    monkeypatch.setattr(neardedup, "BLOCK", block)
    assert {r.doc_id for r in neardedup.deduplicated(df).collect()} == kept_by_brute_force(made)


@pytest.mark.parametrize("entries, few", [(neardedup.BLOCK_ENTRIES, neardedup.FEW), (150, 0), (150, 10)])
def test_a_crowd_that_is_not_quite_alike_gives_no_pairs(spark, monkeypatch, entries, few):
    """Likenesses about 0.7 come out alike by sketches; the step that compares their sets gives a few rows for each member at most, and the same groups."""
    monkeypatch.setattr(neardedup, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(neardedup, "FEW", few)
    texts = [np.array([f"w{i}" for i in range(120)], object) for _ in range(80)]
    for k, t in enumerate(texts):  # of 116 runs 10 differ from the others' in each half; some are alike
        t[[7 + k % 9, 60 + k % 11]] = f"x{k}" if k % 8 else "same"
    made = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    sizes = []
    for name in ("candidates", "crowded", "verified"):
        step = getattr(neardedup, name)
        monkeypatch.setattr(neardedup, name, lambda members, *a, f=step: (sizes.append((members.count(), (out := f(members, *a)).count())), out)[1])
    assert {r.doc_id for r in neardedup.deduplicated(df).collect()} == kept_by_brute_force(made)
    assert len(sizes) == 3 and all(out <= max(1, few) * members for members, out in sizes)


def test_pairs_of_likeness_four_fifths_meet(spark):
    """All pairs at the threshold share a band and come out alike enough: 2,000 pairs of random sets."""
    r = np.random.default_rng(5)
    for _ in range(2000):
        both, left, right = (r.integers(0, 2**63, n, np.uint64) for n in (160, 20, 20))
        a, b = (neardedup.min_hashes(np.unique(np.concatenate([both, x]))) for x in (left, right))
        assert set(neardedup.bands_of(a).tolist()) & set(neardedup.bands_of(b).tolist())
        x, y = (np.frombuffer(neardedup.signature(s), np.uint8)[None] for s in (a, b))
        assert neardedup._agreement(x, y)[0, 0] >= neardedup.ESTIMATE


def test_rows_of_an_id_are_judged_by_their_own_text(spark):
    made = [(1, near(())), (2, near({30})), (2, "something else that copies nothing at all"), (3, "p q r s t u"), (3, "p q r s t u"), (None, near(())), (None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = [tuple(r) for r in neardedup.deduplicated(df).collect()]
    assert sorted(got, key=repr) == sorted([made[0], made[2], made[3], made[5], made[6]], key=repr)


def test_stages_in_turn(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = docs
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:4], (lambda d: quality.filtered(d, labels), neardedup.deduplicated, pii.redacted, mixing.repeated)):
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        assert sorted(map(repr, out.collect())) == sorted(map(repr, wanted(kept).collect())), name
        kept = out.cache()
    last = corpus_pipeline.run(spark, SMALL)
    assert last.count() == kept.count() and sorted(r.decoded for r in last.collect()) == sorted(r.text for r in kept.collect())


def test_fingerprints_are_plain_ones(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a"), (-5, "A b\x0bc\rd \x85 e\u2003f É g"), (-6, "x " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).select("doc_id", "fingerprint").collect()}
    assert got == {i: f"{plain_fingerprint(t, 4):016x}" for i, t in rows}
