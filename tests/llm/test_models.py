"""Tests of the parts that need no Spark."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import bpe, boosting, chat, components, hmm, ordinal, pages, pii, quality, simhash
from tidemark.llm.hashed_text import Sample, features


def test_contract_gives_the_least_node_of_each_component():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = r.integers(0, 30, 20).astype(np.uint64), r.integers(0, 30, 20).astype(np.uint64)
        parent = {int(x): int(x) for x in [*a, *b]}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = sorted((root(x), root(y)))
            parent[q] = p
        nodes, least = components.contract(a, b)
        assert {int(n): int(m) for n, m in zip(nodes, least)} == {x: root(x) for x in parent if root(x) != x}


def test_codes_are_linear_and_cover_their_copies():
    for errors, size, distance in ((15, 128, 32), (13, 1024, 28)):
        code = simhash.anchors(errors)
        assert len(code) == size and np.bitwise_count(code[1:]).min() == distance
        known = set(code.tolist())
        assert all(int(x ^ y) in known for x, y in zip(code[5:40], code[90:125]))
    assert simhash.choose_code(1_000) == 15 and simhash.choose_code(20_000_000) in (11, 10)


def test_every_close_pair_meets_at_an_anchor():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for bit in r.choice(64, r.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    code = simhash.anchors(15)
    held = [set(zip(row.tolist(), anchor.tolist())) for fps in (x, y) for _, _, row, anchor in simhash._near(fps, code, 4)]
    homes = [home for fps in (x, y) for _, home, _, _ in simhash._near(fps, code, 4)]
    assert all((i, int(homes[0][i])) in held[1] or (i, int(homes[1][i])) in held[0] for i in range(300))


def test_chat_text_is_read_back():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice(["<", "|", "\\", ">", "im_end", "\n", "a", "<|im_end|>", "<|nl|>", "<|image:0|>"]) for _ in range(r.randint(0, 12)))
        role = "".join(r.choice(["u", "<|", "\n", "\\"]) for _ in range(r.randint(0, 4)))
        piece = chat.Piece()
        piece.add(role, [chat.Part("text", text)], 0, True)
        formatted = "".join(piece.text)
        assert chat.read_back(formatted) == [(role, text)]
        (a, b), = piece.loss
        assert chat.unescape(formatted[a:b]) == text
    with pytest.raises(ValueError):
        chat.read_back("<|im_start|>user\nno end")


def test_parts_become_placeholders_in_order():
    piece = chat.Piece()
    parts = [chat.Part("text", "see "), chat.Part("image", ref="a.png", width=57, height=28), chat.Part("text", " and <|image:0|> "), chat.Part("audio", ref="b.wav", seconds=1.5), chat.Part("document", ref="c.pdf", pages=3)]
    attached = piece.add("user", parts, 4, False)
    assert attached == 7 and [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in piece.attachments] == [(4, "image", "a.png", 3), (5, "audio", "b.wav", 38), (6, "document", "c.pdf", 768)]
    assert chat.read_back("".join(piece.text)) == [("user", "see  and <|image:0|> ")]
    assert chat.Part.of(None) == [] and chat.Part.of({"kind": None, "text": "x", "width": None}) == [chat.Part("text", "x")]
    odd = chat.Piece()
    odd.add("user", [chat.Part("film", ref="f"), chat.Part("text", "y")], 0, False)
    assert odd.attachments == [{"number": 0, "kind": "film", "ref": "f", "tokens": 1}] and chat.read_back("".join(odd.text)) == [("user", "y")]


def test_forward_recursion_is_exact():
    r = np.random.default_rng(5)
    norm = lambda x, axis=None: x / x.sum(axis, keepdims=True)
    p = hmm.Parameters(norm(r.random(3)), norm(r.random((3, 3)), 1), norm(r.random((6, 3)), 0))
    texts = [[1, 2, 5], [0, 5], [3, 3, 1, 5], [5]]
    order = sorted(range(4), key=lambda i: -len(texts[i]))
    matrix = np.full((4, 4), -1)
    for j, i in enumerate(order):
        matrix[: len(texts[i]), j] = texts[i]
    total = hmm.forward(p, matrix)
    from itertools import product

    for j, i in enumerate(order):
        whole = sum(p.start[s[0]] * p.emit[texts[i][0], s[0]] * np.prod([p.move[a, b] * p.emit[w, b] for a, b, w in zip(s, s[1:], texts[i][1:])]) for s in product(range(3), repeat=len(texts[i])))
        assert abs(total[j] - np.log10(whole)) < 1e-12
    start, move, emit = hmm.expected(p, matrix)
    assert abs(start.sum() - 4) < 1e-9 and abs(move.sum() - 6) < 1e-9 and abs(emit.sum() - 10) < 1e-9
    better = hmm.Parameters(norm(start + 1e-9), norm(move + 1e-9, 1), norm(emit + 1e-9, 0))
    assert hmm.forward(better, matrix).sum() > total.sum()
    for tokens in (1, 4, 8, 12):  # blocks that are made again give the same counts
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(hmm.expected(p, matrix, tokens), (start, move, emit)))


def brute_repeats(words, window=8):
    from collections import Counter

    at = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    many = Counter(at)
    return len({j for i, w in enumerate(at) if many[w] > 1 for j in range(i, i + window)})


def test_base_rules_agree_with_counting():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randint(0, 40))]
        assert quality.repeat_words(words) == brute_repeats(words)
    base = quality.base_rules("# a\n\n x y\nx y\n x y\n\n$é")
    assert (base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines) == (9, 10, 2, 1) and base.failed
    assert quality.base_rules("") == quality.Base(0, 0, 0, 0, 0)


def sample(texts, labels):
    found = [features(t.encode()) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in found])])
    return Sample(np.array(labels), np.arange(len(texts)) % 5, starts, np.concatenate([c for c, _ in found]).astype(np.int32), np.concatenate([v for _, v in found]).astype(np.float32))


def test_classifiers_learn_a_word_on_held_out_texts():
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(5))
    make = lambda grade: " ".join([word() for _ in range(30)] + [["vile", "dull ||| |||", "fine"][grade]] * 2)
    grades = [r.randint(0, 2) for _ in range(900)]
    s = sample([make(g) for g in grades], grades)
    fresh = [(g, make(g).encode()) for g in (0, 1, 2) for _ in range(60)]
    model = ordinal.fit(s)
    expected = [(g, model.of(t).sum()) for g, t in fresh]
    assert all(np.mean([e for g, e in expected if g == k]) + 0.4 < np.mean([e for g, e in expected if g == k + 1]) for k in (0, 1))
    assert all(a >= b for _, t in fresh for a, b in [model.of(t)])
    good = quality.fit(s, (s.labels > 0).astype(int))
    right = [(good.probability(float(good.weights[features(t)[0]] @ features(t)[1])) >= 0.5) == (g > 0) for g, t in fresh]
    assert np.mean(right) > 0.95
    only = quality.fit(sample(["a b"] * 10, [1] * 10), np.ones(10, int))
    assert only.probability(0.0) > 0.8 and len(features(b"")[0]) == 0


def test_trees_learn_a_conjunction():
    r = np.random.default_rng(8)
    x = r.random((2000, 4))
    y = (x[:, 0] > 0.5) & (x[:, 1] < 0.3)
    model = boosting.fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_words_of_a_text_encode_as_the_whole():
    import public_tokenizers

    spec = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer, special, r = bpe.tokenizer_of(spec), bpe.special_tokens(spec), random.Random(9)
    alphabet = [*"ab1 \n\t'’s.é字　 \x85\x1c​", "<|endoftext|>", "'ll", "  ", "\r\n", "😀"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        words = bpe.words_of(text, special)
        assert "".join(words) == text
        assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    n = np.random.default_rng(1).integers(0, 2**21, 500)
    assert (bpe.unpacked(bpe.packed(n)) == n).all() and len(bpe.unpacked(b"")) == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div id="cookie-notice">We use cookies</div>%s<aside>side</aside><form><p>Name</form><script>var x="<p>no</p>";</script><div class='comments'><p>first!</div><footer>&copy; us</footer>"""


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<article><h1>A &amp; B</h1><p>One   two<br>three<p>Four <b>fi</b>ve<div class=ad>buy</div></article><p>after</p>", ["A & B", "One two three", "Four five"]),
        ("<main><p>x&nbsp;&lt;y</main>", ["x <y"]),
        ("<div><h2>Title</h2><ul><li>a<li>b</ul></div>", ["Title", "a", "b"]),
        ("", []),
    ],
)
def test_main_text_of_markup(body, wanted):
    page = pages.lines_of(PAGE % body)
    assert [x for x in pages.settled(page, []).text.split("\n\n") if x] == wanted


def test_difference_removes_what_a_neighbour_shares():
    common = lambda a, b: {i for i, _ in pages.aligned(a.text, b.text)}
    left = lambda a, *others: pages.settled(a, [common(a, b) for b in others]).text.split("\n\n")
    a = pages.Lines(["Frame", "own a", "Foot", "para"], [1, 1, 1, 1])
    b = pages.Lines(["Frame", "own b", "Foot"], [1, 1, 1])
    assert left(a, b) == ["own a", "para"] and left(a, a) == a.text and left(a, a, b) == ["own a", "para"]
    short = pages.Lines([*(f"m{i}" for i in range(12)), "a long line that is the page's own and weighs more than its menu", "t"], [1] * 14)
    other = pages.Lines([*(f"m{i}" for i in range(12)), "another text"], [1] * 13)
    assert left(short, other) == short.text[12:]
    article = pages.Lines(["Frame", "same"], [1, 2])
    assert left(article, article) == ["same"]


def brute_covered(spans, candidates):
    taken = list(spans)
    for c in candidates:
        if not any(s < c[2] and c[1] < e for _, s, e in taken):
            taken.append(c)
    return taken


def test_spans_never_overlap_what_is_taken(monkeypatch):
    r = random.Random(14)
    make = lambda n: [("id", a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(n))]
    for _ in range(300):
        base, offered = make(r.randint(0, 4)), make(r.randint(1, 12))
        monkeypatch.setattr(pii, "base_spans", lambda t: base)
        monkeypatch.setattr(pii, "candidates", lambda t: offered)
        monkeypatch.setattr(pii, "described", lambda t, s: np.zeros((len(s), 1)))

        class Sure:
            def probability(self, x):
                return np.ones(len(x))

        (_, spans), = pii.all_spans(["x" * 80], Sure())
        assert sorted(spans) == sorted(brute_covered(base, sorted(offered, key=lambda c: (c[1], -c[2]))))


def brute_spans(t):
    d = pii._digits
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return pii.ordered(out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(d(m[0])) <= 15])


def test_base_spans_agree_with_the_patterns():
    r = random.Random(11)
    for _ in range(4000):
        t = "".join(r.choice("ab1.@_+-( )5902") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)


def test_trees_find_more_and_leave_the_rest():
    trees = pii.trained()
    r = random.Random(12)
    hits = misses = 0
    for _ in range(1500):
        text, part, real = pii._written(r)
        a = text.index(part)
        (_, spans), = pii.all_spans([text], trees)
        covered = any(s <= a + 1 and e >= a + len(part) - 1 for _, s, e in spans)
        hits += real == covered
        misses += real != covered
    assert hits / (hits + misses) > 0.93
    text = 'x token = "1a6c4f7bcf8c070fc75a8f6f8ed4b9a36b13d44c" and a.b@c.de'
    (base, spans), = pii.all_spans([text], trees)
    assert len(base) == 1 and pii.redact(text, spans) == 'x token = "[SECRET]" and [EMAIL]' and pii.redact("ab", []) == "ab"
    assert hashlib.sha256(pii.as_text(base).encode()).hexdigest()
