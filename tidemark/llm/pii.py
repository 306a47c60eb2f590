"""Personal data: base patterns, and candidates judged by boosted trees.

Base spans (email, ip, card, phone) are exact and always redacted. Generators of high recall propose further spans, which may
overlap: numbers written like cards, phones or identity numbers, addresses with errors, keys and other secrets. Boosted trees look at a candidate's
format and its context and give a probability; those over the threshold of their kind are added where they don't overlap a span
that is more certain. The trees are trained here, on candidates written by fixed templates with a fixed seed.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import texts_of

KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: A candidate of a kind is redacted from this probability on.
THRESHOLDS = {"email": 0.5, "ip": 0.6, "card": 0.5, "phone": 0.6, "id": 0.6, "secret": 0.5}
CONTEXT = 40

Span = tuple[str, int, int]


# base patterns -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap others of the kind; a match that fails its check is dropped."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# candidates --------------------------------------------------------------------------------------

_GENERATORS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[\w-]{2,63}+){1,4}")),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ at [\w-]{1,63}+(?: dot [\w-]{2,63}+){1,4}")),
    ("ip", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w.]*[0-9])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.,])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./-]?[(]?[0-9]{2,5}[)]?){2,5}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ -]?)?[(]?[0-9]{3}[)]?[ -][0-9]{3}-[0-9]{4}(?![0-9])")),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("id", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", re.compile(r"(?<![\w/+=.-])(?=[\w/+=.-]{0,60}[0-9])[A-Za-z0-9][\w/+=.-]{18,}+")),
]

_SECRET_WORDS = re.compile(r"(?:\b|_)(?:token|secret|passw\w*|api.?key|key|access|auth|bearer|credentials?|private)(?:\b|_)", re.I)
_PHONE_WORDS = re.compile(r"\b(?:phone|tel|call|mobile|fax|whatsapp|sms)\b", re.I)
_CARD_WORDS = re.compile(r"\b(?:card|visa|credit|debit|amex|payment|ccn|iban|account)\b", re.I)
_MAIL_WORDS = re.compile(r"\b(?:e-?mail|contact|write|reach)\b", re.I)
_OTHER_WORDS = re.compile(r"\b(?:order|invoice|isbn|version|build|serial|sku|doi|pages?|https?|www|commit|hash|sha|md5|checksum|rev|chapter|section|figure|model|part)\b", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap. Texts without digits and at-signs can have none."""
    if not _DIGIT.search(text) and "@" not in text and "(at)" not in text and "[at]" not in text and " dot " not in text:
        return []
    return [(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]


def _entropy(text: str) -> float:
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def described(text: str, spans: list[Span]) -> np.ndarray:
    """A row of format and context features for each span."""
    rows = []
    for kind, a, b in spans:
        own, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + 8]
        digits = _digits(own)
        letters, upper = sum(c.isalpha() for c in own), sum(c.isupper() for c in own)
        groups = re.findall(r"[0-9]+", own)
        near = before[-1:] or " "
        rows.append(
            [
                KINDS.index(kind), len(own), len(digits), letters, upper, sum(not c.isalnum() for c in own), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
                len(digits) / len(own), luhn(digits) if digits else 0, own.startswith("+"), "@" in own or "at)" in own or "at]" in own, own.count("."), own.count("-"), own.count("("), own.count(" "),
                all(c in "0123456789abcdefABCDEF" for c in own), _entropy(own), sum(int(g) <= 255 for g in groups if len(g) < 5), bool(_DATE.search(own)), len(set(digits)),
                near.isalpha(), near in "\"'`", near in "=:", near in "$€£#/", after[:1] in ("\"", "'", "`"), after[:1] in ("%", "/", "°"), "=" in before[-4:],
                bool(_SECRET_WORDS.search(before)), bool(_PHONE_WORDS.search(before)), bool(_CARD_WORDS.search(before)), bool(_MAIL_WORDS.search(before)), bool(_OTHER_WORDS.search(before)),
            ]
        )
    return np.array(rows, float).reshape(len(rows), 34)


# training ----------------------------------------------------------------------------------------


def _written(r: random.Random) -> tuple[str, str, bool]:
    """A text around one number or word, that part, and whether it is personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(r.randint(2, 9)))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    around = lambda lead, x, tail="": (" ".join(word() for _ in range(r.randint(2, 8))) + " " + lead + x + tail + " " + " ".join(word() for _ in range(r.randint(1, 6))), x)
    plain = r.choice(["", "", "", word() + " "])
    yes = [
        lambda: around(plain, d(16)),
        lambda: around(plain, " ".join(d(4) for _ in range(4))),
        lambda: around(plain, "-".join(d(4) for _ in range(4))),
        lambda: around(r.choice(["card ", "visa: ", ""]), d(r.choice([13, 14, 15, 16, 16, 19]))),
        lambda: around(plain, f"{r.choice(['+1 ', '+44 ', '+49 ', ''])}({d(3)}) {d(3)}-{d(4)}"),
        lambda: around(r.choice(["call ", "tel. ", "phone: ", ""]), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: around(r.choice(["call ", "tel. ", "mobile "]), f"0{d(2)} {d(4)} {d(4)}"),
        lambda: around(plain, f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(r.randint(2, 4))}"),
        lambda: around(plain, f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'de'])}"),
        lambda: around(plain, f"{word()} at {word()} dot com"),
        lambda: around(r.choice(["mail ", "write to ", ""]), f"{word()}(at){word()}.com"),
        lambda: around(plain, ".".join(str(r.randint(0, 255)) for _ in range(4))),
        lambda: around(plain, ":".join(hexed(4) for _ in range(8))),
        lambda: around(r.choice(["ssn ", "", ""]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: around(r.choice(["iban ", ""]), f"{r.choice(['DE', 'FR', 'ES'])}{d(2)} " + " ".join(d(4) for _ in range(4))),
        lambda: around(r.choice(['token = "', 'api_key = "', "password: '", 'secret="', "Bearer "]), r.choice([hexed(40), hexed(32), mixed(r.randint(20, 48))]), '"'),
        lambda: around(r.choice(["key ", ""]), r.choice(["AKIA", "sk-", "ghp_"]) + mixed(r.randint(20, 40))),
        lambda: around(r.choice(['token = "', "Bearer ", "auth: ", ""]), "eyJ" + ".".join(mixed(r.randint(20, 600)) for _ in range(3)), r.choice(['"', ""])),
    ]
    no = [
        lambda: around("", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
        lambda: around("", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"),
        lambda: around("", f"{r.randint(1900, 1990)} - {r.randint(1991, 2030)}"),
        lambda: around(r.choice(["version ", "build ", "v", "section "]), ".".join(str(r.randint(0, 30)) for _ in range(4))),
        lambda: around(r.choice(["order ", "invoice ", "serial ", "sku "]), d(r.randint(8, 16))),
        lambda: around(r.choice(["isbn ", "ISBN: "]), f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
        lambda: around(r.choice(["$", "€", ""]), f"{d(2)} {d(3)} {d(3)}", "%"),
        lambda: around("", " ".join(d(r.randint(1, 3)) for _ in range(r.randint(3, 7)))),
        lambda: around("", f"{d(3)} {d(3)} {d(3)}"),
        lambda: around(r.choice(["commit ", "sha ", "md5 ", "hash "]), hexed(r.choice([32, 40, 64]))),
        lambda: around("http://", f"{word()}.com/{word()}/{d(6)}/{word()}-{word()}"),
        lambda: around("", f"{word()}{word()}-{word()}-{word()}{d(2)}-{word()}"),
        lambda: around("", f"{word()}_{word()}_{d(4)}_{word()}{word()}"),
        lambda: around("", f"{d(4)}/{d(2)}/" + "-".join(word() for _ in range(r.randint(10, 120)))),
        lambda: around("pages ", f"{d(3)}-{d(3)}"),
        lambda: around("", f"{word()} at {word()}. {word()} dot {word()}"),
        lambda: around("", ".".join(str(r.randint(256, 999)) for _ in range(4))),
        lambda: around("", f"{d(3)}-{d(2)}-{d(3)}"),
        lambda: around("", d(r.choice([5, 6, 7, 8, 9, 10, 11, 22, 24]))),
    ]
    real = r.random() < 0.5
    text, part = r.choice(yes if real else no)()
    return text, part, real


@lru_cache(maxsize=1)
def trained(size: int = 6000, seed: int = 11) -> Boosted:
    """Trees fitted on the candidates in so many written texts: those that cover the personal part and little more are right."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(size):
        text, part, real = _written(r)
        a = text.index(part)
        b = a + len(part)
        spans = candidates(text)
        rows.append(described(text, spans))
        labels += [real and s <= a + 1 and e >= b - 1 and (e - s) <= len(part) + 2 for _, s, e in spans]
    x, y = np.concatenate(rows), np.array(labels)
    order = np.random.default_rng(seed).permutation(len(x))
    return fit(x[order], y[order])


# detection ---------------------------------------------------------------------------------------


def _joined_spans(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, overlapping ones as one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(texts: list[str], trees: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: base ones and those that the trees add."""
    bases, offered = [base_spans(t) for t in texts], [candidates(t) for t in texts]
    some = [i for i, c in enumerate(offered) if c]
    shares = trees.probability(np.concatenate([described(texts[i], offered[i]) for i in some])) if some else np.zeros(0)
    out, at = [(b, b) for b in bases], 0
    for i in some:
        found = list(bases[i])
        own = sorted(zip(shares[at : at + len(offered[i])], offered[i]), key=lambda x: (-x[0], x[1][1], -x[1][2]))
        at += len(offered[i])
        starts, ends = _joined_spans(found)
        for share, (kind, a, b) in own:
            k = bisect_left(starts, b)  # of the taken spans that begin before its end, the last one reaches furthest
            if share >= THRESHOLDS[kind] and not (k and ends[k - 1] > a):
                found.append((kind, a, b))
                starts.insert(k, a)
                ends.insert(k, b)
        out[i] = (bases[i], ordered(found))
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of FOUND for every row: counts and places of base spans, and all spans, as kind:start:end in code points.

    A null text counts as empty; ids may be null or repeat; an empty table gives an empty result; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = all_spans(texts_of(batch.column(1)), shared.value)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in results], pa.int64()) for kind in KINDS[:4]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([as_text(b) for b, _ in results], pa.string()), pa.array([as_text(s) for _, s in results], pa.string())], ["doc_id", *(c.split()[0] for c in FOUND.split(", "))])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over, "doc_id long, " + FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at, end = [], 0, 0
    for kind, a, b in ordered(spans):
        if a >= end:
            out += (text[at:a] if a > at else "", f"[{kind.upper()}]")
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data in its texts replaced, and ``chars_col``, where it is given and there, set to the new length.

    Null texts stay null; every row, repeated ones too, stays; an empty table stays empty; other columns, whatever their names, go with their rows; texts are read whole.
    """
    names = df.columns
    at = names.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at)
            texts = texts_of(given)
            clean = [redact(t, s) if s else t for t, (_, s) in zip(texts, all_spans(texts, shared.value))]
            columns = list(batch.columns)
            columns[at] = pa.array([None if g is None else c for g, c in zip(given.to_pylist(), clean)], given.type)
            yield pa.RecordBatch.from_arrays(columns, [f"_c{i}" for i in range(len(names))])

    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    out = plain.mapInArrow(over, ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(df.dtypes))).toDF(*names)
    return out.withColumn(chars_col, F.length(text_col).cast(dict(df.dtypes)[chars_col])) if chars_col in names else out
