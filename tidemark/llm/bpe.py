"""Byte-level BPE through a table of distinct words.

Texts are split into words where no merge can cross: before the last white-space character of a run, and around special
tokens. Each distinct word is encoded once. Words that many tasks hold are encoded ahead and go to every executor, a bounded
table. Of all others a chunk of texts sends each once, packed with those that go to the same part; a part has all of a word's
askers, encodes it once, and its ids return to the chunk, where they are put in the word's places. Decoding joins ids with the
table of pieces, which is as long as the vocabulary and so is at every executor.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, shared_path, shuffle_partitions, sliced, texts_of
from .wordtable import heaviest

#: Words of the table that goes to every executor, and those that a task puts forward for it.
HOT, FORWARD = 262_144, 65_536
#: Words that a task counts before it forgets those seen once.
COUNTED = 300_000
#: Words that a task sees less often count for their parts.
SPLIT_BELOW = 4
#: Characters of text after which a chunk of texts is closed, and of a long text that are split into words at once.
CHUNK_CHARS, SEGMENT_CHARS = 1 << 22, 1 << 20
#: Chunks of a task that are put together at once, and words of theirs whose ids are; a longer document's are put together whole.
GROUP_CHUNKS, RUN_WORDS = 8, 1 << 18
#: Numbers that are made bytes, or read from bytes, at once.
BLOCK = 1 << 17
#: Parts that other words are dealt to, for each shuffle partition; words of a part whose ids are kept at once.
PARTS, KNOWN = 4, 500_000
#: Spark allows so many buckets of a table.
MOST_BUCKETS = 100_000

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{_SPACE}]?[^{_SPACE}]+")
_LONG_SPACE = re.compile(f"[{_SPACE}][{_SPACE}]|[{_SPACE}]\\Z")
_LETTERS_THEN_MARKS = re.compile(f"([{_SPACE}]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{{-~]+)")
_CUT = re.compile(f"(?=[{_SPACE}][^{_SPACE}])")


def load(path: str) -> str:
    """A tokenizer file's text, read on the driver; executors get it with their tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def special_tokens(spec: str) -> list[str]:
    return [t["content"] for t in json.loads(spec)["added_tokens"] if t["special"]]


def tokenizer_of(spec: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def words_of(text: str, special: list[str]) -> list[str]:
    """Words that, encoded one by one, give the ids of the whole text; together they are the text."""
    for token in special:
        if token in text:
            rest = [t for t in special if t != token]
            parts = text.split(token)
            return [*words_of(parts[0], rest), *chain.from_iterable([token, *words_of(p, rest)] for p in parts[1:])]
    if not text:
        return []
    if _LONG_SPACE.search(text) is None:
        return _WORD.findall(text)
    return [w for w in _CUT.split(text) if w]


def parts_of(word: str) -> list[str]:
    """A word as letters and the ASCII punctuation behind them, which no merge joins; any other word stays whole."""
    m = _LETTERS_THEN_MARKS.fullmatch(word)
    return [m[1], m[2]] if m else [word]


def _encode(tokenizer: Any, words: list[str]) -> list[list[int]]:
    """Ids of each word; the tokenizer's own records, which are large, are made for a few thousand words at a time."""
    return [e.ids for i in range(0, len(words), 4096) for e in tokenizer.encode_batch(words[i : i + 4096], add_special_tokens=False)]


def _encoded_hot(spec: str, hot: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids; only a few thousand words' lists are held at a time."""
    tokenizer, many, flat = tokenizer_of(spec), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for i in range(0, len(hot), 4096):
        ids = _encode(tokenizer, hot[i : i + 4096])
        many.append(np.array([len(x) for x in ids], np.int64))
        flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
    return np.concatenate(many), np.concatenate(flat)


# small numbers as bytes --------------------------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 35 in one to five bytes each, seven bits a byte, the last one below 128."""
    return b"".join(_packed(numbers[i : i + BLOCK].astype(np.uint64)) for i in range(0, len(numbers), BLOCK))


def _packed(x: np.ndarray) -> bytes:
    size = np.ones(len(x), np.int64)
    for k in range(1, 5):
        size += x >= 1 << 7 * k
    end = np.cumsum(size)
    out = np.empty(int(end[-1]), np.uint8)
    start = end - size
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        part = (x[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[some] + k] = np.where(size[some] > k + 1, part | np.uint64(128), part)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    out = np.zeros(len(last), np.int64)
    begin = 0
    for i in range(0, len(last), BLOCK):
        end, part = last[i : i + BLOCK], out[i : i + BLOCK]
        start = np.concatenate([[begin], end[:-1] + 1])
        size = end - start + 1
        for k in range(int(size.max())):
            some = np.flatnonzero(size > k)
            part[some] |= (raw[start[some] + k] & 127).astype(np.int64) << 7 * k
        begin = int(end[-1]) + 1
    return out


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _sized(sizes: np.ndarray, body: bytes) -> bytes:
    """Sizes and what they are the sizes of, compressed."""
    head = packed(sizes)
    return _small(len(head).to_bytes(8, "little") + head + body)


def _apart(data: bytes) -> tuple[np.ndarray, bytes]:
    whole = _large(data)
    at = 8 + int.from_bytes(whole[:8], "little")
    return unpacked(whole[8:at]), whole[at:]


# encoding ----------------------------------------------------------------------------------------


def hot_words(texts: DataFrame, spec: str, most: int = HOT) -> list[str]:
    """Common words of the only column of ``texts``, commonest first, at most ``most``.

    Each task counts all its words and puts forward its commonest; which words are found only decides where they are encoded.
    """
    special = special_tokens(spec)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: Counter[str] = Counter()
        for batch in sliced(batches):
            for text in texts_of(batch.column(0)):
                for piece in segments(text, special):
                    counts.update(words_of(piece, special))
            least = 2
            while len(counts) > COUNTED:  # the rarest go, so that memory stays bounded
                counts = Counter({w: n for w, n in counts.items() if n >= least})
                least += 1
        for word in [w for w, n in counts.items() if n < SPLIT_BELOW]:
            for part in parts_of(word):
                counts[part] += counts[word] if part != word else 0
        least = max(2, int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -FORWARD)[-FORWARD])) if len(counts) > FORWARD else 2
        best = [x for x in counts.items() if x[1] >= least]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    counts = cut(texts.mapInArrow(over, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    return heaviest(counts, most).toArrow().sort_by([("n", "descending"), ("word", "ascending")])["word"].to_pylist()


_LAST = 2**31 - 1


def segments(text: str, special: list[str], most: int = SEGMENT_CHARS) -> Iterator[str]:
    """A text in pieces that are split into words apart from one another: cut where a word begins, but not inside special tokens."""
    if len(text) <= most or any(not _WORD.fullmatch(t) for t in special):
        yield text
        return
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + most) if at + most < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def runs_of(last: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Documents whose words end at ``last``, in runs of ``most`` words at most; one with more is a run of its own."""
    a = at = 0
    while a < len(last):
        b = max(a + 1, int(np.searchsorted(last, at + most, "right")))
        yield a, b
        a, at = b, int(last[b - 1])


#: Makes columns of documents, the places where their ids end, and all ids.
Finish = Callable[[list, np.ndarray, np.ndarray], pa.RecordBatch]


def _lists(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))


def _as_arrays(docs: list, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _lists(ends, ids)], ["doc_id", "ids"])


_SPLIT = "task long, chunk int, part int, docs array<long>, sizes binary, data binary"
_SPLIT_TYPES = pa.schema([("task", pa.int64()), ("chunk", pa.int32()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("data", pa.binary())])


def encode(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", finish: Finish = _as_arrays, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """(doc_id, ids) for every row of ``df``: the ids that the tokenizer gives for the whole text, without special tokens added.

    A null text counts as empty and has no ids; ids of documents may be null or repeat, and repeated rows each get their row; an empty table gives an
    empty result; other columns, whatever their names, are ignored; ``finish`` makes other columns of the ids where they are put together; special tokens
    inside a text have their own ids. Neither a text nor a word is cut: a long text is split at words, and a long word stays whole.

    Texts are split once, and what they are split into is written to the shared folder, in a table bucketed by the task that split them and by GROUP_CHUNKS of its chunks; so a lost executor
    can't bring ids to other rows, and ranks aren't shuffled: only words that aren't hot, and their ids, move.
    """
    spark = df.sparkSession
    special = special_tokens(spec)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot = hot_words(rows.select("text"), spec)
    many, flat = _encoded_hot(spec, hot)  # once, here: HOT words at most
    shared_spec, shared_hot, shared_ids = map(spark.sparkContext.broadcast, (spec, hot, (many, flat)))  # apart, so that a worker holds what its task needs
    n = shuffle_partitions(spark)
    chunk_chars, segment_chars, run_words = CHUNK_CHARS, SEGMENT_CHARS, RUN_WORDS
    none, parts, code = len(hot), PARTS * n, "H" if len(pieces_of(spec)) <= 1 << 16 else "I"
    del hot, many, flat
    release()  # the driver's Python too
    ranks_of: dict[str, int] = {}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk of texts, a record with the ranks of its words, and one for each part with the words that aren't hot, each once."""
        release()
        if not ranks_of:
            ranks_of.update((w, i) for i, w in enumerate(shared_hot.value))
        get, first, number = ranks_of.get, TaskContext.get().partitionId() << 32, 0
        docs: list = []
        sizes: list[int] = []
        ranks: list[np.ndarray] = []
        other: dict[str, int] = {}  # words that aren't hot, numbered on from the hot ones
        told: dict[str, list[int]] = {}
        held = 0

        def told_of(word: str) -> list[int]:
            found = told[word] = [other.setdefault(p, none + len(other)) if (r := get(p)) is None else r for p in parts_of(word)]
            return found

        def closed() -> pa.RecordBatch:
            words, task = list(other), first + number // GROUP_CHUNKS
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            rank = np.concatenate([np.arange(none), none + place]).astype(np.int32)[np.concatenate([np.zeros(0, np.int32), *ranks])]
            cuts = [*np.flatnonzero(np.diff(part[order], prepend=-1)).tolist(), len(words)]
            asked = []
            for a, b in zip(cuts, cuts[1:]):
                own = [words[i] for i in order[a:b].tolist()]
                asked.append({"task": task, "chunk": number, "part": int(part[order[a]]), "data": _sized(np.fromiter(map(len, own), np.int64, len(own)), "".join(own).encode())})
            return pa.RecordBatch.from_pylist([{"task": task, "chunk": number, "part": _LAST, "docs": docs, "sizes": packed(np.array(sizes, np.int64)), "data": _small(packed(rank))}, *asked], _SPLIT_TYPES)

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                size = 0
                for piece in segments(text, special, segment_chars):
                    words = words_of(piece, special)
                    found = [get(w) for w in words]
                    if None in found:
                        found = list(chain.from_iterable([r] if r is not None else told.get(w) or told_of(w) for r, w in zip(found, words)))
                    ranks.append(np.array(found, np.int32))
                    size += len(found)
                docs.append(doc)
                sizes.append(size)
                held += len(text)
                if held >= chunk_chars:
                    yield closed()
                    number += 1
                    held = 0
                    for kept in (docs, sizes, ranks, other, told):
                        kept.clear()
        if docs:
            yield closed()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts in order: each distinct word of a part is encoded once, and every chunk that asks gets its ids."""
        release()
        tokenizer, now = tokenizer_of(shared_spec.value), -1
        known: dict[str, array] = {}
        for batch in sliced(batches, 64):
            out = []
            for part, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if part != now or len(known) > KNOWN:
                    known.clear()
                    now = part
                sizes, body = _apart(data)
                text, ends = body.decode(), np.cumsum(sizes).tolist()
                words = [text[a:b] for a, b in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, (array(code, x) for x in _encode(tokenizer, fresh))))
                found = [known[w] for w in words]
                out.append(_sized(np.fromiter(map(len, found), np.int64, len(found)), b"".join(x.tobytes() for x in found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["task", "chunk", "part", "data"])

    def joined(own: pa.Table, answers: pa.Table) -> pa.Table:
        """Some chunks of one task with the ids of their other words, finished some documents at a time."""
        release()
        hot_size, hot_flat = shared_ids.value
        answers = answers.sort_by([("chunk", "ascending"), ("part", "ascending")])
        found: dict[int, list[bytes]] = {}
        for chunk, data in zip(answers["chunk"].to_pylist(), answers["data"].to_pylist()):
            found.setdefault(chunk, []).append(data)
        out = []
        for batch in own.to_batches(max_chunksize=8):
            for chunk, docs, sizes, data in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5))):
                size, flat = [hot_size], [hot_flat]
                for own_size, body in map(_apart, found.pop(chunk, ())):
                    size.append(own_size)
                    flat.append(np.frombuffer(body, "<u2" if code == "H" else "<u4").astype(np.int32))
                each, ids = np.concatenate(size), np.concatenate(flat)
                first, rank, last = np.cumsum(each) - each, unpacked(_large(data)), np.cumsum(unpacked(sizes))
                for a, b in runs_of(last, run_words):
                    at = int(last[a - 1]) if a else 0
                    own_rank = rank[at : last[b - 1]]
                    n = each[own_rank]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    whole = ids[np.repeat(first[own_rank] - ends[:-1], n) + np.arange(int(ends[-1]))]
                    out.append(finish(docs[a:b], ends[last[a:b] - at], whole))
        return pa.Table.from_batches(out, empty.schema)

    path = shared_path(spark, "bpe")
    name = f"tidemark_{path.rpartition('/')[2].replace('-', '_')}"
    buckets = min(n, MOST_BUCKETS)
    texts = rows.mapInArrow(split, _SPLIT)
    texts.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, "task").saveAsTable(name)
    table = spark.table(name)
    empty = finish([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    asked = table.where(F.col("part") < _LAST).select("task", "chunk", "part", "data").repartition(n, "part").sortWithinPartitions("part")
    answers = asked.mapInArrow(encoded, "task long, chunk int, part int, data binary")
    return table.where(F.col("part") == _LAST).groupBy("task").cogroup(answers.groupBy("task")).applyInArrow(joined, schema)


# decoding ----------------------------------------------------------------------------------------


def pieces_of(spec: str) -> list[bytes]:
    """The bytes of every id: the table that decoding joins with; as long as the vocabulary."""
    given = json.loads(spec)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    table = {i: bytes(char[c] for c in token) for token, i in given["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in given["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]


def _joined_by_id(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For runs of ids that end at ``ends``, the values of their ids one after the other: a join of ids with a table whose row number is the id."""
    found = table.take(pa.array(ids))
    places = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
    data, at = memoryview(found.buffers()[2] or b""), places[np.concatenate([[0], ends]).astype(np.int64)].tolist()
    return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


def decode(df: DataFrame, spec: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, special tokens included. Null ids give the empty text; an id that is none of the vocabulary gives nothing; bytes that aren't UTF-8 become U+FFFD."""
    names = df.columns
    at = names.index(ids_col)
    shared = df.sparkSession.sparkContext.broadcast(pieces_of(spec))
    schema = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(df.dtypes)) + ", _out string"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*shared.value, b""], pa.large_binary())
        for batch in sliced(batches):
            lists = [np.array([i for i in x or () if i is not None], np.int64) for x in batch.column(at).to_pylist()]
            ids = np.concatenate([np.zeros(0, np.int64), *lists])
            ids[(ids < 0) | (ids >= len(table) - 1)] = len(table) - 1
            texts = [t.decode("utf-8", "replace") for t in _joined_by_id(table, ids, np.cumsum([len(x) for x in lists]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*(f"_c{i}" for i in range(len(names))), "_out"])

    return df.toDF(*(f"_c{i}" for i in range(len(names)))).mapInArrow(over, schema).toDF(*names, out_col)


def encode_decode(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): what decode() gives of encode()'s ids, by the same join, in the worker that puts the ids together; so ids aren't sent to a second one."""
    shared = df.sparkSession.sparkContext.broadcast(pieces_of(spec))
    tables: list[pa.Array] = []

    def back(docs: list, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        if docs and not tables:
            tables.append(pa.array(shared.value, pa.large_binary()))
        texts = [t.decode("utf-8", "replace") for t in _joined_by_id(tables[0], ids, ends)] if docs else []
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _lists(ends, ids), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encode(df, spec, id_col, text_col, back, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from those ids through the piece table."""
    shared = df.sparkSession.sparkContext.broadcast(pieces_of(spec))
    tables: list[pa.Array] = []

    def digest(docs: list, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        if not tables:
            tables.extend((pa.array(shared.value, pa.large_binary()), pa.array([b"%d," % i for i in range(len(shared.value))], pa.large_binary())))
        one = [sha256(x[:-1]).hexdigest() for x in _joined_by_id(tables[1], ids, ends)]
        two = [sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in _joined_by_id(tables[0], ids, ends)]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(df, spec, id_col, text_col, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
