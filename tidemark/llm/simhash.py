"""SimHash near-duplicates by anchor points.

A text's fingerprint has 64 bits. The anchors are the words of an extended BCH code of length 64,
which covers the space: every fingerprint has an anchor near it. A fingerprint's home is its
nearest anchor, at distance r. Let x and y differ in at most t bits and let r(x) <= r(y). Then
y lies within r(x) + t <= r(y) + t of x's home. So it is enough to copy each fingerprint to every
anchor within its own distance plus the threshold, which is never more than the covering radius plus the
threshold, and to compare the homes of each anchor with the copies that came to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, cut, shingle_hashes, shuffle_partitions
from .components import connected_components, contract

SHINGLE_WORDS = 4
SEED = 42
THRESHOLD = 4

#: Designed error correction of the codes to choose from, with the copies per fingerprint that each was measured to give at
#: threshold 4. Only the cost depends on these figures.
CODES = {15: 13.1, 13: 30.4, 11: 127.4, 10: 200.5}
#: Nanoseconds to move a copy and to compare two fingerprints, for the choice of a code.
MOVE_NS, COMPARE_NS = 700.0, 1.5
#: An anchor's homes and copies are compared in blocks of at most about so many.
HOME_BLOCK, COPY_BLOCK = 4096, 131_072
#: One fingerprint in so many is looked at to find the anchors that need more than one block.
SURVEY = 16


# fingerprints ------------------------------------------------------------------------------------


def fingerprint_of_hashes(blocks: Iterable[np.ndarray]) -> int:
    """The bits set in over half the hashes, as a signed number; 0 without hashes."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed number; 0 for a text without words."""
    return fingerprint_of_hashes(shingle_hashes(text, shingle_words, SEED))


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of ``df``; a null text counts as empty, a null id stays null."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [fingerprint_of(t, shingle_words) for t in bytes_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, over, "doc_id long, fp long")


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# anchors -----------------------------------------------------------------------------------------


def _minimal_polynomials(errors: int) -> int:
    """Generator polynomial, as bits, of the BCH code of length 63 with this designed correction."""
    powers = [1]
    while len(powers) < 63:
        x = powers[-1] << 1
        powers.append(x ^ 0b1000011 if x & 64 else x)
    log = {v: i for i, v in enumerate(powers)}
    generator, used = 1, set()
    for s in range(1, 2 * errors + 1):
        orbit = {s * 2**i % 63 for i in range(6)}
        if min(orbit) in used:
            continue
        used.add(min(orbit))
        factor = [1]  # the product of (x + root) over the orbit, lowest power first
        for r in orbit:
            raised = [0, *factor]
            for i, c in enumerate(factor):
                if c:
                    raised[i] ^= powers[(log[c] + r) % 63]
            factor = raised
        product = 0
        for i, c in enumerate(factor):
            if c:
                product ^= generator << i
        generator = product
    return generator


@lru_cache(maxsize=4)
def anchors(errors: int) -> np.ndarray:
    """All words of the extended BCH code of length 64: those of length 63 with a parity bit."""
    generator = _minimal_polynomials(errors)
    words = np.zeros(1, np.uint64)
    for i in range(63 - (generator.bit_length() - 1)):
        row = generator << i
        words = np.concatenate([words, words ^ np.uint64(row | (row.bit_count() & 1) << 63)])
    return words


def choose_code(fingerprints: int) -> int:
    """The code with the least expected cost for so many fingerprints. Every code gives the same links."""

    def cost(errors: int) -> float:
        n, copies, size = fingerprints, CODES[errors], len(anchors(errors))
        return n * copies * MOVE_NS + n * n * copies / size * COMPARE_NS + n * size * COMPARE_NS

    return min(CODES, key=cost)


def _near(fps: np.ndarray, code: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of fingerprints: the slice, its homes, and row and anchor of every copy."""
    step = max(1, 4_000_000 // len(code))
    for i in range(0, len(fps), step):
        part = fps[i : i + step]
        far = np.bitwise_count(part[:, None] ^ code[None, :])
        home = far.argmin(1)
        row, anchor = np.nonzero(far <= far[np.arange(len(part)), home][:, None] + np.uint8(threshold))
        yield part, home, row, anchor


def _busy(fps: DataFrame, errors: int, threshold: int) -> dict[int, tuple[int, int]]:
    """For anchors with too much for one block: the blocks of homes and of copies. At most one entry per anchor of the code."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = anchors(errors)
        homes, copies = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for _, home, _, anchor in _near(batch.column(0).to_numpy().view(np.uint64), code, threshold):
            homes += np.bincount(home, minlength=len(code))
            copies += np.bincount(anchor, minlength=len(code))
        at = np.flatnonzero(copies)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(homes[at]), pa.array(copies[at])], ["anchor", "homes", "copies"])

    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SURVEY)) == 0)
    counts = arrow_map(some, over, "anchor long, homes long, copies long").groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("copies").alias("copies"))
    busy = counts.where((F.col("homes") * SURVEY > HOME_BLOCK) | (F.col("copies") * SURVEY > COPY_BLOCK)).collect()
    return {r.anchor: (-(-r.homes * SURVEY // HOME_BLOCK) or 1, -(-r.copies * SURVEY // COPY_BLOCK) or 1) for r in busy}


def links(fps: DataFrame, threshold: int = THRESHOLD, errors: int | None = None) -> DataFrame:
    """(a, b): a forest that joins the same fingerprints as all pairs within ``threshold`` bits do.

    ``fps`` holds distinct fingerprints in the column fp. Fingerprints are dealt out by anchor; an anchor with many of them is
    compared in blocks of homes and copies, which become tasks of their own. A block gives back one edge for
    each fingerprint that it links, not one for each pair.
    """
    errors = errors or choose_code(fps.count())
    busy = _busy(fps, errors, threshold)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors(errors)
        blocks = np.ones((len(code), 2), np.int64)
        for anchor, size in busy.items():
            blocks[anchor] = size
        mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)

        def dealt(fp: np.ndarray, anchor: np.ndarray, home: bool) -> pa.RecordBatch:
            own, other = blocks[anchor, 0 if home else 1], blocks[anchor, 1 if home else 0]
            row = np.repeat(np.arange(len(fp)), other)
            across = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
            mine = (mixed(fp) % own)[row]
            i, j = (mine, across) if home else (across, mine)
            key = (anchor[row].astype(np.int64) << 36) | (i << 18) | j
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(np.full(len(row), home))], ["block", "fp", "home"])

        for batch in batches:
            for part, home, row, anchor in _near(batch.column(0).to_numpy().view(np.uint64), code, threshold):
                yield dealt(part, home, True)
                yield dealt(part[row], anchor, False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, fp, home in _blocks(batches):
            edges = _within(fp[home], fp[~home], threshold)
            if edges is not None:
                yield pa.RecordBatch.from_arrays([pa.array(edges[0].view(np.int64)), pa.array(edges[1].view(np.int64))], ["a", "b"])

    dealt_out = fps.mapInArrow(copies, "block long, fp long, home boolean")
    return dealt_out.repartition(shuffle_partitions(fps.sparkSession), "block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole blocks of a sorted partition, one after the other."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        part = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(part[0])) + 1
        if held and len(part[0]) and held[-1][0][-1] != part[0][0]:
            starts = np.concatenate([[0], starts])
        at = 0
        for s in starts.tolist():
            held.append(tuple(x[at:s] for x in part))
            yield _joined(held)
            held, at = [], s
        held.append(tuple(x[at:] for x in part))
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[int, np.ndarray, np.ndarray]:
    block, fp, home = (np.concatenate(x) for x in zip(*held))
    return int(block[0]), fp, home


def _within(homes: np.ndarray, copies: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray] | None:
    """A forest over the pairs of a home and a copy within the threshold; None if there are none."""
    if not len(homes) or len(copies) < 2:
        return None
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 2_000_000 // len(copies))
    for i in range(0, len(homes), step):
        part = homes[i : i + step]
        row, column = np.nonzero(np.bitwise_count(part[:, None] ^ copies[None, :]) <= threshold)
        left, right = part[row], copies[column]
        if len(some := np.flatnonzero(left != right)):
            forest.append(contract(left[some], right[some]))
        if sum(len(x[0]) for x in forest) > 1_000_000:
            forest = [_merged(forest)]
    return _merged(forest) if forest else None


def _merged(forest: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return forest[0] if len(forest) == 1 else contract(*(np.concatenate(x) for x in zip(*forest)))


# groups ------------------------------------------------------------------------------------------


def fingerprint_groups(fps: DataFrame, threshold: int = THRESHOLD, errors: int | None = None) -> DataFrame:
    """(node, root) for every fingerprint that links lead to another one: the members of a group with its least fingerprint, that one included.

    ``fps`` holds distinct fingerprints in the column fp.
    """
    roots = connected_components(links(fps, threshold, errors))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, errors: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``df``.

    Fingerprints that differ in ``threshold`` bits or fewer are linked; component_id is the smallest doc_id reachable by
    links, the document's own included. Null and empty texts have fingerprint zero and are linked like any other;
    a null doc_id stays null and is never the smallest (component_id is null if a group has no other);
    repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
    Texts are taken whole, whatever their length.
    """
    docs = cut(with_fingerprints(df, id_col, text_col))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    member = fingerprint_groups(fps.select("fp"), threshold, errors)
    inside = fps.join(member, fps.fp == member.node)
    least = inside.groupBy("root").agg(F.min("first_doc").alias("least_doc"))
    linked = member.join(least, "root").select(F.col("node").alias("fp"), "least_doc")
    whole = cut(fps.join(linked, "fp", "left").select("fp", F.coalesce("least_doc", "first_doc").alias("component_id")))  # so that a hot fingerprint's documents can be split in the last join
    return docs.join(whole, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
