"""SimHash near-dedup of a table: one row of each group of near copies stays.

Texts with equal sets of shingles, runs of SHINGLE_WORDS words, form a class. Groups begin with operator 1: the classes' SimHash fingerprints
are linked through anchor points where they differ in few bits. Bits see only the closest copies, though: at a Jaccard similarity of 0.8 over
shingles two fingerprints differ in about 10 of 64 bits, and anchors for so wide a threshold would have every fingerprint copied to most of
them. So the links between likenesses of THRESHOLD and what bits see come from min-hashes: classes that agree in a band of
them meet in a bucket, members of a bucket are compared by all their min-hashes, and those that come out alike enough, and aren't in one group
already, are compared by their whole sets. Nothing is capped: a large bucket is compared in blocks, which become tasks of their own.

What is left to chance: two classes of likeness THRESHOLD meet in no band with a probability of about 1e-6, and less if they are more alike; and
a pair of likeness THRESHOLD is estimated below ESTIMATE with a probability of about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, cut, shingle_hashes, shuffle_partitions, written
from .components import connected_components
from .simhash import SEED, fingerprint_groups, fingerprint_of_hashes
from .spotsigs import pruned_likeness

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Min-hashes of a set; a band is made of ROWS of them, dealt out evenly.
MIN_HASHES, BANDS, ROWS = 160, 60, 6
#: Pairs whose min-hashes agree in a smaller share aren't compared by their sets.
ESTIMATE = 0.65
#: Members of a bucket that are compared at once; shingles of members whose sets are compared at once.
BLOCK, BLOCK_ENTRIES = 2048, 1 << 20
#: Others that a member may meet in a block and still be compared by pairs.
FEW = 4


# sets --------------------------------------------------------------------------------------------


def shingles_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the shingles of a UTF-8 text; a text with too few words is one shingle, one without words has none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle_words, SEED)]))


@lru_cache(maxsize=1)
def _turns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and shifts of the min-hashes, and which of them make each band."""
    r = np.random.default_rng(SEED)
    factor, shift = r.integers(0, 2**63, MIN_HASHES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, MIN_HASHES, np.uint64)
    dealt = [p[i : i + ROWS] for p in (r.permutation(MIN_HASHES) for _ in range(BANDS)) for i in range(0, MIN_HASHES - ROWS + 1, ROWS)]
    return factor, shift, np.stack(dealt[:BANDS])


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    factor, shift, _ = _turns()
    least = np.full(MIN_HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * factor + shift).min(0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's min-hashes."""
    parts = np.ascontiguousarray(least[_turns()[2]])
    return np.fromiter((xxhash.xxh3_64_intdigest(b.tobytes(), k) for k, b in enumerate(parts)), np.uint64, BANDS).view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """A byte of each min-hash: unequal ones agree in it by chance once in 256."""
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark and text: a row is named by its id and a hash of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def with_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, class, fp, sketch, bands) for every row of ``df``; a null text counts as empty, and an empty set has no sketch and no bands."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            classes, prints, sketches, bands = [], [], [], []
            for text in bytes_of(part.column(2)):
                blocks = list(shingle_hashes(text, SHINGLE_WORDS, SEED))
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                least = min_hashes(found) if len(found) else None
                classes.append(_class_of(found))
                prints.append(fingerprint_of_hashes(blocks))
                sketches.append(signature(least) if least is not None else None)
                bands.append(bands_of(least) if least is not None else [])
            columns = [*part.columns[:2], pa.array(classes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "class", "fp", "sketch", "bands"])

    return arrow_map(_named(df, id_col, text_col), over, "doc_id long, mark long, class long, fp long, sketch binary, bands array<long>")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, set) of the classes whose rows ``wanted`` names."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shingles_of(t) for t in bytes_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["class", "set"])

    rows = _named(df, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["mark"] == wanted["mark"])
    found = arrow_map(rows.join(wanted, same, "left_semi").select("text"), over, "class long, set array<long>")
    return found.dropDuplicates(["class"])


# links -------------------------------------------------------------------------------------------


def _seen_by_bits(classes: DataFrame) -> DataFrame:
    """(a, b): links between classes whose fingerprints operator 1 puts into one group, each with the least class of it."""
    rooted = classes.join(fingerprint_groups(classes.select("fp").distinct()), F.col("fp") == F.col("node"), "left").select("class", F.coalesce("root", "fp").alias("group"))
    least = rooted.groupBy("group").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rooted.join(least, "group").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sketches as rows of bytes, the share in which each of ``a`` agrees with each of ``b``."""
    out = np.empty((len(a), len(b)), np.float32)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    return out


def _shares(roots: tuple[np.ndarray, np.ndarray], sketches: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """As _agreement(), or 0 for members of one root."""
    share = _agreement(*sketches)
    share[roots[0][:, None] == roots[1][None, :]] = 0
    return share


def _dealt(members: DataFrame) -> DataFrame:
    """Members of buckets, dealt out in blocks; each pair of blocks of a bucket stands together, in (bucket, i, j).

    ``members`` has (bucket, blocks, class, root, sketch), and may have a set at the end.
    """
    rest = [c for c in members.columns if c not in ("bucket", "blocks")]
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("own", own).select("bucket", "own", other.alias("other"), *rest)
    first, last = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("bucket", first.alias("i"), last.alias("j"), (F.col("own") == first).alias("left"), *rest)
    keys = ["bucket", "i", "j"]
    return dealt.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)


def candidates(members: DataFrame) -> DataFrame:
    """(a, b): for each class in a bucket, the pair with the likest class of another root by their sketches, if they come out alike.

    ``members`` has (bucket, blocks, class, root, sketch). A bucket of several blocks is compared by pairs of blocks.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, classes, roots, sketches, _ in _blocks(batches):
            share = _shares((roots[x], roots[y]), (sketches[x], sketches[y]))
            if share.size:
                j = share.argmax(1)
                best = share[np.arange(len(j)), j]
                i = np.flatnonzero(best >= ESTIMATE)
                yield pa.RecordBatch.from_arrays([pa.array(classes[x][i]), pa.array(classes[y][j[i]]), pa.array(best[i])], ["a", "b", "share"])

    found = _dealt(members).mapInArrow(over, "a long, b long, share float")
    found = found.groupBy("a").agg(F.max(F.struct("share", "b")).alias("m")).select("a", "m.b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crowded(members: DataFrame) -> DataFrame:
    """(bucket, class, root, sketch, other): what comes out alike with a class of another root in its bucket. A member that meets FEW of them or fewer in a block
    gives its pairs, without a sketch; any other gives itself, without an ``other``. So a pair is there, or both of its ends are."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, x, y, classes, roots, sketches, _ in _blocks(batches):
            near = _shares((roots[x], roots[y]), (sketches[x], sketches[y])) >= ESTIMATE
            for here, there, met in ((x, y, near), (y, x, near.T)):
                n = met.sum(1)
                i, j = np.nonzero(met & (n <= FEW)[:, None])
                some, other = np.concatenate([here[i], here[n > FEW]]), [*classes[there[j]].tolist(), *[None] * int((n > FEW).sum())]
                sketch = pa.array([sketches[k].tobytes() if o is None else None for k, o in zip(some, other)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), bucket, np.int64)), pa.array(classes[some]), pa.array(roots[some]), sketch, pa.array(other, pa.int64())], ["bucket", "class", "root", "sketch", "other"])

    return _dealt(members).mapInArrow(over, "bucket long, class long, root long, sketch binary, other long").dropDuplicates(["bucket", "class", "other"])


def _linked(x: np.ndarray, y: np.ndarray, near: np.ndarray, roots: np.ndarray, sets: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places of pairs whose sets are alike, of those that are ``near``: enough of them to join the groups that all of them join."""
    words, ids = np.unique(np.concatenate(list(sets[y])), return_inverse=True)
    sizes = np.array([len(v) for v in sets])
    ends = np.cumsum(sizes[y])
    starts, group, held = ends - sizes[y], np.unique(roots, return_inverse=True)[1], np.zeros(len(words), bool)
    out = []
    for i, a in enumerate(x):
        js = np.flatnonzero(near[i])
        js = js[(group[y[js]] != group[a]) & (np.minimum(sizes[y[js]], sizes[a]) >= threshold * np.maximum(sizes[y[js]], sizes[a]))]
        if not len(js):
            continue
        at = np.minimum(np.searchsorted(words, sets[a]), len(words) - 1)
        at = at[words[at] == sets[a]]
        held[at] = True
        for j in js:
            b = y[j]
            if group[a] != group[b]:
                both = np.count_nonzero(held[ids[starts[j] : ends[j]]])
                if both / (sizes[a] + sizes[b] - both) >= threshold:
                    out.append((a, b))
                    group[group == group[b]] = group[a]
        held[at] = False
    return out


def verified(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all classes of a bucket whose sets are alike, a forest for each pair of blocks.

    ``members`` has (bucket, class, root, sketch), ``sets`` (class, set). Blocks hold about BLOCK_ENTRIES shingles, so that long texts make small blocks.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, classes, roots, sketches, held in _blocks(batches):
            if len(x) and len(y):
                near = _shares((roots[x], roots[y]), (sketches[x], sketches[y])) >= ESTIMATE
                pairs = _linked(x, y, near, roots, held, threshold)
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(classes[a]), pa.array(classes[b])], ["a", "b"])

    rows = members.join(sets, "class")
    blocks = rows.groupBy("bucket").agg(F.ceil(F.sum(F.size("set")) / BLOCK_ENTRIES).cast("int").alias("blocks"))
    return _dealt(rows.join(blocks, "bucket").select("bucket", "blocks", "class", "root", "sketch", "set")).mapInArrow(over, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pairs of blocks of a sorted partition, one after the other: the bucket, the places of its two sides (the same for a block with itself), then class,
    root, sketch and, where there are any, set of each place."""
    held: list[tuple] = []
    now = None

    def joined() -> tuple:
        left, classes, roots, sketches, sets = (np.concatenate(x) for x in zip(*held))
        every = np.arange(len(left))
        x, y = (every, every) if now[1] == now[2] else (every[left], every[~left])
        return now[0], x, y, classes, roots, sketches, sets

    for batch in batches:
        bucket, i, j = (np.array(batch.column(c)) for c in (0, 1, 2))
        left, classes, roots = (np.array(batch.column(c)) for c in (3, 4, 5))
        sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(bucket), MIN_HASHES)
        sets = np.empty(len(bucket), object)
        if batch.num_columns > 7:
            for k, v in enumerate(batch.column(7)):
                sets[k] = np.array(v.values)
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            key = (int(bucket[at]), int(i[at]), int(j[at]))
            if held and key != now:
                yield joined()
                held.clear()
            now = key
            held.append((left[at:end], classes[at:end], roots[at:end], sketches[at:end], sets[at:end]))
    if held:
        yield joined()


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of classes that are alike to the threshold or more."""
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("left")), sets.select(F.col("class").alias("b"), F.col("set").alias("right"))
    return pairs.join(left, "a").join(right, "b").where(pruned_likeness(F.col("left"), F.col("right"), threshold) >= threshold).select("a", "b")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their roots, of those buckets that still hold several groups."""
    rooted = members.join(roots, F.col("class") == F.col("node"), "left").select("bucket", "blocks", "class", F.coalesce("root", "class").alias("root"), "sketch")
    crowded = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return rooted.join(crowded, "bucket", "left_semi")


def _roots(members: DataFrame, edges: DataFrame, sets_of, threshold: float) -> DataFrame:
    """(node, root) for the classes that copy one another: by ``edges`` (a, b), or as members of one bucket.

    First each class is compared with the likest one of each of its buckets, which brings a crowd of copies together at the cost of a pair for each of them;
    then all that comes out alike and is still apart: members that meet few others by pairs, but for those that were, and crowds within
    their buckets by their sets, where a block gives back a forest, not pairs.
    """
    both = lambda roots, more: roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = connected_components(edges)
    seen = cut(candidates(_open(members, roots)))
    if not seen.isEmpty():
        nodes = seen.select(F.col("a").alias("class")).unionByName(seen.select(F.col("b").alias("class"))).distinct()
        roots = connected_components(both(roots, _alike(seen, sets_of(nodes), threshold)))
    left = cut(crowded(_open(members, roots)))
    if not left.isEmpty():
        pairs = left.where("other IS NOT NULL").select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        pairs, crowd = cut(pairs.join(seen, ["a", "b"], "left_anti")), left.where("other IS NULL").drop("other")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(crowd.select("class")).distinct())
        roots = connected_components(both(roots, _alike(pairs, sets, threshold).unionByName(verified(crowd, sets, threshold))))
    return roots


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, one for each group of near copies: the one with the smallest id.

    Groups join texts by chains of pairs whose sets of shingles are alike to ``threshold`` (THRESHOLD or more) or equal, or whose fingerprints differ in
    simhash.THRESHOLD bits or fewer. Null and empty texts, and texts without words, are one group. Rows are judged by their own text, so rows that share
    an id don't share a fate; of rows in a group that share the smallest id and differ in text, the one whose text has the least hash stays, and of
    rows that repeat it, one. A row without an id can't be named as a copy and stays. An empty table stays empty; other columns, whatever their
    names, go with their rows; texts are taken whole, whatever their length.
    """
    rows = written(with_classes(df, id_col, text_col), "copies")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    classes = cut(rows.groupBy("class").agg(F.min("fp").alias("fp"), F.min(F.struct("doc_id", "mark")).alias("any"), least.alias("least"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("bands").alias("bands")))
    entries = classes.select("class", F.explode("bands").alias("bucket"))
    several = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = cut(entries.join(several, "bucket").join(classes.select("class", "sketch"), "class").select("bucket", "blocks", "class", "sketch"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return written(_sets(df, classes.join(nodes, "class").select("any.doc_id", "any.mark"), id_col, text_col), "sets")

    roots = _roots(members, _seen_by_bits(classes.select("class", "fp")), sets_of, threshold)
    groups = classes.join(roots, classes["class"] == roots["node"], "left").select(F.coalesce("root", "class").alias("group"), "least")
    kept = cut(groups.groupBy("group").agg(F.min("least").alias("k")).where("k IS NOT NULL").select(F.col("k.doc_id").alias("_kept"), F.col("k.mark").alias("_mark")))
    twice = cut(rows.join(kept, (F.col("doc_id") == F.col("_kept")) & (F.col("mark") == F.col("_mark"))).groupBy("_kept", "_mark").count().where("count > 1").select("_kept", "_mark"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    at = lambda t: (F.col(id_col).cast("long") == t["_kept"]) & (mark == t["_mark"])
    lone = df.where(F.col(id_col).cast("long").isNull())
    left = df.join(kept, at(kept), "left_semi")
    if twice.isEmpty():
        return left.unionByName(lone)
    once = left.join(twice, at(twice), "left_anti")
    return once.unionByName(left.join(twice, at(twice), "left_semi").dropDuplicates([id_col])).unionByName(lone)
