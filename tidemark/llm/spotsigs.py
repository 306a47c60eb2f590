"""SpotSigs fingerprints: chains of content words that follow common words.

Every occurrence of a common word (an anchor) opens a chain: the next CHAIN content words, those
that are no anchors, at DISTANCE from one another. A content word that has no anchor among the FAR words before it
opens a chain itself, under the mark "*": an addition to SpotSigs, so that lists, tables and other languages are covered too. A text's fingerprint is the set of its chains,
each with its anchor. Two texts are as like as the Jaccard similarity of their sets. Everything here is
built from column functions; arrays never leave their row before they are sets of chains.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, cut, shuffle_partitions

# Very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for was on are as with be by at from this an or have not he his they were which but a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei "
    "le la les de et un une du en que qui dans pour par sur au avec pas plus est ce il "
    "el los las del y por con para su al lo como más no se"
).split()

CHAIN = 2
DISTANCE = 1
FAR = 8
THRESHOLD = 0.8
#: Hex digits that stand for a chain in a fingerprint.
DIGITS = 16

_LEAST = -(2**63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, not once for each use."""
    return F.transform(F.array(value), body)[0]


def spots(text: Column, chain: int = CHAIN, distance: int = DISTANCE) -> Column:
    """The set of chains of a text, as a sorted array of hex strings.

    A null or empty text has the empty set. A text with too few content words for any chain is one chain of all its words; a
    text without letters and digits is one chain itself.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    reach = (chain - 1) * distance + 1

    def digest(*parts: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", *parts).cast("binary")), 1, DIGITS)

    def parted(w: Column) -> Column:
        at = F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i).otherwise(-1 - i))  # of content words below 0
        return F.struct(w.alias("w"), F.filter(at, lambda i: i >= 0).alias("anchors"), F.transform(F.filter(at, lambda i: i < 0), lambda i: -1 - i).alias("content"))

    def chained(s: Column) -> Column:
        words, anchors, content = s["w"], s["anchors"], s["content"]
        whole_chains = F.size(content) - reach

        def links(start: Column) -> list[Column]:
            return [F.get(words, F.get(content, start + k * distance)) for k in range(chain)]

        # before the a-th anchor, at position i, stand i - a content words
        after = F.transform(anchors, lambda i, a: F.when(i - a <= whole_chains, digest(F.get(words, i), *links(i - a))))
        lone = F.transform(content, lambda i, j: F.when((j <= whole_chains) & (i - F.coalesce(F.get(content, j - FAR), j - FAR) == FAR), digest(F.lit("*"), *links(j))))
        found = F.filter(F.concat(after, lone), lambda d: d.isNotNull())
        return F.when(F.size(found) > 0, found).when(F.size(words) > 0, F.array(digest(F.array_join(words, " ")))).otherwise(
            F.when(F.length(whole) > 0, F.array(digest(whole))).otherwise(F.array().cast("array<string>"))
        )

    return F.array_sort(F.array_distinct(_let(_let(words, parted), chained)))


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets of chains; two empty sets are alike (1)."""
    common = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).otherwise(common / (F.size(left) + F.size(right) - common))


def pruned_likeness(left: Column, right: Column, threshold: float) -> Column:
    """As likeness(), or null below the threshold; sets of too different sizes aren't intersected at all."""
    most = F.least(F.size(left), F.size(right)) / F.greatest(F.size(left), F.size(right), F.lit(1))
    return F.when((most >= threshold) | (F.size(left) + F.size(right) == 0), likeness(left, right)).otherwise(F.lit(None))


def fingerprint(spot_set: Column) -> Column:
    """The set as one string; equal sets, and so equal texts, have equal strings."""
    return F.array_join(spot_set, "")


# neighbours in id order --------------------------------------------------------------------------


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` with a column bucket that rises with ``key``: about equal shares, cut at approximate quantiles."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, shares, 20 * buckets)).first()[0] or [])) if shares else []
    return df.withColumn("bucket", bucket_of(F.col(key), cuts))


def with_next(df: DataFrame, key: str, text: str, derived: Column, name: str) -> DataFrame:
    """``df`` with next_text and next_<name>: text and ``derived`` of the row that follows by (key, text); the first follows the last.

    Rows are dealt to buckets of neighbouring keys. At the end of each bucket goes a copy of the row
    that opens the next one, so that a window over one bucket sees every neighbour: no global order, one shuffle of the texts.
    """
    buckets = 3 * shuffle_partitions(df.sparkSession)
    rows = _dealt(df, key, buckets)
    firsts = [tuple(r) for r in rows.groupBy("bucket").agg(F.min(key)).orderBy("bucket").collect()]  # a row for each bucket
    rows = rows.withColumn("copy", F.lit(False))
    if firsts:
        opens = df.where(F.col(key).isin([k for _, k in firsts])).groupBy(key).agg(F.min(text).alias(text))
        before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
        bucket = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col(key)]
        rows = rows.unionByName(opens.select(key, text, bucket.cast("int").alias("bucket"), F.lit(True).alias("copy")), allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("copy", key, text)
    dealt = rows.repartition("bucket").withColumn(name, derived)
    follow = dealt.withColumns({f"next_{text}": F.lead(text).over(order), f"next_{name}": F.lead(name).over(order)})
    return follow.where(~F.col("copy")).drop("copy", "bucket")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next text, with their likeness.

    Edited: the last floor(n/2) code points give way to the first as many, or all, of the next document by
    ascending id (nulls first, equal ids by text; after the last comes the first; a lone document follows itself). Null texts count as
    empty; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    rows = with_next(docs, "key", "text", spots(F.col("text")), "spots")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", "next_spots")
    rows = rows.select("*", spots(F.col("edited")).alias("edited_spots"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


# near duplicates ---------------------------------------------------------------------------------


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): class of every document, and pairs of classes that are alike to ``threshold`` or more.

    members has (doc_id, class_id): documents with equal sets form one class, named by its smallest id. pairs has
    (left_id, right_id, likeness) between classes, left_id < right_id. A set of n chains is indexed by its n - ceil(threshold * n) + 1
    rarest ones, in the partition of its size: sizes whose ratio can reach the threshold lie in the same or in neighbouring
    partitions. Sizes are compared before sets are intersected. No pair is lost and none is capped. Empty sets are one class without pairs.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), spots(F.col(text_col).cast("string")).alias("spots"))
    docs = cut(docs)
    classes = docs.groupBy("spots").agg(F.min("doc_id").alias("class_id"))
    members = docs.join(classes, "spots").select("doc_id", "class_id")
    sets = cut(classes.where((F.size("spots") > 0) & F.col("class_id").isNotNull()))
    each = sets.select("class_id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    ranked = each.join(each.groupBy("spot").agg(F.count("*").alias("held_by")), "spot")
    keep = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    rarest = ranked.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("held_by", "spot"))).alias("by"))
    prefix = rarest.select("class_id", "n", F.explode(F.slice("by", F.lit(1), keep)).alias("s")).select("class_id", "n", F.col("s.spot").alias("spot"))
    part = F.floor(F.log(F.col("n").cast("double")) / log(1 / threshold)).cast("int")
    left = prefix.select(F.col("class_id").alias("left_id"), F.col("n").alias("left_n"), "spot", F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("right_id"), F.col("n").alias("right_n"), "spot", part.alias("part"))
    close = F.least("left_n", "right_n") >= threshold * F.greatest("left_n", "right_n") - 1e-9
    found = left.join(right, ["spot", "part"]).where((F.col("left_id") < F.col("right_id")) & close).select("left_id", "right_id").distinct()
    a, b = sets.select(F.col("class_id").alias("left_id"), F.col("spots").alias("a")), sets.select(F.col("class_id").alias("right_id"), F.col("spots").alias("b"))
    pairs = found.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", pruned_likeness(F.col("a"), F.col("b"), threshold).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)
