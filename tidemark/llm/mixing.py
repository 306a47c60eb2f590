"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id. Words are summed by source and hash bucket; a source's budget then falls
inside one bucket, and only that bucket is summed again by the next bits of the hash, until it holds a
single hash. Documents below the threshold are taken. Thresholds for a larger budget take all that a smaller one took,
and documents are filtered, not sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Sources in code point order, null last, weigh these again and again.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MOST = 3
#: Hash bits, and those that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits that depend on the id alone, as any engine with MD5 computes them."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: A plan of so many sources or fewer goes to every executor; a larger one is joined by source.
SMALL_PLAN = 10_000


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= SMALL_PLAN else plan


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): a row for each source of ``sized`` (source, size).

    Targets share the total by weight; a source whose share is over MOST times its size stops there, and the excess goes to the others by
    weight. So a target is the lesser of MOST times the size and weight times one level, and the level is found by summing sources in the
    order in which they stop. One row per source passes through these windows, whatever the number of documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    stop = F.lit(MOST) * F.col("source_size") / F.col("weight")
    before = Window.orderBy(stop, F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = weighed.select(
        "*",
        stop.alias("stop"),
        ((F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"),
    )
    # the first source that doesn't stop sets the level; if all stop, none matters
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", F.col("level")))).over(whole)["level"]
    return stepped.select("source", "source_size", F.least((MOST * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * level, F.lit(float("inf")))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, whole, below): documents are taken ``whole`` times, and once more where their hash is below ``below``.

    ``sized`` has (source, size, h). One histogram for each level of bits: sums by source and bucket of the documents whose hash starts with the prefix found so far.
    The loop ends when no boundary bucket has two different hashes: after as many levels as the hash has at most.
    """
    source_size = F.col("source_size")
    whole = F.when(source_size > 0, F.floor(F.col("target") / source_size)).otherwise(0).cast("long")
    found = goals.select("source", whole.alias("whole"), (F.col("target") - whole * source_size).alias("rest"))
    # prefix: leading bits of the boundary; got: words below it
    state = cut(found.select("source", "whole", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("got"), F.lit(True).alias("open")))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        goal = _small(state.select(F.col("source").alias("goal_source"), "prefix", "got", "rest").where("open"))
        inside = sized.join(goal, _same(F.col("source"), F.col("goal_source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        bars = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("got").alias("got"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("bucket")  # 2 ** LEVEL_BITS buckets of a source at most
        stacked = bars.select("*", (F.col("got") + F.sum("words").over(order)).alias("upto"))
        # the boundary: the first bucket that goes past the budget
        edge = stacked.where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("got"), "words", "low", "high")).alias("e"))
        e = edge.select(F.col("source").alias("edge_source"), "e")
        joined = state.join(e, _same(F.col("source"), F.col("edge_source")), "left")
        single = F.col("e.low") == F.col("e.high")
        # a single hash can't be parted: it is taken if that brings the sum nearer to the budget
        nearer = (F.col("e.got") + F.col("e.words") - F.col("rest")) < (F.col("rest") - F.col("e.got"))
        hit = F.col("open") & F.col("e").isNotNull()
        state = cut(
            joined.select(
                "source",
                "whole",
                "rest",
                F.when(hit & single, F.col("e.low") + F.when(nearer, 1).otherwise(0)).when(hit, F.col("e.bucket")).when(F.col("open"), F.lit(2**HASH_BITS)).otherwise(F.col("prefix")).alias("prefix"),
                F.when(hit, F.col("e.got")).otherwise(F.col("got")).alias("got"),
                (hit & ~single).alias("open"),
            )
        )
        if state.where("open").isEmpty():
            break
    return state.select("source", "whole", F.col("prefix").alias("below"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``df``: copies is how often the mix takes the document, 0 to MOST.

    Targets share 100 % of all words. Null texts have size 0; null sources are one source, the last; rows with equal ids share their fate, as
    their hashes are equal; an empty table gives an empty result; sources without words have target 0. Reruns agree. Other columns are ignored.
    """
    sized = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")).withColumn("h", hash_of(F.col("doc_id"))))
    goals = cut(targets(sized, weights))
    plan = thresholds(sized, goals)
    both = goals.join(plan.withColumnRenamed("source", "plan_source"), _same(F.col("source"), F.col("plan_source"))).drop("plan_source").withColumnRenamed("source", "goal_source")
    rows = sized.join(_small(cut(both)), _same(F.col("source"), F.col("goal_source")))
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(MOST)).alias("copies"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it, 0 to MOST times. Texts aren't shuffled for this unless there are very many sources.

    Nulls, ties, repeated rows and empty tables as in mixed(); other columns, whatever their names, go with their rows.
    """
    columns = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(columns))))
    doc, text, source = (F.col(f"_c{columns.index(c)}") for c in (id_col, text_col, source_col))
    sized = cut(plain.select(doc.alias("doc_id"), source.cast("string").alias("source"), size_of(text).alias("size")).withColumn("h", hash_of(F.col("doc_id"))))
    plan = thresholds(sized, cut(targets(sized))).select(F.col("source").alias("plan_source"), "whole", "below")
    rows = plain.withColumn("h", hash_of(doc)).join(_small(cut(plan)), _same(source.cast("string"), F.col("plan_source")))
    copies = F.least(F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0), F.lit(MOST)).cast("int")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*(f"_c{i}" for i in range(len(columns)))).toDF(*columns)
