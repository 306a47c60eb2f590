"""Change logs as streams: fold each micro-batch and merge it into a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import apply_changes, fold_aggregated, with_key_changes
from ..operators.merge import prune_to
from ..parsers.ddl import added_columns, dropped_columns, is_structural, leaves_gap
from ..sources.state import StateStore

KEEP_VERSIONS = 2


class VersionedTable:
    """A Parquet table whose versions are folders; a small document names the current one.

    A micro-batch that is run again finds its own number in the document and does nothing: at-least-once delivery, exactly-once effect.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self.spark, self.folder, self.name = spark, f"{folder.rstrip('/')}/{name}", name
        self.state = StateStore(spark, self.folder)

    def current(self) -> DataFrame | None:
        """The current version; None before the first. Versions beyond the first without a document that names one are refused, not taken for an empty table."""
        now = self.state.read("current")
        if now is None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v[1-9]*")
            if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
                raise RuntimeError(f"{self.folder} has versions, but nothing says which one is current")
        return self.spark.read.parquet(f"{self.folder}/v{now['version']}") if now else None

    def replace(self, df: DataFrame, batch: int | None = None) -> None:
        now = self.state.read("current") or {"version": -1}
        version = now["version"] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.state.write("current", {"version": version, "batch": batch if batch is not None else now.get("batch", -1)})
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{version - KEEP_VERSIONS}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def seen(self, batch: int) -> bool:
        return batch <= (self.state.read("current") or {}).get("batch", -1)


def widened(target: DataFrame, log: DataFrame, added: Sequence[str]) -> DataFrame:
    """The target with columns that the log's structure changes added and its rows have, null so far."""
    there = {c.lower() for c in target.columns}
    kinds = {f.name.lower(): f for f in log.schema}
    fresh = [kinds[a.lower()] for a in dict.fromkeys(a.lower() for a in added) if a.lower() in kinds and a.lower() not in there]
    return target.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fresh))


def merge_batch(
    table: VersionedTable, key: Sequence[str], order: Sequence[str], old_key: Sequence[str] = (), clean: Callable[[DataFrame], DataFrame] | None = None, ddl: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: structure changes, key changes, cleansing, fold, prune to the target's columns, merge.

    ``ddl`` names a column with the text of a structure change, null in rows of data. Added columns are added to the target before the batch is merged; every structure change is
    filed as a task in the document ddl-tasks, with whether rows that were copied before lack its values, and drops are left to whoever reads those tasks.
    """

    def structured(batch: DataFrame, target: DataFrame | None) -> DataFrame | None:
        texts = [r[0] for r in batch.where(F.col(ddl).isNotNull()).orderBy(*order).select(ddl).collect()]  # structure changes of one batch
        if not texts:
            return target
        filed = table.state.read("ddl-tasks") or {"tasks": []}
        tasks = [{"sql": t, "added": added_columns(t), "dropped": dropped_columns(t), "gap": leaves_gap(t)} for t in texts if is_structural(t)]
        table.state.write("ddl-tasks", {"tasks": filed["tasks"] + [t for t in tasks if t not in filed["tasks"]]})
        return widened(target, batch, [a for t in tasks for a in t["added"]]) if target is not None else None

    def apply(batch: DataFrame, number: int) -> None:
        if table.seen(number) or batch.isEmpty():
            return
        target = table.current()
        if ddl:
            target = structured(batch, target)
            batch = batch.where(F.col(ddl).isNull()).drop(ddl)
        rows = with_key_changes(batch, key, old_key) if old_key else batch.withColumn("_step", F.lit(1))
        rows = clean(rows) if clean else rows
        folded = fold_aggregated(rows, key, [*order, "_step"])
        if target is None:
            target = folded.drop("op", "_step", *order).limit(0)
        wanted = prune_to(folded.drop("op", "_step"), target.columns, key).columns
        table.replace(apply_changes(target, folded.select(*wanted, "op"), key), number)

    return apply


def follow(spark: SparkSession, path: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100) -> StreamingQuery:
    """Read change files as they come, in order, and apply each batch. Offsets are in the checkpoint; they advance after the merge."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed(events: DataFrame, when: str, value: str, width: str, late: str) -> DataFrame:
    """Tumbling windows over a stream; values later than ``late`` are left out."""
    return events.withWatermark(when, late).groupBy(F.window(when, width).alias("w")).agg(F.count("*").alias("samples"), F.avg(value).alias("average"), F.max(value).alias("largest")).select(F.col("w.start").alias("slot"), "samples", "average", "largest")
