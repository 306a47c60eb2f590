"""Alerts from signals: announce what is new, repeat after a while, tell when it is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "category string, subject string, last_sent timestamp, active boolean"
CATEGORIES = ("SYNC_FAILURE", "POLLING_STUCK", "PROJECT_DOWN", "CDC_STALLED", "DATA_DRIFT", "CONNECTION_UNHEALTHY", "SLOT_BACKLOG", "TARGET_REPAIRED", "DDL_SKIPPED")


def evaluate(signals: DataFrame, state: DataFrame, now: Column, cooldown_minutes: int, enabled: tuple[str, ...] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(announcements, new state). An announcement is NEW, REPEAT or RECOVERED for a (category, subject).

    Signals with one key count once. State of an enabled category whose signal is gone is announced as recovered and
    dropped; of a category that was switched off it is dropped silently.
    """
    key = ["category", "subject"]
    current = signals.where(F.col("category").isin(*enabled)).groupBy(*key).agg(F.first("detail", ignorenulls=True).alias("detail"))
    both = current.withColumn("_now", F.lit(True)).join(state.where("active"), key, "full_outer")
    due = F.col("last_sent") <= now - F.expr(f"INTERVAL {cooldown_minutes} MINUTES")
    event = F.when(F.col("_now") & F.col("active").isNull(), "NEW").when(F.col("_now") & due, "REPEAT").when(F.col("_now").isNull() & F.col("category").isin(*enabled), "RECOVERED")
    judged = both.withColumn("event", event)
    sent = F.when(F.col("event").isin("NEW", "REPEAT"), now).otherwise(F.col("last_sent"))
    return judged.where("event IS NOT NULL").select(*key, "event", "detail"), judged.where("_now").select(*key, sent.alias("last_sent"), F.lit(True).alias("active"))
