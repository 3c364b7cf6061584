"""Collecting: new messages, cursors, history plans, failures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcatalog.operators.checks import backoff

SEEN = 2000
DISABLE_AFTER = 50


def new_messages(fetched: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Messages whose ids the source has not shown, each once."""
    return fetched.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def keep_seen(seen: DataFrame, group: str, order: list, most: int = SEEN) -> DataFrame:
    """The last ``most`` ids of each source."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return seen.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")


def advance_cursors(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cursors after a fetch: the greatest id seen, whether its post was stored or not; a truncated
    fetch parks it as pending until one comes through. Cursors never go back. History starts at the
    oldest id of the first fetch and is done at 1.

    ``sources``: source_id, cursor, pending, backfill; ``fetched``: source_id, message_id, truncated.
    """
    got = fetched.groupBy("source_id").agg(
        F.max("message_id").alias("newest"), F.min("message_id").alias("oldest"), F.bool_or("truncated").alias("cut")
    )
    out = sources.join(got, "source_id", "left")
    whole = ~F.coalesce("cut", F.lit(False)) & F.col("newest").isNotNull()
    back = F.coalesce("backfill", "oldest")
    return out.select(
        "source_id",
        F.when(whole, F.greatest("cursor", "pending", "newest")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(whole, F.lit(None)).otherwise(F.greatest("pending", "newest")).cast("long").alias("pending"),
        back.alias("backfill"),
        F.coalesce(back <= 1, F.lit(False)).alias("backfill_done"),
    )


def plan_backfill(sources: DataFrame, pages: int, step: int = 20) -> DataFrame:
    """(source_id, before): the pages of a history run, backwards."""
    last = F.greatest(F.lit(2), F.col("backfill") - step * (pages - 1)).cast("long")
    plan = F.when(F.col("backfill") > 1, F.sequence(F.col("backfill").cast("long"), last, F.lit(-step).cast("long")))
    return sources.select("source_id", F.explode(plan).alias("before"))


def merge_state(state: DataFrame, update: DataFrame) -> DataFrame:
    """Key-value states of sources: an update's null deletes, offsets never go back."""
    both = state.alias("s").join(update.alias("u").withColumn("_u", F.lit(True)), ["source_id", "key"], "full")
    value = F.when(F.col("_u").isNull(), F.col("s.value")).otherwise(F.greatest("s.value", "u.value"))
    gone = F.coalesce("_u", F.lit(False)) & F.col("u.value").isNull()
    return both.where(~gone).select("source_id", "key", value.alias("value"))


def record_failures(sources: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """Failures in a row: wait longer each time, disabled after DISABLE_AFTER; success resets."""
    out = sources.join(failed.select("source_id", F.lit(True).alias("_f")).distinct(), "source_id", "left")
    bad = F.col("_f").isNotNull()
    n = F.when(bad, F.col("failures") + 1).otherwise(F.lit(0)).cast("long")
    return out.select(
        "source_id", n.alias("failures"), (F.lit(now) + F.when(bad, backoff(n)).otherwise(F.col("interval"))).cast("long").alias("next_run_at"),
        (F.col("enabled") & (n < DISABLE_AFTER)).alias("enabled"),
    )
