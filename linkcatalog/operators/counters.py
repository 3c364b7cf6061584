"""Counters and statistics over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def media_counters(media: DataFrame, bridge: DataFrame, resources: DataFrame) -> DataFrame:
    """Links and valid links per season; seasons without a link go."""
    counts = bridge.join(resources.select("resource_id", "check_status"), "resource_id").groupBy("media_id").agg(
        F.count("*").alias("resource_count"), F.count_if(F.col("check_status") == "valid").alias("valid_count")
    )
    return media.select("media_id", "work_id").join(counts, "media_id")


def work_counters(works: DataFrame, counted: DataFrame) -> DataFrame:
    """Seasons, links and valid links per work; works without seasons keep zeros."""
    sums = counted.groupBy("work_id").agg(
        F.count("*").alias("season_count"), F.sum("resource_count").alias("resource_count"), F.sum("valid_count").alias("valid_count")
    )
    return works.select("work_id").join(sums, "work_id", "left").na.fill(0)


def recount_tags(tags: DataFrame, media_tag: DataFrame) -> DataFrame:
    """(tag, old, media_count, changed)."""
    counts = media_tag.groupBy("tag").agg(F.count("*").alias("n"))
    out = tags.join(counts, "tag", "left").withColumn("media_count", F.coalesce("n", F.lit(0)))
    return out.select("tag", "old", "media_count", (F.col("media_count") != F.col("old")).alias("changed"))


def by_status(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value with their share, most first."""
    out = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def provider_by_check(resources: DataFrame) -> DataFrame:
    """Per provider: all, valid, unchecked, invalid and other links."""
    s = F.col("check_status")
    named = ("valid", "unchecked", "invalid")
    return resources.groupBy("provider").agg(
        F.count("*").alias("total"),
        *[F.count_if(s == x).alias(x) for x in named],
        F.count_if(~s.isin(*named)).alias("other"),
    )


def orphans(resources: DataFrame, bridge: DataFrame) -> DataFrame:
    """Links that no season has."""
    return resources.join(bridge, "resource_id", "left_anti")


def stats_report(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per metric: name and value."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.union(one)
    return out


def progress(stage: str, rows: DataFrame, status: str) -> DataFrame:
    s = F.col(status)
    return rows.agg(
        F.count_if(s == "pending").alias("pending"), F.count_if(s == "running").alias("running"), F.count_if(s == "done").alias("done")
    ).select(F.lit(stage).alias("stage"), "pending", "running", "done")


def tag_retag(tags: DataFrame, media_tag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags ``(tag, kind, norm_key, new_kind)`` under their new kind: those that meet become one, the
    smallest, which takes all their seasons once. Returns (tags with counts, pairs)."""
    target = tags.groupBy("new_kind", "norm_key").agg(F.min("tag").alias("target"))
    moved = tags.join(target, ["new_kind", "norm_key"])
    pairs = media_tag.join(moved.select("tag", "target"), "tag").select("media_id", F.col("target").alias("tag")).distinct()
    counts = pairs.groupBy("tag").agg(F.count("*").alias("media_count"))
    kept = target.select(F.col("target").alias("tag"), F.col("new_kind").alias("kind"), "norm_key")
    return kept.join(counts, "tag", "left").withColumn("media_count", F.coalesce("media_count", F.lit(0))), pairs
