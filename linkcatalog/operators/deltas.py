"""Counts kept up to date by signed edits: what changed is read, what stayed isn't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcatalog.storage import stored
from linkcatalog.store import Remove, Store, Upsert, Version


@dataclass
class Edits:
    """What happened to the links of seasons, each part optional.

    added, removed: media_id, resource_id, valid (as it was before, for removed, and is after, for added); each
    pair is new or was there. flipped: resource_id, valid, of links whose validity changed, with ``links``, the
    pairs that were there before, where the flipped ones are looked up. moved: media_id, work_id, of seasons that
    are now of this work; new seasons come here too.
    """

    added: DataFrame | None = None
    removed: DataFrame | None = None
    flipped: DataFrame | None = None
    links: DataFrame | None = None
    moved: DataFrame | None = None


def link_deltas(edits: Edits) -> DataFrame | None:
    """(media_id, links, valid): by how much each season's counts change."""
    parts = []
    for rows, sign in ((edits.added, 1), (edits.removed, -1)):
        if rows is not None:
            parts.append(rows.select("media_id", F.lit(sign).alias("links"), (F.col("valid").cast("int") * sign).alias("valid")))
    if edits.flipped is not None:
        held = edits.links.join(edits.flipped, "resource_id")
        if edits.removed is not None:  # of these those alone whose link flipped
            gone = edits.removed.select("media_id", "resource_id").join(edits.flipped.select("resource_id"), "resource_id", "left_semi")
            held = held.join(gone, ["media_id", "resource_id"], "left_anti")
        parts.append(held.select("media_id", F.lit(0).alias("links"), F.when(F.col("valid"), 1).otherwise(-1).alias("valid")))
    out = None
    for x in parts:
        out = x if out is None else out.unionByName(x)
    return None if out is None else out.groupBy("media_id").agg(F.sum("links").alias("links"), F.sum("valid").alias("valid"))


def changed_counts(media: DataFrame, works: DataFrame, edits: Edits) -> tuple[DataFrame, DataFrame]:
    """The rows of ``media`` (media_id, work_id, resource_count, valid_count) and ``works`` (work_id, season_count,
    resource_count, valid_count) that the edits change, with their new counts. Seasons left without links come
    with a count of 0; a work counts seasons with links alone.

    Only edited seasons and their works are met: the counts that are stored are filtered by them, and no links
    are read but those of flipped ones. What becomes of the edited seasons is written once, for both results."""
    spark = media.sparkSession
    by = link_deltas(edits)
    by = by if by is not None else spark.createDataFrame([], "media_id long, links long, valid long")
    moved = edits.moved if edits.moved is not None else spark.createDataFrame([], "media_id long, work_id long")
    edit = by.join(moved.select("media_id", F.col("work_id").alias("to_work")), "media_id", "full")
    old = media.select("media_id", F.col("work_id").alias("from_work"), F.col("resource_count").alias("had"), F.col("valid_count").alias("had_valid"))
    after = edit.join(old, "media_id", "left")
    zero = F.lit(0).cast("long")
    after = after.select(
        "media_id", "from_work", F.coalesce("to_work", "from_work").alias("work_id"), "had", "had_valid",
        (F.coalesce("had", zero) + F.coalesce("links", zero)).alias("resource_count"), (F.coalesce("had_valid", zero) + F.coalesce("valid", zero)).alias("valid_count"),
    )
    after = stored(after, "edited-seasons")
    gone = after.where("had is not null").select(F.col("from_work").alias("work_id"), F.lit(-1).alias("s"), (-F.col("had")).alias("r"), (-F.col("had_valid")).alias("v"))
    come = after.where("resource_count > 0").select("work_id", F.lit(1).alias("s"), F.col("resource_count").alias("r"), F.col("valid_count").alias("v"))
    sums = gone.unionByName(come).where("work_id is not null").groupBy("work_id").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("v").alias("v"))
    sums = sums.where("s <> 0 or r <> 0 or v <> 0").join(works, "work_id", "left")
    plus = lambda c, d: (F.coalesce(c, zero) + F.col(d)).alias(c)
    new_works = sums.select("work_id", plus("season_count", "s"), plus("resource_count", "r"), plus("valid_count", "v"))
    return after.select("media_id", "work_id", "resource_count", "valid_count"), new_works


def apply_edits(store: Store, edits: Edits, writer: str, epoch: int) -> Version | None:
    """Merges the edits of an epoch into the stored counts, once: the epoch is the watermark of what is counted."""

    def work(at: Version) -> dict:
        media, works = changed_counts(store.read("media_count", at), store.read("work_count", at), edits)
        return {"media_count": [Upsert(media.where("resource_count > 0")), Remove(media.where("resource_count <= 0"))], "work_count": Upsert(works)}

    return store.transact(work, writer, epoch)
