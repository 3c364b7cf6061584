"""Repairs as a queue: tasks are applied in batches, each one commit, so that a round goes on where it was cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcatalog.operators import identity
from linkcatalog.storage import stored
from linkcatalog.store import Change, Remove, Store, Upsert, Version

DELETE, RETITLE, REHOME = "delete", "retitle", "rehome"
#: Shares of all seasons that a round may delete or rehome.
DELETE_SHARE, REHOME_SHARE = 0.05, 0.2
MAX_TITLE = 500
TASK = (
    "task_id bigint, media_id bigint, kind string, symptom string, title string, media_type string, year bigint, target_key string, season int, "
    "status string, detected_at bigint, applied_at bigint"
)


class BlastRadiusExceeded(RuntimeError):
    """A round would change more seasons than one may."""


def check_blast_radius(counts: dict[str, int], total: int, delete_share: float = DELETE_SHARE, rehome_share: float = REHOME_SHARE) -> None:
    """Raises where any kind is beyond its share: then the whole round is refused, whatever the other kinds."""
    for kind, share in ((DELETE, delete_share), (REHOME, rehome_share)):
        if total and counts.get(kind, 0) > share * total:
            raise BlastRadiusExceeded(f"{counts[kind]} {kind} tasks of {total} seasons are more than {share:.0%}")


def _pending(tasks: DataFrame, kind: str) -> DataFrame:
    return tasks.where((F.col("status") == "pending") & (F.col("kind") == kind))


def _closed(own: DataFrame, applied: DataFrame, now: int) -> DataFrame:
    """Tasks after their batch: applied, or skipped where there was nothing to do."""
    hit = own.join(applied.select("task_id", F.lit(True).alias("_did")), "task_id", "left")
    status = F.when(F.col("_did"), "applied").otherwise("skipped")
    return hit.select(*[{"status": status, "applied_at": F.lit(now).cast("long")}.get(c, F.col(c)).alias(c) for c in own.columns])


def delete_batch(own: DataFrame, media: DataFrame, bridge: DataFrame, now: int) -> dict[str, Change]:
    """Seasons go with their links; a task whose season is gone already is skipped."""
    alive = own.join(media.select("media_id"), "media_id", "left_semi")
    held = bridge.join(alive.select("media_id"), "media_id", "left_semi")
    return {"media": Remove(alive.select("media_id")), "bridge": Remove(held), "repair_task": Upsert(_closed(own, alive, now))}


def retitle_batch(own: DataFrame, media: DataFrame, now: int) -> dict[str, Change]:
    """Titles, types and years are renewed, blanks of the task keeping what is there; a task is skipped where its
    season is gone or has these values already."""
    t, m = own.alias("t"), media.alias("m")
    both = t.join(m, F.col("t.media_id") == F.col("m.media_id"))
    new = {
        "title": F.left(F.coalesce(F.nullif("t.title", F.lit("")), F.col("m.title")), F.lit(MAX_TITLE)),
        "media_type": F.coalesce("t.media_type", "m.media_type"),
        "year": F.coalesce("t.year", "m.year"),
    }
    differs = F.lit(False)
    for c, x in new.items():
        differs = differs | ~x.eqNullSafe(F.col(f"m.{c}"))
    changed = both.where(differs)
    rows = changed.select(*[new.get(c, F.col(f"m.{c}")).alias(c) for c in media.columns])
    return {"media": Upsert(rows), "repair_task": Upsert(_closed(own, changed.select("t.task_id"), now))}


def _bound(tasks: DataFrame, media: DataFrame) -> DataFrame:
    """The tasks whose seasons are there; one that names no season keeps the season's own."""
    return tasks.join(media.select("media_id", F.col("season").alias("_own")), "media_id").withColumn("season", F.coalesce("season", "_own")).drop("_own")


def _first_whole(own: DataFrame, media: DataFrame, batch: int) -> DataFrame:
    """The first ``batch`` tasks and all others to the same targets: seasons that meet are weighed together, however
    the tasks are dealt to batches."""
    first = stored(own.orderBy("detected_at", "task_id").limit(batch), "repair-first")
    goals = _bound(first, media).select("target_key", "season").distinct()
    same = _bound(own, media).join(goals, ["target_key", "season"], "left_semi").select("task_id")
    return stored(own.join(same.unionByName(first.select("task_id")).distinct(), "task_id", "left_semi"), "repair-batch")


def rehome_batch(own: DataFrame, media: DataFrame, bridge: DataFrame, works: DataFrame, now: int, leaving: DataFrame | None = None) -> dict[str, Change | list[Change]]:
    """Seasons move to their targets, with their new titles. Those that meet there become one, with the links of all
    and the blanks of year and type filled; missing works are made first. Only seasons of the batch and those
    that sit at its targets are met, less those that are ``leaving`` (media_id) by a later batch of the round."""
    alive = _bound(own, media)
    targets = alive.select("media_id", F.col("target_key").alias("work_id"), "season")
    goals = targets.select(F.col("work_id").alias("work_key"), "season").distinct()
    there = media.join(goals, ["work_key", "season"], "left_semi")
    if leaving is not None:
        there = there.join(leaving, "media_id", "left_anti")
    met = there.unionByName(media.join(alive.select("media_id"), "media_id", "left_semi")).dropDuplicates(["media_id"])
    held = bridge.join(met.select("media_id"), "media_id", "left_semi")
    counts = held.groupBy("media_id").agg(F.count("*").alias("links"))
    sized = met.join(counts, "media_id", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumnRenamed("work_key", "work_id")
    mapping = identity.assign_identities(sized, targets)
    merged = mapping.where("media_id <> survivor")
    titles = alive.select("media_id", F.left("title", F.lit(MAX_TITLE)).alias("_title"))
    filled = identity.merge_attributes(met.join(mapping.select("media_id", "survivor"), "media_id").drop("work_key", "season"), "survivor")
    filled = filled.join(merged.select("survivor").distinct(), "survivor", "left_semi").select(
        F.col("survivor").alias("media_id"), F.col("year").alias("_year"), F.col("media_type").alias("_type")
    )
    kept = mapping.where("media_id = survivor").select("media_id", F.col("work_id").alias("_key"), F.col("season").alias("_season"))
    rows = met.join(kept, "media_id").join(titles, "media_id", "left").join(filled, "media_id", "left")
    new = {
        "work_key": F.col("_key"), "season": F.col("_season"), "title": F.coalesce(F.nullif("_title", F.lit("")), F.col("title")),
        "year": F.coalesce("_year", "year"), "media_type": F.coalesce("_type", "media_type"),
    }
    rows = rows.select(*[new.get(c, F.col(c)).alias(c) for c in media.columns])
    moved = held.join(merged.select("media_id", "survivor"), "media_id")
    came = moved.select(F.col("survivor").alias("media_id"), "resource_id").distinct().join(held, ["media_id", "resource_id"], "left_anti")
    first = F.min_by(F.struct("title", "media_type", "year"), F.struct("detected_at", "task_id")).alias("f")
    spec = alive.groupBy(F.col("target_key").alias("work_key")).agg(first).select("work_key", F.coalesce("f.title", F.lit("")).alias("title"), "f.media_type", "f.year")
    both = spec.alias("n").join(works.alias("o"), "work_key", "left")
    fill = lambda c, blank: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit(blank)), F.col(f"n.{c}"), F.lit(blank)).alias(c)
    made = both.select("work_key", F.coalesce("o.title", "n.title").alias("title"), fill("media_type", "unknown"), fill("year", 0))
    return {
        "work": Upsert(made), "media": [Upsert(rows), Remove(merged.select("media_id"))],
        "bridge": [Upsert(came), Remove(moved.select("media_id", "resource_id"))], "repair_task": Upsert(_closed(own, alive, now)),
    }


def run_round(store: Store, now: int, limit: int | None = None, force: bool = False, dry_run: bool = False, batch: int = 100_000) -> dict[str, int]:
    """Drains the pending tasks: deletes, then retitles, then rehomes, those detected first coming first.

    Tables: media (media_id, work_key, season, title, media_type, year), bridge (media_id, resource_id), work
    (work_key, title, media_type, year), repair_task (TASK). At most ``limit`` tasks of each kind; beyond the blast
    radius the whole round is refused, unless ``force``. A dry run stops behind that gate. Deletes are one
    commit, the others one for each ``batch`` tasks; rehomes to one target stay in one batch, and what a later batch takes
    away is not met: batches leave what one commit of all would. A batch that another writer got before is made anew on what
    that left; one that fails stays pending with those after it, and the next round takes them. Returns what the
    round found, and the tasks that it closed by kind and status.
    """
    at = store.current()
    tasks = store.read("repair_task", at)
    place = F.struct("detected_at", "task_id")
    ends, counts = {}, {}
    for kind in (DELETE, RETITLE, REHOME):
        own = _pending(tasks, kind)
        own = own if limit is None else own.orderBy("detected_at", "task_id").limit(limit)
        n, end = own.agg(F.count("*"), F.max(place)).first()
        counts[kind], ends[kind] = n, end
    if not force:
        check_blast_radius(counts, store.read("media", at).count())
    if dry_run:
        return counts
    for kind in (DELETE, RETITLE, REHOME):
        if not counts[kind]:
            continue
        until = place <= F.struct(*[F.lit(x).cast("long") for x in ends[kind]])

        def work(at: Version, kind: str = kind, until=until) -> dict[str, Change | list[Change]]:
            rest = _pending(store.read("repair_task", at), kind).where(until)
            if rest.isEmpty():
                return {}
            media = store.read("media", at)
            own = {DELETE: lambda: rest, RETITLE: lambda: rest.orderBy("detected_at", "task_id").limit(batch), REHOME: lambda: _first_whole(rest, media, batch)}[kind]()
            if kind == DELETE:
                return delete_batch(own, media, store.read("bridge", at), now)
            if kind == RETITLE:
                return retitle_batch(own, media, now)
            leaving = rest.join(own.select("task_id"), "task_id", "left_anti").select("media_id")
            return rehome_batch(own, media, store.read("bridge", at), store.read("work", at), now, leaving)

        while store.transact(work):
            pass
    closed = store.read("repair_task").where((F.col("applied_at") == now) & (F.col("status") != "pending")).groupBy("kind", "status").count().collect()
    return counts | {f"{kind}_{status}": n for kind, status, n in closed}


def enqueue(store: Store, plans: DataFrame, now: int) -> Version | None:
    """Plans (columns of TASK, without status and times) become tasks, as :func:`identity.sync_tasks` says: of a
    season's pending tasks one stays, refreshed if the plan differs, skipped where there is no plan any more."""

    def work(at: Version) -> dict[str, Change | list[Change]]:
        tasks = store.read("repair_task", at)
        old = tasks.where("status = 'pending'")
        names = ["media_id", "kind", "symptom", "title", "media_type", "year", "target_key", "season"]
        p = plans.select("task_id", *names)
        same = old.select("media_id", F.col("task_id").alias("_id"), F.col("kind").alias("_kind"), F.col("detected_at").alias("_at"))
        both = p.join(same, "media_id", "left")
        stays = F.col("_kind").eqNullSafe(F.col("kind"))
        new = both.select(
            F.when(stays, F.col("_id")).otherwise(F.col("task_id")).alias("task_id"), *names, F.lit("pending").alias("status"),
            F.when(stays, F.col("_at")).otherwise(F.lit(now)).cast("long").alias("detected_at"), F.lit(None).cast("long").alias("applied_at"),
        )
        over = old.join(p.select("media_id", "kind"), ["media_id", "kind"], "left_anti").withColumn("status", F.lit("skipped")).withColumn("applied_at", F.lit(now).cast("long"))
        return {"repair_task": Upsert(new.select(*tasks.columns).unionByName(over.select(*tasks.columns)))}

    return store.transact(work)
