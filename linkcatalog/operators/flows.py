"""Whole flows over the catalogue: repairs applied, works rebuilt, links cleaned, answers reused, tables synced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcatalog.functions import links
from linkcatalog.operators import identity, ingest
from linkcatalog.operators.repairs import DELETE_SHARE, REHOME_SHARE


# --- repairs --------------------------------------------------------------


def forecast_merges(plans: DataFrame, media: DataFrame) -> DataFrame:
    """``plans`` (media_id, kind, target_key, season) with expect_merge: does a rehomed season arrive where
    another sits that stays, or where another arrives too?"""
    moved = plans.where("kind in ('rehome', 'delete')").select("media_id")
    sits = media.join(moved, "media_id", "left_anti").select(F.col("work_key").alias("target_key"), "season")
    comes = plans.where("kind = 'rehome'").select("target_key", "season")
    there = sits.unionByName(comes).groupBy("target_key", "season").agg(F.count("*").alias("_n"))
    out = plans.join(there, ["target_key", "season"], "left")
    return out.select(*plans.columns, ((F.col("kind") == "rehome") & (F.coalesce("_n", F.lit(0)) > 1)).alias("expect_merge"))


def apply_repairs(
    media: DataFrame, bridge: DataFrame, plans: DataFrame, delete_share: float = DELETE_SHARE, rehome_share: float = REHOME_SHARE, force: bool = False
) -> dict[str, DataFrame]:
    """Deletes, then retitles, then rehomes, behind the gate of :func:`identity.blast_gate`: where the plans of any kind
    are more than its share of all seasons nothing is done at all, unless ``force``.

    ``media``: media_id, work_key, season, title; ``plans``: media_id, kind, title, target_key, season. Rehomed
    seasons that meet others at their target become one with them: the one that sits there and stays, else
    the one with the most links, takes the links of all, each once. Returns media, bridge and mapping
    (media_id, survivor).
    """
    if not force and not identity.blast_gate(plans, media, delete_share, rehome_share).where("blocked").isEmpty():
        plans = plans.limit(0)
    gone = plans.where("kind = 'delete'").select("media_id")
    media, bridge = media.join(gone, "media_id", "left_anti"), bridge.join(gone, "media_id", "left_anti")
    titled = plans.where("kind = 'retitle'").select("media_id", F.col("title").alias("_title"))
    media = media.join(titled, "media_id", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")
    counts = bridge.groupBy("media_id").agg(F.count("*").alias("links"))
    own = media.join(counts, "media_id", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumnRenamed("work_key", "work_id")
    targets = plans.where("kind = 'rehome'").select("media_id", F.col("target_key").alias("work_id"), "season")
    mapping = identity.assign_identities(own, targets)
    kept = mapping.where("media_id = survivor").select("media_id", F.col("work_id").alias("work_key"), "season")
    media = media.drop("work_key", "season").join(kept, "media_id")
    return {"media": media, "bridge": identity.move_links(bridge, mapping), "mapping": mapping.select("media_id", "survivor")}


# --- works ----------------------------------------------------------------


def rebuild_works(media: DataFrame, works: DataFrame, rulings: DataFrame) -> dict[str, DataFrame]:
    """Works made anew from the seasons whose series key no ruling has decided and that aren't junk: scan,
    aggregate, get or create, reassign. ``media``: media_id, series_key, title, year, media_type, junk, work_key;
    ``works``: work_key, title, media_type, year. Known works keep their title; type and year fill blanks.
    Returns works (with created) and media (with work_key)."""
    decided = rulings.where("state = 'decided'").select("series_key").distinct()
    free = media.where("not junk and series_key <> ''").join(decided, "series_key", "left_anti")
    made = identity.best_titles(free, "series_key").select(F.col("series_key").alias("work_key"), "title", "media_type", "year")
    o, n = works.alias("o"), made.alias("n")
    fill = lambda c, blank: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit(blank)), F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    both = o.join(n, "work_key", "full").select(
        "work_key", F.coalesce("o.title", "n.title").alias("title"), fill("media_type", "unknown"), fill("year", 0), F.col("o.title").isNull().alias("created")
    )
    moved = free.select("media_id", F.col("series_key").alias("_key"))
    seasons = media.join(moved, "media_id", "left").withColumn("work_key", F.coalesce("_key", "work_key")).drop("_key")
    return {"works": both, "media": seasons}


# --- links ----------------------------------------------------------------


#: What a link takes over from its duplicates where it has none.
FILLED = ("passcode", "title_raw", "episode_info", "size", "sharer_id", "sharer_name", "sharer_avatar_url")


def cleanup_resources(resources: DataFrame, bridge: DataFrame, provider: str = "ctfile") -> dict[str, DataFrame]:
    """Links of unknown provider whose address has the form of ``provider``, which came to be known late, become
    its links. Those that turn out the same are one: the link that had this identity before, else the
    smallest id, keeps its address, sums up how often all were seen, fills its blanks (FILLED) from the others by
    id, and takes their seasons. Links of unknown provider to pages that are no shared files go with their
    pairs. All other links stay as they are.

    ``resources``: resource_id, provider, share_id, url, seen_count, first_seen, last_seen, and any of FILLED. Returns
    resources, bridge and counts (media_id, resource_count) of the seasons that any of this touched.
    Only links of this provider are shuffled, and only the pairs of those that end.
    """
    known = F.when(F.col("provider") == "other", links.provider_of(F.col("url")))
    rows = resources.withColumn("_known", known)
    found = F.coalesce(F.col("_known.provider") == provider, F.lit(False))
    rows = rows.withColumn("_found", found).withColumn("_page", (F.col("provider") == "other") & ~found & links.is_page(F.col("url")))
    same = rows.where((F.col("provider") == provider) | F.col("_found")).withColumn("_share", F.when(F.col("_found"), F.col("_known.share_id")).otherwise(F.col("share_id")))
    place = F.struct("_found", "resource_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    alike = same.groupBy("_share").agg(
        F.min_by(F.struct("resource_id", "url", "_found"), place).alias("own"), F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), *[first(c) for c in FILLED if c in resources.columns],
    )
    renewed = {"resource_id": F.col("own.resource_id"), "url": F.col("own.url"), "provider": F.lit(provider), "share_id": F.col("_share")}
    rest = [c for c in resources.columns if c not in (*renewed, *alike.columns)]
    merged = alike
    if rest:  # columns that only the kept link tells
        merged = alike.join(resources.select(F.col("resource_id").alias("_id"), *rest), F.col("own.resource_id") == F.col("_id"))
    merged = merged.select(*[renewed.get(c, F.col(c)).alias(c) for c in resources.columns])
    others = rows.where((F.col("provider") != provider) & ~F.col("_found") & ~F.col("_page")).select(*resources.columns)
    to = same.join(alike.select("_share", F.col("own.resource_id").alias("target")), "_share").select(F.col("resource_id").alias("_old"), "target")
    ended = to.where("_old <> target").unionByName(rows.where("_page").select(F.col("resource_id").alias("_old"), F.lit(None).cast(dict(to.dtypes)["target"]).alias("target")))
    moving = bridge.join(ended, F.col("resource_id") == F.col("_old")).drop("_old")
    came = moving.where("target is not null").select("media_id", F.col("target").alias("resource_id")).distinct().join(bridge, ["media_id", "resource_id"], "left_anti")
    stayed = bridge.join(ended.select(F.col("_old").alias("resource_id")), "resource_id", "left_anti").select("media_id", "resource_id")
    pairs = stayed.unionByName(came.select("media_id", "resource_id"))
    grew = bridge.join(to.where("_old <> target").select(F.col("target").alias("resource_id")).distinct(), "resource_id", "left_semi")
    touched = moving.select("media_id").unionByName(grew.select("media_id")).distinct()
    counts = touched.join(pairs, "media_id", "left").groupBy("media_id").agg(F.count("resource_id").alias("resource_count"))
    return {"resources": others.unionByName(merged), "bridge": pairs, "counts": counts}


# --- stored answers -------------------------------------------------------


def reuse_answers(docs: DataFrame, cache: DataFrame, model: str, version: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents with the answer that this model and version gave before, documents that have none). Of answers that
    repeat the newest counts. ``cache``: key, model, version, created_at, output."""
    own = cache.where((F.col("model") == model) & (F.col("version") == version))
    last = own.groupBy(key).agg(F.max_by("output", F.struct("created_at", "output")).alias("output"))
    return docs.join(last, key), docs.join(last, key, "left_anti")


# --- table sync -----------------------------------------------------------


@dataclass(frozen=True)
class SyncTable:
    """A table of the sync: its key, its watermark column, whether rows change, and the tables it refers to."""

    name: str
    key: tuple[str, ...]
    mark: str
    mutable: bool = True
    refers: tuple[str, ...] = ()


#: The catalogue's tables; jobs sync some of them.
TABLES = (
    SyncTable("source", ("source_id",), "updated_at"),
    SyncTable("document", ("doc_id",), "updated_at", refers=("source",)),
    SyncTable("work", ("work_id",), "updated_at"),
    SyncTable("media", ("media_id",), "updated_at", refers=("work",)),
    SyncTable("resource", ("resource_id",), "updated_at"),
    SyncTable("bridge", ("media_id", "resource_id"), "created_at", False, ("media", "resource")),
    SyncTable("link_check", ("check_id",), "checked_at", False),
)
JOBS = {"collect": ("source", "document"), "catalogue": ("work", "media", "resource", "bridge"), "verify": ("resource", "link_check")}


def in_key_order(tables: tuple[SyncTable, ...]) -> list[SyncTable]:
    """Each table after those that it refers to."""
    left, out = list(tables), []
    names = {t.name for t in tables}
    while left:
        ready = [t for t in left if not {r for r in t.refers if r in names} - {o.name for o in out}]
        if not ready:
            raise ValueError("tables refer to each other in a ring")
        out += ready
        left = [t for t in left if t not in ready]
    return out


def sync_table(spec: SyncTable, target: DataFrame, source: DataFrame, watermark: int | None, overlap: int = 300) -> DataFrame:
    """The target after taking the source's rows from the watermark on (less ``overlap``, which an upsert takes
    twice without harm): last writer wins, or, of tables whose rows don't change, what is there stays."""
    new = ingest.overlap_rows(source, spec.mark, watermark, overlap)
    if not spec.mutable:
        return target.unionByName(new.join(target.select(*spec.key), list(spec.key), "left_anti").dropDuplicates(list(spec.key)))
    return ingest.upsert_latest(target, new, list(spec.key), spec.mark)


def sync(tables: tuple[SyncTable, ...], target: dict[str, DataFrame], source: dict[str, DataFrame], watermarks: dict[str, int | None]) -> dict[str, DataFrame]:
    """All tables of a job, in key order; pull and push differ in which side is the target."""
    return {t.name: sync_table(t, target[t.name], source[t.name], watermarks.get(t.name)) for t in in_key_order(tables)}


# --- history --------------------------------------------------------------


def step_history(sources: DataFrame, read: DataFrame, reopen: Column | None = None) -> DataFrame:
    """(source_id, backfill, backfill_done) after a history run: the cursor steps down to the oldest id read,
    never up; at 1, or where a page came back empty, history is done; ``reopen`` starts it again at the newest id.
    ``sources``: source_id, backfill, backfill_done, cursor; ``read``: source_id, oldest (null: an empty page)."""
    got = read.groupBy("source_id").agg(F.min("oldest").alias("_oldest"), F.bool_or(F.col("oldest").isNull()).alias("_empty"))
    out = sources.join(got, "source_id", "left")
    again = reopen if reopen is not None else F.lit(False)
    down = F.when(~F.col("backfill_done"), F.least("backfill", "_oldest")).otherwise(F.col("backfill"))
    done = F.col("backfill_done") | F.coalesce(down <= 1, F.lit(False)) | F.coalesce("_empty", F.lit(False))
    return out.select("source_id", F.when(again, F.col("cursor")).otherwise(down).alias("backfill"), (done & ~again).alias("backfill_done"))
