"""Entity resolution: works from seasons, rulings, merges, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALIAS_CAP = 50


def pick_survivor(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each group the row with the most links, then the greatest id as text."""
    return rows.groupBy(*group).agg(F.max_by("media_id", F.struct("links", F.col("media_id").cast("string"))).alias("survivor"))


def best_titles(rows: DataFrame, key: str) -> DataFrame:
    """Per key: the most frequent title (then the shortest, then the greatest), the smallest known
    year, and the first known type by media_id. Two levels of aggregation: titles first."""
    titles = rows.groupBy(key, "title").agg(F.count("*").alias("n"))
    best = titles.groupBy(key).agg(F.max_by("title", F.struct(F.col("n"), -F.length("title"), F.col("title"))).alias("title"))
    known = F.when(F.col("media_type") != "unknown", F.struct("media_id", "media_type"))
    rest = rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.min(F.nullif(F.col("year"), F.lit(0))).alias("year"), F.min(known)["media_type"].alias("media_type")
    )
    return best.join(rest, key).withColumn("year", F.coalesce("year", F.lit(0))).withColumn("media_type", F.coalesce("media_type", F.lit("unknown")))


def majority(rows: DataFrame, key: str) -> DataFrame:
    """Per key the most frequent title and the most frequent known type, ties to the smallest."""
    t = rows.groupBy(key, "title").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("title", F.struct(-F.col("n"), F.col("title"))).alias("title"))
    m = (
        rows.where("media_type <> 'unknown'").groupBy(key, "media_type").agg(F.count("*").alias("n"))
        .groupBy(key).agg(F.min_by("media_type", F.struct(-F.col("n"), F.col("media_type"))).alias("media_type"))
    )
    return t.join(m, key, "left").withColumn("media_type", F.coalesce("media_type", F.lit("unknown")))


def blocks(rows: DataFrame, pack: int = 50) -> DataFrame:
    """(block_key, series_key, rows, resources, place): entries of blocks with two keys or more, by
    resources, rows, key. Blocks hold few keys each."""
    entries = rows.groupBy("block_key", "series_key").agg(F.count("*").alias("rows"), F.sum("links").alias("resources"))
    many = entries.groupBy("block_key").agg(F.count("*").alias("keys")).where("keys >= 2")
    order = Window.partitionBy("block_key").orderBy(F.desc("resources"), F.desc("rows"), "series_key")
    out = entries.join(many, "block_key").withColumn("place", F.row_number().over(order))
    return out.withColumn("pack", F.floor((F.col("place") - 1) / pack).cast("long"))


def best_decision(decisions: DataFrame, key: str) -> DataFrame:
    """The ruling of most confidence (null counts 0), the first of equals."""
    best = F.max_by(F.struct(*decisions.columns), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("position")))
    return decisions.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def resolve_target(items: DataFrame, rulings: DataFrame) -> DataFrame:
    """Items with their target: dropped by a junk ruling, ruled fields with fallbacks where decided,
    the item's own otherwise. Items without a ruling are marked pending."""
    r = rulings.select("series_key", F.col("state"), F.col("junk"), F.col("work_key").alias("_k"), F.col("season").alias("_s"), F.col("media_type").alias("_t"), F.col("year").alias("_y"))
    out = items.join(r, "series_key", "left")
    decided = F.coalesce(F.col("state") == "decided", F.lit(False))
    known = lambda a, b, blank: F.when(decided, F.coalesce(F.nullif(a, blank), b)).otherwise(b)
    return out.select(
        "item_id", "series_key",
        F.when(decided, F.coalesce(F.col("_k"), F.col("series_key"))).otherwise(F.col("series_key")).alias("target_key"),
        F.when(decided, F.coalesce(F.col("_s"), F.col("season"))).otherwise(F.col("season")).alias("target_season"),
        known(F.col("_t"), F.col("media_type"), F.lit("unknown")).alias("target_type"),
        known(F.col("_y"), F.col("year"), F.lit(0)).alias("target_year"),
        (decided & F.coalesce("junk", F.lit(False))).alias("dropped"),
        F.col("state").isNull().alias("pending"),
    )


def assign_identities(media: DataFrame, targets: DataFrame) -> DataFrame:
    """(media_id, survivor, work_id, season): rows that end at one identity become one.

    A row that sits at the identity and stays wins; else the one with the most links. All rows'
    final identities are computed at once, so that swaps need no parking.
    """
    t = targets.select("media_id", F.col("work_id").alias("_w"), F.col("season").alias("_s"))
    out = media.join(t, "media_id", "left")
    w, s = F.coalesce("_w", "work_id"), F.coalesce("_s", "season")
    sits = (w == F.col("work_id")) & (s == F.col("season"))
    out = out.select("media_id", "links", w.alias("work_id"), s.alias("season"), sits.alias("sits"))
    best = out.groupBy("work_id", "season").agg(
        F.max_by("media_id", F.struct("sits", "links", F.col("media_id").cast("string"))).alias("survivor")
    )
    return out.join(best, ["work_id", "season"]).select("media_id", "survivor", "work_id", "season")


def merge_attributes(rows: DataFrame, group: str) -> DataFrame:
    """Of each group's rows: the smallest known year, the first known type and text (survivor first,
    then by id), and the distinct titles in that order as aliases, ALIAS_CAP at most.

    Titles are made distinct first, and only the first ALIAS_CAP of a group are ever gathered."""
    place = F.struct((F.col("media_id") != F.col(group)).cast("int").alias("o"), F.col("media_id").alias("i"))
    first = lambda c, blank=None: F.min(
        F.when(F.col(c).isNotNull() & (F.lit(True) if blank is None else F.col(c) != blank), F.struct(place.alias("p"), F.col(c).alias("v")))
    )["v"]
    one = rows.groupBy(group).agg(
        F.coalesce(F.min(F.nullif(F.col("year"), F.lit(0))), F.lit(0)).alias("year"),
        F.coalesce(first("media_type", "unknown"), F.lit("unknown")).alias("media_type"),
        first("title").alias("title"),
    )
    titles = rows.where("title is not null").groupBy(group, F.col("title").alias("alias")).agg(F.min(place).alias("p"))
    titles = titles.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("p"))).where(F.col("rn") <= ALIAS_CAP)
    listed = titles.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "alias"))), lambda x: x["alias"]), "|").alias("aliases"))
    return one.join(listed, group, "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def upsert_works(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known works keep their title and take a type or year only where they have none; a further title
    becomes an alias, after those they have; unknown keys are new works."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "full")
    fill = lambda c, blank: F.coalesce(F.nullif(f"o.{c}", F.lit(blank)), f"n.{c}", f"o.{c}").alias(c)
    other = F.when(F.col("n.title").isNotNull() & F.col("o.title").isNotNull() & (F.col("n.title") != F.col("o.title")), F.array("n.title"))
    kept = F.coalesce("o.aliases", F.array().cast("array<string>"))
    aliases = F.slice(F.array_distinct(F.concat(kept, F.coalesce(other, F.array().cast("array<string>")))), 1, ALIAS_CAP)
    return both.select(key, F.coalesce("o.title", "n.title").alias("title"), fill("media_type", "unknown"), fill("year", 0), aliases.alias("aliases"))


def prompt_packs(entries: DataFrame) -> DataFrame:
    """(block_key, pack, message): the entries of each pack as numbered lines; a pack holds 50 at most."""
    line = F.format_string("%d. %s (%d rows, %d links)", F.col("place"), F.col("series_key").cast("string"), F.col("rows"), F.col("resources"))
    listed = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return entries.groupBy("block_key", "pack").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("message"))


def move_links(bridge: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links of merged seasons under their survivors, each once."""
    m = mapping.select("media_id", "survivor")
    return bridge.join(m, "media_id", "left").select(F.coalesce("survivor", "media_id").alias("media_id"), "resource_id").distinct()


def plan_repairs(facts: DataFrame) -> DataFrame:
    """(media_id, kind, symptom): junk, empty shell, drifted key, drifted title, in this order.

    ``facts``: media_id, junk, links, ruled_junk, stored_key, target_key, title, clean.
    """
    kind = (
        F.when(F.col("junk"), F.struct(F.lit("delete").alias("kind"), F.lit("junk").alias("symptom")))
        .when(F.col("links") == 0, F.struct(F.lit("delete").alias("kind"), F.lit("empty_shell").alias("symptom")))
        .when(F.col("ruled_junk"), F.struct(F.lit("delete").alias("kind"), F.lit("junk").alias("symptom")))
        .when((F.col("target_key") != "") & ~F.col("target_key").eqNullSafe(F.col("stored_key")), F.struct(F.lit("rehome").alias("kind"), F.lit("key_drift").alias("symptom")))
        .when(F.col("clean") != F.col("title"), F.struct(F.lit("retitle").alias("kind"), F.lit("title_drift").alias("symptom")))
    )
    return facts.withColumn("_p", kind).where("_p is not null").select("media_id", "_p.kind", "_p.symptom")


def sync_tasks(tasks: DataFrame, plans: DataFrame) -> DataFrame:
    """Pending tasks against new plans: unchanged, refreshed, skipped (other kind or no plan), created."""
    t = tasks.where("status = 'pending'").select("media_id", F.col("kind").alias("old_kind"), F.col("symptom").alias("old_symptom"))
    out = t.join(plans, "media_id", "full")
    same = F.col("kind") == F.col("old_kind")
    action = (
        F.when(F.col("old_kind").isNull(), "created")
        .when(F.col("kind").isNull(), "skipped")
        .when(~same, "replaced")
        .when(F.col("symptom") == F.col("old_symptom"), "unchanged")
        .otherwise("refreshed")
    )
    return out.select("media_id", F.coalesce("kind", "old_kind").alias("kind"), action.alias("action"))


def blast_gate(plans: DataFrame, media: DataFrame, delete_share: float = 0.05, rehome_share: float = 0.2) -> DataFrame:
    """Per gated kind: planned rows, all seasons, and whether the plan is beyond its share."""
    total = F.lit(media.count())
    shares = plans.sparkSession.createDataFrame([("delete", delete_share), ("rehome", rehome_share)], "kind string, share double")
    counts = plans.groupBy("kind").agg(F.count("*").alias("n"))
    out = shares.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("kind", "n", total.cast("long").alias("total"), ((total > 0) & (F.col("n") > F.col("share") * total)).alias("blocked"))


def retype(stored: Column, found: Column) -> Column:
    """Book and comic always override, unknown never does, a known type stays."""
    return F.when(found.isin("book", "comic"), found).when((stored == "unknown") & (found != "unknown"), found).otherwise(stored)


def prune_empty(media: DataFrame, bridge: DataFrame, works: DataFrame, now: int, age: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(seasons without links, works then without seasons), older than ``age`` seconds."""
    gone = media.join(bridge, "media_id", "left_anti").where(F.col("created_at") < now - age)
    left = media.join(gone.select("media_id"), "media_id", "left_anti")
    return gone, works.join(left, "work_id", "left_anti").where(F.col("created_at") < now - age)


def merge_resources(rows: DataFrame, key: list[str]) -> DataFrame:
    """Links that turn out the same: mentions summed, first and last seen, the first known size."""
    return rows.groupBy(*key).agg(
        F.min("resource_id").alias("resource_id"), F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.min(F.when(F.col("size").isNotNull(), F.struct("resource_id", "size")))["size"].alias("size"),
    )
