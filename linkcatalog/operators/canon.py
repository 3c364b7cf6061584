"""Rulings on titles and the catalogue built from posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcatalog.functions import titles
from linkcatalog.functions.text import let
from linkcatalog.operators import extract, identity

JUNK_CONFIDENCE = 0.9
MEDIA_TYPES = extract.MEDIA_TYPES


def _first_of_key(answers: DataFrame) -> DataFrame:
    order = Window.partitionBy("pack", "key").orderBy("position")
    return answers.withColumn("_rn", F.row_number().over(order))


def validate_decisions(entries: DataFrame, answers: DataFrame, key_of: Column | None = None) -> DataFrame:
    """Answers ``(pack, position, key, work_title, is_junk, season, year, media_type)`` with a verdict:
    ok, unknown_key (not asked), duplicate_key (the first counts) or empty_work_title.

    ``entries``: pack, key. ``key_of`` gives the work's key from work_title; the model's own keys are
    never taken. Seasons outside 0-99 and years outside 1900-2100 are blanked, other types unknown.
    """
    asked = entries.select("pack", "key", F.lit(True).alias("_asked")).distinct()
    rows = answers.join(asked, ["pack", "key"], "left")
    known = _first_of_key(rows.where("_asked")).select("pack", "position", "_rn")
    rows = rows.join(known, ["pack", "position"], "left")
    title = F.trim(F.coalesce("work_title", F.lit("")))
    key = key_of if key_of is not None else titles.call("series_norm_key", title)
    junk = F.coalesce("is_junk", F.lit(False))
    verdict = (
        F.when(F.col("_asked").isNull(), "unknown_key").when(F.col("_rn") > 1, "duplicate_key")
        .when(~junk & (key == ""), "empty_work_title").otherwise("ok")
    )
    return rows.select(
        "pack", "position", "key", F.when(~junk, F.nullif(key, F.lit(""))).alias("work_key"), junk.alias("is_junk"),
        F.when(F.col("season").between(0, 99), F.col("season")).alias("season"), F.when(F.col("year").between(1900, 2100), F.col("year")).alias("year"),
        F.when(F.col("media_type").isin(*MEDIA_TYPES), F.col("media_type")).otherwise("unknown").alias("media_type"), verdict.alias("verdict"),
    )


def validate_classifications(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """As above for type-only answers: junk needs JUNK_CONFIDENCE, and an unknown type is no signal."""
    asked = entries.select("pack", "key", F.lit(True).alias("_asked")).distinct()
    rows = answers.join(asked, ["pack", "key"], "left")
    known = _first_of_key(rows.where("_asked")).select("pack", "position", "_rn")
    rows = rows.join(known, ["pack", "position"], "left")
    junk = F.coalesce("is_junk", F.lit(False))
    kind = F.when(F.col("media_type").isin(*MEDIA_TYPES), F.col("media_type")).otherwise("unknown")
    verdict = (
        F.when(F.col("_asked").isNull(), "unknown_key").when(F.col("_rn") > 1, "duplicate_key")
        .when(junk & (F.coalesce("confidence", F.lit(0.0)) < JUNK_CONFIDENCE), "junk_low_confidence")
        .when(~junk & (kind == "unknown"), "no_signal").otherwise("ok")
    )
    return rows.select("pack", "position", "key", junk.alias("is_junk"), kind.alias("media_type"), verdict.alias("verdict"))


def missing_answers(entries: DataFrame, validated: DataFrame) -> DataFrame:
    return entries.join(validated.where("verdict <> 'unknown_key'").select("pack", "key").distinct(), ["pack", "key"], "left_anti")


def settle_known_works(rulings: DataFrame, works: DataFrame, key: str, junk: Column | None = None) -> DataFrame:
    """Undecided keys that equal a known work's key, decided for free: the work's majority title and
    type; season and year are not taken over."""
    known = identity.majority(works, key)
    rows = rulings.where("state <> 'decided'").join(known, rulings["series_key"] == known[key])
    rows = rows.where(~(junk if junk is not None else titles.call("is_junk_media_title", F.col("title"))))
    return rows.select("series_key", F.col("series_key").alias("work_key"), F.col("title").alias("work_title"), "media_type", F.lit("decided").alias("state"))


def apply_rulings(media: DataFrame, rulings: DataFrame) -> DataFrame:
    """(media_id, action): delete for junk, retype where only a type is ruled, settled where work and
    season are what the ruling says, rehome otherwise; seasons without a decided ruling are left out."""
    r = rulings.where("state = 'decided'").select("series_key", "junk", "work_key", F.col("season").alias("_s"), F.col("media_type").alias("_t"))
    rows = media.join(r, "series_key")
    season = F.coalesce("_s", "season")
    action = (
        F.when(F.col("junk"), "delete").when(F.col("work_key").isNull(), "retype")
        .when((F.col("work_key") == F.col("own_key")) & (season == F.col("season")), "settled").otherwise("rehome")
    )
    return rows.select("media_id", action.alias("action"), F.col("work_key"), season.alias("season"))


def purge_junk(media: DataFrame, bridge: DataFrame, media_tag: DataFrame, junk: Column) -> dict[str, DataFrame]:
    """Seasons with junk titles go with their pairs; links stay. Returns what is left and what went."""
    gone = media.where(junk).select("media_id")
    return {name: df.join(gone, "media_id", "left_anti") for name, df in (("media", media), ("bridge", bridge), ("media_tag", media_tag))} | {"gone": gone}


def new_pairs(pairs: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that are not there yet, each once: counts grow by these alone."""
    return pairs.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def requeue_checkable(resources: DataFrame, checkable: tuple[str, ...]) -> DataFrame:
    """Unsupported links whose provider has a probe by now are unchecked again."""
    now = (F.col("check_status") == "unsupported") & F.col("provider").isin(*checkable)
    return resources.withColumn("requeued", now).withColumn("check_status", F.when(now, "unchecked").otherwise(F.col("check_status")))


def interval_factors(checks: DataFrame, group: str, order: list[str], bucket: Column) -> DataFrame:
    """The factor of each group's check interval after its history: times 1.5 when limited, times
    0.99 when not, within 1 to 16, in order.

    A step scales and clamps; steps in a row again scale and clamp (by one factor, between two bounds).
    So each ``bucket`` of a history, which does not fall along the order, is folded to one such step, and these
    are folded in turn: no history is gathered whole.
    """
    times = lambda x: F.when(x["limited"], F.lit(1.5)).otherwise(F.lit(0.99))
    within = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))
    step = lambda m, lo, hi: F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"))
    low, high = F.lit(1.0), F.lit(16.0)
    rows = checks.select(group, bucket.alias("_b"), F.struct(*order, (F.col("status") == "error").alias("limited")).alias("_x"))
    parts = rows.groupBy(group, "_b").agg(F.sort_array(F.collect_list("_x")).alias("h"))
    folded = F.aggregate(
        "h", step(F.lit(1.0), F.lit(0.0), F.lit(1e300)),
        lambda a, x: step(a["m"] * times(x), within(a["lo"] * times(x), low, high), within(a["hi"] * times(x), low, high)),
    )
    whole = parts.select(group, F.struct(F.col("_b").alias("b"), folded.alias("f")).alias("s")).groupBy(group).agg(F.sort_array(F.collect_list("s")).alias("h"))
    return whole.select(group, F.aggregate("h", F.lit(1.0), lambda a, s: within(a * s["f"]["m"], s["f"]["lo"], s["f"]["hi"])).alias("factor"))


def build_catalogue(extracted: DataFrame, doc: str) -> dict[str, DataFrame]:
    """Works, seasons, links, tags and pairs from documents with ``outcome``, as one set of plans.

    Works by series key, seasons by (work, season); titles are the first seen (by document, place),
    further titles aliases; known types and years fill unknown ones. A link counts one mention per
    document. Ids are hashes of the natural keys, so that reruns agree. A document's items with their keys and its links of no
    item come out of one array: behind it no filter is worked out before, so each text is extracted and keyed once.
    """
    told = ("title", "media_type", "year", "links", "tags")

    def item(i: Column, n: Column) -> Column:
        season = F.coalesce(titles.call("extract_season", i["title"]), F.lit(0))
        return F.struct(n.alias("place"), *[i[c].alias(c) for c in told], titles.call("series_norm_key", i["title"]).alias("series_key"), season.alias("season"))

    def parts(o: Column) -> Column:
        items = F.transform(o["items"], item)
        loose = F.struct(*[(o["unattributed"] if c == "links" else F.lit(None)).alias(c) for c in ("place", *told, "series_key", "season")])
        return F.concat(items, F.array(loose))

    rows = extracted.select(doc, F.explode_outer(let(F.col("outcome"), parts)).alias("x")).where("x is not null").select(doc, "x.*")
    rows = rows.withColumn("media_key", F.when(F.col("series_key") != "", F.concat_ws("|", "series_key", F.col("season").cast("string"))))
    items = rows.where("series_key <> ''")
    at = F.struct(F.col(doc).alias("d"), F.col("place").alias("p"))

    def first(column: str, known: Column, blank):
        value = F.min(F.when(known, F.struct(at.alias("at"), F.col(column).alias("v"))))["v"]
        return F.coalesce(value, F.lit(blank)).alias(column)

    described = [
        first("title", F.lit(True), ""), first("media_type", F.col("media_type") != "unknown", "unknown"), first("year", F.col("year").isNotNull(), 0)
    ]
    works = items.groupBy("series_key").agg(*described, F.countDistinct("media_key").alias("season_count"))
    media = items.groupBy("media_key", "series_key", "season").agg(*described, F.array_sort(F.collect_set("title")).alias("titles"))
    media = media.withColumn("aliases", F.array_except("titles", F.array("title"))).drop("titles")
    links = rows.where("place is null or series_key <> ''").select(doc, "media_key", F.explode("links").alias("x"))
    mention = links.select(doc, "media_key", "x.provider", "x.share_id", "x.url", "x.passcode")
    per_doc = mention.groupBy("provider", "share_id", doc).agg(F.min("url").alias("url"), F.min("passcode").alias("passcode"))
    resources = per_doc.groupBy("provider", "share_id").agg(
        F.count("*").alias("seen_count"), F.min("url").alias("url"), F.min_by("passcode", F.when(F.col("passcode").isNotNull(), F.col(doc))).alias("passcode")
    )
    bridge = mention.where("media_key is not null").select("media_key", "provider", "share_id").distinct()
    tags = items.select("media_key", F.explode("tags").alias("t")).select("media_key", "t.kind", "t.name").distinct()
    return {"works": works, "media": media, "resources": resources, "bridge": bridge, "media_tag": tags}
