"""Queries of rulings and of the catalogue built from posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.functions import misc
from linkcatalog.operators import canon, extract
from linkcatalog.plans.entities import Catalog, with_entities
from linkcatalog.plans.texts import _dealt, _posts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *entities: str):
    def keep(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_entities(sql, *entities) if entities else sql
        return f

    return keep


_ANSWERS = """doc_id % 40 AS pack, doc_id AS position, CAST(doc_id % 97 AS VARCHAR(9)) AS key, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS work_title,
  doc_id % 9 = 0 AS is_junk, CAST(doc_id % 130 AS INTEGER) AS season, CAST(1850 + n_chars % 300 AS INTEGER) AS year,
  CASE doc_id % 3 WHEN 0 THEN 'tv' WHEN 1 THEN 'nonsense' ELSE 'unknown' END AS media_type, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars % 100 AS DOUBLE) / 100 END AS confidence"""
_ASKED = """a AS (SELECT *, doc_ok AND row_number() OVER (PARTITION BY pack, key, doc_ok ORDER BY position) > 1 AS dup FROM
  (SELECT *, CAST(key AS INTEGER) % 5 <> 0 AS doc_ok FROM q))"""


def _answers(c: Catalog) -> tuple[DataFrame, DataFrame]:
    answers = c.spark.sql(f"SELECT {_ANSWERS} FROM {{d}}", d=c.raw("documents"))
    return answers.where("CAST(key AS INT) % 5 <> 0").select("pack", "key").distinct(), answers


@query(
    "validate_decisions",
    f"""WITH q AS (SELECT {_ANSWERS} FROM documents), {_ASKED}
    SELECT pack, position, key, CASE WHEN NOT is_junk THEN nullif(work_title, '') END AS work_key, is_junk, CASE WHEN season BETWEEN 0 AND 99 THEN season END AS season,
      CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year, CASE WHEN media_type = 'tv' THEN 'tv' ELSE 'unknown' END AS media_type,
      CASE WHEN NOT doc_ok THEN 'unknown_key' WHEN dup THEN 'duplicate_key' WHEN NOT is_junk AND work_title = '' THEN 'empty_work_title' ELSE 'ok' END AS verdict FROM a""",
)
def validate_decisions(c: Catalog) -> DataFrame:
    entries, answers = _answers(c)
    return canon.validate_decisions(entries, answers, F.trim(F.coalesce("work_title", F.lit(""))))


@query(
    "validate_classifications",
    f"""WITH q AS (SELECT {_ANSWERS} FROM documents), {_ASKED}
    SELECT pack, position, key, is_junk, CASE WHEN media_type = 'tv' THEN 'tv' ELSE 'unknown' END AS media_type,
      CASE WHEN NOT doc_ok THEN 'unknown_key' WHEN dup THEN 'duplicate_key' WHEN is_junk AND coalesce(confidence, 0) < 0.9 THEN 'junk_low_confidence'
        WHEN NOT is_junk AND media_type <> 'tv' THEN 'no_signal' ELSE 'ok' END AS verdict FROM a""",
)
def validate_classifications(c: Catalog) -> DataFrame:
    return canon.validate_classifications(*_answers(c))


_STATES = "c_custkey AS series_key, CASE c_custkey % 3 WHEN 0 THEN 'decided' ELSE 'pending' END AS state"


@query(
    "settle_known_works",
    f"""+ r AS (SELECT {_STATES} FROM customer), t AS (SELECT work_id, title, count(*) AS n FROM media GROUP BY ALL),
    k AS (SELECT work_id, media_type, count(*) AS n FROM media WHERE media_type <> 'unknown' GROUP BY ALL)
    SELECT series_key, series_key AS work_key, a.title AS work_title, coalesce(b.media_type, 'unknown') AS media_type, 'decided' AS state FROM r
    JOIN (SELECT work_id, arg_min(title, (-n, title)) AS title FROM t GROUP BY work_id) a ON a.work_id = series_key
    LEFT JOIN (SELECT work_id, arg_min(media_type, (-n, media_type)) AS media_type FROM k GROUP BY work_id) b USING (work_id) WHERE r.state <> 'decided' AND a.title <> 'LOW'""",
    "media",
)
def settle_known_works(c: Catalog) -> DataFrame:
    rulings = c.spark.sql(f"SELECT {_STATES} FROM {{t}}", t=c.raw("customer"))
    return canon.settle_known_works(rulings, c.media, "work_id", F.col("title") == "LOW")


_RULED = """c_custkey AS series_key, CASE c_custkey % 4 WHEN 0 THEN 'pending' ELSE 'decided' END AS state, c_custkey % 9 = 0 AS junk,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 100000 END AS work_key,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS season, 'tv' AS media_type"""


@query(
    "apply_rulings",
    f"""+ r AS (SELECT {_RULED} FROM customer) SELECT media_id, CASE WHEN junk THEN 'delete' WHEN work_key IS NULL THEN 'retype'
      WHEN work_key = work_id AND coalesce(r.season, media.season) = media.season THEN 'settled' ELSE 'rehome' END AS action, work_key, coalesce(r.season, media.season) AS season
    FROM media JOIN r ON series_key = work_id WHERE state = 'decided'""",
    "media",
)
def apply_rulings(c: Catalog) -> DataFrame:
    rulings = c.spark.sql(f"SELECT {_RULED} FROM {{t}}", t=c.raw("customer"))
    media = c.media.select("media_id", F.col("work_id").alias("series_key"), F.col("work_id").alias("own_key"), "season")
    return canon.apply_rulings(media, rulings)


@query("purge_junk", "SELECT tag, count(*) AS media_count FROM media_tag WHERE media_id NOT IN (SELECT media_id FROM media WHERE title = 'LOW') GROUP BY tag", "media", "media_tag")
def purge_junk(c: Catalog) -> DataFrame:
    left = canon.purge_junk(c.media, c.bridge, c.media_tag, F.col("title") == "LOW")
    return left["media_tag"].groupBy("tag").agg(F.count("*").alias("media_count"))


@query(
    "link_new_pairs",
    "SELECT resource_id, count(*) AS new_pairs FROM bridge WHERE media_id % 4 <> 0 OR resource_id % 3 <> 0 GROUP BY resource_id",
    "bridge",
)
def link_new_pairs(c: Catalog) -> DataFrame:
    there = c.bridge.where("media_id % 4 = 0 AND resource_id % 3 = 0")
    return canon.new_pairs(c.bridge, there, ["media_id", "resource_id"]).groupBy("resource_id").agg(F.count("*").alias("new_pairs"))


@query(
    "requeue_checkable",
    """SELECT resource_id, CASE WHEN check_status = 'error' AND provider = 'quark' THEN 'unchecked' WHEN check_status = 'error' THEN 'unsupported' ELSE check_status END AS check_status,
      check_status = 'error' AND provider = 'quark' AS requeued FROM resource""",
    "resource",
)
def requeue_checkable(c: Catalog) -> DataFrame:
    rows = c.resource.withColumn("check_status", F.when(F.col("check_status") == "error", "unsupported").otherwise(F.col("check_status")))
    return canon.requeue_checkable(rows, ("quark",)).select("resource_id", "check_status", "requeued")


@query(
    "interval_factors",
    """+ h AS (SELECT link, list(status = 'error' ORDER BY checked_at, check_id) AS l FROM checks GROUP BY link)
    SELECT link, round(list_reduce(list_transform(l, lambda x: CASE WHEN x THEN 1.5::DOUBLE ELSE 0.99::DOUBLE END), lambda a, x: greatest(1.0::DOUBLE, least(16.0::DOUBLE, a * x)), 1.0::DOUBLE), 6) AS factor FROM h""",
    "checks",
)
def interval_factors(c: Catalog) -> DataFrame:
    return canon.interval_factors(c.checks, "link", ["checked_at", "check_id"], F.expr("checked_at div 86400")).withColumn("factor", F.round("factor", 6))


@query(
    "catalogue_links",
    """SELECT provider, share_id, count(DISTINCT doc_id) AS seen_count, max(passcode) AS passcode FROM (SELECT doc_id, 'quark' AS provider, substr(md5(text), 1, 12) AS share_id, substr(md5(text), 1, 4) AS passcode FROM documents
    UNION ALL SELECT doc_id, 'alipan', substr(md5(text), 13, 11), NULL FROM documents) GROUP BY provider, share_id""",
)
def catalogue_links(c: Catalog) -> DataFrame:
    built = canon.build_catalogue(extract.extract(_dealt(_posts(c)), "post"), "doc_id")
    return built["resources"].select("provider", "share_id", "seen_count", "passcode")


@query("catalogue_works")
def catalogue_works(c: Catalog) -> DataFrame:
    return canon.build_catalogue(extract.extract(_dealt(_posts(c)), "post"), "doc_id")["works"]


@query("catalogue_media")
def catalogue_media(c: Catalog) -> DataFrame:
    return canon.build_catalogue(extract.extract(_dealt(_posts(c)), "post"), "doc_id")["media"].withColumn("aliases", F.array_join("aliases", "|"))


@query("shard_of_key", "SELECT doc_id, CAST(CASE WHEN d >= 'a' THEN ascii(d) - 87 ELSE ascii(d) - 48 END AS INTEGER) % 8 AS shard FROM (SELECT doc_id, right(md5(text), 1) AS d FROM documents)")
def shard_of_key(c: Catalog) -> DataFrame:
    return c.raw("documents").select("doc_id", misc.shard_of(F.md5("text"), 8).alias("shard"))
