"""Queries over the catalogue: search, counters, statistics, ingest, checks, claims, identity, repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.functions import misc
from linkcatalog.operators import checks, counters, identity, ingest, search
from linkcatalog.plans.entities import Catalog, with_entities
from linkcatalog.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A fixed "now" for schedules over the driver's events.
NOW = 1_705_000_000


def query(name: str, sql: str | None = None, *entities: str):
    """Registers a query over a Catalog under ``name`` with its SQL."""

    def keep(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_entities(sql, *entities) if entities else sql
        return f

    return keep


# --- search ---------------------------------------------------------------

_NONEMPTY = "work_id IN (SELECT work_id FROM media JOIN bridge USING (media_id))"
_TYPES = "media_type IN ('movie', 'tv', 'anime', 'variety', 'documentary', 'unknown')"


@query(
    "search_like",
    f"""SELECT work_id, title, media_type, year FROM work WHERE {_TYPES} AND {_NONEMPTY}
    AND (contains(lower(title), '00001') OR contains(norm_key, '00001')) ORDER BY work_id DESC LIMIT 20 OFFSET 5""",
    "work", "media", "bridge",
)
def search_like(c: Catalog) -> DataFrame:
    rows = search.filter_works(c.work, c.media, c.bridge, c.resource)
    return search.search_like(rows, "00001", 20, 5).select("work_id", "title", "media_type", "year")


@query(
    "search_valid_provider",
    f"""SELECT work_id, title FROM work WHERE {_TYPES}
    AND work_id IN (SELECT work_id FROM media JOIN bridge USING (media_id) JOIN resource USING (resource_id) WHERE check_status = 'valid')
    AND work_id IN (SELECT work_id FROM media JOIN bridge USING (media_id) JOIN resource USING (resource_id) WHERE provider = 'quark')""",
    "work", "media", "resource", "bridge",
)
def search_valid_provider(c: Catalog) -> DataFrame:
    return search.filter_works(c.work, c.media, c.bridge, c.resource, valid_only=True, provider="quark").select("work_id", "title")


@query(
    "search_count",
    f"SELECT count(*) AS n FROM work WHERE {_TYPES} AND year = 1970 AND {_NONEMPTY}",
    "work", "media", "bridge",
)
def search_count(c: Catalog) -> DataFrame:
    return search.filter_works(c.work, c.media, c.bridge, c.resource, year=1970).agg(F.count("*").alias("n"))


_TRGM = """list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN generate_series(1, length(w) + 1)]
  FOR w IN string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')]))"""


@query(
    "search_trgm",
    f"""+ k AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm_key FROM part),
    t AS (SELECT *, {_TRGM.format("norm_key")} AS a, {_TRGM.format("'smallwidget'")} AS b FROM k),
    s AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS score FROM t)
    SELECT p_partkey AS work_id, p_name AS title, round(score, 9) AS score FROM s
    WHERE score >= 0.2 OR contains(norm_key, 'smallwidget') OR contains(lower(p_name), 'small widget')
    ORDER BY s.score DESC, work_id DESC LIMIT 50""",
    "work",
)
def search_trgm(c: Catalog) -> DataFrame:
    rows = c.raw("part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), search.key_column(F.col("p_name")).alias("norm_key"))
    return search.search_trgm(rows, "small widget", 50).select("work_id", "title", F.round("score", 9).alias("score"))


@query(
    "search_trgm_indexed",
    f"""+ t AS (SELECT p_partkey, p_name, {_TRGM.format("p_name")} AS a, {_TRGM.format("'green widget'")} AS b FROM part),
    s AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS score FROM t)
    SELECT p_partkey AS work_id, p_name AS title, round(score, 9) AS score FROM s WHERE score >= 0.2""",
    "work",
)
def search_trgm_indexed(c: Catalog) -> DataFrame:
    rows = c.raw("part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"))
    found = search.search_postings(search.store_postings(rows, "title", new_path(c.spark, "postings")), "green widget")
    return found.join(rows, "work_id").select("work_id", "title", F.round("score", 9).alias("score"))


@query(
    "season_topk_links",
    """SELECT media_id, resource_id, provider, check_status, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY media_id
    ORDER BY CASE WHEN check_status = 'valid' THEN 0 ELSE 1 END, resource_id DESC) AS INTEGER) AS rn
    FROM bridge JOIN resource USING (resource_id)) WHERE rn <= 5""",
    "bridge", "resource",
)
def season_topk_links(c: Catalog) -> DataFrame:
    return search.top_links(c.bridge, c.resource).select("media_id", "resource_id", "provider", "check_status", "rn")


@query(
    "work_detail",
    """SELECT work_id, title, coalesce(s, NULL) AS seasons, coalesce(n, 0) AS n_seasons FROM work LEFT JOIN
    (SELECT work_id, string_agg(season || ':' || media_id, ',' ORDER BY season, media_id) AS s, count(*) AS n FROM media GROUP BY work_id) USING (work_id)""",
    "work", "media",
)
def work_detail(c: Catalog) -> DataFrame:
    return search.work_detail(c.work, c.media).select("work_id", "title", "seasons", "n_seasons")


@query(
    "keyset_page",
    """+ q AS (SELECT media_id, CASE WHEN media_id % 4 = 0 THEN NULL ELSE created_at END AS parsed_at FROM media)
    SELECT * FROM q WHERE (parsed_at IS NULL AND media_id > 100) OR parsed_at IS NOT NULL
    ORDER BY parsed_at NULLS FIRST, media_id LIMIT 500""",
    "media",
)
def keyset_page(c: Catalog) -> DataFrame:
    rows = c.media.select("media_id", F.when(F.col("media_id") % 4 != 0, F.col("created_at")).alias("parsed_at"))
    return search.keyset_page(rows, "parsed_at", "media_id", None, 100, 500)


@query("shard_cover", "SELECT doc_id, ('0x' || right(md5(CAST(doc_id AS VARCHAR)), 1))::INTEGER % 8 AS shard FROM documents")
def shard_cover(c: Catalog) -> DataFrame:
    return c.raw("documents").select("doc_id", misc.shard_of(F.md5(F.col("doc_id").cast("string")), 8).alias("shard"))


# --- counters and statistics ----------------------------------------------

_COUNTED = """+ counted AS (SELECT media_id, work_id, count(*) AS resource_count, count(*) FILTER (check_status = 'valid') AS valid_count
    FROM media JOIN bridge USING (media_id) JOIN resource USING (resource_id) GROUP BY media_id, work_id)"""


@query("counters_media", f"{_COUNTED} SELECT * FROM counted", "media", "bridge", "resource")
def counters_media(c: Catalog) -> DataFrame:
    return counters.media_counters(c.media, c.bridge, c.resource)


@query(
    "counters_work",
    f"""{_COUNTED} SELECT work_id, count(media_id) AS season_count, CAST(coalesce(sum(resource_count), 0) AS BIGINT) AS resource_count,
    CAST(coalesce(sum(valid_count), 0) AS BIGINT) AS valid_count FROM work LEFT JOIN counted USING (work_id) GROUP BY work_id""",
    "work", "media", "bridge", "resource",
)
def counters_work(c: Catalog) -> DataFrame:
    return counters.work_counters(c.work, counters.media_counters(c.media, c.bridge, c.resource))


@query(
    "tag_recount",
    """+ tags AS (SELECT DISTINCT p_brand AS tag, CAST(length(p_brand) AS BIGINT) AS old FROM part)
    SELECT tag, old, count(media_id) AS media_count, count(media_id) <> old AS changed FROM tags LEFT JOIN media_tag USING (tag) GROUP BY tag, old""",
    "media_tag",
)
def tag_recount(c: Catalog) -> DataFrame:
    tags = c.raw("part").select(F.col("p_brand").alias("tag"), F.length("p_brand").cast("long").alias("old")).distinct()
    return counters.recount_tags(tags, c.media_tag)


@query(
    "stats_by_status",
    "SELECT check_status AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM resource GROUP BY check_status",
    "resource",
)
def stats_by_status(c: Catalog) -> DataFrame:
    return counters.by_status(c.resource, "check_status").withColumn("share", F.round("share", 9))


@query(
    "stats_provider_check",
    """SELECT provider, count(*) AS total, count(*) FILTER (check_status = 'valid') AS valid, count(*) FILTER (check_status = 'unchecked') AS unchecked,
    count(*) FILTER (check_status = 'invalid') AS invalid, count(*) FILTER (check_status NOT IN ('valid', 'unchecked', 'invalid')) AS other
    FROM resource GROUP BY provider""",
    "resource",
)
def stats_provider_check(c: Catalog) -> DataFrame:
    return counters.provider_by_check(c.resource)


@query("stats_orphans", "SELECT resource_id, provider FROM resource WHERE NOT EXISTS (SELECT 1 FROM bridge WHERE bridge.resource_id = resource.resource_id)", "resource", "bridge")
def stats_orphans(c: Catalog) -> DataFrame:
    return counters.orphans(c.resource, c.bridge).select("resource_id", "provider")


@query(
    "stats_report",
    """SELECT 'works' AS metric, count(*) AS value FROM work UNION ALL SELECT 'seasons', count(*) FROM media UNION ALL
    SELECT 'links', count(*) FROM resource UNION ALL SELECT 'bridge', count(*) FROM bridge UNION ALL
    SELECT 'empty_seasons', count(*) FROM media WHERE media_id NOT IN (SELECT media_id FROM bridge) UNION ALL
    SELECT 'typed_works', count(*) FROM work WHERE media_type <> 'unknown'""",
    "work", "media", "resource", "bridge",
)
def stats_report(c: Catalog) -> DataFrame:
    return counters.stats_report({
        "works": c.work, "seasons": c.media, "links": c.resource, "bridge": c.bridge,
        "empty_seasons": c.media.join(c.bridge, "media_id", "left_anti"), "typed_works": c.work.where("media_type <> 'unknown'"),
    })


_PROGRESS = "count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'done') AS done"


@query(
    "progress_snapshot",
    f"""SELECT 'parse' AS stage, {_PROGRESS} FROM (SELECT CASE status WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS s FROM media)
    UNION ALL SELECT 'verify', {_PROGRESS} FROM (SELECT CASE check_status WHEN 'unchecked' THEN 'pending' WHEN 'error' THEN 'running' ELSE 'done' END AS s FROM resource)""",
    "media", "resource",
)
def progress_snapshot(c: Catalog) -> DataFrame:
    parse = c.media.withColumn("s", F.expr("CASE status WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END"))
    verify = c.resource.withColumn("s", F.expr("CASE check_status WHEN 'unchecked' THEN 'pending' WHEN 'error' THEN 'running' ELSE 'done' END"))
    return counters.progress("parse", parse, "s").union(counters.progress("verify", verify, "s"))


@query(
    "retag_merge",
    """+ tags AS (SELECT DISTINCT p_brand AS tag, right(p_brand, 1) AS norm_key, CASE WHEN length(p_brand) = 7 THEN 'short' ELSE 'long' END AS new_kind FROM part),
    target AS (SELECT new_kind, norm_key, min(tag) AS target FROM tags GROUP BY ALL)
    SELECT target AS tag, new_kind AS kind, norm_key, count(DISTINCT media_id) AS media_count
    FROM tags JOIN target USING (new_kind, norm_key) LEFT JOIN media_tag USING (tag) GROUP BY ALL""",
    "media_tag",
)
def retag_merge(c: Catalog) -> DataFrame:
    brand = F.col("p_brand")
    tags = c.raw("part").select(brand.alias("tag"), F.right(brand, F.lit(1)).alias("norm_key"), F.when(F.length(brand) == 7, "short").otherwise("long").alias("new_kind")).distinct()
    return counters.tag_retag(tags, c.media_tag)[0]


# --- ingest and sync ------------------------------------------------------

_HASH = r"""sha256(array_to_string(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN
  string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))], lambda x: x <> ''), chr(10)))"""


@query("content_hash", f"SELECT doc_id, {_HASH} AS content_hash FROM documents")
def content_hash(c: Catalog) -> DataFrame:
    return c.raw("documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))


@query(
    "ingest_many_outcomes",
    f"""WITH h AS (SELECT doc_id, {_HASH} AS content_hash FROM documents), stored AS (SELECT content_hash FROM h WHERE doc_id % 10 = 0)
    SELECT doc_id, content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM stored)
      OR row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'duplicated' ELSE 'created' END AS outcome
    FROM h WHERE doc_id % 10 <> 0""",
)
def ingest_many_outcomes(c: Catalog) -> DataFrame:
    docs = c.raw("documents")
    stored = docs.where("doc_id % 10 = 0").select(ingest.content_hash(F.col("text")).alias("content_hash"))
    return ingest.ingest_many(docs.where("doc_id % 10 <> 0"), stored, "doc_id").select("doc_id", "content_hash", "outcome")


@query(
    "ingest_dedupe",
    f"SELECT min(doc_id) AS doc_id, content_hash, count(*) AS copies FROM (SELECT doc_id, {_HASH} AS content_hash FROM documents) GROUP BY content_hash",
)
def ingest_dedupe(c: Catalog) -> DataFrame:
    hashed = c.raw("documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "upsert_resources",
    """+ m AS (SELECT *, seen_at < 900000000 AS early FROM mention),
    a AS (SELECT provider, share_id, early, count(*) AS n, min(seen_at) AS f, max(seen_at) AS l,
      arg_min(passcode, (seen_at, passcode)) FILTER (passcode IS NOT NULL) AS p FROM m GROUP BY ALL)
    SELECT provider, share_id, CAST(sum(n) AS BIGINT) AS seen_count, min(f) AS first_seen, max(l) AS last_seen,
      coalesce(max(p) FILTER (early), max(p) FILTER (NOT early)) AS passcode FROM a GROUP BY provider, share_id""",
    "mention",
)
def upsert_resources(c: Catalog) -> DataFrame:
    old = ingest.upsert_resources(None, c.mention.where("seen_at < 900000000"))
    return ingest.upsert_resources(old, c.mention.where("seen_at >= 900000000"))


_SIDES = """+ local AS (SELECT media_id, created_at AS mark, title FROM media WHERE media_id % 3 <> 0),
    far AS (SELECT media_id, created_at + (media_id % 5 - 2) * 86400 AS mark, 'far' AS title FROM media WHERE media_id % 4 <> 0)"""


@query(
    "sync_upsert",
    f"""{_SIDES} SELECT media_id, mark, title FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY mark DESC, side) AS rn
    FROM (SELECT *, 0 AS side FROM local UNION ALL SELECT *, 1 FROM far)) WHERE rn = 1""",
    "media",
)
def sync_upsert(c: Catalog) -> DataFrame:
    local = c.media.where("media_id % 3 <> 0").select("media_id", F.col("created_at").alias("mark"), "title")
    far = c.media.where("media_id % 4 <> 0").select("media_id", F.expr("created_at + (media_id % 5 - 2) * 86400").alias("mark"), F.lit("far").alias("title"))
    return ingest.upsert_latest(local, far, ["media_id"], "mark")


@query("sync_overlap_window", "SELECT check_id, checked_at FROM checks WHERE checked_at >= (SELECT max(checked_at) FROM checks WHERE check_id % 50 = 0) - 300", "checks")
def sync_overlap_window(c: Catalog) -> DataFrame:
    mark = ingest.max_watermark(c.checks.where("check_id % 50 = 0"), "checked_at")
    return ingest.overlap_rows(c.checks, "checked_at", mark).select("check_id", "checked_at")


# --- checks and queues ----------------------------------------------------


@query(
    "latest_check",
    "SELECT link, check_id, status, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY checked_at DESC, check_id DESC) AS rn FROM checks) WHERE rn = 1",
    "checks",
)
def latest_check(c: Catalog) -> DataFrame:
    return checks.latest_check(c.checks, ["link"], "checked_at", "check_id").select("link", "check_id", "status", "checked_at")


_NEXT = """CASE WHEN {s} = 'valid' THEN {t} + 604800 WHEN {s} = 'invalid' AND {n} < 2 THEN {t} + 2592000
  WHEN {s} IN ('rate_limited', 'error') THEN {t} + CASE WHEN {n} <= 0 THEN 60 ELSE CAST(least(21600, 60 * pow(2, least({n}, 20))) AS BIGINT) END END"""
_LATEST = """+ latest AS (SELECT link, arg_max(status, (checked_at, check_id)) AS s, arg_max(checked_at, (checked_at, check_id)) AS t FROM checks GROUP BY link),
    r AS (SELECT resource_id, share_id AS link, check_status FROM resource)"""


@query(
    "relink_hydrate",
    f"""{_LATEST} SELECT resource_id, link, CASE WHEN check_status = 'unchecked' AND s IS NOT NULL THEN s ELSE check_status END AS check_status,
    CASE WHEN check_status = 'unchecked' AND s IS NOT NULL THEN {_NEXT.format(s="s", t="t", n="0")} END AS next_check_at,
    check_status = 'unchecked' AND s IS NOT NULL AS hydrated FROM r LEFT JOIN latest USING (link)""",
    "resource", "checks",
)
def relink_hydrate(c: Catalog) -> DataFrame:
    rows = c.resource.select("resource_id", F.col("share_id").alias("link"), "check_status", F.lit(None).cast("long").alias("next_check_at"))
    return checks.relink(rows, checks.latest_check(c.checks, ["link"], "checked_at", "check_id"), ["link"])


@query(
    "check_state_machine",
    f"""+ a AS (SELECT *, lag(status) OVER w AS prev FROM checks WINDOW w AS (PARTITION BY link ORDER BY checked_at, check_id)),
    b AS (SELECT *, sum(CASE WHEN prev = status THEN 0 ELSE 1 END) OVER (PARTITION BY link ORDER BY checked_at, check_id) AS run FROM a),
    d AS (SELECT *, CAST(row_number() OVER (PARTITION BY link, run ORDER BY checked_at, check_id) AS INTEGER) AS attempts FROM b)
    SELECT check_id, link, status, attempts, coalesce((status = 'valid') <> (prev = 'valid'), status = 'valid') AS flipped,
    {_NEXT.format(s="status", t="checked_at", n="attempts")} AS next_check_at FROM d""",
    "checks",
)
def check_state_machine(c: Catalog) -> DataFrame:
    out = checks.check_states(c.checks, ["link"], "checked_at", "check_id")
    return out.select("check_id", "link", "status", "attempts", "flipped", "next_check_at")


@query(
    "verify_schedule",
    f"SELECT check_id, {_NEXT.format(s='status', t='checked_at', n='(check_id % 12)')} AS next_check_at FROM checks",
    "checks",
)
def verify_schedule(c: Catalog) -> DataFrame:
    return c.checks.select("check_id", checks.next_check(F.col("status"), F.col("check_id") % 12, F.col("checked_at")).alias("next_check_at"))


_QUEUE = """doc_id, CASE WHEN source = 'src3' THEN NULL ELSE source END AS source,
  CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' ELSE 'pending' END AS parse_status,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1705000000 + (doc_id % 9 - 5) * 60 END AS lease_until,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1705000000 + (doc_id % 8 - 6) * 60 END AS next_parse_at,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1700000000 + doc_id % 100 END AS last_parsed_at, doc_id % 6 AS attempts"""


@query(
    "claim_documents",
    f"""WITH q AS (SELECT {_QUEUE} FROM documents), due AS (SELECT *, CASE WHEN source IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY source) END AS n
      FROM q WHERE parse_status IN ('pending', 'running') AND (lease_until IS NULL OR lease_until <= 1705000000)
      AND (next_parse_at IS NULL OR next_parse_at <= 1705000000))
    SELECT doc_id, source, n AS left_in_source, attempts + CASE parse_status WHEN 'running' THEN 1 ELSE 0 END AS attempts_now,
      CASE WHEN parse_status = 'running' AND attempts >= 4 THEN 'failed' ELSE 'claimed' END AS claim
    FROM due ORDER BY n, last_parsed_at NULLS FIRST, doc_id LIMIT 100""",
)
def claim_documents(c: Catalog) -> DataFrame:
    queue = c.spark.sql(f"SELECT {_QUEUE} FROM {{docs}}", docs=c.raw("documents"))
    return checks.claim_documents(queue, NOW, 100).select("doc_id", "source", "left_in_source", "attempts_now", "claim")


_LINKS = """resource_id, provider, check_status, resource_id % 6 AS check_attempts,
  CASE WHEN resource_id % 5 = 0 THEN NULL ELSE 1705000000 + (resource_id % 9 - 5) * 60 END AS lease_until,
  CASE WHEN resource_id % 3 = 0 THEN NULL ELSE 1705000000 + (resource_id % 8 - 6) * 60 END AS next_check_at"""


@query(
    "claim_resources",
    f"""+ q AS (SELECT {_LINKS} FROM resource)
    SELECT resource_id, provider, check_attempts + 1 AS check_attempts,
      1705000000 + CAST(least(21600, 60 * pow(2, check_attempts + 1)) AS BIGINT) AS next_check_at FROM q
    WHERE provider IN ('quark') AND (lease_until IS NULL OR lease_until <= 1705000000)
      AND (next_check_at <= 1705000000 OR (next_check_at IS NULL AND check_status = 'unchecked'))
    ORDER BY q.next_check_at NULLS FIRST, resource_id LIMIT 200""",
    "resource",
)
def claim_resources(c: Catalog) -> DataFrame:
    queue = c.spark.sql(f"SELECT {_LINKS} FROM {{links}}", links=c.resource)
    return checks.claim_resources(queue, NOW, 200, ("quark",)).select("resource_id", "provider", "check_attempts", "next_check_at")


_SOURCES = """s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'web' ELSE 'telegram' END AS source_type,
  s_suppkey % 10 <> 0 AS enabled, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1705000000 + (s_suppkey % 9 - 5) * 60 END AS lease_until,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 1705000000 + (s_suppkey % 11 - 7) * 60 END AS next_run_at,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 1705000000 - s_suppkey * 1000 END AS last_success_at"""


@query(
    "claim_sources",
    f"""WITH q AS (SELECT {_SOURCES} FROM supplier), p AS (SELECT *, CASE WHEN source_type IN ('rss', 'web')
      AND (last_success_at IS NULL OR last_success_at <= 1705000000 - 43200) THEN 0 ELSE 1 END AS priority FROM q
      WHERE enabled AND (next_run_at IS NULL OR next_run_at <= 1705000000) AND (lease_until IS NULL OR lease_until <= 1705000000))
    SELECT source_id, source_type, priority FROM p ORDER BY priority, next_run_at NULLS FIRST, source_id LIMIT 30""",
)
def claim_sources(c: Catalog) -> DataFrame:
    queue = c.spark.sql(f"SELECT {_SOURCES} FROM {{s}}", s=c.raw("supplier"))
    return checks.claim_sources(queue, NOW, 30).select("source_id", "source_type", "priority")


@query(
    "stale_summary",
    f"""WITH q AS (SELECT {_QUEUE} FROM documents) SELECT parse_status, count(*) FILTER (lease_until <= 1705000000) AS expired, count(*) AS n FROM q GROUP BY parse_status""",
)
def stale_summary(c: Catalog) -> DataFrame:
    queue = c.spark.sql(f"SELECT {_QUEUE} FROM {{docs}}", docs=c.raw("documents"))
    return queue.groupBy("parse_status").agg(F.count_if(F.col("lease_until") <= NOW).alias("expired"), F.count("*").alias("n"))


@query("round_robin", "SELECT resource_id, provider, CAST(row_number() OVER (PARTITION BY provider ORDER BY last_seen, resource_id) AS INTEGER) AS turn FROM resource", "resource")
def round_robin(c: Catalog) -> DataFrame:
    return checks.round_robin(c.resource, "provider", ["last_seen", "resource_id"], F.expr("last_seen div 86400")).select("resource_id", "provider", "turn")


@query(
    "parse_outcomes",
    """WITH q AS (SELECT doc_id, n_chars % 3 > 0 AS ok, n_chars % 5 = 0 AS catalog, doc_id % 6 AS attempts FROM documents)
    SELECT doc_id, CASE WHEN ok AND catalog THEN 'skipped' WHEN ok THEN 'done' WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status,
      CASE WHEN ok THEN attempts ELSE attempts + 1 END AS attempts,
      CASE WHEN NOT ok AND attempts + 1 < 5 THEN 1705000000 + CAST(60 * pow(2, attempts + 1) AS BIGINT) END AS next_parse_at FROM q""",
)
def parse_outcomes(c: Catalog) -> DataFrame:
    docs = c.raw("documents")
    out = checks.parse_outcome(F.col("n_chars") % 3 > 0, F.col("n_chars") % 5 == 0, F.col("doc_id") % 6, F.lit(NOW).cast("long"))
    return docs.select("doc_id", out.alias("o")).select("doc_id", "o.*")


# --- identity and repair --------------------------------------------------

_LINKED = """+ linked AS (SELECT media.*, (SELECT count(*) FROM bridge WHERE bridge.media_id = media.media_id) AS links FROM media)"""


def _linked(c: Catalog) -> DataFrame:
    counts = c.bridge.groupBy("media_id").agg(F.count("*").alias("links"))
    return c.media.join(counts, "media_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query("survivor_pick", f"{_LINKED} SELECT work_id, season, arg_max(media_id, (links, CAST(media_id AS VARCHAR))) AS survivor FROM linked GROUP BY work_id, season", "media", "bridge")
def survivor_pick(c: Catalog) -> DataFrame:
    return identity.pick_survivor(_linked(c), ["work_id", "season"])


@query(
    "rebuild_works",
    """+ t AS (SELECT work_id, title, count(*) AS n FROM media GROUP BY ALL)
    SELECT m.work_id, t.title, count(*) AS rows, coalesce(min(nullif(year, 0)), 0) AS year,
      coalesce(arg_min(media_type, media_id) FILTER (media_type <> 'unknown'), 'unknown') AS media_type
    FROM media m JOIN (SELECT work_id, arg_max(title, (n, -length(title), title)) AS title FROM t GROUP BY work_id) t USING (work_id) GROUP BY m.work_id, t.title""",
    "media",
)
def rebuild_works(c: Catalog) -> DataFrame:
    return identity.best_titles(c.media, "work_id").select("work_id", "title", "rows", "year", "media_type")


@query(
    "canon_majority",
    """+ t AS (SELECT work_id, title, count(*) AS n FROM media GROUP BY ALL), k AS (SELECT work_id, media_type, count(*) AS n FROM media WHERE media_type <> 'unknown' GROUP BY ALL)
    SELECT work_id, a.title, coalesce(b.media_type, 'unknown') AS media_type FROM (SELECT work_id, arg_min(title, (-n, title)) AS title FROM t GROUP BY work_id) a
    LEFT JOIN (SELECT work_id, arg_min(media_type, (-n, media_type)) AS media_type FROM k GROUP BY work_id) b USING (work_id)""",
    "media",
)
def canon_majority(c: Catalog) -> DataFrame:
    return identity.majority(c.media, "work_id").select("work_id", "title", "media_type")


@query(
    "canon_blocks",
    f"""{_LINKED}, e AS (SELECT work_id % 50 AS block_key, work_id AS series_key, count(*) AS rows, CAST(sum(links) AS BIGINT) AS resources FROM linked GROUP BY ALL)
    SELECT block_key, series_key, rows, resources, CAST(row_number() OVER (PARTITION BY block_key ORDER BY resources DESC, rows DESC, series_key) AS INTEGER) AS place,
      (row_number() OVER (PARTITION BY block_key ORDER BY resources DESC, rows DESC, series_key) - 1) // 50 AS pack FROM e
    WHERE block_key IN (SELECT block_key FROM e GROUP BY block_key HAVING count(*) >= 2)""",
    "media", "bridge",
)
def canon_blocks(c: Catalog) -> DataFrame:
    rows = _linked(c).withColumn("block_key", F.col("work_id") % 50).withColumn("series_key", F.col("work_id"))
    return identity.blocks(rows).select("block_key", "series_key", "rows", "resources", "place", "pack")


@query(
    "prompt_packs",
    f"""{_LINKED}, e AS (SELECT work_id % 50 AS block_key, work_id AS series_key, count(*) AS rows, CAST(sum(links) AS BIGINT) AS resources FROM linked GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY block_key ORDER BY resources DESC, rows DESC, series_key) AS place FROM e
      WHERE block_key IN (SELECT block_key FROM e GROUP BY block_key HAVING count(*) >= 2))
    SELECT block_key, (place - 1) // 50 AS pack, string_agg(place || '. ' || series_key || ' (' || rows || ' rows, ' || resources || ' links)', chr(10) ORDER BY place) AS message FROM p GROUP BY ALL""",
    "media", "bridge",
)
def prompt_packs(c: Catalog) -> DataFrame:
    rows = _linked(c).withColumn("block_key", F.col("work_id") % 50).withColumn("series_key", F.col("work_id"))
    return identity.prompt_packs(identity.blocks(rows))


@query(
    "upsert_works",
    """+ o AS (SELECT work_id, title, CASE WHEN work_id % 2 = 0 THEN 'unknown' ELSE media_type END AS media_type, year FROM work WHERE work_id % 3 <> 0),
    n AS (SELECT work_id, CASE WHEN work_id % 4 = 0 THEN title || '!' ELSE title END AS title, media_type, year + 1 AS year FROM work WHERE work_id % 5 <> 0)
    SELECT work_id, coalesce(o.title, n.title) AS title, coalesce(nullif(o.media_type, 'unknown'), n.media_type, o.media_type) AS media_type,
      coalesce(nullif(o.year, 0), n.year, o.year) AS year, CASE WHEN o.title <> n.title THEN n.title ELSE '' END AS aliases FROM o FULL JOIN n USING (work_id)""",
    "work",
)
def upsert_works(c: Catalog) -> DataFrame:
    i = F.col("work_id")
    kind = F.when(i % 2 == 0, "unknown").otherwise(F.col("media_type"))
    old = c.work.where("work_id % 3 <> 0").select(i, "title", kind.alias("media_type"), "year", F.array().cast("array<string>").alias("aliases"))
    title = F.when(i % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    new = c.work.where("work_id % 5 <> 0").select(i, title.alias("title"), "media_type", (F.col("year") + 1).alias("year"))
    return identity.upsert_works(old, new, "work_id").withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "best_decision",
    """WITH d AS (SELECT doc_id % 500 AS key, doc_id AS position, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE (n_chars % 10) / 10.0::DOUBLE END AS confidence FROM documents)
    SELECT key, position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(confidence, 0) DESC, position) AS rn FROM d) WHERE rn = 1""",
)
def best_decision(c: Catalog) -> DataFrame:
    rows = c.raw("documents").select((F.col("doc_id") % 500).alias("key"), F.col("doc_id").alias("position"), F.when(F.col("n_chars") % 4 != 0, (F.col("n_chars") % 10) / 10.0).alias("confidence"))
    return identity.best_decision(rows, "key").select("key", "position")


_RULINGS = """c_custkey AS series_key, CASE c_custkey % 4 WHEN 0 THEN 'pending' ELSE 'decided' END AS state, c_custkey % 9 = 0 AS junk,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey + 100000 END AS work_key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 4 END AS season,
  CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'tv' END AS media_type, c_custkey % 3 * 1000 AS year"""


@query(
    "resolve_target",
    f"""+ r AS (SELECT {_RULINGS} FROM customer WHERE c_custkey % 7 <> 0)
    SELECT media_id AS item_id, work_id AS series_key,
      CASE WHEN r.state = 'decided' THEN coalesce(r.work_key, work_id) ELSE work_id END AS target_key,
      CASE WHEN r.state = 'decided' THEN coalesce(r.season, media.season) ELSE media.season END AS target_season,
      CASE WHEN r.state = 'decided' THEN coalesce(nullif(r.media_type, 'unknown'), media.media_type) ELSE media.media_type END AS target_type,
      CASE WHEN r.state = 'decided' THEN coalesce(nullif(r.year, 0), media.year) ELSE media.year END AS target_year,
      coalesce(r.state = 'decided', false) AND coalesce(r.junk, false) AS dropped, r.state IS NULL AS pending
    FROM media LEFT JOIN r ON r.series_key = media.work_id""",
    "media",
)
def resolve_target(c: Catalog) -> DataFrame:
    rulings = c.spark.sql(f"SELECT {_RULINGS} FROM {{t}} WHERE c_custkey % 7 <> 0", t=c.raw("customer"))
    items = c.media.select(F.col("media_id").alias("item_id"), F.col("work_id").alias("series_key"), "season", "media_type", "year")
    return identity.resolve_target(items, rulings)


_IDENTITY = f"""{_LINKED}, t AS (SELECT media_id, work_id % 300 AS work_id, CASE WHEN media_id % 2 = 0 THEN 1 ELSE season END AS season FROM media WHERE media_id % 5 <> 0),
    f AS (SELECT l.media_id, links, coalesce(t.work_id, l.work_id) AS work_id, coalesce(t.season, l.season) AS season,
      coalesce(t.work_id, l.work_id) = l.work_id AND coalesce(t.season, l.season) = l.season AS sits FROM linked l LEFT JOIN t USING (media_id)),
    mapping AS (SELECT media_id, first_value(media_id) OVER (PARTITION BY work_id, season ORDER BY sits DESC, links DESC, CAST(media_id AS VARCHAR) DESC) AS survivor, work_id, season FROM f)"""


def _mapping(c: Catalog) -> DataFrame:
    targets = c.media.where("media_id % 5 <> 0").select("media_id", (F.col("work_id") % 300).alias("work_id"), F.expr("CASE WHEN media_id % 2 = 0 THEN 1 ELSE season END").alias("season"))
    return identity.assign_identities(_linked(c), targets)


@query("assign_identities", f"{_IDENTITY} SELECT media_id, survivor, work_id, season FROM mapping", "media", "bridge")
def assign_identities(c: Catalog) -> DataFrame:
    return _mapping(c).select("media_id", "survivor", "work_id", "season")


@query("merge_links", f"{_IDENTITY} SELECT DISTINCT survivor AS media_id, resource_id FROM bridge JOIN mapping USING (media_id)", "media", "bridge")
def merge_links(c: Catalog) -> DataFrame:
    return identity.move_links(c.bridge, _mapping(c))


@query(
    "merge_attributes",
    f"""{_IDENTITY}, j AS (SELECT media.*, survivor, media_id <> survivor AS o FROM media JOIN mapping USING (media_id)),
    a AS (SELECT survivor, title, min((o, media_id)) AS p FROM j GROUP BY survivor, title)
    SELECT survivor, coalesce(min(nullif(year, 0)), 0) AS year, coalesce(arg_min(media_type, (o, media_id)) FILTER (media_type <> 'unknown'), 'unknown') AS media_type,
      arg_min(title, (o, media_id)) AS title, any_value(x) AS aliases
    FROM j JOIN (SELECT survivor, string_agg(title, '|' ORDER BY p) AS x FROM a GROUP BY survivor) USING (survivor) GROUP BY survivor""",
    "media", "bridge",
)
def merge_attributes(c: Catalog) -> DataFrame:
    rows = c.media.join(_mapping(c).select("media_id", "survivor"), "media_id")
    return identity.merge_attributes(rows, "survivor")


_FACTS = """+ facts AS (SELECT media_id, title = 'LOW' AND media_id % 10 = 0 AS junk, links, media_id % 17 = 0 AS ruled_junk,
      CAST(work_id AS VARCHAR) AS stored_key, CASE WHEN media_id % 6 = 0 THEN '' WHEN media_id % 4 = 0 THEN 'x' ELSE CAST(work_id AS VARCHAR) END AS target_key,
      title, replace(title, 'NOT ', '') AS clean FROM linked),
    plans AS (SELECT media_id, CASE WHEN junk OR links = 0 OR ruled_junk THEN 'delete' WHEN target_key <> '' AND target_key <> stored_key THEN 'rehome' ELSE 'retitle' END AS kind,
      CASE WHEN junk THEN 'junk' WHEN links = 0 THEN 'empty_shell' WHEN ruled_junk THEN 'junk' WHEN target_key <> '' AND target_key <> stored_key THEN 'key_drift' ELSE 'title_drift' END AS symptom
      FROM facts WHERE junk OR links = 0 OR ruled_junk OR (target_key <> '' AND target_key <> stored_key) OR clean <> title)"""
_FACTS_SQL = _LINKED + ", " + _FACTS.lstrip("+ ")


def _plans(c: Catalog) -> DataFrame:
    own = F.col("work_id").cast("string")
    facts = _linked(c).select(
        "media_id", ((F.col("title") == "LOW") & (F.col("media_id") % 10 == 0)).alias("junk"), "links", (F.col("media_id") % 17 == 0).alias("ruled_junk"),
        own.alias("stored_key"), F.when(F.col("media_id") % 6 == 0, "").when(F.col("media_id") % 4 == 0, "x").otherwise(own).alias("target_key"),
        "title", F.replace(F.col("title"), F.lit("NOT "), F.lit("")).alias("clean"),
    )
    return identity.plan_repairs(facts)


@query("repair_plan", f"{_FACTS_SQL} SELECT * FROM plans", "media", "bridge")
def repair_plan(c: Catalog) -> DataFrame:
    return _plans(c)


@query(
    "repair_task_sync",
    f"""{_FACTS_SQL}, t AS (SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 'delete' ELSE 'retitle' END AS k, CASE WHEN media_id % 8 = 0 THEN 'junk' ELSE 'title_drift' END AS s FROM media WHERE media_id % 3 = 0)
    SELECT coalesce(t.media_id, plans.media_id) AS media_id, coalesce(kind, k) AS kind, CASE WHEN k IS NULL THEN 'created' WHEN kind IS NULL THEN 'skipped'
      WHEN kind <> k THEN 'replaced' WHEN symptom = s THEN 'unchanged' ELSE 'refreshed' END AS action FROM t FULL JOIN plans ON t.media_id = plans.media_id""",
    "media", "bridge",
)
def repair_task_sync(c: Catalog) -> DataFrame:
    tasks = c.media.where("media_id % 3 = 0").select(
        "media_id", F.lit("pending").alias("status"), F.when(F.col("media_id") % 2 == 0, "delete").otherwise("retitle").alias("kind"),
        F.when(F.col("media_id") % 8 == 0, "junk").otherwise("title_drift").alias("symptom"),
    )
    return identity.sync_tasks(tasks, _plans(c))


@query(
    "blast_radius",
    f"""{_FACTS_SQL}, s AS (SELECT 'delete' AS kind, 0.05 AS share UNION ALL SELECT 'rehome', 0.2), m AS (SELECT count(*) AS total FROM media)
    SELECT s.kind, count(media_id) AS n, total, total > 0 AND count(media_id) > s.share * total AS blocked FROM s CROSS JOIN m LEFT JOIN plans ON plans.kind = s.kind GROUP BY s.kind, s.share, total""",
    "media", "bridge",
)
def blast_radius(c: Catalog) -> DataFrame:
    return identity.blast_gate(_plans(c), c.media)


@query("prune_empty_media", "SELECT media_id, work_id FROM media WHERE media_id NOT IN (SELECT media_id FROM bridge) AND created_at < 1000000000 - 3600", "media", "bridge")
def prune_empty_media(c: Catalog) -> DataFrame:
    works = c.work
    return identity.prune_empty(c.media, c.bridge, works, 1_000_000_000)[0].select("media_id", "work_id")


@query(
    "prune_empty_works",
    """+ gone AS (SELECT media_id FROM media WHERE media_id NOT IN (SELECT media_id FROM bridge) AND created_at < 1000000000 - 3600)
    SELECT work_id, title FROM work WHERE work_id NOT IN (SELECT work_id FROM media WHERE media_id NOT IN (SELECT media_id FROM gone))""",
    "work", "media", "bridge",
)
def prune_empty_works(c: Catalog) -> DataFrame:
    return identity.prune_empty(c.media, c.bridge, c.work, 1_000_000_000)[1].select("work_id", "title")


@query(
    "cleanup_resources",
    """SELECT share_id // 10 AS new_id, min(resource_id) AS resource_id, CAST(sum(seen_count) AS BIGINT) AS seen_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
      arg_min(CASE WHEN share_id % 3 <> 0 THEN share_id END, resource_id) FILTER (share_id % 3 <> 0) AS size FROM resource GROUP BY share_id // 10""",
    "resource",
)
def cleanup_resources(c: Catalog) -> DataFrame:
    rows = c.resource.withColumn("new_id", F.expr("share_id div 10")).withColumn("size", F.when(F.col("share_id") % 3 != 0, F.col("share_id")))
    return identity.merge_resources(rows, ["new_id"])


@query(
    "requeue_stale",
    """+ q AS (SELECT media_id, status = 'F' AS done, CASE media_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'rules-v1' ELSE 'rules-v2' END AS v FROM media)
    SELECT media_id, v AS version FROM q WHERE done AND v IS DISTINCT FROM 'rules-v2'""",
    "media",
)
def requeue_stale(c: Catalog) -> DataFrame:
    v = F.when(F.col("media_id") % 3 == 1, "rules-v1").when(F.col("media_id") % 3 == 2, "rules-v2")
    return c.media.withColumn("version", v).where((F.col("status") == "F") & ~F.col("version").eqNullSafe("rules-v2")).select("media_id", "version")
