"""Queries of the jobs that commit to a store, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.operators import claims, deltas, repairs, reset
from linkcatalog.plans.catalog import _LINKS, _QUEUE, _SOURCES as _DUE_SOURCES, NOW
from linkcatalog.plans.entities import Catalog, seconds_duck, seconds_spark, with_entities
from linkcatalog.plans.flows import _PLANS, _repairs
from linkcatalog.storage import new_path, stored
from linkcatalog.store import Put, Store
from linkcatalog.streaming import check_timers, collect_job
from linkcatalog.streaming.jobs import drain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
START = 1_700_000_000


def query(name: str, sql: str, *entities: str):
    def keep(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        SQL[name] = with_entities(sql, *entities) if entities else sql
        return f

    return keep


def _store(c: Catalog, name: str) -> Store:
    return Store(c.spark, new_path(c.spark, name))


# --- the collect job: suppliers are sources, line items their posts, return flags the rounds ---

_ROUNDS = ("A", "N", "R")
_SOURCES = """s_suppkey AS source_id, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS title, 900 AS fetch_interval,
  CASE WHEN s_acctbal > 5000 THEN s_suppkey * 20 END AS cursor, s_nationkey * 4 AS failures"""
_POSTS = """l_suppkey AS source_id, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS kind, l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN 'x' ELSE '' END || CAST(l_orderkey AS VARCHAR(20)) AS id, seconds(l_shipdate) AS published_at,
  CASE WHEN l_quantity > 49 THEN '' ELSE CAST(l_partkey AS VARCHAR(20)) || ' of ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END AS text"""


def _said(r: int) -> dict[str, str]:
    """What a round's fetch of a source says, by the columns of supplier."""
    return {
        "error": "CASE WHEN s_nationkey % 4 = 1 THEN 'timeout' END" if r == 2 else "CAST(NULL AS VARCHAR(9))",
        "truncated": f"(s_nationkey + {r}) % 3 = 0",
        "reopen": f"s_nationkey % 5 = 0 AND {r} = 3",
        "back_done": f"s_nationkey % 3 = 0 AND {r} = 2",
    }


def _fetches(c: Catalog, r: int) -> DataFrame:
    spark = c.spark
    posts = spark.sql(f"SELECT {seconds_spark(_POSTS)} FROM {{l}} WHERE l_returnflag = '{_ROUNDS[r - 1]}'", l=c.raw("lineitem"))
    entry = F.struct("l_orderkey", "l_linenumber", F.struct("id", "text", F.lit(None).cast("string").alias("url"), "published_at").alias("m"))
    listed = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))), lambda x: x["m"])
    got = posts.groupBy("source_id").agg(listed(0).alias("messages"), listed(1).alias("old"), F.min(F.when(F.col("kind") == 1, F.col("l_orderkey"))).alias("oldest"))
    says = ", ".join(f"{sql} AS {k}" for k, sql in _said(r).items())
    rows = spark.sql(f"SELECT s_suppkey AS source_id, 'T' || s_name AS title, {says} FROM {{s}}", s=c.raw("supplier")).join(got, "source_id", "left")
    good = F.col("error").isNull()
    state = F.from_json(F.lit({1: '{"page":"1"}', 2: '{"page":"2","v":"x"}', 3: '{"page":null}'}[r]), "map<string,string>")
    back = F.struct(
        F.col("old").alias("messages"), F.col("oldest").cast("long").alias("cursor"), F.col("back_done").alias("done"),
        F.from_json(F.lit('{"h":"%d"}' % r), "map<string,string>").alias("state"),
    )
    return rows.select(
        F.col("source_id").cast("long").alias("source_id"), F.lit(START + 1000 * r).cast("long").alias("fetched_at"), "error", "title", "truncated",
        F.col("reopen").alias("backfill_pending"), F.when(good, state).alias("state"), F.when(good, F.coalesce("messages", F.array().cast(collect_job._MESSAGES))).alias("messages"),
        F.when(good & (F.size("old") > 0), back).alias("history"),
    )


def _collect_sql() -> str:
    """The rounds one after the other."""
    out = f"""WITH posts AS (SELECT {seconds_duck(_POSTS)} FROM lineitem),
    s0 AS (SELECT {_SOURCES}, true AS enabled, CAST(NULL AS BIGINT) AS cursor_at, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS backfill, false AS backfill_done,
      CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS BIGINT) AS next_fetch_at, CAST(NULL AS VARCHAR) AS page, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS h, s_nationkey, s_name
      FROM supplier)"""
    for r, flag in enumerate(_ROUNDS, 1):
        said = _said(r)
        now = START + 1000 * r
        page = {1: "'1'", 2: "'2'", 3: "NULL"}[r]
        out += f""",
    g{r} AS (SELECT source_id, max(CASE WHEN kind = 0 AND l_linenumber <> 7 THEN l_orderkey END) AS newest, min(CASE WHEN kind = 0 AND l_linenumber <> 7 THEN l_orderkey END) AS oldest,
      arg_min(published_at, (-l_orderkey, l_linenumber)) FILTER (kind = 0 AND l_linenumber <> 7) AS newest_at, bool_or(kind = 1) AS back, min(CASE WHEN kind = 1 THEN l_orderkey END) AS back_to
      FROM posts WHERE flag = '{flag}' GROUP BY source_id),
    x{r} AS (SELECT s.*, {said['error']} AS err, {said['truncated']} AS cut, backfill_done AND NOT ({said['reopen']}) AS was_done, {said['back_done']} AS bd, newest, oldest, newest_at,
      coalesce(back, false) AS back, back_to, greatest(newest, pending) AS top, 'T' || s_name AS new_title FROM s{r - 1} s LEFT JOIN g{r} USING (source_id)),
    y{r} AS (SELECT *, NOT cut AND top IS NOT NULL AND (cursor IS NULL OR top > cursor) AS moves, back AND NOT was_done AS steps FROM x{r}),
    z{r} AS (SELECT *, CASE WHEN moves THEN top ELSE cursor END AS c2 FROM y{r}),
    s{r} AS (SELECT source_id, CASE WHEN err IS NULL THEN coalesce(nullif(title, ''), new_title) ELSE title END AS title, fetch_interval, CASE WHEN err IS NULL THEN c2 ELSE cursor END AS cursor,
      CASE WHEN err IS NULL THEN 0 ELSE failures + 1 END AS failures, enabled AND NOT (err IS NOT NULL AND failures + 1 >= 50) AS enabled,
      CASE WHEN err IS NULL AND moves AND newest = top THEN newest_at ELSE cursor_at END AS cursor_at,
      CASE WHEN err IS NOT NULL THEN pending WHEN NOT cut AND top IS NOT NULL THEN NULL WHEN cut THEN top ELSE pending END AS pending,
      CASE WHEN err IS NOT NULL THEN backfill WHEN steps THEN coalesce(back_to, backfill, oldest, c2) ELSE coalesce(backfill, oldest, c2) END AS backfill,
      CASE WHEN err IS NOT NULL THEN backfill_done ELSE was_done OR (steps AND bd) END AS backfill_done, err AS last_error,
      CASE WHEN err IS NOT NULL THEN {now} + CAST(least(21600, 60 * pow(2, least(failures + 1, 20))) AS BIGINT)
        ELSE {now} + CASE WHEN cut OR NOT (was_done OR (steps AND bd)) THEN 5 ELSE fetch_interval END END AS next_fetch_at,
      CASE WHEN err IS NULL THEN {page} ELSE page END AS page, CASE WHEN err IS NULL AND {r} = 2 THEN 'x' ELSE v END AS v, CASE WHEN err IS NULL AND steps THEN '{r}' ELSE h END AS h,
      s_nationkey, s_name FROM z{r})"""
    rounds = " UNION ALL ".join(
        f"SELECT source_id, {r} AS r, kind, l_orderkey, l_linenumber, text FROM posts JOIN x{r} USING (source_id) WHERE flag = '{flag}' AND err IS NULL" for r, flag in enumerate(_ROUNDS, 1)
    )
    return f"""{out},
    m AS ({rounds}), f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY r, source_id, kind, l_orderkey, l_linenumber) AS n FROM m),
    k AS (SELECT source_id, count(*) FILTER (n = 1 AND text <> '' AND kind = 0) AS total_collected, count(*) FILTER (n = 1 AND text <> '' AND kind = 1) AS total_backfilled,
      count(*) FILTER (n > 1 AND text <> '') AS duplicated, count(*) FILTER (text = '') AS skipped_empty FROM f GROUP BY source_id)
    SELECT source_id, title, enabled, cursor, cursor_at, pending, backfill, backfill_done, failures, last_error, next_fetch_at, page, v, h,
      coalesce(total_collected, 0) AS total_collected, coalesce(total_backfilled, 0) AS total_backfilled, coalesce(total_collected, 0) + coalesce(total_backfilled, 0) AS stored,
      coalesce(duplicated, 0) AS duplicated, coalesce(skipped_empty, 0) AS skipped_empty FROM s3 LEFT JOIN k USING (source_id)"""


@query("collect_job", _collect_sql())
def collect_all(c: Catalog) -> DataFrame:
    """Three rounds of fetches come as files, and the stream goes on with each; a round is one commit of posts, cursors, history and
    schedule."""
    store = _store(c, "collect")
    collect_job.create(store, c.spark.sql(f"SELECT {_SOURCES} FROM {{s}}", s=c.raw("supplier")))
    for r in (1, 2, 3):
        _fetches(c, r).write.parquet(f"{store.root}/fetches/round={r}")
        fetches = c.spark.readStream.schema(collect_job.FETCH).parquet(f"{store.root}/fetches/*")
        collect_job.CollectJob(store).run(fetches, f"{store.root}/state")
    at = store.current()
    stored = store.read("document", at).groupBy("source_id").agg(F.count("*").alias("stored"))
    sums = store.read("fetch_report", at).groupBy("source_id").agg(F.sum("duplicated").alias("duplicated"), F.sum("skipped_empty").alias("skipped_empty"))
    rows = store.read("source", at).join(stored, "source_id", "left").join(sums, "source_id", "left").na.fill(0, ["stored", "duplicated", "skipped_empty"])
    return rows.select(
        "source_id", "title", "enabled", "cursor", "cursor_at", "pending", "backfill", "backfill_done", "failures", "last_error", "next_fetch_at",
        *[F.try_element_at("state", F.lit(k)).alias(k) for k in ("page", "v", "h")], "total_collected", "total_backfilled", "stored", "duplicated", "skipped_empty",
    )


# --- claims: two workers at once, who never get the same row ---


def _two(claim: Callable[[str], DataFrame]) -> None:
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(claim, ("w1", "w2")))


def _documents_claimed(before: str, after: str, limit: int) -> str:
    """One claim in SQL: table ``before`` to table ``after``."""
    return f"""{after}_due AS (SELECT * FROM {before} WHERE parse_status IN ('pending', 'running') AND (lease_until IS NULL OR lease_until <= {NOW}) AND (next_parse_at IS NULL OR next_parse_at <= {NOW})),
    {after}_few AS (SELECT d.*, CASE WHEN source IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY source) END AS n, parse_status = 'running' AND attempts + 1 >= 5 AS poison FROM {after}_due d
      ORDER BY n, last_parsed_at NULLS FIRST, doc_id LIMIT {limit * 2 + 8}),
    {after}_c AS (SELECT *, coalesce(sum(CASE WHEN poison THEN 0 ELSE 1 END) OVER (ORDER BY n, last_parsed_at NULLS FIRST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {after}_few),
    {after} AS (SELECT q.doc_id, q.source, CASE WHEN c.poison THEN 'failed' WHEN c.doc_id IS NOT NULL THEN 'running' ELSE q.parse_status END AS parse_status,
      CASE WHEN c.poison THEN NULL WHEN c.doc_id IS NOT NULL THEN {NOW + 600} ELSE q.lease_until END AS lease_until, CASE WHEN c.poison THEN NULL ELSE q.next_parse_at END AS next_parse_at, q.last_parsed_at,
      q.attempts + CASE WHEN c.doc_id IS NOT NULL AND c.parse_status = 'running' THEN 1 ELSE 0 END AS attempts, q.claimed OR c.doc_id IS NOT NULL AS claimed
      FROM {before} q LEFT JOIN (SELECT * FROM {after}_c WHERE b < {limit}) c ON c.doc_id = q.doc_id)"""


@query(
    "claim_documents_shared",
    f"""WITH q0 AS (SELECT {_QUEUE}, false AS claimed FROM documents), {_documents_claimed("q0", "q1", 40)}, {_documents_claimed("q1", "q2", 40)}
    SELECT doc_id, parse_status, lease_until, next_parse_at, attempts FROM q2 WHERE claimed""",
)
def claim_documents_shared(c: Catalog) -> DataFrame:
    store = _store(c, "claims")
    queue = c.spark.sql(f"SELECT {_QUEUE}, CAST(NULL AS STRING) AS lease_token, CAST(NULL AS STRING) AS parse_error FROM {{docs}}", docs=c.raw("documents"))
    store.commit(store.current(), {"document_queue": Put(queue, ["doc_id"])})
    _two(lambda w: claims.claim_documents(store, w, NOW, 40))
    got = store.read("document_queue").where("lease_token is not null or parse_error is not null")
    return got.select("doc_id", "parse_status", "lease_until", "next_parse_at", "attempts")


_CHECKED = f"{_LINKS.replace('check_status,', 'share_id, ')}, CASE check_status WHEN 'error' THEN 'checking' ELSE check_status END AS check_status"
_CLAIMED = f"""+ q AS (SELECT {_CHECKED} FROM resource),
    c AS (SELECT *, check_status = 'checking' AS again FROM q WHERE provider = 'quark' AND (lease_until IS NULL OR lease_until <= {NOW}) AND (next_check_at <= {NOW} OR (next_check_at IS NULL AND check_status = 'unchecked'))
      ORDER BY next_check_at NULLS FIRST, resource_id LIMIT 120)"""
_MORE = ("prior_status", "lease_token", "url", "title_raw", "sharer_id", "sharer_name", "sharer_avatar_url")


def _links_store(c: Catalog) -> Store:
    store = _store(c, "links")
    blank = ", ".join([*(f"CAST(NULL AS STRING) AS {x}" for x in _MORE), "CAST(NULL AS BIGINT) AS last_checked_at", "CAST(NULL AS BIGINT) AS size_bytes"])
    links = c.spark.sql(f"SELECT {_CHECKED}, {blank} FROM {{r}}", r=c.resource).withColumn("check_attempts", F.col("check_attempts").cast("long"))
    store.commit(store.current(), {"resource": Put(links, ["resource_id"])})
    return store


@query(
    "claim_resources_shared",
    f"""{_CLAIMED} SELECT resource_id, check_status AS prior_status, CAST(check_attempts + CASE WHEN again THEN 1 ELSE 0 END AS BIGINT) AS check_attempts, {NOW + 600} AS lease_until,
      CASE WHEN again THEN {NOW} + CAST(least(21600, 60 * pow(2, check_attempts + 1)) AS BIGINT) ELSE next_check_at END AS next_check_at FROM c""",
    "resource",
)
def claim_resources_shared(c: Catalog) -> DataFrame:
    store = _links_store(c)
    _two(lambda w: claims.claim_resources(store, w, NOW, 60, checkable=("quark",)))
    got = store.read("resource").where("lease_token is not null and check_status = 'checking'")
    return got.select("resource_id", "prior_status", "check_attempts", "lease_until", "next_check_at")


@query(
    "claim_sources_shared",
    f"""WITH q AS (SELECT {_DUE_SOURCES}, s_suppkey % 6 AS failures FROM supplier), p AS (SELECT *, CASE WHEN source_type IN ('rss', 'web')
      AND (last_success_at IS NULL OR last_success_at <= {NOW} - 43200) THEN 0 ELSE 1 END AS priority FROM q
      WHERE enabled AND (next_run_at IS NULL OR next_run_at <= {NOW}) AND (lease_until IS NULL OR lease_until <= {NOW}) ORDER BY priority, next_run_at NULLS FIRST, source_id LIMIT 14)
    SELECT source_id, {NOW + 600} AS lease_until, CAST(failures + CASE WHEN lease_until IS NULL THEN 0 ELSE 1 END AS BIGINT) AS failures,
      CASE WHEN lease_until IS NULL THEN next_run_at ELSE {NOW} + CAST(least(21600, 60 * pow(2, failures + 1)) AS BIGINT) END AS next_fetch_at FROM p""",
)
def claim_sources_shared(c: Catalog) -> DataFrame:
    store = _store(c, "sources")
    rows = c.spark.sql(f"SELECT {_DUE_SOURCES}, s_suppkey % 6 AS failures, CAST(NULL AS STRING) AS lease_token FROM {{s}}", s=c.raw("supplier")).withColumnRenamed("next_run_at", "next_fetch_at")
    store.commit(store.current(), {"source_queue": Put(rows, ["source_id"])})
    _two(lambda w: claims.claim_sources(store, w, NOW, 7))
    got = store.read("source_queue").where("lease_token is not null")
    return got.select("source_id", "lease_until", F.col("failures").cast("long").alias("failures"), "next_fetch_at")


# --- checks written with history and counts ---

_STATUS = "CASE resource_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'rate_limited' END"
_AFTER = f"""{_CLAIMED}, a AS (SELECT resource_id, again, {_STATUS} AS status, check_status AS base, check_attempts FROM c),
    d AS (SELECT resource_id, status, base, CASE WHEN again THEN check_attempts + 1 WHEN status = base THEN check_attempts + 1 ELSE 1 END AS attempts FROM a)"""


def _checked_store(c: Catalog) -> Store:
    store = _links_store(c)
    known = c.spark.sql(f"SELECT {_CHECKED} FROM {{r}}", r=c.resource).select("resource_id", "check_status")
    held = c.bridge.join(known, "resource_id").groupBy("media_id").agg(F.count("*").alias("resource_count"), F.count_if(F.col("check_status") == "valid").alias("valid_count"))
    media = c.media.select("media_id", "work_id").join(held, "media_id")
    works = media.groupBy("work_id").agg(F.count("*").alias("season_count"), F.sum("resource_count").alias("resource_count"), F.sum("valid_count").alias("valid_count"))
    history = "provider string, share_id bigint, url string, checked_at bigint, status string, http_code int, probe string, detail string, latency_ms bigint"
    store.commit(store.current(), {
        "bridge": Put(c.bridge, ["media_id", "resource_id"]), "media_count": Put(media, ["media_id"]), "work_count": Put(works, ["work_id"]),
        "link_check": Put(c.spark.createDataFrame([], history)),
    })
    mine = claims.claim_resources(store, "w", NOW, 120, checkable=("quark",))
    found = mine.selectExpr(
        "resource_id", f"{_STATUS} AS status", "CASE WHEN resource_id % 2 = 0 THEN 'T' END AS title", "resource_id * 10 AS size_bytes", "'id' AS sharer_id", "'S' AS sharer_name",
        "'' AS sharer_avatar_url", "200 AS http_code", "'p' AS probe", "CAST(NULL AS STRING) AS detail", "CAST(5 AS BIGINT) AS latency_ms",
    )
    claims.finish_checks(store, found, "w", NOW + 60)
    return store


@query(
    "check_persist",
    f"""{_AFTER} SELECT resource_id, status AS check_status, CAST(attempts AS BIGINT) AS check_attempts, CASE WHEN resource_id % 2 = 0 THEN 'T' END AS title_raw, CAST(resource_id * 10 AS BIGINT) AS size_bytes,
      'S' AS sharer_name, CASE WHEN status = 'valid' THEN {NOW + 60} + 7 * 86400 WHEN status = 'invalid' AND attempts < 2 THEN {NOW + 60} + 30 * 86400
      WHEN status = 'rate_limited' THEN {NOW + 60} + CAST(least(21600, 60 * pow(2, least(attempts, 20))) AS BIGINT) END AS next_check_at, CAST(1 AS BIGINT) AS n_history FROM d""",
    "resource",
)
def check_persist(c: Catalog) -> DataFrame:
    store = _checked_store(c)
    history = store.read("link_check").select("provider", "share_id").groupBy("provider", "share_id").agg(F.count("*").alias("n_history"))
    got = store.read("resource").where(f"last_checked_at = {NOW + 60} and lease_token is null").join(history, ["provider", "share_id"], "left")
    return got.select("resource_id", "check_status", "check_attempts", "title_raw", "size_bytes", "sharer_name", "next_check_at", F.coalesce("n_history", F.lit(0)).alias("n_history"))


@query(
    "check_persist_counts",
    f"""{_AFTER}, r AS (SELECT q.resource_id, coalesce(d.status, q.check_status) AS s FROM q LEFT JOIN d USING (resource_id)),
    m AS (SELECT media_id, count(*) AS n, count(*) FILTER (s = 'valid') AS v FROM bridge JOIN r USING (resource_id) GROUP BY media_id)
    SELECT work_id, count(*) AS season_count, CAST(sum(n) AS BIGINT) AS resource_count, CAST(sum(v) AS BIGINT) AS valid_count FROM m JOIN media USING (media_id) GROUP BY work_id""",
    "resource", "bridge", "media",
)
def check_persist_counts(c: Catalog) -> DataFrame:
    return _checked_store(c).read("work_count").select("work_id", "season_count", "resource_count", "valid_count")


# --- counts kept by edits: what was linked by returned line items goes, by those of flag N comes ---

_VALID = {"before": "check_status = 'valid'", "after": "CASE WHEN share_id % 7 = 0 THEN check_status <> 'valid' ELSE check_status = 'valid' END"}
_LINKED_BY = "share_id * 2 + CASE provider WHEN 'quark' THEN 1 ELSE 0 END"


@query(
    "counters_incremental",
    f"""+ p AS (SELECT media_id, {_LINKED_BY} AS resource_id, flag FROM mention), l AS (SELECT media_id, resource_id, bool_or(flag = 'N') AS kept FROM p GROUP BY ALL),
    r AS (SELECT resource_id, {_VALID["after"]} AS valid FROM resource),
    m AS (SELECT media_id, count(*) AS n, count(*) FILTER (valid) AS v FROM l JOIN r USING (resource_id) WHERE kept GROUP BY media_id),
    w AS (SELECT media_id, CASE WHEN status = 'O' THEN work_id + 1 ELSE work_id END AS work_id FROM media)
    SELECT work_id, count(*) AS season_count, CAST(sum(n) AS BIGINT) AS resource_count, CAST(sum(v) AS BIGINT) AS valid_count FROM m JOIN w USING (media_id) GROUP BY work_id""",
    "mention", "resource", "media",
)
def counters_incremental(c: Catalog) -> DataFrame:
    """Counts of the links of flags A and R, then the edits to those of flag N, in two epochs, the first of which
    comes twice."""
    store = _store(c, "counts")
    pairs = c.mention.select("media_id", F.expr(_LINKED_BY).alias("resource_id"), "flag")
    flags = pairs.groupBy("media_id", "resource_id").agg(F.bool_or(F.col("flag") == "N").alias("new"), F.bool_or(F.col("flag") != "N").alias("old"))
    links = stored(c.resource.select("resource_id", F.expr(_VALID["before"]).alias("before"), F.expr(_VALID["after"]).alias("after")), "links")
    both = stored(flags.join(links, "resource_id"), "pairs")
    before = both.where("old")
    counted = before.groupBy("media_id").agg(F.count("*").alias("resource_count"), F.count_if("before").alias("valid_count")).join(c.media.select("media_id", "work_id"), "media_id")
    media = stored(counted.select("media_id", "work_id", "resource_count", "valid_count"), "seasons")
    works = media.groupBy("work_id").agg(F.count("*").alias("season_count"), F.sum("resource_count").alias("resource_count"), F.sum("valid_count").alias("valid_count"))
    store.commit(store.current(), {"media_count": Put(media, ["media_id"]), "work_count": Put(works, ["work_id"])})
    first = deltas.Edits(
        added=both.where("new and not old").select("media_id", "resource_id", F.col("after").alias("valid")),
        removed=both.where("old and not new").select("media_id", "resource_id", F.col("before").alias("valid")),
        flipped=links.where("before <> after").select("resource_id", F.col("after").alias("valid")), links=before.select("media_id", "resource_id"),
        moved=c.media.join(both.where("new and not old").select("media_id").distinct(), "media_id", "left_semi").select("media_id", "work_id"),
    )
    deltas.apply_edits(store, first, "edits", 0)
    deltas.apply_edits(store, first, "edits", 0)
    moved = c.media.where("status = 'O'").join(store.read("media_count").select("media_id"), "media_id", "left_semi")
    deltas.apply_edits(store, deltas.Edits(moved=moved.select("media_id", (F.col("work_id") + 1).alias("work_id"))), "edits", 1)
    return store.read("work_count").where("season_count > 0").select("work_id", "season_count", "resource_count", "valid_count")


# --- repair rounds and reset ---

_TASKS = """t AS (SELECT p.* FROM p JOIN media USING (media_id) WHERE media.title = 'URGENT' AND (kind <> 'delete' OR media.price > 200000)),
    t2 AS (SELECT t.media_id, t.kind, CASE t.kind WHEN 'retitle' THEN 'new ' || t.title ELSE t.title END AS title, t.target_key, t.season FROM t)"""


def _repair_store(c: Catalog) -> Store:
    store = _store(c, "repairs")
    media, plans = _repairs(c)
    more = c.media.select("media_id", "year", "media_type", "price", "created_at", F.col("title").alias("was"))
    media = media.join(more.select("media_id", "media_type", "year"), "media_id")
    tasks = plans.join(more, "media_id").where("was = 'URGENT' and (kind <> 'delete' or price > 200000)").select(
        F.col("media_id").alias("task_id"), "media_id", "kind", F.lit("s").alias("symptom"), F.when(F.col("kind") == "retitle", F.concat(F.lit("new "), "title")).otherwise(F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("long").alias("year"), "target_key", "season", F.lit("pending").alias("status"),
        F.col("created_at").cast("long").alias("detected_at"), F.lit(None).cast("long").alias("applied_at"),
    )
    works = c.work.select(F.col("work_id").cast("string").alias("work_key"), "title", "media_type", F.col("year").cast("long").alias("year"))
    store.commit(store.current(), {
        "media": Put(media.withColumn("year", F.col("year").cast("long")), ["media_id"]), "bridge": Put(c.bridge, ["media_id", "resource_id"]),
        "work": Put(works, ["work_key"]), "repair_task": Put(tasks, ["task_id"]),
    })
    return store


@query(
    "repair_round",
    f"""{_PLANS}, {_TASKS},
    left_ AS (SELECT m.media_id, coalesce(h.target_key, work_key) AS work_key, coalesce(h.season, m.season) AS season, coalesce(h.title, r.title, m.title) AS title, h.media_id IS NOT NULL AS moved,
        coalesce(h.target_key, work_key) = work_key AND coalesce(h.season, m.season) = m.season AS sits, (SELECT count(*) FROM bridge WHERE bridge.media_id = m.media_id) AS links
      FROM m LEFT JOIN t2 r ON r.media_id = m.media_id AND r.kind = 'retitle' LEFT JOIN t2 h ON h.media_id = m.media_id AND h.kind = 'rehome'
      WHERE m.media_id NOT IN (SELECT media_id FROM t2 WHERE kind = 'delete')),
    goal AS (SELECT DISTINCT work_key, season FROM left_ WHERE moved),
    f AS (SELECT left_.*, CASE WHEN goal.work_key IS NULL THEN media_id ELSE first_value(media_id) OVER (PARTITION BY left_.work_key, left_.season ORDER BY sits DESC, links DESC, CAST(media_id AS VARCHAR) DESC) END AS survivor
      FROM left_ LEFT JOIN goal ON goal.work_key = left_.work_key AND goal.season = left_.season),
    b AS (SELECT survivor AS media_id, count(DISTINCT resource_id) AS n FROM f JOIN bridge USING (media_id) GROUP BY survivor)
    SELECT media_id, work_key, season, title, CAST(coalesce(n, 0) AS BIGINT) AS links, (SELECT count(*) FROM t2) AS tasks FROM f LEFT JOIN b USING (media_id) WHERE media_id = survivor""",
    "media", "bridge",
)
def repair_round(c: Catalog) -> DataFrame:
    store = _repair_store(c)
    report = repairs.run_round(store, NOW)
    counts = store.read("bridge").groupBy("media_id").agg(F.count("*").alias("links"))
    tasks = sum(n for k, n in report.items() if k.endswith(("_applied", "_skipped")))
    rows = store.read("media").join(counts, "media_id", "left")
    return rows.select("media_id", "work_key", "season", "title", F.coalesce("links", F.lit(0)).alias("links"), F.lit(tasks).cast("long").alias("tasks"))


@query(
    "reset_tables",
    """+ n AS (SELECT 'media' AS name, count(*) AS before FROM media UNION ALL SELECT 'work', count(*) FROM work UNION ALL SELECT 'bridge', count(*) FROM bridge
      UNION ALL SELECT 'source', count(*) FROM supplier UNION ALL SELECT 'document_queue', count(*) FROM documents UNION ALL SELECT 'link_check', count(*) FROM checks)
    SELECT name, before, CASE WHEN name IN ('source', 'document_queue', 'link_check') THEN before ELSE 0 END AS after,
      CASE WHEN name = 'document_queue' THEN before ELSE 0 END AS requeued, before AS restored FROM n""",
    "media", "work", "bridge", "checks",
)
def reset_tables(c: Catalog) -> DataFrame:
    """Reset with documents kept, counted, and taken back."""
    store = _store(c, "reset")
    queue = c.spark.sql(f"SELECT {_QUEUE} FROM {{docs}}", docs=c.raw("documents"))
    sources = c.spark.sql("SELECT s_suppkey AS source_id, CAST(s_suppkey AS BIGINT) AS cursor, true AS backfill_done FROM {s}", s=c.raw("supplier"))
    tables = {"media": (c.media, ["media_id"]), "work": (c.work, ["work_id"]), "bridge": (c.bridge, ["media_id", "resource_id"]), "link_check": (c.checks, ["check_id"])}
    tables |= {"document_queue": (queue, ["doc_id"]), "source": (sources, ["source_id"])}
    store.commit(store.current(), {n: Put(rows, key) for n, (rows, key) in tables.items()})
    report = reset.reset(store, keep_documents=True)
    pending = store.read("document_queue").where("parse_status = 'pending' and attempts = 0 and lease_until is null").count()
    store.restore(report.snapshot)
    rows = [(n, report.before[n], report.after[n], pending if n == "document_queue" else 0, store.read(n).count()) for n in tables]
    return c.spark.createDataFrame(rows, "name string, before long, after long, requeued long, restored long")


# --- the check machine with claims and timers: events in three files, dealt without regard to time ---

_CLAIMS = "CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'view' THEN 'valid' WHEN 'signup' THEN 'invalid' WHEN 'click' THEN 'checking' ELSE 'error' END"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(
    "stream_check_timers",
    f"""WITH e AS (SELECT user_id AS link, event_id AS check_id, {seconds_duck("seconds(ts)")} AS checked_at, {_CLAIMS} AS status FROM events),
    a AS (SELECT *, sum(CASE WHEN status = 'checking' THEN 0 ELSE 1 END) OVER (PARTITION BY link ORDER BY checked_at, check_id) - CASE WHEN status = 'checking' THEN 0 ELSE 1 END AS part FROM e),
    p AS (SELECT link, part, count(*) FILTER (status = 'checking') AS claims, max(status) FILTER (status <> 'checking') AS result FROM a GROUP BY link, part),
    b AS (SELECT *, lag(result) OVER (PARTITION BY link ORDER BY part) AS prev, claims >= 2 AS lost FROM p),
    d AS (SELECT *, CASE WHEN result IS NULL OR lost THEN greatest(claims - 1, 0) ELSE 1 END AS more, CASE WHEN result IS NOT NULL AND NOT lost AND result IS DISTINCT FROM prev THEN 1 ELSE 0 END AS anew FROM b),
    r AS (SELECT *, sum(anew) OVER (PARTITION BY link ORDER BY part) AS run FROM d),
    n AS (SELECT *, sum(more) OVER (PARTITION BY link, run ORDER BY part) AS attempts, row_number() OVER (PARTITION BY link ORDER BY part DESC) AS back FROM r)
    SELECT link, (SELECT count(*) FROM e WHERE e.link = n.link) AS checks, max(coalesce(result, 'checking')) FILTER (back = 1) AS status, CAST(max(attempts) FILTER (back = 1) AS INTEGER) AS attempts,
      CAST(count(*) FILTER (result IS NOT NULL AND (result = 'valid') <> (NOT lost AND coalesce(prev, '') = 'valid')) AS INTEGER) AS flips FROM n GROUP BY link""",
)
def stream_check_timers(c: Catalog) -> DataFrame:
    spark, at = c.spark, new_path(c.spark, "timers")
    rows = c.raw("events").selectExpr("user_id AS link", "event_id AS check_id", f"{seconds_spark('seconds(ts)')} AS checked_at", f"{_CLAIMS} AS status", "md5(CAST(event_id AS STRING)) AS h")
    rows = rows.withColumn("h", F.substr("h", F.lit(1), F.lit(1)))
    for n, some in enumerate(("h < '5'", "h >= '5' and h < 'a'", "h >= 'a'")):
        rows.where(some).drop("h").coalesce(1).write.parquet(f"{at}/batch={n}")
    schema = "link long, check_id long, checked_at long, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*").withColumn("at", F.timestamp_seconds("checked_at"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        out = drain(check_timers.check_timers(stream, "4000 days"), "timers", "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = out.groupBy("link").agg(F.max_by(F.struct("checks", "status", "attempts", "flips"), "checks").alias("x"))
    return last.select("link", "x.*")
