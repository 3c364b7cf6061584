"""Queries of collecting: messages are conversation turns, sources are suppliers and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.operators import collect
from linkcatalog.plans.entities import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        SQL[name] = sql
        return f

    return keep


@query("collect_new_messages", "SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 0")
def collect_new_messages(c: Catalog) -> DataFrame:
    turns = c.raw("conversations").select("conv_id", "turn")
    return collect.new_messages(turns.union(turns), turns.where("turn % 3 = 0"), ["conv_id", "turn"])


@query("collect_keep_seen", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def collect_keep_seen(c: Catalog) -> DataFrame:
    rows = collect.keep_seen(c.raw("events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5)
    return rows.select("user_id", "event_id")


_CURSORS = """s_suppkey AS source_id, CAST(s_suppkey * 20 AS BIGINT) AS cursor, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey * 30 AS BIGINT) END AS pending,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey AS BIGINT) END AS backfill"""
_FETCHED = "l_suppkey AS source_id, l_orderkey AS message_id, l_suppkey % 7 = 0 AND l_linenumber = 7 AS truncated"


@query(
    "advance_cursors",
    f"""WITH s AS (SELECT {_CURSORS} FROM supplier), g AS (SELECT source_id, max(message_id) AS newest, min(message_id) AS oldest, bool_or(truncated) AS cut
      FROM (SELECT {_FETCHED} FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0) GROUP BY source_id)
    SELECT source_id, CASE WHEN NOT cut THEN greatest(cursor, coalesce(pending, 0), newest) ELSE cursor END AS cursor,
      CASE WHEN coalesce(NOT cut, false) THEN NULL ELSE greatest(pending, newest) END AS pending, coalesce(backfill, oldest) AS backfill,
      coalesce(coalesce(backfill, oldest) <= 1, false) AS backfill_done FROM s LEFT JOIN g USING (source_id)""",
)
def advance_cursors(c: Catalog) -> DataFrame:
    sources = c.spark.sql(f"SELECT {_CURSORS} FROM {{s}}", s=c.raw("supplier"))
    fetched = c.spark.sql(f"SELECT {_FETCHED} FROM {{l}} JOIN {{s}} ON s_suppkey = l_suppkey WHERE s_acctbal >= 0", l=c.raw("lineitem"), s=c.raw("supplier"))
    return collect.advance_cursors(sources, fetched)


@query(
    "plan_backfill",
    "SELECT s_suppkey AS source_id, s_suppkey * 7 - 20 * k AS before FROM supplier, generate_series(0, 4) AS t(k) WHERE s_suppkey * 7 - 20 * k >= 2",
)
def plan_backfill(c: Catalog) -> DataFrame:
    return collect.plan_backfill(c.raw("supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") * 7).alias("backfill")), 5)


@query(
    "merge_state",
    """WITH s AS (SELECT s_suppkey AS source_id, 'sheet' || (s_suppkey % 3) AS key, s_suppkey AS value FROM supplier WHERE s_suppkey % 2 = 0),
    u AS (SELECT s_suppkey AS source_id, 'sheet' || (s_suppkey % 3) AS key, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * (s_suppkey % 4) END AS value FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT coalesce(s.source_id, u.source_id) AS source_id, coalesce(s.key, u.key) AS key, CASE WHEN u.key IS NULL THEN s.value ELSE greatest(s.value, u.value) END AS value
    FROM s FULL JOIN u ON s.source_id = u.source_id AND s.key = u.key WHERE u.key IS NULL OR u.value IS NOT NULL""",
)
def merge_state(c: Catalog) -> DataFrame:
    i = F.col("s_suppkey")
    base = c.raw("supplier").select(i.alias("source_id"), F.concat(F.lit("sheet"), (i % 3).cast("string")).alias("key"), i)
    state = base.where("s_suppkey % 2 = 0").select("source_id", "key", i.alias("value"))
    update = base.where("s_suppkey % 3 = 0").select("source_id", "key", F.when(i % 5 != 0, i * (i % 4)).alias("value"))
    return collect.merge_state(state, update)


@query(
    "record_failures",
    """SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 60 + 1 ELSE 0 END AS failures,
      1705000000 + CASE WHEN s_suppkey % 3 = 0 THEN CAST(least(21600, 60 * pow(2, least(s_suppkey % 60 + 1, 20))) AS BIGINT) ELSE 900 END AS next_run_at,
      s_suppkey % 10 <> 0 AND CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 60 + 1 ELSE 0 END < 50 AS enabled FROM supplier""",
)
def record_failures(c: Catalog) -> DataFrame:
    i = F.col("s_suppkey")
    sources = c.raw("supplier").select(i.alias("source_id"), (i % 60).alias("failures"), F.lit(900).alias("interval"), (i % 10 != 0).alias("enabled"))
    return collect.record_failures(sources, sources.where("source_id % 3 = 0"), 1_705_000_000)


@query("top_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_keys(c: Catalog) -> DataFrame:
    return c.raw("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
