"""The catalogue's tables, laid over the driver's tables: each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL that both engines read; seconds() stands for the whole seconds of a time stamp.
SQL = {
    "work": """SELECT c_custkey AS work_id, c_name AS title, lower(replace(c_name, '#', '')) AS norm_key,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'movie' WHEN 'BUILDING' THEN 'tv' WHEN 'FURNITURE' THEN 'anime'
    WHEN 'MACHINERY' THEN 'book' ELSE 'unknown' END AS media_type,
  CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1960 + c_custkey % 60 END AS year, c_nationkey AS created_at FROM customer""",
    "media": """SELECT o_orderkey AS media_id, o_custkey AS work_id, o_orderkey % 3 AS season, substr(o_orderpriority, 3) AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1990 + o_orderkey % 30 END AS year,
  CASE o_orderstatus WHEN 'F' THEN 'movie' WHEN 'O' THEN 'tv' ELSE 'unknown' END AS media_type,
  seconds(o_orderdate) AS created_at, o_totalprice AS price, o_orderstatus AS status FROM orders""",
    "mention": """SELECT CASE l_linestatus WHEN 'F' THEN 'quark' ELSE 'alipan' END AS provider, l_partkey AS share_id,
  l_orderkey AS media_id, seconds(l_shipdate) AS seen_at, l_suppkey AS supplier, l_returnflag AS flag, l_quantity AS quantity,
  CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey AS VARCHAR(20)) END AS passcode FROM lineitem""",
    "resource": """SELECT share_id * 2 + CASE provider WHEN 'quark' THEN 1 ELSE 0 END AS resource_id, provider, share_id,
  CASE share_id % 5 WHEN 0 THEN 'unchecked' WHEN 1 THEN 'invalid' WHEN 2 THEN 'error' ELSE 'valid' END AS check_status,
  count(*) AS seen_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM mention GROUP BY provider, share_id""",
    "bridge": """SELECT DISTINCT media_id, share_id * 2 + CASE provider WHEN 'quark' THEN 1 ELSE 0 END AS resource_id FROM mention
  WHERE quantity <= 15""",
    "checks": """SELECT event_id AS check_id, user_id AS link, seconds(ts) AS checked_at,
  CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'view' THEN 'valid' WHEN 'signup' THEN 'invalid' WHEN 'click' THEN 'invalid'
    ELSE 'error' END AS status FROM events""",
    "media_tag": """SELECT DISTINCT media_id, p_brand AS tag FROM mention JOIN part ON p_partkey = share_id""",
}
_NEEDS = {"resource": ("mention",), "bridge": ("mention",), "media_tag": ("mention",)}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def seconds_spark(sql: str) -> str:
    import re

    return re.sub(r"seconds\((\w+)\)", r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", sql)


def seconds_duck(sql: str) -> str:
    import re

    return re.sub(r"seconds\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)


class Catalog:
    """The entities of one folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            import re

            sql = seconds_spark(SQL[name])
            inputs = {t: self.raw(t) for t in _TABLES if re.search(rf"\b{t}\b", sql)}
            inputs |= {t: getattr(self, t) for t in _NEEDS.get(name, ())}
            for t in inputs:
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            return self.spark.sql(sql, **inputs)
        raise AttributeError(name)


def with_entities(sql: str, *names: str) -> str:
    """SQL for the other engine with the entities that it uses in front."""
    order = [n for n in SQL if n in {*names, *(x for n in names for x in _NEEDS.get(n, ()))}]
    head = ", ".join(f"{n} AS ({seconds_duck(SQL[n])})" for n in order)
    return f"WITH {head}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
