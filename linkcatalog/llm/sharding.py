"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_BITS, discard, global_rank, hash_bucket, materialize, shuffle_hash, table

#: Rows that meet in one bucket of the distributed ranking, on average.
BUCKET_ROWS = 1024


def shard_rows(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata_col: str = "source",
) -> DataFrame:
    """One row per input row: (id, size, text_crc32, law, shard, slot, grown_shard).

    Rows are shuffled within their source by a seeded hash of the id; a row's rank over its
    source's row count is its fractional rank; rows in the order of fractional rank are cut
    into ``n_shards`` runs whose counts differ by one at most (law ``rows``), so that every shard
    holds each source in its share of the whole. Slots count from 0 in each shard.

    A source of any share is ranked in hash-range buckets of about BUCKET_ROWS rows: no source
    meets in one task. Texts are only measured, never moved.

    Null text: size 8, crc 0. Null source: a source of its own. Null ids are shuffled by their texts' crc.
    Repeated rows stay, each with its own slot. grown_shard is null for this law.
    Equal texts may lie in different shards. Empty input gives no rows. Extra columns are ignored.
    """
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = materialize(
        docs.select(
            own.alias("doc_id"),
            F.col(strata_col).cast("string").alias("_src"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            shuffle_hash(seed, own, F.when(own.isNull(), F.crc32(text))).alias("_h"),
        ),
        "shard-rows",
    )
    n = base.count()
    n_buckets = max(1, -(-n // BUCKET_ROWS))
    ranked = global_rank(
        base.withColumn("_b", hash_bucket(F.col("_h"), n_buckets)), ["_src"], "_b",
        [F.col("_h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "_rank",
    ).drop("_b")
    totals = base.groupBy(F.col("_src").alias("_s")).agg(F.count("*").alias("_n"))
    # the fractional rank (rank + 1/2) / n, as a fraction of 2**HASH_BITS
    part = F.floor((F.col("_rank") + 0.5) / F.col("_n") * float(1 << HASH_BITS)).cast("long")
    spread = materialize(
        ranked.join(totals, F.col("_src").eqNullSafe(F.col("_s")))
        .withColumn("_f", part)
        .withColumn("_b", hash_bucket(F.col("_f"), n_buckets))
        .select("doc_id", "size", "text_crc32", "_f", "_b", "_src"),
        "shard-spread",
    )
    discard(base)
    # sources at one fraction: in the order of a hash of their names
    placed = global_rank(spread, [], "_b", [F.col("_f"), shuffle_hash(seed, F.col("_src")), F.col("_src")], "_pos")
    total = F.lit(max(n, 1)).cast("long")
    shard = F.expr(f"_pos * {n_shards} div {max(n, 1)}")
    return placed.withColumn("_shard", shard).select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - F.ceil(F.col("_shard") * total / F.lit(n_shards)).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_proportional_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) AS r(i)))),
d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes,
    substr(md5(CAST(doc_id AS VARCHAR) || '::7'), 1, 15) AS h FROM documents),
crc AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM crc),
p AS (SELECT *, row_number() OVER (ORDER BY floor((rank + 0.5::DOUBLE) / n * 1152921504606846976::DOUBLE),
    substr(md5(coalesce(source, '') || ':7'), 1, 15), source) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, pos * 24 // total AS shard FROM p)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(pos - CAST(ceil(shard * total / 24.0) AS BIGINT) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
