"""Ingest: content hashes, first-wins deduplication, upserts of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_for_hash(text: Column) -> Column:
    """One kind of line end, lines stripped, blank lines dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def ingest_many(incoming: DataFrame, existing: DataFrame, order: str, text: str = "text") -> DataFrame:
    """(order, content_hash, outcome) of each incoming row: created, duplicated (an earlier row of the batch or a
    stored one has the hash) or skipped (no text). ``order`` is unique in the batch.

    Texts are normalised once and never shuffled: the first of each hash is found by an aggregate (combined
    before the shuffle, where a third of the batch shares a hash) and met by ``order``, which has no hot
    key; :func:`created_rows` takes the texts of those alone.
    """
    plain = incoming.select(order, normalize_for_hash(F.col(text)).alias("_plain"))
    keyed = plain.select(order, F.when(F.col("_plain") != "", F.sha2("_plain", 256)).alias("content_hash"))
    first = keyed.where("content_hash is not null").groupBy("content_hash").agg(F.min(order).alias(order))
    new = first.join(existing.select("content_hash").distinct(), "content_hash", "left_anti").select(order, F.lit(True).alias("_new"))
    outcome = F.when(F.col("content_hash").isNull(), "skipped").when(F.col("_new"), "created").otherwise("duplicated")
    return keyed.join(new, order, "left").select(order, "content_hash", outcome.alias("outcome"))


def created_rows(incoming: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """The rows to store, with their hashes."""
    return incoming.join(outcomes.where("outcome = 'created'").select(order, "content_hash"), order)


def report(outcomes: DataFrame) -> DataFrame:
    """(outcome, n): what became of a batch."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def upsert_resources(old: DataFrame | None, mentions: DataFrame) -> DataFrame:
    """Links by (provider, share_id): mentions counted, first and last seen, first known pass code.

    ``old`` rows have the same columns as the result and win where both know a value.
    """
    new = mentions.groupBy("provider", "share_id").agg(
        F.count("*").alias("seen_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.min_by("passcode", F.when(F.col("passcode").isNotNull(), F.struct("seen_at", "passcode"))).alias("passcode"),
    )
    if old is None:
        return new
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, ["provider", "share_id"], "full")
    return joined.select(
        "provider", "share_id",
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.seen_count", F.lit(0))).alias("seen_count"),
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.coalesce("o.passcode", "n.passcode").alias("passcode"),
    )


def upsert_latest(target: DataFrame, incoming: DataFrame, key: list[str], mark: str) -> DataFrame:
    """Last writer wins by ``mark``; an equal mark keeps the target. Append-only tables pass a
    constant mark: what is there stays. An aggregate, so that rows of a hot key are combined before the shuffle."""
    both = target.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(-1)))
    last = F.max_by(F.struct(*target.columns), F.struct(F.col(mark).isNotNull(), F.col(mark), F.col("_side")))
    return both.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(last.alias("_row")).select("_row.*")


def max_watermark(rows: DataFrame, mark: str) -> int | None:
    """One value for the driver: the next run's filter on it reaches the scan."""
    return rows.agg(F.max(mark)).first()[0]


def overlap_rows(rows: DataFrame, mark: str, watermark: int | None, seconds: int = 300) -> DataFrame:
    """Rows from ``seconds`` before the watermark on; an idempotent upsert takes them twice. Without a
    watermark all rows."""
    return rows if watermark is None else rows.where(F.col(mark) >= watermark - seconds)
