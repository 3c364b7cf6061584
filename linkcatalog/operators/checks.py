"""Link checks: latest state, state machine, schedules, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcatalog.operators.ranks import global_rank

MINUTE, DAY = 60, 86400
MAX_ATTEMPTS = 5


def backoff(n: Column) -> Column:
    """Seconds: a minute, doubled with each failure, six hours at most."""
    return F.when(n <= 0, F.lit(60)).otherwise(F.least(F.lit(21600), F.lit(60) * F.pow(F.lit(2.0), F.least(n, F.lit(20))))).cast("long")


def next_check(status: Column, attempts: Column, now: Column) -> Column:
    """Valid links in a week; invalid ones in a month, but not after the second time; limited and
    failed checks after the backoff; others never."""
    return (
        F.when(status == "valid", now + 7 * DAY)
        .when((status == "invalid") & (attempts < 2), now + 30 * DAY)
        .when(status.isin("rate_limited", "error"), now + backoff(attempts))
    )


def latest_check(checks: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last check of each key; combined before the shuffle."""
    last = F.max_by(F.struct(*checks.columns), F.struct(F.col(at), F.col(tie)))
    return checks.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(last.alias("_row")).select("_row.*")


def relink(resources: DataFrame, latest: DataFrame, key: list[str]) -> DataFrame:
    """Unchecked links take the latest state of their history; the next check counts no attempt."""
    known = latest.select(*key, F.col("status").alias("_s"), F.col("checked_at").alias("_t"))
    out = resources.join(known, key, "left")
    take = (F.col("check_status") == "unchecked") & F.col("_s").isNotNull()
    return out.select(
        *[c for c in resources.columns if c not in ("check_status", "next_check_at")],
        F.when(take, F.col("_s")).otherwise(F.col("check_status")).alias("check_status"),
        F.when(take, next_check(F.col("_s"), F.lit(0), F.col("_t"))).otherwise(F.col("next_check_at")).alias("next_check_at"),
        take.alias("hydrated"),
    )


def check_states(checks: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Each check with its attempts (checks in a row with this status), the next check and whether
    validity flipped: the fold over a link's history as gaps and islands."""
    by = Window.partitionBy(*key).orderBy(at, tie)
    before = F.lag("status").over(by)
    out = checks.withColumn("_prev", before).withColumn("_new", F.coalesce((F.col("status") != F.col("_prev")).cast("int"), F.lit(1)))
    out = out.withColumn("_run", F.sum("_new").over(by))
    out = out.withColumn("attempts", F.row_number().over(Window.partitionBy(*key, "_run").orderBy(at, tie)))
    flipped = F.coalesce((F.col("status") == "valid") != (F.col("_prev") == "valid"), F.col("status") == "valid")
    out = out.withColumn("flipped", flipped).withColumn("next_check_at", next_check(F.col("status"), F.col("attempts"), F.col(at)))
    return out.drop("_prev", "_new", "_run")


def claim_documents(docs: DataFrame, now: int, limit: int) -> DataFrame:
    """Pending or abandoned documents that are due, those of the source with the fewest left first;
    a document that was given up MAX_ATTEMPTS times fails instead."""
    due = docs.where(
        F.col("parse_status").isin("pending", "running")
        & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))
        & (F.col("next_parse_at").isNull() | (F.col("next_parse_at") <= now))
    )
    left = due.where("source is not null").groupBy("source").agg(F.count("*").alias("_n"))
    out = due.join(left, "source", "left").withColumn("left_in_source", F.coalesce("_n", F.lit(1)))
    reclaimed = F.col("parse_status") == "running"
    out = out.withColumn("attempts_now", F.col("attempts") + reclaimed.cast("int"))
    poison = reclaimed & (F.col("attempts_now") >= MAX_ATTEMPTS)
    out = out.withColumn("claim", F.when(poison, "failed").otherwise("claimed"))
    return out.orderBy("left_in_source", F.asc_nulls_first("last_parsed_at"), "doc_id").limit(limit).drop("_n")


def claim_resources(resources: DataFrame, now: int, limit: int, checkable: tuple[str, ...], force: bool = False) -> DataFrame:
    """Checkable links whose lease is free and that are due: unchecked without a date, or past it.
    Claiming counts an attempt and sets the backoff, should the claim be lost."""
    due = (F.col("next_check_at") <= now) | (F.col("next_check_at").isNull() & (F.col("check_status") == "unchecked"))
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    rows = resources.where(F.col("provider").isin(*checkable) & free & (F.lit(force) | due))
    out = rows.orderBy(F.asc_nulls_first("next_check_at"), "resource_id").limit(limit)
    attempts = F.col("check_attempts") + 1
    return out.withColumn("next_check_at", F.lit(now) + backoff(attempts)).withColumn("check_attempts", attempts)


def claim_sources(sources: DataFrame, now: int, limit: int) -> DataFrame:
    """Enabled, free and due sources; those that lose posts when late come first."""
    late = F.col("source_type").isin("rss", "web") & (F.col("last_success_at").isNull() | (F.col("last_success_at") <= now - DAY // 2))
    due = F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    rows = sources.where(F.col("enabled") & due & free).withColumn("priority", F.when(late, 0).otherwise(1))
    return rows.orderBy("priority", F.asc_nulls_first("next_run_at"), "source_id").limit(limit)


def round_robin(rows: DataFrame, group: str, order: list, bucket: Column) -> DataFrame:
    """Rows of all groups in turn: ``turn`` counts within the group. ``bucket`` does not fall along the order; rows
    meet only those of their group and bucket, however large the group is."""
    ranked = global_rank(rows.withColumn("_bucket", bucket), [group], "_bucket", order, "turn")
    return ranked.withColumn("turn", (F.col("turn") + 1).cast("int")).drop("_bucket")


def with_leases(queue: DataFrame, claimed: DataFrame, key: str, until: int, token: str) -> DataFrame:
    """The queue after a claim: claimed rows carry the lease's end and token and count the attempt; a row whose
    claim says ``failed`` leaves the queue with that status and no lease."""
    took = claimed.select(key, F.col("claim").alias("_claim"), F.col("attempts_now").alias("_n"))
    out = queue.join(took, key, "left")
    mine, lost = F.col("_claim") == "claimed", F.col("_claim") == "failed"
    return out.select(
        *[c for c in queue.columns if c not in ("parse_status", "lease_until", "attempts")],
        F.when(mine, "running").when(lost, "failed").otherwise(F.col("parse_status")).alias("parse_status"),
        F.when(mine, F.lit(until)).when(lost, F.lit(None)).otherwise(F.col("lease_until")).cast("long").alias("lease_until"),
        F.when(mine, F.lit(token)).alias("lease_token"),
        F.coalesce("_n", "attempts").alias("attempts"),
    )


def parse_outcome(ok: Column, catalog: Column, attempts: Column, now: Column) -> Column:
    """Status, attempts and next time after a parse."""
    failed = attempts + 1
    return (
        F.when(ok & catalog, F.struct(F.lit("skipped").alias("status"), attempts.alias("attempts"), F.lit(None).cast("long").alias("next_parse_at")))
        .when(ok, F.struct(F.lit("done").alias("status"), attempts.alias("attempts"), F.lit(None).cast("long").alias("next_parse_at")))
        .when(failed >= MAX_ATTEMPTS, F.struct(F.lit("failed").alias("status"), failed.alias("attempts"), F.lit(None).cast("long").alias("next_parse_at")))
        .otherwise(F.struct(F.lit("pending").alias("status"), failed.alias("attempts"), (now + backoff(failed)).alias("next_parse_at")))
    )
