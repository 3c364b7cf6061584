"""Claims that no two workers share, and what comes of the claimed rows: each is one commit to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcatalog.functions.vocabulary import CHECKABLE
from linkcatalog.operators import checks, deltas
from linkcatalog.operators.checks import DAY, MAX_ATTEMPTS, backoff
from linkcatalog.store import Append, Remove, Store, Upsert, Version

LEASE = 600


def over_fetch(limit: int) -> int:
    """Candidates to look at for ``limit`` claims, as some end instead of being claimed."""
    return limit * 2 + 8


def _claim(store: Store, table: str, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Commits the rows that ``choose`` changes (a few times the limit of a claim) and returns them. Where
    another worker was faster, the choice is made again among what it left."""

    def work(at: Version) -> dict:
        rows = choose(store.read(table, at))
        taken = rows.collect()
        return {table: Upsert(rows.sparkSession.createDataFrame(taken, rows.schema))} if taken else {}

    done = store.transact(work)
    return store.wrote(done, table) if done else store.read(table).limit(0)


def _free(rows: DataFrame, now: int) -> Column:
    return F.col("lease_until").isNull() | (F.col("lease_until") <= now)


def _set(rows: DataFrame, values: dict[str, Column], columns: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.select(*[(values[c].cast(kinds[c]) if c in values else F.col(c)).alias(c) for c in columns])


def claim_documents(store: Store, token: str, now: int, limit: int = 20, lease: int = LEASE, source: str | None = None) -> DataFrame:
    """Takes up to ``limit`` pending or abandoned documents of ``document_queue`` that are due; those of the source
    with the fewest left come first (each document without a source counts as a source of one), then those not
    parsed for longest. An abandoned one counts an attempt, and with MAX_ATTEMPTS of them fails instead of being
    claimed again. Returns the claimed and the failed rows.

    ``document_queue``: doc_id (key), source, parse_status, attempts, lease_until, lease_token, next_parse_at,
    last_parsed_at, parse_error."""

    def choose(queue: DataFrame) -> DataFrame:
        due = queue.where(
            F.col("parse_status").isin("pending", "running") & _free(queue, now) & (F.col("next_parse_at").isNull() | (F.col("next_parse_at") <= now))
        )
        if source is not None:
            due = due.where(F.col("source") == source)
        left = due.where("source is not null").groupBy("source").agg(F.count("*").alias("_left"))
        order = [F.coalesce("_left", F.lit(1)), F.asc_nulls_first("last_parsed_at"), F.col("doc_id")]
        few = due.join(left, "source", "left").orderBy(*order).limit(over_fetch(limit))
        again = F.col("parse_status") == "running"
        poison = again & (F.col("attempts") + 1 >= MAX_ATTEMPTS)
        before = F.sum((~poison).cast("int")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        few = few.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit)
        blank = F.lit(None)
        return _set(
            few,
            {
                "parse_status": F.when(poison, "failed").otherwise("running"),
                "attempts": F.col("attempts") + again.cast("int"),
                "lease_until": F.when(poison, blank).otherwise(F.lit(now + lease)),
                "lease_token": F.when(poison, blank).otherwise(F.lit(token)),
                "next_parse_at": F.when(poison, blank).otherwise(F.col("next_parse_at")),
                "parse_error": F.when(poison, F.lit("abandoned too often")).otherwise(F.col("parse_error")),
            },
            queue.columns,
        )

    return _claim(store, "document_queue", choose)


def claim_resources(
    store: Store, token: str, now: int, limit: int = 20, lease: int = LEASE, provider: str | None = None, force: bool = False, checkable: tuple[str, ...] = CHECKABLE
) -> DataFrame:
    """Takes checkable links of ``resource`` that are due (with ``force`` all, those not checked for longest first).
    A claimed link is ``checking`` and keeps its status before as prior_status; one abandoned while it was
    checked counts an attempt and waits by the backoff.

    ``resource``: resource_id (key), provider, check_status, prior_status, check_attempts, next_check_at,
    last_checked_at, lease_until, lease_token, and more."""

    def choose(rows: DataFrame) -> DataFrame:
        due = (F.col("next_check_at") <= now) | (F.col("next_check_at").isNull() & (F.col("check_status") == "unchecked"))
        own = rows.where(F.col("provider").isin(*checkable) & _free(rows, now) & (F.lit(force) | F.coalesce(due, F.lit(False))))
        if provider is not None:
            own = own.where(F.col("provider") == provider)
        few = own.orderBy(F.asc_nulls_first("last_checked_at" if force else "next_check_at"), "resource_id").limit(limit)
        again = F.col("check_status") == "checking"
        attempts = F.col("check_attempts") + again.cast("int")
        return _set(
            few,
            {
                "prior_status": F.col("check_status"), "check_status": F.lit("checking"), "check_attempts": attempts, "lease_until": F.lit(now + lease),
                "lease_token": F.lit(token), "next_check_at": F.when(again, F.lit(now) + backoff(attempts)).otherwise(F.col("next_check_at")),
            },
            rows.columns,
        )

    return _claim(store, "resource", choose)


def claim_sources(store: Store, token: str, now: int, limit: int = 5, lease: int = LEASE) -> DataFrame:
    """Takes enabled sources of ``source_queue`` that are due; those that lose posts when late come first. The lease
    alone keeps others off: one that ran out means that the worker failed, which counts and waits like a failure.

    ``source_queue``: source_id (key), source_type, enabled, next_fetch_at, last_success_at, failures, lease_until,
    lease_token."""

    def choose(rows: DataFrame) -> DataFrame:
        late = F.col("source_type").isin("rss", "web") & (F.col("last_success_at").isNull() | (F.col("last_success_at") <= now - DAY // 2))
        due = F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now)
        few = rows.where(F.col("enabled") & due & _free(rows, now))
        few = few.orderBy(F.when(late, 0).otherwise(1), F.asc_nulls_first("next_fetch_at"), "source_id").limit(limit)
        again = F.col("lease_until").isNotNull()
        failures = F.col("failures") + again.cast("int")
        return _set(
            few,
            {
                "lease_until": F.lit(now + lease), "lease_token": F.lit(token), "failures": failures,
                "next_fetch_at": F.when(again, F.lit(now) + backoff(failures)).otherwise(F.col("next_fetch_at")),
            },
            rows.columns,
        )

    return _claim(store, "source_queue", choose)


def finish_documents(store: Store, outcomes: DataFrame, token: str, now: int) -> Version | None:
    """Writes what became of claimed documents, as long as the lease is still this worker's: ``outcomes``: doc_id, ok,
    catalog, error. See :func:`checks.parse_outcome`."""

    def work(at: Version) -> dict:
        queue = store.read("document_queue", at)
        mine = queue.where(F.col("lease_token") == token).join(outcomes.select("doc_id", "ok", "catalog", "error"), "doc_id")
        after = checks.parse_outcome(F.col("ok"), F.col("catalog"), F.col("attempts"), F.lit(now).cast("long"))
        values = {
            "parse_status": after["status"], "attempts": after["attempts"], "next_parse_at": after["next_parse_at"], "lease_until": F.lit(None),
            "lease_token": F.lit(None), "last_parsed_at": F.lit(now), "parse_error": F.when(F.col("ok"), F.lit(None)).otherwise(F.col("error")),
        }
        return {"document_queue": Upsert(_set(mine, values, queue.columns))}

    return store.transact(work)


#: Columns of what a probe found, beside resource_id and status.
DETAILS = {"title": 512, "sharer_id": 128, "sharer_name": 128, "sharer_avatar_url": 2048}


def after_check(rows: DataFrame) -> DataFrame:
    """Links after a check (columns of ``resource`` and, prefixed ``o_``, of the outcome, checked_at among them).

    The status before the claim is the baseline: a check that repeats it counts on, another starts at 1. Where the
    baseline is itself ``checking`` the claim has already counted the lost attempt. Titles and sizes fill
    blanks, sharers are renewed."""
    status, base, now = F.col("o_status"), F.coalesce("prior_status", "check_status"), F.col("o_checked_at")
    attempts = F.when(base == "checking", F.col("check_attempts")).when(status == base, F.col("check_attempts") + 1).otherwise(F.lit(1)).cast("long")
    renewed = lambda c: F.coalesce(F.nullif(F.left(F.col(f"o_{c}"), F.lit(DETAILS[c])), F.lit("")), F.col(c))
    values = {
        "check_status": status, "check_attempts": attempts, "last_checked_at": now, "next_check_at": checks.next_check(status, attempts, now),
        "title_raw": F.coalesce(F.nullif("title_raw", F.lit("")), F.nullif(F.left("o_title", F.lit(DETAILS["title"])), F.lit(""))),
        "size_bytes": F.coalesce("size_bytes", "o_size_bytes"), "lease_until": F.lit(None), "lease_token": F.lit(None), "prior_status": F.lit(None),
        **{c: renewed(c) for c in DETAILS if c != "title"},
    }
    columns = [c for c in rows.columns if not c.startswith("o_")]
    flipped = (status == "valid") != (base == "valid")
    return _set(rows.withColumn("_flipped", flipped), values, [*columns, "_flipped"])


def finish_checks(store: Store, outcomes: DataFrame, token: str, now: int) -> Version | None:
    """Checks become history, links take their results, and the counts of seasons and works whose links gained or lost
    validity follow, all in one commit.

    ``outcomes``: resource_id, status, title, size_bytes, sharer_id, sharer_name, sharer_avatar_url, http_code,
    probe, detail, latency_ms. Only links whose lease is still this worker's count. Tables: resource,
    link_check, bridge, media_count, work_count."""

    def work(at: Version) -> dict:
        links = store.read("resource", at)
        found = outcomes.select(*[F.col(c).alias(f"o_{c}") for c in outcomes.columns]).withColumn("o_checked_at", F.lit(now).cast("long"))
        mine = links.where(F.col("lease_token") == token).join(found, F.col("resource_id") == F.col("o_resource_id"))
        done = after_check(mine)
        history = mine.select(
            "provider", "share_id", "url", F.col("o_checked_at").alias("checked_at"), F.col("o_status").alias("status"),
            *[F.col(f"o_{c}").alias(c) for c in ("http_code", "probe", "detail", "latency_ms")],
        )
        flips = done.where("_flipped").select("resource_id", (F.col("check_status") == "valid").alias("valid"))
        edits = deltas.Edits(flipped=flips, links=store.read("bridge", at))
        media, works = deltas.changed_counts(store.read("media_count", at), store.read("work_count", at), edits)
        return {
            "resource": Upsert(done.drop("_flipped")), "link_check": Append(history), "work_count": Upsert(works),
            "media_count": [Upsert(media.where("resource_count > 0")), Remove(media.where("resource_count <= 0"))],
        }

    return store.transact(work)
