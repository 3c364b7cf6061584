"""Collecting as one job: what a stream of fetches brings is stored, and sources move on, in one commit a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcatalog.operators import ingest
from linkcatalog.operators.checks import backoff
from linkcatalog.operators.collect import DISABLE_AFTER
from linkcatalog.storage import stored
from linkcatalog.store import Append, Put, Store, Upsert, Version

_MESSAGES = "array<struct<id:string,text:string,url:string,published_at:bigint>>"
#: One fetch of a source: its new messages or an error, and the step back into history that went with it.
FETCH = (
    "source_id bigint, fetched_at bigint, error string, title string, truncated boolean, backfill_pending boolean, state map<string,string>, "
    f"messages {_MESSAGES}, history struct<messages:{_MESSAGES},cursor:bigint,done:boolean,state:map<string,string>>"
)
SOURCE = (
    "source_id bigint, title string, enabled boolean, fetch_interval bigint, cursor bigint, cursor_at bigint, pending bigint, backfill bigint, "
    "backfill_done boolean, failures bigint, last_error string, last_fetched_at bigint, last_success_at bigint, next_fetch_at bigint, "
    "total_collected bigint, total_backfilled bigint, state map<string,string>"
)
DOCUMENT = "content_hash string, source_id bigint, message_id string, url string, published_at bigint, text string"
REPORT = (
    "source_id bigint, fetched bigint, backfilled bigint, created bigint, backfill_created bigint, duplicated bigint, skipped_empty bigint, "
    "cursor_before bigint, cursor_after bigint, error string"
)
#: Seconds to the next fetch while there is more to come.
SOON = 5


def create(store: Store, sources: DataFrame) -> Version:
    """The job's tables, with these sources (columns of SOURCE; missing ones are blank)."""
    spark = sources.sparkSession
    blank = {
        "enabled": F.lit(True), "backfill_done": F.lit(False), "failures": F.lit(0), "total_collected": F.lit(0), "total_backfilled": F.lit(0),
        "state": F.create_map().cast("map<string,string>"),
    }
    wanted = spark.createDataFrame([], SOURCE).schema
    rows = sources.select(*[(F.col(f.name) if f.name in sources.columns else blank.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in wanted])
    empty = lambda schema: spark.createDataFrame([], schema)
    return store.commit(
        store.current(), {"source": Put(rows, ["source_id"]), "document": Put(empty(DOCUMENT), ["content_hash"]), "fetch_report": Put(empty(REPORT))}
    )


def _marks(state: Column) -> Column:
    """A state to merge, each value in a struct, so that a null value differs from none."""
    return F.transform_values(state, lambda _, v: F.struct(v.alias("v")))


def _merged(old: Column, new: Column) -> Column:
    """New values win, null values delete their key."""
    none = F.create_map().cast("map<string,struct<v:string>>")
    both = F.map_zip_with(old, F.coalesce(new, none), lambda _, a, b: F.when(b.isNull(), a).otherwise(b["v"]))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def _summary(fetch: str = "") -> Column:
    """What a fetch tells about its source: no texts."""
    numbered = F.filter(F.col("messages"), lambda m: m["id"].rlike("^[0-9]{1,18}$"))
    ids = F.transform(numbered, lambda m, i: F.struct(m["id"].cast("long").alias("id"), (-i).alias("i"), m["published_at"].alias("at")))
    return F.struct(
        "fetched_at", "error", "title", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("backfill_pending", F.lit(False)).alias("reopen"),
        _marks(F.col("state")).alias("state"), F.array_max(ids).alias("newest"), F.array_min(ids)["id"].alias("oldest"),
        F.col("history").isNotNull().alias("went_back"), F.col("history.cursor").alias("back_to"), F.coalesce("history.done", F.lit(False)).alias("back_done"),
        _marks(F.col("history.state")).alias("back_state"),
    )


def after_fetch(s: Column, x: Column) -> Column:
    """The struct of a source (columns of SOURCE) after a fetch (:func:`_summary`).

    The cursor goes to the greatest id seen, whether its post was stored or not, but only once a fetch has come
    through: until then the greatest id waits as ``pending``. History starts at the oldest id of the first fetch,
    or at the cursor, and goes on where a history step left it. A failure counts, waits by the backoff and
    disables the source in the end; success resets.
    """
    failed = x["error"].isNotNull()
    failures = F.when(failed, s["failures"] + 1).otherwise(F.lit(0).cast("long"))
    top = F.greatest(x["newest"]["id"], s["pending"])
    through = ~x["truncated"] & top.isNotNull()
    on = through & (s["cursor"].isNull() | (top > s["cursor"]))
    cursor = F.when(on, top).otherwise(s["cursor"])
    cursor_at = F.when(on & (x["newest"]["id"] == top), x["newest"]["at"]).otherwise(s["cursor_at"])
    pending = F.when(through, F.lit(None).cast("long")).otherwise(F.when(x["truncated"], top).otherwise(s["pending"]))
    start = F.coalesce(s["backfill"], x["oldest"], cursor)
    was_done = s["backfill_done"] & ~x["reopen"]
    steps = x["went_back"] & ~was_done
    done = was_done | (steps & x["back_done"])
    state = _merged(s["state"], x["state"])
    wait = F.when(x["truncated"] | ~done, F.lit(SOON).cast("long")).otherwise(s["fetch_interval"])
    good = {
        "title": F.coalesce(F.nullif(s["title"], F.lit("")), x["title"]),
        "cursor": cursor,
        "cursor_at": cursor_at,
        "pending": pending,
        "backfill": F.when(steps, F.coalesce(x["back_to"], start)).otherwise(start),
        "backfill_done": done,
        "last_error": F.lit(None).cast("string"),
        "last_success_at": x["fetched_at"],
        "next_fetch_at": x["fetched_at"] + wait,
        "state": F.when(steps, _merged(state, x["back_state"])).otherwise(state),
    }
    bad = {
        "last_error": x["error"],
        "next_fetch_at": x["fetched_at"] + backoff(failures),
        "enabled": s["enabled"] & (failures < DISABLE_AFTER),
    }
    always = {"failures": failures, "last_fetched_at": x["fetched_at"]}

    def column(name: str) -> Column:
        if name in always:
            return always[name]
        return F.when(failed, bad.get(name, s[name])).otherwise(good.get(name, s[name])) if name in good or name in bad else s[name]

    return F.struct(*[column(n).alias(n) for n in _SOURCE_COLUMNS])


_SOURCE_COLUMNS = [x.split()[0] for x in SOURCE.split(", ")]


def _many(column: str, which: Callable[[Column], Column]) -> Column:
    """How many of an array's elements are such ones."""
    return F.coalesce(F.size(F.filter(column, which)), F.lit(0))


def batch_changes(batch: DataFrame, sources: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """What a batch of fetches (FETCH) changes: ``source`` rows after it, ``document`` rows to add, a ``fetch_report``.

    Several fetches of one source count in the order of their times. Each content is stored once, the first
    time that it comes; posts without text are skipped, but cursors pass them. Fetches of unknown sources
    are ignored. Stored hashes are only scanned for those of the batch. What is new is told by fetch and place, without
    its hash, and written once, for all results; texts move once, with their whole fetch, to be written.
    """
    known = batch.join(sources.select("source_id"), "source_id", "left_semi")
    fetch = ["source_id", "fetched_at"]
    posts = lambda column, kind: known.where(F.col(column).isNotNull()).select(
        *fetch, F.lit(kind).alias("kind"), F.posexplode(F.transform(column, lambda m: ingest.normalize_for_hash(F.coalesce(m["text"], F.lit(""))))).alias("place", "plain")
    )
    both = posts("messages", 0).unionByName(posts("history.messages", 1)).where("plain <> ''")
    hashed = both.select(F.unhex(F.sha2("plain", 256)).alias("hash"), F.struct("fetched_at", "source_id", "kind", "place").alias("at"))
    first = hashed.groupBy("hash").agg(F.min("at").alias("at"))
    new = first.join(documents.select(F.unhex("content_hash").alias("hash")), "hash", "left_anti")
    kept = new.groupBy(*[F.col(f"at.{k}").alias(k) for k in fetch]).agg(F.collect_list(F.struct("at.kind", "at.place")).alias("kept"))
    kept = stored(kept.withColumn("created", _many("kept", lambda k: k["kind"] == 0)).withColumn("backfill_created", _many("kept", lambda k: k["kind"] == 1)), "collect-new")
    blank = lambda m: ingest.normalize_for_hash(F.coalesce(m["text"], F.lit(""))) == ""
    size = lambda column: F.coalesce(F.size(column), F.lit(0))
    seen = known.select("source_id", size("messages").alias("fetched"), size("history.messages").alias("backfilled"), (_many("messages", blank) + _many("history.messages", blank)).alias("skipped_empty"))
    seen = seen.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("fetched", "backfilled", "skipped_empty")])
    made = kept.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("created", "backfill_created")])
    counts = seen.join(made, "source_id", "left").na.fill(0, ["created", "backfill_created"])
    counts = counts.withColumn("duplicated", F.expr("fetched + backfilled - skipped_empty - created - backfill_created"))
    steps = known.select("source_id", _summary().alias("x")).groupBy("source_id").agg(F.sort_array(F.collect_list("x.fetched_at")).alias("times"), F.collect_list("x").alias("xs"))
    # by time; maps have no order, so the fetches themselves can't be sorted
    ordered = F.transform("times", lambda t: F.filter("xs", lambda x: x["fetched_at"] == t)[0])
    ends = sources.join(steps, "source_id").withColumn("s", F.struct(*_SOURCE_COLUMNS))
    ends = ends.select("source_id", F.col("cursor").alias("cursor_before"), F.aggregate(ordered, F.col("s"), after_fetch).alias("s"))
    ends = ends.join(counts, "source_id", "left").na.fill(0, [c for c in counts.columns if c != "source_id"])
    moved = {"total_collected": F.col("s.total_collected") + F.col("created"), "total_backfilled": F.col("s.total_backfilled") + F.col("backfill_created")}
    rows = ends.select(*[moved.get(c, F.col(f"s.{c}")).alias(c) for c in _SOURCE_COLUMNS])
    report = ends.select("source_id", *[c for c in counts.columns if c != "source_id"], "cursor_before", F.col("s.cursor").alias("cursor_after"), F.col("s.last_error").alias("error"))
    message = lambda k: F.when(k["kind"] == 0, F.get("messages", k["place"])).otherwise(F.get("history.messages", k["place"]))
    created = known.select(*fetch, "messages", "history").join(kept.select(*fetch, "kept"), fetch)
    created = created.select("source_id", F.explode_outer(F.transform("kept", message)).alias("m"))
    created = created.select(ingest.content_hash(F.col("m.text")).alias("content_hash"), "source_id", F.col("m.id").alias("message_id"), "m.url", "m.published_at", "m.text")
    return {"source": rows, "document": created, "fetch_report": report}


class CollectJob:
    """Runs fetches into a store. A batch is one commit of posts, cursors, history and schedule, which carries the
    batch's number: a batch that comes again after a crash changes nothing, wherever the crash was."""

    def __init__(self, store: Store, name: str = "collect"):
        self.store, self.name = store, name

    def step(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:

            def work(at: Version) -> dict:
                out = batch_changes(batch, self.store.read("source", at), self.store.read("document", at))
                return {"source": Upsert(out["source"]), "document": Append(out["document"]), "fetch_report": Append(out["fetch_report"])}

            self.store.transact(work, self.name, epoch)
        finally:
            batch.unpersist()

    def run(self, fetches: DataFrame, checkpoint: str) -> None:
        """All that the stream holds, then ends."""
        stream = fetches.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
