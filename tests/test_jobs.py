"""Stores, and the jobs that commit to them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from linkcatalog.operators import claims, repairs, reset
from linkcatalog.plans import jobs
from linkcatalog.store import Append, Conflict, Put, Remove, Store, Upsert
from linkcatalog.streaming import check_timers, collect_job, jobs as streams


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows_in(store, name, at=None):
    return sorted(map(tuple, store.read(name, at).collect()))


def test_changes_of_a_table(spark, store):
    df = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    one = store.commit(store.current(), {"t": Put(df((1, "a"), (2, "b"), (3, None)), ["k"])})
    two = store.commit(one, {"t": [Append(df((4, "d"))), Upsert(df((2, "B"), (5, "e"))), Remove(df((1, "x")))]})
    assert rows_in(store, "t", one) == [(1, "a"), (2, "b"), (3, None)]
    assert rows_in(store, "t") == [(2, "B"), (3, None), (4, "d"), (5, "e")]
    three = store.commit(two, {"t": [Append(df((1, "again"))), Remove(df((5, None)))]})
    assert rows_in(store, "t", three) == [(1, "again"), (2, "B"), (3, None), (4, "d")]
    assert sorted(map(tuple, store.wrote(three, "t").collect()), key=str) == [(1, "again"), (5, None)]
    at = three
    for n in range(30):  # many changes are merged into files
        at = store.commit(at, {"t": Upsert(df((n % 4 + 1, f"v{n}")))})
    assert len(at.tables["t"]["changes"]) <= 12
    assert rows_in(store, "t") == [(1, "v28"), (2, "v29"), (3, "v26"), (4, "v27")]
    assert store.restore(one.number).number == at.number + 1
    assert rows_in(store, "t") == [(1, "a"), (2, "b"), (3, None)]


def test_of_two_commits_on_one_version_one_wins(spark, store):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    at = store.commit(store.current(), {"t": Put(df, ["k"])})
    store.commit(at, {"t": Append(df.withColumn("k", F.lit(2)))})
    with pytest.raises(Conflict):
        store.commit(at, {"t": Append(df.withColumn("k", F.lit(3)))})
    assert [k for k, _ in rows_in(store, "t")] == [1, 2]


def test_writers_at_once_lose_nothing(spark, store):
    one = spark.createDataFrame([("n", 0)], "k string, v long")
    store.commit(store.current(), {"t": Put(one, ["k"])})

    def count():
        for _ in range(2):
            store.transact(lambda at: {"t": Upsert(store.read("t", at).withColumn("v", F.col("v") + 1))})

    threads = [threading.Thread(target=count) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows_in(store, "t") == [("n", 8)]


def test_an_epoch_counts_once(spark, store):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    store.commit(store.current(), {"t": Put(df, ["k"])})
    add = lambda k: lambda at: {"t": Append(df.withColumn("k", F.lit(k)))}
    assert store.transact(add(2), "w", 0) is not None
    assert store.transact(add(3), "w", 0) is None
    assert store.transact(add(4), "other", 0) is not None
    assert [k for k, _ in rows_in(store, "t")] == [1, 2, 4]


def fetch(source, at, ids=(), texts=None, **said):
    posts = None if ids is None else [{"id": str(i), "text": (texts or {}).get(i, f"post {i}"), "url": None, "published_at": 10} for i in ids]
    blank = {"error": None, "title": None, "truncated": False, "backfill_pending": False, "state": None, "history": None}
    return {"source_id": source, "fetched_at": at, "messages": posts} | blank | said


def write_fetches(spark, folder, rounds):
    for n, rows in enumerate(rounds):
        spark.createDataFrame(rows, collect_job.FETCH).coalesce(1).write.parquet(f"{folder}/round={n:03d}")


def all_of(store):
    return {n: sorted(map(str, store.read(n).collect())) for n in ("source", "document", "fetch_report")}


ROUNDS = [
    [fetch(1, 100, [5, 7, "x"], {7: " "}, title="one", state={"page": "1"}), fetch(2, 100, [9], truncated=True), fetch(9, 100, [1])],
    [fetch(1, 200, None, error="timeout"), fetch(2, 200, [12, 5], truncated=False, history={"messages": [], "cursor": 3, "done": True, "state": {"a": "b"}})],
    [fetch(1, 300, [6, 8], state={"page": None}), fetch(2, 300, [], backfill_pending=True), fetch(1, 310, [11]), fetch(1, 305, None, error="late")],
]


def start(spark, store):
    collect_job.create(store, spark.createDataFrame([(1, 900), (2, 60)], "source_id long, fetch_interval long"))


def stream(spark, folder):
    return spark.readStream.schema(collect_job.FETCH).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_collect_job(spark, store, tmp_path):
    start(spark, store)
    write_fetches(spark, f"{tmp_path}/in", ROUNDS)
    collect_job.CollectJob(store).run(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state")
    got = {r["source_id"]: r.asDict() for r in store.read("source").collect()}
    assert sorted(got) == [1, 2]
    one, two = got[1], got[2]
    assert (one["cursor"], one["pending"], one["backfill"], one["failures"], one["title"], one["state"]) == (11, None, 5, 0, "one", {})
    assert (one["next_fetch_at"], one["total_collected"], one["last_error"]) == (315, 5, None)
    assert (two["cursor"], two["pending"], two["backfill"], two["backfill_done"], two["state"]) == (12, None, 3, False, {"a": "b"})
    assert two["total_collected"] == 2  # 9 and 12; post 5 is the first source's
    assert store.read("document").count() == 7


@pytest.mark.parametrize("where, epoch", [("before", 1), ("after", 0), ("after", 2)])
def test_a_killed_collect_job_goes_on_as_if_nothing_were(spark, store, tmp_path, where, epoch):
    """Killed before or after the commit of each batch, and run again from its checkpoint."""
    start(spark, store)
    write_fetches(spark, f"{tmp_path}/in", ROUNDS)

    class Killed(collect_job.CollectJob):
        def step(self, batch, n):
            if n == epoch and where == "before":
                raise RuntimeError("killed")
            super().step(batch, n)
            if n == epoch:
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Killed(store).run(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state")
    collect_job.CollectJob(store).run(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state")
    clean = Store(spark, f"file://{tmp_path}/clean")
    start(spark, clean)
    collect_job.CollectJob(clean).run(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state2")
    assert all_of(store) == all_of(clean)


def test_checks_out_of_order_within_the_watermark(spark, tmp_path):
    """Batches of shuffled checks, folded by timers as the watermark passes them, give what the ordered history gives."""
    r = random.Random(1)
    rows = [(r.randrange(4), i, 1_700_000_000 + i * 3600, r.choice(["valid", "invalid", "error", "checking"])) for i in range(160)]
    for k in range(4):
        part = rows[k * 40 : k * 40 + 40]
        r.shuffle(part)
        spark.createDataFrame(part, "link long, check_id long, checked_at long, status string").coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema("link long, check_id long, checked_at long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs._ROCKS)
    try:
        out = streams.drain(check_timers.check_timers(stream.withColumn("at", F.timestamp_seconds("checked_at")), "2 days"), "timers", "update").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for x in sorted(out, key=lambda x: x["checks"]):
        got[x["link"]] = (x["checks"], x["status"], x["attempts"], x["flips"])
    for link in range(4):
        checks, status, _, attempts, flips = check_timers.fold(check_timers._START, [s for k, _, _, s in rows if k == link])
        assert got[link] == (checks, status, attempts, flips)


def test_a_claim_keeps_the_baseline_and_a_lost_one_counts_once():
    after = lambda *s: check_timers.fold(check_timers._START, s)[3:]
    assert after("invalid", "checking", "invalid") == (2, 0)
    assert after("valid", "checking", "invalid") == (1, 2)
    assert after("invalid", "checking", "checking", "invalid") == (2, 0)
    assert after("valid", "checking", "checking", "invalid", "checking", "invalid") == (3, 1)


def repair_store(spark, root):
    store = Store(spark, root)
    media = [(k, f"k{k % 7}", k // 7, f"t{k}", "unknown" if k % 2 else "tv", 2000 + k if k % 4 else 0) for k in range(1, 60)]
    tasks = [(k, k, "delete", "s", None, None, None, None, None, "pending", k, None) for k in (3, 99)]
    tasks += [(k, k, "retitle", "s", f"t{k}" if k == 10 else f"new{k}", None, None, None, None, "pending", k, None) for k in (10, 11, 12, 13)]
    tasks += [(k, k, "rehome", "s", f"moved{k}", "anime", 1990, f"k{k % 2 + 8 if k > 25 else 1}", 1, "pending", 100 - k, None) for k in (20, 22, 25, 27, 98)]
    store.commit(store.current(), {
        "media": Put(spark.createDataFrame(media, "media_id long, work_key string, season int, title string, media_type string, year long"), ["media_id"]),
        "bridge": Put(spark.createDataFrame([(k, r) for k, *_ in media for r in range(k % 5)], "media_id long, resource_id long"), ["media_id", "resource_id"]),
        "work": Put(spark.createDataFrame([(f"k{k}", f"w{k}", "unknown", 0) for k in range(7)], "work_key string, title string, media_type string, year long"), ["work_key"]),
        "repair_task": Put(spark.createDataFrame(tasks, repairs.TASK), ["task_id"]),
    })
    return store


def test_a_repair_round_goes_on_after_a_crash(spark, tmp_path):
    """Cut off after its second commit, and run again, it leaves what one run leaves."""
    clean, cut = (repair_store(spark, f"file://{tmp_path}/{n}") for n in ("clean", "cut"))
    report = repairs.run_round(clean, 1000, batch=3)
    assert {k: v for k, v in report.items() if "_" in k} == {"delete_applied": 1, "delete_skipped": 1, "retitle_applied": 3, "retitle_skipped": 1, "rehome_applied": 4, "rehome_skipped": 1}
    commit, done = cut.commit, []

    def until_second(*args, **more):
        if len(done) == 2:
            raise RuntimeError("killed")
        done.append(1)
        return commit(*args, **more)

    cut.commit = until_second
    with pytest.raises(RuntimeError, match="killed"):
        repairs.run_round(cut, 1000, batch=3)
    assert cut.read("repair_task").where("status = 'pending'").count() == 6
    cut.commit = commit
    repairs.run_round(cut, 1000, batch=3)
    for name in ("media", "bridge", "work", "repair_task"):
        assert rows_in(cut, name) == rows_in(clean, name), name
    media = {x["media_id"]: x for x in clean.read("media").collect()}
    assert 3 not in media and media[11]["title"] == "new11" and media[12]["title"] == "new12"
    moved = [x for x in media.values() if x["title"].startswith("moved")]
    assert {(x["work_key"], x["season"]) for x in moved} >= {("k9", 1)} and "k9" in {x["work_key"] for x in clean.read("work").collect()}
    assert len({(x["work_key"], x["season"]) for x in media.values() if x["season"] == 1 and x["work_key"] == "k1"}) == 1


def test_a_round_beyond_the_gate_is_refused_whole(spark, tmp_path):
    store = repair_store(spark, f"file://{tmp_path}/s")
    more = spark.createDataFrame([(500 + k, k, "delete", "s", None, None, None, None, None, "pending", 1, None) for k in (40, 41, 42)], repairs.TASK)
    store.commit(store.current(), {"repair_task": Append(more)})
    at = store.current().number
    with pytest.raises(repairs.BlastRadiusExceeded):
        repairs.run_round(store, 1000)
    assert store.current().number == at
    assert repairs.run_round(store, 1000, dry_run=True, force=True) == {"delete": 5, "retitle": 4, "rehome": 5}
    assert repairs.run_round(store, 1000, force=True)["delete_applied"] == 4


def test_a_reset_that_fails_leaves_all_tables(spark, tmp_path, monkeypatch):
    store = repair_store(spark, f"file://{tmp_path}/s")
    before = {n: rows_in(store, n) for n in ("media", "bridge", "work", "repair_task")}
    write, done = store._write, []

    def fails(name, rows):
        done.append(name)
        if len(done) == 3:
            raise RuntimeError("disk full")
        return write(name, rows)

    monkeypatch.setattr(store, "_write", fails)
    with pytest.raises(RuntimeError, match="disk full"):
        reset.reset(store)
    monkeypatch.setattr(store, "_write", write)
    assert {n: rows_in(store, n) for n in before} == before
    assert reset.leaves_first({"a": (), "b": ("a",), "c": ("b", "a")}) == ["c", "b", "a"]
    report = reset.reset(store)
    assert set(report.after.values()) == {0} and report.tables.index("bridge") < report.tables.index("media") < report.tables.index("work")
    store.restore(report.snapshot)
    assert {n: rows_in(store, n) for n in before} == before


def test_two_workers_never_claim_a_row_twice(spark, store):
    queue = "doc_id long, source string, parse_status string, attempts long, lease_until long, lease_token string, next_parse_at long, last_parsed_at long, parse_error string"
    rows = [(k, None, "pending", 0, None, None, None, None, None) for k in range(30)]
    store.commit(store.current(), {"document_queue": Put(spark.createDataFrame(rows, queue), ["doc_id"])})
    got = {}

    def work(name):
        got[name] = [x["doc_id"] for _ in range(2) for x in claims.claim_documents(store, name, 1000, limit=7).collect()]

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got["a"]) == len(got["b"]) == 14 and not set(got["a"]) & set(got["b"])
    ends = spark.createDataFrame([(k, k % 2 == 0, False, "bad") for k in got["a"]], "doc_id long, ok boolean, catalog boolean, error string")
    claims.finish_documents(store, ends, "b", 1010)  # not its leases: nothing happens
    assert store.read("document_queue").where("parse_status = 'running'").count() == 28
    claims.finish_documents(store, ends, "a", 1010)
    now = {x["doc_id"]: x for x in store.read("document_queue").collect()}
    assert all(now[k]["parse_status"] == ("done" if k % 2 == 0 else "pending") and now[k]["lease_token"] is None for k in got["a"])
