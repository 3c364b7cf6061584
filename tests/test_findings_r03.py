"""What the review of round 3 found: small tables on which a query differed from its SQL."""

import glob
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from linkcatalog.operators import canon, extract, repairs
from linkcatalog.plans import flows, jobs
from linkcatalog.store import Store
from tests.conftest import rows_of


@pytest.fixture
def equal(spark, tmp_path):
    """Runs a query over tables given as DataFrames and its SQL over the same."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, rows in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            rows.write.parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        got, want = rows_of(e.queries()[name](spark, str(tmp_path)).toArrow()), rows_of(con.execute(e.oracle_sql()[name]).to_arrow_table())
        assert got[1] and got == want

    return check


def test_f1_titles_cut_off_within_a_reference(spark, equal):
    titles = ["The&amp;&amp;&amp; of% eran&amp;&amp", "a &lt;b&gt; & c", "x&amp", "one&am", "token = &quot;7&quot;"]
    pages = [(n, "https://a.example/1", f"<html><head><title>{t}</title></head><body>t&amp</body></html>") for n, t in enumerate(titles)]
    equal("page_titles", pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


def _letters(text, n):
    return hashlib.md5(text.encode()).hexdigest()[:n].translate(str.maketrans("0123456789", "ghijklmnop"))


def test_f4_keys_of_letters_that_repeat_or_are_a_mark(spark, equal):
    texts = [t for t in map(str, range(400_000)) if (s := _letters(t, 6))[:3] == s[3:] or "hifi" in s][:60]
    assert any("hifi" in _letters(t, 6) for t in texts) and any(len({*_letters(t, 3)}) == 3 for t in texts)
    equal("title_series_key", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_f3_rounds_of_many_batches_leave_what_one_leaves(spark, data, same, monkeypatch):
    run = repairs.run_round
    monkeypatch.setattr(repairs, "run_round", lambda store, now: run(store, now, batch=10))
    same(jobs.QUERIES["repair_round"], jobs.SQL["repair_round"])


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """The plans of what stores write, by table."""
    plans, write = [], Store._write

    def keep(self, name, rows):
        plans.append((name, _plan(rows)))
        return write(self, name, rows)

    monkeypatch.setattr(Store, "_write", keep)
    return plans


def test_f5_new_posts_are_told_once_for_all_results(spark, data, written):
    jobs.QUERIES["collect_job"](spark, data)
    commits = [p for name, p in written if name in ("source", "document", "fetch_report")]
    assert len(commits) >= 12 and not any(re.search(r"LeftAnti, \((content_)?hash", p) for p in commits)


def test_f6_line_items_are_not_read_for_each_count(spark, data, written):
    jobs.QUERIES["counters_incremental"](spark, data)
    assert {name for name, _ in written} == {"media_count", "work_count"} and not any("l_orderkey" in p for _, p in written)


def test_f8_files_grow_with_the_table(spark, tmp_path, equal, monkeypatch):
    monkeypatch.setattr(flows, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    texts = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 300).cast("string")).alias("text"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        equal("stream_ingest", documents=texts)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(glob.glob(f"{tmp_path}/ingest/posts/**/*.json", recursive=True)) == 12
    assert len(glob.glob(f"{tmp_path}/ingest/out/epoch=*")) == 3


def test_f7_f9_posts_are_extracted_and_keyed_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("名称：大主宰\nhttps://pan.quark.cn/s/a"), F.col("id").cast("string")).alias("text"))
    built = canon.build_catalogue(extract.extract(docs), "doc_id")
    plans = {name: _plan(built[name]) for name in ("resources", "media")}
    assert all(p.count("Range (") == 1 for p in plans.values())
    assert not any("regexp_replace" in line for p in plans.values() for line in p.splitlines() if "Filter " in line)
