import pytest
from pyspark.sql import functions as F

from linkcatalog.functions import misc
from linkcatalog.operators import canon, checks, extract, ingest


def test_shards_and_closure():
    assert misc.parse_shard("3/8") == (3, 8)
    for bad in ("8/8", "1/17", "x", "1/0"):
        with pytest.raises(ValueError):
            misc.parse_shard(bad)
    assert misc.closure({"c"}, {"c": {"b"}, "b": {"a"}, "z": {"a"}}) == {"a", "b", "c"}


def test_column_helpers(spark):
    row = spark.range(1).select(
        misc.owner_id(F.lit("1")).alias("a"), misc.owner_id(F.lit("01")).alias("b"), misc.owner_id(F.lit("-")).alias("c"),
        misc.link_lines(F.array(F.lit("u"), F.lit("v"))).alias("d"), checks.backoff(F.lit(0)).alias("e"), checks.backoff(F.lit(3)).alias("f"), checks.backoff(F.lit(99)).alias("g"),
    ).first()
    assert tuple(row) == ("1", "62", None, "[0] u\n[1] v", 60, 480, 21600)


def test_ingest_outcomes(spark):
    new = spark.createDataFrame([(1, "a\r\n b "), (2, "a\nb"), (3, " \n"), (4, None), (5, "old")], "pos long, text string")
    old = spark.createDataFrame([("old",)], "text string").select(ingest.content_hash(F.col("text")).alias("content_hash"))
    got = {r["pos"]: r["outcome"] for r in ingest.ingest_many(new, old, "pos").collect()}
    assert got == {1: "created", 2: "duplicated", 3: "skipped", 4: "skipped", 5: "duplicated"}


def test_catalogue(spark):
    docs = spark.createDataFrame(
        [
            (1, "名称：大主宰 (2023)\nhttps://pan.quark.cn/s/a1\n名称：夸克\nhttps://pan.quark.cn/s/b2"),
            (2, "名称：大主宰 第二季 4K 动漫\nhttps://pan.quark.cn/s/a1 提取码：wxyz\nhttps://www.alipan.com/s/c3 #科幻"),
            (3, None),
        ],
        "doc_id long, text string",
    )
    built = canon.build_catalogue(extract.extract(docs), "doc_id")
    (work,) = built["works"].collect()
    assert (work["series_key"], work["title"], work["media_type"], work["year"], work["season_count"]) == ("大主宰", "大主宰", "anime", 2023, 2)
    links = {(r["provider"], r["share_id"]): (r["seen_count"], r["passcode"]) for r in built["resources"].collect()}
    assert links == {("quark", "a1"): (2, "wxyz"), ("quark", "b2"): (1, None), ("alipan", "c3"): (1, None)}
    assert built["bridge"].count() == 3 and built["media"].count() == 2
    assert [(r["kind"], r["name"]) for r in built["media_tag"].collect()] == [("genre", "科幻")]
