import base64
import hashlib
import json
import zlib

from pyspark.sql import functions as F

from linkcatalog.operators import extract
from linkcatalog.sources import files, parsers
from linkcatalog.streaming import jobs


def test_channel_page():
    html = """<div class="tgme_widget_message" data-post="chan/12"><div class="tgme_widget_message_text">b<br/><a href="https://pan.quark.cn/s/x">label</a></div>
      <time datetime="2024-01-02T00:00:00+00:00"></time></div>
      <div class="tgme_widget_message" data-post="chan/9"><a class="tgme_widget_message_reply"><div class="tgme_widget_message_text">quoted</div></a>
      <div class="tgme_widget_message_text">a</div></div>"""
    got = parsers.channel_messages(html)
    assert [(m["message_id"], m["text"]) for m in got] == [("9", "a"), ("12", "b\nhttps://pan.quark.cn/s/x")]
    assert parsers.plan_pages(50, 2) == ([50, 30], 10, False)
    assert parsers.plan_pages(30, 9) == ([30, 10], 1, True)


def test_feed():
    rss = """<?xml version="1.0"?><rss><channel><title>c</title><item><title>T</title><guid>g1</guid><description><![CDATA[<p>x<br>y</p>]]></description>
      <pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate><infoHash>0123456789abcdef0123</infoHash></item></channel></rss>"""
    (m,) = parsers.feed_messages(rss)
    assert m["message_id"] == "g1" and m["text"] == "T\nx\ny\nmagnet:?xt=urn:btih:0123456789abcdef0123"
    assert parsers.feed_messages("<broken") == []


def test_payloads():
    packed = base64.urlsafe_b64encode(zlib.compress(json.dumps({"a": 1}).encode())).decode().rstrip("=")
    assert parsers.decode_sheet(packed) == {"a": 1}
    assert parsers.decode_sheet("!") is None
    assert parsers.render_row({"a": {"k1": {"k1": "剧"}, "k30": "x"}, "b": {"k8": [{"k2": "y", "k3": "http://x"}]}, "c": None, "d": {"k8": [{"k2": "z", "k3": "no link"}]}}, {"a": "名称"}) == "名称：剧\nb：http://x\nd：z no link"
    info = b"d6:lengthi3e4:name1:ae"
    assert parsers.torrent_magnet(b"d8:announce1:x4:info" + info + b"e") == "magnet:?xt=urn:btih:" + hashlib.sha1(info).hexdigest()
    assert parsers.torrent_magnet(b"junk") is None
    assert parsers.text_blocks("a\n\nb\nc", 2) == ["a", "b", "c"]


def test_probes(spark):
    rows = [
        ("quark", '{"code": 0}', 200, "valid"), ("quark", '{"code": 9, "message": "需要提取码"}', 200, "need_password"), ("uc", '{"code": 41006}', 200, "invalid"),
        ("quark", '{"code": 5}', 200, "error"), ("quark", "<html>", 200, "error"), ("quark", '{"code": 0}', 429, "rate_limited"),
        ("alipan", '{"has_pwd": true}', 200, "need_password"), ("alipan", '{"share_name": "x"}', 200, "valid"), ("alipan", '{"code": "ShareLink.Expired"}', 200, "invalid"),
        ("ctfile", '{"code": 200, "file": {"file_id": 3}}', 200, "valid"), ("ctfile", '{"code": 404}', 200, "invalid"),
        ("pan123", '{"code": 0, "data": {"Expired": true}}', 200, "invalid"), ("pan123", '{"code": 0, "data": {}}', 200, "valid"), ("baidu", "{}", 200, "unsupported"), ("quark", None, 200, "error"),
    ]
    df = spark.createDataFrame(rows, "provider string, body string, http int, want string")
    bad = df.withColumn("got", extract.classify_probe(F.col("provider"), F.col("body"), F.col("http"))).where("not (got <=> want)").collect()
    assert bad == []


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n---\n \n---\ny", encoding="utf-8")
    assert sorted(r[0].strip() for r in files.read_txt(spark, str(tmp_path / "a.txt"), "---").collect() if r[0].strip()) == ["x", "y"]
    (tmp_path / "b.jsonl").write_text('{"text": "t", "source": "s"}\nnot json\n\n', encoding="utf-8")
    good, bad = files.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    assert [tuple(r) for r in good.collect()] == [("t", "s")] and bad.count() == 1


def test_ingest_stream(spark, tmp_path):
    """Posts come in files; each text is stored once, in whichever batch it comes first."""
    for i in range(4):
        rows = [{"id": 10 * i + k, "text": f"post {k % (3 + i)}"} for k in range(10)]
        (tmp_path / f"{i}.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    out = str(tmp_path / "out")
    schema = "id long, text string, content_hash string"

    def stored(epoch):
        if epoch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{out}/epoch={e}" for e in range(epoch)])

    run = jobs.ingest_batches(stored, lambda rows, epoch: rows.select("id", "text", "content_hash").write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), "id")
    posts = files.stream_posts(spark, str(tmp_path / "*.jsonl"), files=1)
    posts.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(schema).parquet(*[f"{out}/epoch={e}" for e in range(4)]).collect()
    assert sorted(r["text"] for r in kept) == [f"post {k}" for k in range(6)]
