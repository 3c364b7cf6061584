"""Inputs whose results are known, as SQL beside the plans: every text function, parser and extractor."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.functions import links, misc, titles
from linkcatalog.operators import checks, extract
from linkcatalog.sources import parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _text(x) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    escaped = str(x).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    return f"'{escaped}'"


def cases(name: str, rows: list[tuple], result):
    """Registers the query ``name``: (no, kind, result) of ``rows`` (kind, input, expected); ``result`` gives
    the plan for a frame of (no, kind, input)."""
    listed = ", ".join(f"({i}, {_text(kind)}, {_text(want)})" for i, (kind, _, want) in enumerate(rows))
    SQL[name] = f"SELECT CAST(no AS BIGINT) AS no, kind, result FROM (VALUES {listed}) AS t(no, kind, result)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, kind, given) for i, (kind, given, _) in enumerate(rows)], "no long, kind string, input string")
        return result(df).select("no", "kind", F.col("result").cast("string").alias("result"))

    QUERIES[name] = run


def _by_kind(functions: dict[str, Callable | tuple[Callable, Callable]]):
    """Each kind's function over its own rows; of a pair the second shows what the first makes (in a plan of its
    own: higher-order functions can't take what comes from Python in one projection)."""

    def result(df: DataFrame) -> DataFrame:
        out = None
        for kind, f in functions.items():
            make, show = f if isinstance(f, tuple) else (f, None)
            one = df.where(F.col("kind") == kind).select("no", "kind", make(F.col("input")).alias("result"))
            if show:
                one = one.select("no", "kind", F.explode(F.array("result")).alias("made")).select("no", "kind", show(F.col("made")).alias("result"))
            one = one.select("no", "kind", F.col("result").cast("string").alias("result"))
            out = one if out is None else out.union(one)
        return out

    return result


def _title(*names: str) -> dict[str, Callable]:
    return {n: (lambda n: lambda x: titles.call(n, x))(n) for n in names}


cases(
    "title_cleaning",
    [("clean_title", a, b) for a, b in (
        ("测试剧集 1080p 中字 WEB-DL", "测试剧集"), ("【4K高码率】测试剧集（2024）", "测试剧集"), ("测试剧集 更新至20集", "测试剧集"),
        ("Some.Title.2024.1080p.WEB-DL.H265", "Some Title"), ("测试剧集　１０８０Ｐ", "测试剧集"), ("📁 测试剧集 🏷", "测试剧集"), ("测试剧集2 4K", "测试剧集2"),
        ("电视剧：师兄太稳健 (2026)", "师兄太稳健"), ("寒衣入心（2026）4K S01E01 - E20 HiveWeb", "寒衣入心"), ("一斩苍穹 (2026) 4K 更新至6集/国漫", "一斩苍穹"),
        ("动画人生 1080p", "动画人生"), ("某书名 译者:李四 出版社:人民文学", "某书名"), ("某片 2001年剧情片", "某片"), ("某剧 2024年 第2季", "某剧 第2季"),
        ("年会不能停", "年会不能停"), ("莲花楼 豆瓣8 5分", "莲花楼"), ("刀锋战士13部全", "刀锋战士"), ("◎译 名 曼哈顿 曼克顿", "曼哈顿 曼克顿"),
        ("◎年　代 1995 ◎译　名 大话西游 ◎产　地 中国香港", "大话西游"), ("No 027 唐伯虎点秋香", "唐伯虎点秋香"), ("Room No 237", "Room No 237"),
        ("金钱游戏 全", "金钱游戏"), ("种群 2G 集", "种群"), ("雷霆扫毒 11 3GB", "雷霆扫毒"), ("花开锦绣 10bi &FLAC无损HiFi声", "花开锦绣"), ("DV时代", "DV时代"),
        ("Tom & Jerry", "Tom & Jerry"), ("D 大主宰 动漫版", "大主宰"), ("007803 诛天大主宰", "诛天大主宰"), ("K Pop 猎魔女团", "K Pop 猎魔女团"),
        ("少年江湖 少年江湖", "少年江湖"), ("", ""), (None, None),
    )]
    + [("norm_key", "some.title", "sometitle"), ("norm_key", "测试·剧集！", "测试剧集"), ("norm_key", "【4K】测试剧集 全40集 中字", "测试剧集")]
    + [("series_norm_key", x, "大主宰") for x in ("大主宰 第2季", "大主宰年番2", "大主宰 S02", "大主宰丨丨1080p丨", "大主宰 Great Ruler", "D 大主宰 动漫版")]
    + [("series_norm_key", a, b) for a, b in (("天命大主宰", "天命大主宰"), ("Dopesick", "dopesick"), ("狼的孩子雨和雪 おおかみこどもの雨と雪", "狼的孩子雨和雪"), ("美国狙击手 American Sniper", "美国狙击手"))]
    + [("block_key", "误杀2", "误杀"), ("block_key", "大主宰 II", "大主宰"), ("tag_norm_key", "＃ Sci-Fi", "scifi"), ("strip_season", "大主宰 第二季", "大主宰")],
    _by_kind(_title("clean_title", "norm_key", "series_norm_key", "block_key", "tag_norm_key", "strip_season")),
)

cases(
    "title_attributes",
    [("extract_season", a, b) for a, b in (("大主宰 第2季", 2), ("大主宰 第二季", 2), ("大主宰年番2", 2), ("大主宰II", 2), ("Stranger Things S03", 3), ("大主宰年番 10", None), ("大主宰 更新至S01E93", None), ("误杀2", None))]
    + [("extract_year", a, b) for a, b in (("测试剧集 (2024)", 2024), ("测试剧集（1998）", 1998), ("Some.Title.2016.1080p", 2016), ("测试剧集 1920x1080", None), ("复仇者联盟 2025年8月25日更新", None), ("流浪地球2 2023", 2023))]
    + [("extract_quality", a, b) for a, b in (("测试剧集 4K HDR", "4k"), ("测试剧集 2160p", "4k"), ("测试剧集 1080P", "1080p"), ("某片 720p", "720p"), ("某片 标清", "sd"), ("某片", "unknown"))]
    + [("extract_episode_info", a, b) for a, b in (("测试剧集 全40集", "全40集"), ("Stranger Things S02", "S02"), ("某剧", None))]
    + [("extract_size_bytes", a, b) for a, b in (("大小：440.41MB", 461803356), ("7.49G", 8042326261), ("未知", None))]
    + [("guess_media_type", a, b) for a, b in (("测试剧集 全40集", "tv"), ("某书 作者:张三 已改编动画 番剧", "book"), ("狂徒（2026）4K S01", "tv"), ("某综艺", "variety"), ("纪录片 海洋", "documentary"), ("国漫 某", "anime"), ("某电影", "movie"), ("某", "unknown"))]
    + [("looks_like_catalog", a, b) for a, b in (("更144部", "true"), ("5月3日片单", "true"), ("大主宰", "false"))]
    + [("is_junk_media_title", a, b) for a, b in (*((x, "true") for x in ("夸克", "夸克网盘", "链接", "查看资源", "84", "007803", "adg4qmqwc8j", "", "◎年 代", "感谢")), *((x, "false") for x in ("大主宰", "误杀2", "更上一层楼", "Oppenheimer", "三体")))]
    + [("classify_tag", a, b) for a, b in (("科幻", "genre"), ("美国", "region"), ("国语", "language"), ("2024", "year"), ("90年代", "year"), ("吞噬星空", "other"))]
    + [("extract_category", a, b) for a, b in (("电视剧：某剧", "电视剧"), ("某 综艺 节目", "综艺"), ("某", None))],
    _by_kind(_title("extract_season", "extract_year", "extract_quality", "extract_episode_info", "extract_size_bytes", "guess_media_type", "looks_like_catalog",
                    "is_junk_media_title", "classify_tag", "extract_category")),
)

_INFO = "0123456789abcdef0123456789abcdef01234567"
cases(
    "link_forms",
    [("known", a, b) for a, b in (
        ("https://pan.quark.cn/s/abc123def456", "quark abc123def456"), ("https://drive.uc.cn/s/xyz789", "uc xyz789"), ("https://www.alipan.com/s/AbCd1234", "alipan AbCd1234"),
        ("https://www.aliyundrive.com/s/AbCd1234", "alipan AbCd1234"), ("https://www.alipan.com/t/TtTt1111", "alipan TtTt1111"), ("https://pan.baidu.com/s/1AbCdEf-gh", "baidu AbCdEf-gh"),
        ("https://pan.baidu.com/share/init?surl=AbCdEf", "baidu AbCdEf"), ("https://115.com/s/sw1234abc", "pan115 sw1234abc"), ("https://www.123pan.com/s/7Tx1jv-yOMtv", "pan123 7Tx1jv-yOMtv"),
        ("https://www.123865.com/s/u9izjv-GF3Kv", "pan123 u9izjv-GF3Kv"), ("https://1820645299.share.123pan.cn/123pan/7Tx1jv-yOMtv", "pan123 7Tx1jv-yOMtv"),
        ("https://yun.139.com/shareweb/#/w/i/2xop3Kh97fRxo", "mobile139 2xop3Kh97fRxo"), ("https://www.400gb.com/file/73864951", "ctfile file/73864951"),
        ("https://url01.ctfile.com/f/8067059-687855402-65ca36", "ctfile f/8067059-687855402-65ca36"), ("https://cloud.189.cn/t/QqQq22", "tianyi QqQq22"),
        ("https://pan.xunlei.com/s/VN_abc-123", "xunlei VN_abc-123"), ("https://www.lanzoux.com/iAbCd12", "lanzou iAbCd12"), (f"magnet:?xt=urn:btih:{_INFO}", f"magnet {_INFO}"),
        ("ed2k://|file|Show.S01E01.mkv|12345|ABCDEF0123456789ABCDEF0123456789|/", "ed2k abcdef0123456789abcdef0123456789"), ("https://example.com/x", None), (None, None),
    )]
    + [("page", a, b) for a, b in (("https://t.me/chan", "true"), ("https://movie.douban.com/x", "true"), ("https://a.b.douban.com", "true"), ("https://notdouban.com/", "false"), ("http://[bad", "true"), ("https://new.example/a", "false"))]
    + [("trim", a, b) for a, b in (("https://a.example/x）。", "https://a.example/x"), ("https://a.example/x?y=1),", "https://a.example/x?y=1"))]
    + [("scan", a, b) for a, b in (
        ("看（https://pan.quark.cn/s/abc123）密码：x1y2 https://t.me/chan https://pan.quark.cn/s/abc123。 https://new.example/a", "quark abc123 x1y2 2 31, other https://new.example/a - 89 110"),
        ("😀 https://pan.baidu.com/s/1ab?pwd=q1w2 提取码: zzzz", "baidu ab q1w2 2 38"), (f"MAGNET:?xt=urn:btih:{_INFO}&dn=x###y", f"magnet {_INFO} - 0 65"), ("no links", ""), (None, None),
    )]
    + [("scan_known", "https://new.example/a https://pan.xunlei.com/s/q", "xunlei q - 22 48")],
    _by_kind({
        "known": lambda x: F.concat(links.provider_of(x)["provider"], F.lit(" "), links.provider_of(x)["share_id"]),
        "page": links.is_page,
        "trim": links.trimmed,
        "scan": lambda x: _listed(links.scan_links(x)),
        "scan_known": lambda x: _listed(links.scan_links(x, False)),
    }),
)


def _listed(found):
    row = lambda k: F.concat_ws(" ", k["provider"], k["share_id"], F.coalesce(k["passcode"], F.lit("-")), k["start"].cast("string"), k["end"].cast("string"))
    return F.array_join(F.transform(found, row), ", ")


def _items(outcome):
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    item = lambda i: F.concat_ws(" ", i["title"], blank(i["year"]), i["media_type"], i["quality"], blank(i["episode_info"]), blank(i["size_bytes"]), F.concat(F.lit("["), F.array_join(i["links"]["share_id"], " "), F.lit("]")))
    return F.concat(F.array_join(F.transform(outcome["items"], item), ", "), F.lit(" / "), F.array_join(outcome["unattributed"]["share_id"], " "), F.when(outcome["is_catalog"], " catalog").otherwise(""))


_Q = "https://pan.quark.cn/s/"
cases(
    "extractor_outcomes",
    [
        ("rule", f"名称：大主宰 (2023) 4K\n大小：2GB\n{_Q}a1\n名称：夸克\n{_Q}b2", "大主宰 2023 unknown 4k - 4096 [a1] / b2"),
        ("rule", f"名称：剧集甲\n夸克：{_Q}aaa111\n名称：剧集乙 全40集\n夸克：{_Q}bbb222", "剧集甲 - tv unknown - - [aaa111], 剧集乙 - tv unknown 全40集 - [bbb222] / "),
        ("rule", f"剧集甲\n{_Q}a1\n\n【剧集乙】\n{_Q}b2", "剧集甲 - tv unknown - - [a1], 剧集乙 - tv unknown - - [b2] / "),
        ("rule", f"5月3日片单\n{_Q}a1", " / a1 catalog"),
        ("sheet", f"文本 1：大主宰\n夸克：{_Q}a1\n年份：2023\n画质：4K", "大主宰 2023 unknown 4k - - [a1] / "),
        ("sheet", f"剧名：剧名\n链接：{_Q}a1", " / a1"),
        ("payload", '{"items": [{"title": "甲剧", "year": 2020, "media_type": "tv", "quality": "4k", "link_indexes": [0, 0, 9]}, {"title": ""}]}', "甲剧 2020 tv 4k - - [a1] / b2"),
        ("payload", "nonsense", " / a1 b2"),
    ],
    lambda df: extract.extract(
        df.select(
            "no", "kind", F.when(F.col("kind") == "payload", F.lit(f"{_Q}a1 {_Q}b2")).otherwise(F.col("input")).alias("text"),
            F.when(F.col("kind") == "payload", F.col("input")).alias("answer"), F.when(F.col("kind") == "sheet", "kdocs").otherwise("rss").alias("source_type"),
        ), "text", "source_type", "answer",
    ).select("no", "kind", F.explode(F.array("outcome")).alias("o")).select("no", "kind", _items(F.col("o")).alias("result")),
)


def _messages(found):
    return F.array_join(F.transform(found, lambda m: F.concat_ws(" ", m["message_id"], m["text"])), " | ")


def _rows(found):
    return F.array_join(F.transform(found, lambda r: F.concat_ws(" ", r["row_id"], r["text"])), " | ")


def _packed(value) -> str:
    return base64.urlsafe_b64encode(zlib.compress(json.dumps(value).encode())).decode().rstrip("=")


_CELLS = {"fT": {"k1": {"k1": "大主宰"}, "k30": "x", "k31": 1}, "fQ": {"k8": [{"k2": "点击查看", "k3": f"{_Q}a1"}], "k30": "x", "k31": 8}, "fY": {"k17": {"k1": "2026"}, "k30": "x", "k31": 17}}
_OPS = [[{"t": 3005, "c": {"k1": "s1", "k3": {"k3": {k: {"k30": n, "k31": 1} for k, n in (("fT", "剧名"), ("fQ", "夸克"), ("fY", "年份"))}}}}, {"t": 3028, "c": {"k2": {"k1": {"r1": {"k1": _CELLS}}}}}]]
_SHEET = {"clientVars": {"collab_client_vars": {
    "initialAttributedText": {"text": [{"smartsheet": _packed(_OPS)}]},
    "smartsheetConfig": json.dumps({"pageCtx": json.dumps({"ver": 100, "sheet_id": "s1", "total_row": 1})}),
    "smartsheetPermission": base64.b64encode(json.dumps([{"priv": {"items": [{"sheet_id": "s1"}, {"sheet_id": "s2"}]}}]).encode()).decode(),
}}}
_CHANNEL = f"""<div class="tgme_widget_message" data-post="chan/12"><div class="tgme_widget_message_text">b<br/><a href="{_Q}x">label</a></div>
<time datetime="2024-01-02T00:00:00+00:00"></time></div><div class="tgme_widget_message" data-post="chan/9"><a class="tgme_widget_message_reply"><div class="tgme_widget_message_text">quoted</div></a>
<div class="tgme_widget_message_text">a</div></div>"""
_FEED = """<?xml version="1.0"?><rss><channel><title>c</title><item><title>T</title><guid>g1</guid><description><![CDATA[<p>x<br>y</p>]]></description><infoHash>0123456789abcdef0123</infoHash></item></channel></rss>"""
_SHOW = {"data": {"info": {"id": 1, "cnname": "甲", "enname": "A", "year": [2020]}, "list": [{"season_cn": "第一季", "items": {"MP4": [{"episode": "1", "name": "n", "size": "1GB", "files": [{"way_cn": "夸克", "address": f"{_Q}a1", "passwd": "x1y2"}]}]}}]}}
cases(
    "source_payloads",
    [
        ("channel", _CHANNEL, "9 a | 12 b;" + _Q + "x"),
        ("feed", _FEED, "g1 T;x;y;magnet:?xt=urn:btih:0123456789abcdef0123"), ("feed", "<broken", ""),
        ("page", "<html><head><title>T</title></head><body><p>x</p><script>no</script><p><a href='/d'>y</a></p></body></html>", "T x;y https://h.example/d"),
        ("sheet", json.dumps(_SHEET), f"s1,s2 s1 100 1 r1 剧名：大主宰;夸克：{_Q}a1;年份：2026"), ("sheet", "{}", None),
        ("database", json.dumps({"records": [{"id": 7, "fields": {"名称": "甲", "链接": [{"text": "y", "href": f"{_Q}a1"}], "空": None}}]}), f"7 名称：甲;链接：{_Q}a1"),
        ("snapshot", json.dumps(_SHOW), f"名称：甲 A;年份：2020;第一季 MP4 1 n 1GB 夸克 {_Q}a1 提取码：x1y2"), ("snapshot", '{"data": {"info": {}, "list": []}}', None),
        ("blocks", "a\n\nb\nc", "a|b;c"),
        ("index", 'x Markdown Content:{"data": [{"id": "12"}, {"id": "9"}, {"id": "12"}, {"id": "x"}]}', "12,9"), ("index", "{}", ""),
        ("discussion", json.dumps({"data": {"id": "9", "attributes": {"title": "片"}}, "included": [{"type": "posts", "attributes": {"number": 2, "contentHtml": "<p>二</p>"}}, {"type": "posts", "attributes": {"number": 1, "contentHtml": f"<p>一 {_Q}a1</p>"}}]}), f"9 片;一 {_Q}a1"),
        ("comments", json.dumps({"data": [{"id": 3, "content": f"{_Q}a1", "children": [{"id": 4, "content": "谢谢"}]}, {"id": 5, "content": ""}]}), f"3 {_Q}a1 | 4 谢谢"),
        ("collection", f"1. 甲\n{_Q}a\n2. 乙\n{_Q}b", f"名称：甲;{_Q}a;名称：乙;{_Q}b"), ("collection", f"1. 甲\n2. 乙\n{_Q}b", f"名称：甲;名称：乙;合集资源：;{_Q}b"), ("collection", "甲", None),
    ],
    lambda df: _one_line(_by_kind({
        "channel": (lambda x: parsers.call("channel_messages", x), _messages),
        "feed": (lambda x: parsers.call("feed_messages", x), _messages),
        "page": (lambda x: parsers.page_column(x, F.lit("https://h.example/c")), lambda p: F.concat_ws(" ", p["title"], p["text"], F.array_join(p["links"], ","))),
        "sheet": (lambda x: parsers.call("sheet_page", x), lambda p: F.when(p.isNotNull(), F.concat_ws(" ", F.array_join(p["sheet_ids"], ","), p["sheet_id"], p["version"].cast("string"), p["total_rows"].cast("string"), _rows(p["rows"])))),
        "database": (lambda x: parsers.call("database_page", x), _rows),
        "snapshot": lambda x: parsers.call("snapshot_text", x),
        "blocks": lambda x: F.array_join(parsers.call("text_blocks", x), "|"),
        "index": lambda x: F.array_join(parsers.call("discussion_ids", x).cast("array<string>"), ","),
        "discussion": (lambda x: parsers.call("discussion", x), lambda m: F.concat_ws(" ", m["message_id"], m["text"])),
        "comments": (lambda x: parsers.call("comments", x), _messages),
        "collection": (parsers.collection_text, lambda x: x),
    })(df)),
)


def _one_line(df: DataFrame) -> DataFrame:
    return df.withColumn("result", F.replace("result", F.lit("\n"), F.lit(";")))


_FILE = '{"code": 200, "file": {"file_id": 3, "file_name": "甲.mkv", "file_size": "1.5 MB", "username": "u"}}'
cases(
    "probe_details",
    [
        ("quark", '{"code": 0}', "valid"), ("quark", '{"code": 9, "message": "需要提取码"}', "need_password"), ("uc", '{"code": 41006}', "invalid"), ("uc", '{"code": 41013}', "rate_limited"), ("quark", '{"code": 5}', "error"),
        ("quark", "<html>", "error"), ("alipan", '{"has_pwd": true}', "need_password"), ("alipan", '{"code": "ShareLink.Expired"}', "invalid"), ("alipan", '{"code": "TooManyRequests"}', "rate_limited"),
        ("quark", '{"code": 0, "data": {"title": "甲", "author": {"nick_name": "n"}}}', "valid 甲 n"), ("alipan", '{"share_name": "乙", "creator_name": "c"}', "valid 乙 c"),
        ("ctfile", _FILE, "valid 甲.mkv u 1572864"), ("ctfile", '{"code": 423}', "need_password"), ("ctfile", '{"code": 404}', "invalid"), ("ctfile", '{"code": 403, "message": "链接不完整"}', "invalid"), ("ctfile", '{"code": 429}', "rate_limited"),
        ("pan123", '{"code": 0, "data": {"Expired": true}}', "invalid"), ("pan123", '{"code": 0, "data": {"ShareName": "丙"}}', "valid 丙"), ("pan123", '{"code": 5, "message": "已失效"}', "invalid"), ("baidu", "{}", "unsupported"),
    ],
    lambda df: df.withColumn("d", extract.probe_details(F.col("kind"), F.col("input"), F.lit(200))).select(
        "no", "kind", F.concat_ws(" ", F.col("d.status"), F.col("d.title"), F.col("d.sharer"), F.col("d.size_bytes").cast("string")).alias("result")
    ),
)

cases(
    "small_helpers",
    [
        ("owner", "10", "1"), ("owner", "01", "62"), ("owner", "0", None), ("owner", "a!", None), ("backoff", "0", "60"), ("backoff", "3", "480"), ("backoff", "30", "21600"),
        ("shard", "00ff", "3"), ("title_marker", "1. 名称：测试剧集", "测试剧集"), ("retype", "tv book", "book"), ("retype", "tv movie", "tv"), ("retype", "unknown movie", "movie"), ("retype", "tv unknown", "tv"),
    ],
    _by_kind({
        "owner": misc.owner_id, "backoff": lambda x: checks.backoff(x.cast("int")), "shard": lambda x: misc.shard_of(x, 4),
        "title_marker": lambda x: titles.call("strip_title_marker", x), "retype": lambda x: _retype(x),
    }),
)


def _retype(x):
    from linkcatalog.operators import identity

    return identity.retype(F.split_part(x, F.lit(" "), F.lit(1)), F.split_part(x, F.lit(" "), F.lit(2)))
