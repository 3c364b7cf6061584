"""Extractors: one document to items with links and tags; link probes as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcatalog.functions import links as L
from linkcatalog.functions import titles as T
from linkcatalog.functions.text import let, nfkc, nfkc_steps, one_of, pattern, program, strip

# Labels of sheet columns.
TITLE_COLUMNS = ("剧名", "名称", "片名", "标题", "资源名", "资源名称", "影片名", "电影名")
YEAR_COLUMNS = ("年份", "年代", "上映年份", "首播年份")
TYPE_COLUMNS = ("类型", "分类", "题材")
EPISODE_COLUMNS = ("集数", "更新", "进度", "更新进度")
QUALITY_COLUMNS = ("画质", "清晰度", "分辨率")
NOTE_COLUMNS = ("备注", "失效留言", "序号", "整理日期", "更新日期", "说明", "网盘", "来源")
LINK_COLUMNS = (
    "夸克", "夸克网盘", "夸克链接", "百度", "百度网盘", "百度云", "度盘", "阿里", "阿里云盘", "阿里网盘", "UC", "uc", "UC网盘",
    "天翼", "天翼云盘", "115", "115网盘", "迅雷", "迅雷云盘", "移动云盘", "光鸭云盘", "云盘", "网盘链接", "原链接", "链接",
    "社区链接", "下载链接", "分享链接", "磁力", "磁力下载", "磁力链接", "种子", "查看资源", "资源链接", "地址", "下载地址",
    "提取码", "访问码", "分享码", "密码",
)
SHARED_LINKS = pattern(r"(?m)^\s*合集资源\s*[:：]")
EXTRACTOR_VERSION = {"rule": "v2", "sheet": "v1", "payload": "v1"}

ITEM = (
    f"struct<title:string,norm_key:string,original_title:string,year:int,media_type:string,episode_info:string,quality:string,"
    f"size_bytes:bigint,links:{L.LINK_TYPE},tags:array<struct<kind:string,name:string>>>"
)
OUTCOME = f"struct<is_catalog:boolean,items:array<{ITEM}>,unattributed:{L.LINK_TYPE},extractor:string,version:string>"


_NONE = {"links": L.LINK_TYPE, "tags": "array<struct<kind:string,name:string>>"}


def _item(title: Column, key: Column, **more: Column) -> Column:
    """An item of a cleaned title and its key; what isn't told is blank."""
    blank = {"media_type": F.lit("unknown"), "quality": F.lit("unknown"), **{k: F.array().cast(kind) for k, kind in _NONE.items()}}
    told = {"title": title, "norm_key": key} | blank | more
    return F.struct(*[told.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _ITEM_FIELDS])


_ITEM_FIELDS = (
    ("title", "string"), ("norm_key", "string"), ("original_title", "string"), ("year", "int"), ("media_type", "string"), ("episode_info", "string"),
    ("quality", "string"), ("size_bytes", "bigint"), ("links", L.LINK_TYPE), ("tags", "array<struct<kind:string,name:string>>"),
)


def _outcome(name: str, items: Column, links: Column, is_catalog: Column) -> Column:
    """Items and the links that none of them has."""
    key = lambda x: F.struct(x["provider"].alias("p"), x["share_id"].alias("s"))

    def of_items(items: Column) -> Column:
        used = F.flatten(F.transform(items, lambda i: F.transform(i["links"], key)))
        left = let(used, lambda used: F.filter(links, lambda x: ~F.array_contains(used, key(x))))
        return F.struct(
            F.coalesce(is_catalog, F.lit(False)).alias("is_catalog"), items.alias("items"), left.alias("unattributed"), F.lit(name).alias("extractor"),
            F.lit(EXTRACTOR_VERSION[name]).alias("version"),
        )

    return let(items, of_items)


# Each extractor adds a column of its name step by step. Steps name the columns of steps before once, by let: merged into one
# projection, they are still worked out once for each row.

_X = "__extract_"


def _x(name: str) -> Column:
    return F.col(_X + name)


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(_X + name, value)


def _keyed(df: DataFrame, name: str, *kept: str) -> DataFrame:
    """An array of structs with ``raw`` gets ``raw`` in its compatibility form as ``plain``, cleaned as ``title``, and
    the ``key`` of that."""
    more = lambda x, *names: [x[n].alias(n) for n in (*kept, "raw", *names)]
    df = _with(df, name, F.transform(_x(name), lambda x: F.struct(*more(x), program(x["raw"], nfkc_steps()).alias("plain"))))
    df = _with(df, name, F.transform(_x(name), lambda x: F.struct(*more(x, "plain"), program(x["plain"], T.CLEANING).alias("title"))))
    return _with(df, name, F.transform(_x(name), lambda x: F.struct(*more(x, "plain", "title"), T.key_of_cleaned(x["title"]).alias("key"))))


def rule_extract(df: DataFrame, text: str) -> DataFrame:
    """Segments to items. A line that names shared links gives all links to every item; without it
    segments with a catalogue's title, or of five segments and more with one link at most, are no
    items, and a document of such alone is a catalogue."""
    mine = _x("kind") == "rule"
    df = _with(df, "segments", F.when(mine, let(_x("links"), lambda links: L.segment_text(F.col(text), links))))
    df = _keyed(_with(df, "titled", F.transform(_x("segments"), lambda s: F.struct(s.alias("s"), F.coalesce(s["title_raw"], F.lit("")).alias("raw")))), "titled", "s")
    more = lambda x: [x[n].alias(n) for n in ("s", "plain", "title", "key")]

    def good(of: Column) -> Column:
        return F.transform(
            F.filter(of["titled"], lambda x: ~T.is_junk_key(x["title"], x["key"])),
            lambda x: F.struct(*more(x), (~of["shared"] & (T.catalog_in(x["plain"]) | of["many"])).alias("listed")),
        )

    def items(of: Column) -> Column:
        def item(x: Column, body: Column) -> Column:
            media = let(T.media_type_in(x["plain"]), lambda k: F.when(k != "unknown", k).otherwise(T.media_type_in(body)))
            return _item(
                x["title"], x["key"], year=T.year_in(x["plain"]), media_type=media, episode_info=T.episode_in(body), quality=T.quality_in(body),
                size_bytes=T.size_in(body), tags=T.tags_in(body), links=F.coalesce(of["shared"], x["s"]["links"]),
            )

        return F.transform(F.filter(of["good"], lambda x: ~x["listed"]), lambda x: let(nfkc(x["s"]["text"]), lambda body: item(x, body)))

    df = _with(df, "shared", F.when(mine, let(_x("links"), lambda links: F.when(F.col(text).rlike(SHARED_LINKS) & (F.size(links) > 0), links))))
    many = let(_x("links"), lambda links: F.size(links) <= 1)
    told = F.struct(_x("titled").alias("titled"), _x("shared").isNotNull().alias("shared"), ((F.size(_x("segments")) >= 5) & many).alias("many"))
    df = _with(df, "good", F.when(mine, let(told, good)))
    df = _with(df, "items", F.when(mine, let(F.struct(_x("good").alias("good"), _x("shared").alias("shared")), items)))
    made = F.struct(_x("items").alias("items"), _x("links").alias("links"), (F.size(_x("good")) > 0).alias("any"))
    return _with(df, "rule", F.when(mine, let(made, lambda of: _outcome("rule", of["items"], of["links"], of["any"] & (F.size(of["items"]) == 0)))))


def find_title(fields: Column) -> Column:
    """A title column's value; else the first column that is neither known nor a link. A value that
    echoes its column's name is a header. ``fields``: array<struct<k, v>>, each label once."""
    other = (*LINK_COLUMNS, *NOTE_COLUMNS, *YEAR_COLUMNS, *QUALITY_COLUMNS, *EPISODE_COLUMNS, *TYPE_COLUMNS)
    real = F.filter(fields, lambda p: F.lower(p["k"]) != F.lower(p["v"]))
    named = F.filter(real, lambda p: p["k"].isin(*TITLE_COLUMNS))
    free = F.filter(real, lambda p: ~one_of(p["k"], other) & ~p["v"].rlike("(?i)^(?:https?://|magnet:)"))
    return F.coalesce(F.get(named, F.lit(0))["v"], F.get(free, F.lit(0))["v"])


def _each_label_once(pairs: Column) -> Column:
    """The last value of a label, in the place of its first."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.transform(keys, lambda k: F.struct(k.alias("k"), last(k).alias("v")))


def sheet_extract(df: DataFrame, text: str) -> DataFrame:
    """One row of a sheet to one item with all its links."""
    mine = _x("kind") == "sheet"
    df = _with(df, "fields", F.when(mine, let(L.field_lines(F.col(text)), _each_label_once)))
    df = _with(df, "named", F.when(mine, F.array(F.struct(F.coalesce(let(_x("fields"), find_title), F.lit("")).alias("raw")))))
    df = _keyed(df, "named")
    first = lambda fields, names: F.get(F.filter(fields, lambda p: p["k"].isin(*names)), F.lit(0))["v"]
    columns = {"year": YEAR_COLUMNS, "kind": TYPE_COLUMNS, "episode": EPISODE_COLUMNS, "quality": QUALITY_COLUMNS}
    df = _with(df, "cells", let(_x("fields"), lambda fields: F.struct(*[first(fields, names).alias(n) for n, names in columns.items()])))

    def item(of: Column) -> Column:
        raw, cells = of["x"]["raw"], of["cells"]
        told = lambda n: F.coalesce(F.nullif(cells[n], F.lit("")), raw)
        return _item(
            of["x"]["title"], of["x"]["key"], year=F.coalesce(T.extract_year(cells["year"]), T.extract_year(raw)),
            media_type=let(T.guess_media_type(F.coalesce(cells["kind"], F.lit(""))), lambda k: F.when(k != "unknown", k).otherwise(T.guess_media_type(raw))),
            episode_info=T.extract_episode_info(told("episode")), quality=T.extract_quality(told("quality")), tags=T.extract_tags(F.col(text)), links=of["links"],
        )

    df = _with(df, "listed", F.when(mine, let(_x("named")[0]["raw"], lambda raw: (raw != "") & T.looks_like_catalog(raw))))
    df = _with(df, "junk", F.when(mine, let(_x("named")[0], lambda x: T.is_junk_key(x["title"], x["key"]))))
    of = F.struct(_x("named")[0].alias("x"), _x("cells").alias("cells"), _x("links").alias("links"))
    none = F.array().cast(f"array<{ITEM}>")
    df = _with(df, "items", F.when(mine, F.when(_x("listed") | _x("junk"), none).otherwise(F.array(let(of, item)))))
    made = F.struct(_x("items").alias("items"), _x("links").alias("links"), _x("listed").alias("listed"))
    return _with(df, "sheet", F.when(mine, let(made, lambda of: _outcome("sheet", of["items"], of["links"], of["listed"]))))


def payload_extract(df: DataFrame, text: str, payload: str) -> DataFrame:
    """A model's stored answer: links by index, each once, out-of-range ones dropped; untitled items
    dropped; tags only where one item is all. What is no JSON object has no items."""
    mine = _x("kind") == "payload"
    get = lambda v, name, kind: F.try_variant_get(v, f"$.{name}", kind)
    is_int = lambda v: F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))
    said = lambda v, name: F.nullif(strip(get(v, name, "string")), F.lit(""))
    nothing = F.array().cast("array<variant>")
    df = _with(df, "answer", F.when(mine, F.try_parse_json(F.col(payload))))
    raw = F.filter(F.coalesce(get(_x("answer"), "items", "array<variant>"), nothing), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    df = _keyed(_with(df, "said", F.when(mine, F.transform(raw, lambda v: F.struct(v.alias("v"), F.coalesce(said(v, "title"), F.lit("")).alias("raw"))))), "said", "v")

    def read(of: Column) -> Column:
        def item(x: Column) -> Column:
            wanted = F.filter(F.coalesce(get(x["v"], "link_indexes", "array<variant>"), nothing), is_int)
            wanted = F.filter(F.transform(wanted, lambda i: F.try_variant_get(i, "$", "int")), lambda i: i.between(0, F.size(of["links"]) - 1))
            year = let(get(x["v"], "year", "variant"), lambda y: F.when(is_int(y), F.try_variant_get(y, "$", "int")))
            title = F.when(x["title"] != "", x["title"]).otherwise(x["raw"])
            return F.struct(x["v"].alias("v"), title.alias("title"), x["key"].alias("key"), F.array_distinct(wanted).alias("wanted"), year.alias("year"))

        return F.transform(F.filter(of["said"], lambda x: x["key"] != ""), item)

    def items(of: Column) -> Column:
        kept, links = of["kept"], of["links"]
        taken = lambda n: F.flatten(F.transform(F.slice(kept, 1, n), lambda x: x["wanted"]))
        own = lambda x, n: F.transform(F.filter(x["wanted"], lambda i: ~F.array_contains(taken(n), i)), lambda i: F.get(links, i))
        one_of = lambda v, name, known: let(get(v, name, "string"), lambda k: F.when(k.isin(*known), k).otherwise(F.lit("unknown")))
        return F.transform(kept, lambda x, n: _item(
            x["title"], x["key"], original_title=said(x["v"], "original_title"), year=F.when(x["year"].between(1900, 2100), x["year"]), media_type=one_of(x["v"], "media_type", MEDIA_TYPES),
            episode_info=said(x["v"], "episode_info"), quality=one_of(x["v"], "quality", QUALITIES), links=own(x, n),
            tags=F.when(F.size(kept) == 1, T.extract_tags(F.col(text))).otherwise(F.array().cast(_NONE["tags"])),
        ))

    df = _with(df, "kept", F.when(mine, let(F.struct(_x("said").alias("said"), _x("links").alias("links")), read)))
    df = _with(df, "items", F.when(mine, let(F.struct(_x("kept").alias("kept"), _x("links").alias("links")), items)))
    made = F.struct(_x("items").alias("items"), _x("links").alias("links"), get(_x("answer"), "is_catalog", "boolean").alias("listed"))
    return _with(df, "payload", F.when(mine, let(made, lambda of: _outcome("payload", of["items"], of["links"], of["listed"]))))


MEDIA_TYPES = ("movie", "tv", "anime", "variety", "documentary", "book", "comic", "other", "unknown")
QUALITIES = ("4k", "1080p", "720p", "sd", "unknown")
SHEET_SOURCES = ("tencent_docs", "kdocs")


def extract(docs: DataFrame, text: str = "text", source_type: str | None = None, payload: str | None = None) -> DataFrame:
    """``docs`` with ``outcome``: the stored answer where ``payload`` has one, sheet rows for sheet sources, rules
    for all others. All are column expressions. Null text gives a null outcome."""
    kind = F.when(F.col(text).isNotNull(), F.lit("rule"))
    if source_type:
        kind = F.when(F.col(text).isNotNull() & F.col(source_type).isin(*SHEET_SOURCES), F.lit("sheet")).otherwise(kind)
    if payload:
        kind = F.when(F.col(text).isNotNull() & F.col(payload).isNotNull(), F.lit("payload")).otherwise(kind)
    df = rule_extract(_with(_with(docs, "kind", kind), "links", L.scan_links(F.col(text))), text)
    done = ["rule"]
    if source_type:
        df, done = sheet_extract(df, text), [*done, "sheet"]
    if payload:
        df, done = payload_extract(df, text, payload), [*done, "payload"]
    return df.select(*docs.columns, F.coalesce(*[_x(n) for n in done]).alias("outcome"))


def items(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row per item with its place in the document. The outer form keeps Spark from filtering documents by their
    number of items first, for which it would extract them once more."""
    each = extracted.select(*keys, F.posexplode_outer("outcome.items").alias("place", "item")).where("place is not null")
    return each.select(*keys, "place", "item.*")


# --- probes ---------------------------------------------------------------

# Codes and words of providers' answers.
ANSWERS = {
    "quark": {
        "password": ((41005,), ("提取码", "密码", "访问码")),
        "gone": ((41004, 41006, 41007, 41008, 41031), ("分享不存在", "文件不存在", "已失效", "已删除", "已取消", "违规", "过期")),
        "rate": ((40001, 41013, 429), ("频繁", "限制", "稍后")),
    },
    "alipan": {
        "gone": ("NotFound.ShareLink", "ShareLink.Cancelled", "ShareLink.Expired", "ForbiddenShareLinkViolation", "ShareLink.Forbidden", "ShareLink.ContentInvalid"),
        "rate": ("TooManyRequests", "Throttling"),
    },
}


def classify_probe(provider: Column, body: Column, http_code: Column) -> Column:
    """The state that a provider's answer tells; what is not understood is an error, never invalid."""
    get = lambda path: F.get_json_object(body, path)
    code, message = get("$.code"), F.coalesce(get("$.message"), F.lit(""))
    has = lambda x, words: x.rlike("|".join(words))
    one_of = lambda codes: F.coalesce(code.isin(*[str(c) for c in codes]), F.lit(False))
    q = ANSWERS["quark"]
    quark = (
        F.when(code == "0", "valid")
        .when(one_of(q["password"][0]) | has(message, q["password"][1]), "need_password")
        .when(one_of(q["gone"][0]) | has(message, q["gone"][1]), "invalid")
        .when(one_of(q["rate"][0]) | has(message, q["rate"][1]), "rate_limited")
        .otherwise("error")
    )
    a = ANSWERS["alipan"]
    blank = code.isNull() | code.isin("", "0", "false")
    alipan = (
        F.when(blank & F.coalesce(get("$.has_pwd") == "true", F.lit(False)), "need_password").when(blank, "valid")
        .when(code.isin(*a["gone"]), "invalid").when(code.isin(*a["rate"]), "rate_limited").otherwise("error")
    )
    inner = F.coalesce(F.nullif(get("$.file.message"), F.lit("")), message)
    filled = lambda path: F.coalesce(get(path) != "", F.lit(False))
    ctfile = (
        F.when((code == "200") & (filled("$.file.file_id") | filled("$.file.url")), "valid").when(code == "423", "need_password")
        .when(code.isin("404", "503") | ((code == "403") & inner.contains("不完整")), "invalid").when(code == "429", "rate_limited").otherwise("error")
    )
    pan123 = (
        F.when((code == "0") & get("$.data").startswith("{"), F.when(get("$.data.Expired") == "true", "invalid").otherwise("valid"))
        .when(code == "0", "error")
        .when(has(message, ("不存在", "已失效", "已取消", "过期")), "invalid").when(has(message, ("提取码", "密码")), "need_password").otherwise("error")
    )
    return (
        F.when(http_code == 429, "rate_limited")
        .when(~F.coalesce(F.trim(body).startswith("{"), F.lit(False)), "error")
        .when(provider.isin("quark", "uc"), quark).when(provider == "alipan", alipan)
        .when(provider == "ctfile", ctfile).when(provider == "pan123", pan123).otherwise("unsupported")
    )


def probe_details(provider: Column, body: Column, http_code: Column) -> Column:
    """struct<status, title, sharer, size_bytes>: the state of :func:`classify_probe` with what the answer
    tells of a share that is there."""
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths])
    status = classify_probe(provider, body, http_code)
    there = lambda x: F.when(status == "valid", x)
    title = (
        F.when(provider.isin("quark", "uc"), get("$.data.title")).when(provider == "alipan", get("$.share_name", "$.share_title"))
        .when(provider == "ctfile", get("$.file.file_name")).when(provider == "pan123", get("$.data.ShareName"))
    )
    sharer = (
        F.when(provider.isin("quark", "uc"), get("$.data.author.nick_name")).when(provider == "alipan", get("$.creator_name"))
        .when(provider == "ctfile", get("$.file.username")).when(provider == "pan123", get("$.data.UserNickName"))
    )
    size = F.when(provider == "ctfile", get("$.file.file_size"))
    number, unit = F.regexp_extract(size, r"(?i)^([0-9.]+)\s*([KMGT]?)", 1), F.upper(F.regexp_extract(size, r"(?i)^([0-9.]+)\s*([KMGT]?)", 2))
    times = F.pow(F.lit(1024.0), F.when(unit == "", F.lit(0)).otherwise(F.instr(F.lit("KMGT"), unit)))
    return F.struct(
        status.alias("status"), there(title).alias("title"), there(sharer).alias("sharer"),
        there(F.when(number != "", (number.cast("double") * times).cast("long"))).alias("size_bytes"),
    )
