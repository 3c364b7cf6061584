"""Payload parsers: stored pages, feeds, sheets and files to messages."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import zlib
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcatalog.functions import links as L
from linkcatalog.functions import titles
from linkcatalog.functions.text import let, strip

MESSAGE = "array<struct<message_id:string,text:string,published_at:string,url:string>>"


def _message(key, text: str, at: str | None = None, url: str | None = None) -> dict:
    return {"message_id": str(key), "text": text.strip(), "published_at": at, "url": url}


class _Channel(HTMLParser):
    """Messages of a channel page: a stack of open tags tells where text belongs."""

    VOID = frozenset(("br", "img", "input", "meta", "link", "hr", "source", "wbr"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[tuple[str, str]] = []

    def _within(self, role: str) -> bool:
        return any(r == role for _, r in self.open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names, role = a.get("class", "").split(), ""
        if tag == "div" and "tgme_widget_message" in names and "data-post" in a:
            role = "message"
            self.out.append(_message(a["data-post"].rpartition("/")[2], "", None, "https://t.me/" + a["data-post"]))
        elif "tgme_widget_message_reply" in names:
            role = "reply"
        elif "tgme_widget_message_text" in names:
            role = "text"
        if self.out and tag == "time" and a.get("datetime"):
            self.out[-1]["published_at"] = a["datetime"]
        if self._writes():
            if tag == "br":
                self.out[-1]["text"] += "\n"
            elif tag == "a" and re.match(r"https?://|magnet:", a.get("href", "")) and not re.match(r"https?://t\.me/", a["href"]):
                self.out[-1]["text"] += a["href"]
                role = "label"
        if tag not in self.VOID:
            self.open.append((tag, role))

    def _writes(self) -> bool:
        return bool(self.out) and self._within("text") and not self._within("reply") and not self._within("label")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self._writes():
            self.out[-1]["text"] += data


def channel_messages(page: str) -> list[dict]:
    """By numeric id."""
    p = _Channel()
    p.feed(page)
    out = [m | {"text": m["text"].strip()} for m in p.out if m["message_id"].isdigit()]
    return sorted(out, key=lambda m: int(m["message_id"]))


def plan_pages(cursor: int, most: int, step: int = 20) -> tuple[list[int], int, bool]:
    """Page ids backwards from a cursor, the next cursor, and whether history is done."""
    pages = list(range(cursor, 1, -step))[:most]
    left = max(1, cursor - step * len(pages))
    return pages, left, left <= 1


class _Text(HTMLParser):
    BLOCK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "article", "section"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title, self.hidden, self.in_title = "", 0, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.hidden += tag in ("script", "style")
        self.in_title |= tag == "title"
        if tag in self.BLOCK:
            self.parts.append("\n")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if m := re.search(r"https?://[^\s'\"]+|magnet:[^\s'\"]+", a.get("onclick") or ""):
            self.links.append(m[0])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


def page(body: str, base: str = "") -> dict:
    """Title, visible text and resolved links of a page."""
    p = _Text()
    p.feed(body)
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    found = dict.fromkeys(u for u in (resolve(base, x) for x in p.links) if u)
    return {"title": " ".join(p.title.split()), "text": "\n".join(x for x in lines if x), "links": list(found)}


PAGE = "struct<title:string,text:string,links:array<string>>"


def resolve(base: str, href: str) -> str | None:
    try:
        url = urljoin(base, html.unescape(href.strip()))
        return url if urlsplit(url).scheme in ("http", "https", "magnet", "ed2k") else None
    except ValueError:
        return None


def canonical_url(url: str) -> str:
    url = url.partition("#")[0]
    return url if len(url) <= 128 else "sha256:" + hashlib.sha256(url.encode()).hexdigest()


def _name(node) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def feed_messages(body: str) -> list[dict]:
    """RSS or Atom items, whatever their name spaces; info hashes become magnets; by time."""
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", body))
    except ElementTree.ParseError:
        return []
    out = []
    for item in (n for n in root.iter() if _name(n) in ("item", "entry")):
        value: dict[str, str] = {}
        links: list[str] = []
        for n in item.iter():
            text = (n.text or "").strip()
            if _name(n) in ("link", "enclosure") and (n.get("href") or n.get("url") or text):
                links.append(n.get("href") or n.get("url") or text)
            elif _name(n) == "infohash" and re.fullmatch(r"[0-9A-Za-z]{20,64}", text):
                links.append(f"magnet:?xt=urn:btih:{text}")
            elif _name(n) == "magneturi" and text:
                links.append(text)
            elif text:
                value.setdefault(_name(n), text)
        body_html = next((value[k] for k in ("encoded", "content", "description", "summary") if k in value), "")
        text = "\n".join(x for x in (value.get("title", ""), page(body_html)["text"], *dict.fromkeys(links)) if x)
        key = next((x for x in (value.get("guid"), value.get("id"), *links, text) if x), "")
        key = key if len(key) <= 128 else "sha256:" + hashlib.sha256(key.encode()).hexdigest()
        out.append(_message(key, text, _time(next((value[k] for k in ("pubdate", "published", "updated") if k in value), None)), links[0] if links else None))
    return sorted(out, key=lambda m: m["published_at"] or "")


def _time(raw: str | None) -> str | None:
    if not raw:
        return None
    try:
        return parsedate_to_datetime(raw).isoformat()
    except ValueError:
        return raw


def decode_sheet(packed: str) -> object:
    """base64url of zlib of JSON."""
    try:
        return json.loads(zlib.decompress(base64.urlsafe_b64decode(packed + "=" * (-len(packed) % 4))))
    except (ValueError, zlib.error):
        return None


# Keys of a sheet's cells: the address of a link, and what describes the cell.
CELL_LINK, CELL_META = "k3", ("k30", "k31", "k32")
#: The same of the records of a database.
RECORD_LINKS, RECORD_META = ("href", "url", "link"), ("type", "id", "style", "color", "format")


def _leaves(cell: object, links: tuple[str, ...], skip: tuple[str, ...]) -> str:
    if isinstance(cell, bool) or cell is None:
        return ""
    if isinstance(cell, (str, int, float)):
        return str(cell).strip()
    if isinstance(cell, dict):
        for k in links:
            if isinstance(cell.get(k), str) and re.match(r"(?i)https?://|magnet:", cell[k]):
                return cell[k].strip()
        cell = [v for k, v in cell.items() if k not in skip]
    return " ".join(x for x in (_leaves(c, links, skip) for c in cell) if x)


def cell_text(cell: object) -> str:
    """Strings and numbers of a sheet's cell, depth first; a link gives its address alone, not its label."""
    return _leaves(cell, (CELL_LINK,), CELL_META)


def record_text(cell: object) -> str:
    """The same of a database's cell."""
    return _leaves(cell, RECORD_LINKS, RECORD_META)


def render_row(row: dict[str, object], labels: dict[str, str] | None = None, read=cell_text) -> str:
    """``label：value`` lines of the cells with text; attachments are left out."""
    pairs = ((labels.get(k, k) if labels else k, read(v)) for k, v in row.items() if not (isinstance(v, dict) and v.get("type") == "attachment"))
    return "\n".join(f"{k}：{v}" for k, v in pairs if v)


def _find(tree: object, key: str) -> object:
    """The first value of a key, depth first."""
    left = [tree]
    while left:
        node = left.pop(0)
        if isinstance(node, dict):
            if key in node:
                return node[key]
            left = [*node.values(), *left]
        elif isinstance(node, list):
            left = [*node, *left]
    return None


def sheet_page(payload: str) -> dict | None:
    """A sheet's page: its sheets' ids, version, rows in all, and the rows that it holds as text.

    The operations are packed (:func:`decode_sheet`); that of the columns gives labels by id, those
    of the rows cells by column; the permission blob lists the sheets.
    """
    try:
        data = json.loads(payload)
        ops = decode_sheet(_find(data, "smartsheet"))
        page = json.loads(json.loads(_find(data, "smartsheetConfig"))["pageCtx"])
        allowed = json.loads(base64.b64decode(_find(data, "smartsheetPermission") or "W10="))
    except (ValueError, KeyError, TypeError):
        return None
    labels: dict[str, str] = {}
    rows: dict[str, dict] = {}
    left = [ops]
    while left:
        node = left.pop(0)
        if isinstance(node, list):
            left = [*node, *left]
        elif isinstance(node, dict):
            for v in node.values():
                if isinstance(v, dict) and v and all(isinstance(x, dict) and isinstance(x.get("k30"), str) and set(x) <= set(CELL_META) for x in v.values()):
                    labels |= {k: x["k30"] for k, x in v.items()}
            inner = node.get("k2")
            if isinstance(inner, dict) and isinstance(inner.get("k1"), dict):
                rows |= {k: v["k1"] for k, v in inner["k1"].items() if isinstance(v, dict) and isinstance(v.get("k1"), dict)}
            left = [*node.values(), *left]
    texts = [(k, render_row(r, labels)) for k, r in rows.items()]
    sheets = [i["sheet_id"] for p in allowed for i in p.get("priv", {}).get("items", [])]
    return {
        "sheet_ids": sheets, "sheet_id": page.get("sheet_id"), "version": page.get("ver"), "total_rows": page.get("total_row"),
        "rows": [{"row_id": k, "text": t} for k, t in texts if t],
    }


SHEET_PAGE = "struct<sheet_ids:array<string>,sheet_id:string,version:bigint,total_rows:bigint,rows:array<struct<row_id:string,text:string>>>"


def database_page(payload: str) -> list[dict]:
    """Records of a database's page as (row_id, text)."""
    try:
        rows = json.loads(payload)["records"]
        texts = [(str(r["id"]), render_row(r.get("fields") or {}, read=record_text)) for r in rows]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    return [{"row_id": k, "text": t} for k, t in texts if t]


def reader_json(body: str) -> dict | None:
    """The JSON object of a reader's answer, behind its prefix, if it has an object under ``data``."""
    try:
        data = json.loads(body.split("Markdown Content:", 1)[-1])
    except ValueError:
        return None
    return data if isinstance(data, dict) and isinstance(data.get("data"), (dict, list)) else None


def discussion_ids(body: str) -> list[int]:
    """Ids of the discussions that an index page lists, each once, in its order."""
    data = (reader_json(body) or {}).get("data")
    ids = [int(x["id"]) for x in data if isinstance(x, dict) and str(x.get("id", "")).isdigit()] if isinstance(data, list) else []
    return list(dict.fromkeys(ids))


def discussion(body: str) -> dict | None:
    """One discussion as (message_id, text): its title and its first post."""
    whole = reader_json(body)
    data = whole and whole["data"]
    if not isinstance(data, dict) or "id" not in data:
        return None
    about = data.get("attributes") or {}
    posts = [x for x in whole.get("included") or [] if isinstance(x, dict) and x.get("type") == "posts"]
    first = min(posts, key=lambda x: (x.get("attributes") or {}).get("number") or 0, default={})
    text = "\n".join(x for x in (about.get("title"), page((first.get("attributes") or {}).get("contentHtml") or "")["text"]) if x)
    return _message(data["id"], text, about.get("createdAt"))


def comments(body: str) -> list[dict]:
    """Comments of a page, with the comments under them, as messages."""
    try:
        found = json.loads(body)["data"]
    except (ValueError, KeyError, TypeError):
        return []
    out, left = [], list(found) if isinstance(found, list) else []
    while left:
        c = left.pop(0)
        if not isinstance(c, dict):
            continue
        if c.get("id") is not None and c.get("content"):
            out.append(_message(c["id"], str(c["content"]), c.get("date")))
        left = [*(c.get("children") or []), *left]
    return out


def text_blocks(text: str, most: int = 4000) -> list[str]:
    """Paragraphs, long ones cut at line ends."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        held = ""
        for line in block.strip().split("\n"):
            while len(line) > most:
                out += [held] * bool(held) + [line[:most]]
                held, line = "", line[most:]
            if held and len(held) + 1 + len(line) > most:
                out.append(held)
                held = ""
            held = f"{held}\n{line}" if held else line
        if held.strip():
            out.append(held)
    return out


def snapshot_text(raw: str) -> str | None:
    """A stored show with its files as text; null without any link."""
    try:
        data = json.loads(raw)["data"]
        info, found = data["info"], []
        lines = ["名称：" + " ".join(str(info[k]) for k in ("cnname", "enname") if info.get(k))]
        if info.get("year"):
            lines.append("年份：" + ",".join(map(str, info["year"] if isinstance(info["year"], list) else [info["year"]])))
        for season in data.get("list") or []:
            for kind, entries in (season.get("items") or {}).items():
                for e in entries:
                    for f in e.get("files") or []:
                        if f.get("address"):
                            code = f" 提取码：{f['passwd']}" if f.get("passwd") else ""
                            found.append(" ".join(str(x) for x in (season.get("season_cn"), kind, e.get("episode"), e.get("name"), e.get("size"), f.get("way_cn"), f["address"]) if x) + code)
        return "\n".join(lines + found) if found else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _bencode_end(b: bytes, at: int) -> int:
    """The place after the value at ``at``."""
    if b[at : at + 1] == b"i":
        return b.index(b"e", at) + 1
    if b[at : at + 1] in (b"l", b"d"):
        at += 1
        while b[at : at + 1] != b"e":
            at = _bencode_end(b, at)
        return at + 1
    colon = b.index(b":", at)
    return colon + 1 + int(b[at:colon])


def torrent_magnet(body: bytes) -> str | None:
    """The magnet of a torrent file of 5 MiB at most: SHA-1 of its info dictionary."""
    if len(body) > 5 << 20 or body[:1] != b"d":
        return None
    try:
        at = 1
        while body[at : at + 1] != b"e":
            start = _bencode_end(body, at)
            end = _bencode_end(body, start)
            if body[at:start] == b"4:info":
                return "magnet:?xt=urn:btih:" + hashlib.sha1(body[start:end]).hexdigest()
            at = end
    except (ValueError, RecursionError):
        return None
    return None


def collection_text(text: Column) -> Column:
    """A post of several titles as named blocks: each title with the links up to the next, or, if
    fewer than two have links of their own, all links in a shared block; null for fewer than two."""
    key = lambda x: F.struct(x["provider"].alias("p"), x["share_id"].alias("s"))
    once = lambda found: F.filter(found, lambda x, i: F.array_position(F.transform(found, key), key(x)) == i + 1)
    urls = lambda found: F.transform(let(found, once), lambda x: x["url"])

    def of_rows(rows: Column, links: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            own = F.slice(links, r["met"] + 1, F.coalesce(F.get(rows, i + 1)["met"], F.size(links)) - r["met"])
            titled = [F.when(r["line"].rlike(form), titles.strip_title_marker(strip(F.regexp_extract(r["line"], form, 1)))) for form in (L.NUMBERED, L.HEADING)]
            return let(own, lambda own: F.struct(i.alias("i"), F.when(F.size(own) == 0, F.coalesce(*titled)).alias("title"), urls(own).alias("urls")))

        def of_lines(lines: Column) -> Column:
            opens = F.filter(lines, lambda x: x["title"].isNotNull())
            block = lambda opens: F.transform(opens, lambda o, k: F.struct(
                F.concat(F.lit("名称："), o["title"]).alias("named"),
                F.flatten(F.transform(F.slice(lines, o["i"] + 1, F.coalesce(F.get(opens, k + 1)["i"], F.size(lines)) - o["i"]), lambda x: x["urls"])).alias("urls"),
            ))

            def of_blocks(blocks: Column) -> Column:
                each = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(b["named"]), b["urls"])))
                shared = F.concat(F.transform(blocks, lambda b: b["named"]), F.array(F.lit("合集资源：")), urls(links))
                linked = F.size(F.filter(blocks, lambda b: F.size(b["urls"]) > 0)) >= 2
                return F.when(F.size(blocks) >= 2, F.array_join(F.when(linked, each).otherwise(shared), "\n"))

            return let(let(opens, block), of_blocks)

        return let(F.transform(rows, row), of_lines)

    return let(L.scan_links(text, once=False), lambda links: let(L.line_rows(text, links), lambda rows: of_rows(rows, links)))


#: Source types with the forms of their addresses, in the order in which they are asked.
ROUTES = (
    ("tencent_docs", r"https?://docs\.qq\.com/(?:sheet|smartsheet)/([A-Za-z0-9]+)"),
    ("kdocs", r"https?://(?:www\.)?kdocs\.cn/l/([A-Za-z0-9]+)"),
    ("tencent_text", r"https?://docs\.qq\.com/doc/([A-Za-z0-9]+)"),
    ("forum", r"https?://[^/]+/(?:d|t|thread)/(\d+)"),
    ("yyets", r"(?:https?://yyets\.|yyets:)(\S+)"),
    ("rss", r"(https?://\S*(?:rss|feed|atom)\S*|https?://\S+\.xml)"),
    ("telegram", r"(?:https?://t\.me/(?:s/)?|@)([A-Za-z0-9_]{4,})"),
    ("web", r"(https?://\S+)"),
)


def detect_source(url: Column) -> tuple[Column, Column]:
    """(source_type, identifier): the first route whose form matches."""
    kind = ident = None
    for name, form in ROUTES:
        hit = url.rlike(f"(?i)^{form}")
        value = F.regexp_extract(url, f"(?i)^{form}", 1)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        ident = F.when(hit, value) if ident is None else ident.when(hit, value)
    return kind, ident


BY_NAME = {
    "channel_messages": (channel_messages, MESSAGE),
    "feed_messages": (feed_messages, MESSAGE),
    "page": (page, PAGE),
    "text_blocks": (text_blocks, "array<string>"),
    "snapshot_text": (snapshot_text, "string"),
    "torrent_magnet": (torrent_magnet, "string"),
    "sheet_page": (sheet_page, SHEET_PAGE),
    "database_page": (database_page, "array<struct<row_id:string,text:string>>"),
    "discussion_ids": (discussion_ids, "array<bigint>"),
    "discussion": (discussion, MESSAGE.removeprefix("array<").removesuffix(">")),
    "comments": (comments, MESSAGE),
    "canonical_url": (canonical_url, "string"),
}


def call(name: str, column: Column) -> Column:
    """A parser over a payload column, in Arrow batches; null gives null."""
    f, kind = BY_NAME[name]
    return F.udf(lambda x: None if x is None else f(x), kind, useArrow=True)(column)


def page_column(body: Column, base: Column) -> Column:
    """PAGE of a page with its links resolved against its address."""
    return F.udf(lambda x, u: None if x is None else page(x, u or ""), PAGE, useArrow=True)(body, base)
