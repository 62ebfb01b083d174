"""Interleaved document sequences: pages as ordered text and media references.

A page's HTML is parsed once into items in reading order. An item is a stretch of text or a reference
to an image, video, sound, embedded document, or, if asked for, a link. A reference has its
URL, resolved against the page's, and a digest: the SHA-256 of that URL, or of the bytes of a
``data:`` URL. Payloads are known by the digest of their URL and by that of their content, so both kinds of reference find
them by joining digests. Each item has its position, the
figure caption or alternative text belongs to the item itself, the caption of a figure without media is a text
item in its place, and what the join finds is put
back by page and position, so nothing comes out of line.

A digest may be referred to by very many pages: the payloads' side of the join has each digest once, and Spark splits
partitions that are skewed at run time.

Defined results: a null page has null items, an empty one none; malformed HTML is read as far as
it goes, unclosed tags close at the end; ``script``, ``style``, ``noscript``, ``template``, ``svg`` and
``head`` count nothing, and a head without its end tag ends at the first tag that can't be in one; references without URL are passed over; a URL that can't be resolved against the
page's stays as it is; a digest without payload has null size, type and content digest; of
several payloads of one digest the one with the smallest content digest counts; a payload without URL is known by its
content; repeated rows and rows that share an id each give a row, with the same references resolved; other columns, of
any names, pass through, and a column named items is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltweave.llm.text import column, free, place, with_arrow
from siltweave.session import written

_SKIPPED = {"script", "style", "noscript", "template", "svg", "head"}
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head", "html"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "section", "article", "nav", "footer", "header", "main", "aside", "blockquote", "pre", "figure", "dl", "dt", "dd", "hr"}
_MEDIA = {"img": ("image", "src"), "video": ("video", "src"), "audio": ("audio", "src"), "embed": ("embed", "src"), "iframe": ("embed", "src"), "object": ("embed", "data")}
_VOID = {"img", "embed", "br", "hr", "source", "input", "meta", "link"}
_SPACE = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("url", pa.string()), ("digest", pa.string())])
ITEM_SQL = "STRUCT<pos: INT, kind: STRING, text: STRING, url: STRING, digest: STRING>"


def data_bytes(url: str) -> bytes:
    """The bytes of a data: URL; bad base64 counts as its own characters."""
    head, _, body = url[5:].partition(",")
    raw = unquote_to_bytes(body)
    if head.rstrip().lower().endswith(";base64"):
        try:
            return base64.b64decode(raw, validate=False)
        except (binascii.Error, ValueError):
            return raw
    return raw


def digest_of(url: str) -> str:
    raw = data_bytes(url) if url[:5].lower() == "data:" else url.encode("utf-8", "surrogatepass")
    return hashlib.sha256(raw).hexdigest()


class _Parser(HTMLParser):
    def __init__(self, base: str, links: bool):
        super().__init__(convert_charrefs=True)
        self.base, self.links = base, links
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip: list[str] = []
        self.named = ""  # the open tag whose text belongs to the head
        self.figures: list[tuple[int, list[str], list[int]]] = []  # items before it, words of its captions, items before each of these
        self.caption = 0
        self.open: list[tuple[dict, list[str]]] = []  # links
        self.player: list[dict] = []

    def flush(self) -> None:
        text = _LINES.sub("\n", _SPACE.sub(" ", "".join(self.text))).strip(" \n")
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "url": None, "digest": None})

    def reference(self, kind: str, url: str | None, text: str | None) -> dict | None:
        url = (url or "").strip()
        if not url:
            return None
        if url[:5].lower() != "data:":
            try:
                url = urljoin(self.base, url)
            except ValueError:
                pass
        self.flush()
        item = {"kind": kind, "text": text or None, "url": url, "digest": digest_of(url)}
        self.items.append(item)
        return item

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip == ["head"] and tag not in _IN_HEAD:  # its end tag may be left out
            self.skip.pop()
        if tag in ("title", "noframes"):
            self.named = tag
        if tag in _SKIPPED and not (tag == "head" and "head" in self.skip):
            self.skip.append(tag)
        if self.skip:
            return
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "figure":
            self.figures.append((len(self.items) + bool("".join(self.text).strip()), [], []))
        elif tag == "figcaption":
            self.caption += 1
            if self.figures:
                self.flush()
                self.figures[-1][2].append(len(self.items))
        elif tag in _MEDIA:
            a = dict(attrs)
            kind, key = _MEDIA[tag]
            url = a.get(key) or (a.get("srcset") or a.get("data-src") or "").split(",")[0].strip().split(" ")[0]
            item = self.reference(kind, url, a.get("alt") or a.get("title"))
            if tag in ("video", "audio"):
                self.player.append(item or {"kind": kind, "text": a.get("title")})
        elif tag == "source" and self.player and "url" not in self.player[-1]:
            last = self.player[-1]
            item = self.reference(last["kind"], dict(attrs).get("src"), last["text"])
            if item:
                self.player[-1] = item
        elif tag == "a" and self.links:
            item = self.reference("link", dict(attrs).get("href"), None)
            if item:
                self.open.append((item, []))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            if tag == "svg" and self.skip == ["head"]:
                self.skip.pop()
            return
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.named:
            self.named = ""
        if self.skip:
            if self.skip == ["head"] and tag in ("body", "html"):
                self.skip.pop()
            elif tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "figcaption":
            self.caption = max(0, self.caption - 1)
        elif tag == "figure" and self.figures:
            self.close_figure()
        elif tag in ("video", "audio") and self.player:
            self.player.pop()
        elif tag == "a" and self.open:
            self.close_link()

    def close_figure(self) -> None:
        first, words, at = self.figures.pop()
        text = _SPACE.sub(" ", " ".join(words)).strip()
        media = [x for x in self.items[first:] if x["kind"] not in ("text", "link")]
        for item in media if text else ():
            item["text"] = text
        if text and not media:
            self.items.insert(at[0] if at else len(self.items), {"kind": "text", "text": text, "url": None, "digest": None})

    def close_link(self) -> None:
        item, words = self.open.pop()
        item["text"] = " ".join("".join(words).split()) or None

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and not self.named and data.strip():
            self.skip.pop()
        if self.skip:
            return
        if self.caption and self.figures:
            self.figures[-1][1].append(data.replace("\n", " "))
        elif self.open:
            self.open[-1][1].append(data)
        else:
            self.text.append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self.close_link()
        while self.figures:
            self.close_figure()
        self.flush()
        for i, x in enumerate(self.items):
            x["pos"] = i
        return self.items


def parse(html: str, base: str = "", links: bool = False) -> list[dict]:
    """The items of a page in reading order."""
    p = _Parser(base or "", links)
    p.feed(html.replace("\x00", ""))
    return p.finish()


def payload_index(payloads: DataFrame, url_col: str = "url", content_col: str = "content", type_col: str | None = None) -> DataFrame:
    """(digest, content_digest, bytes, media_type), digests in binary: a row for each payload's URL and for each content, by its digest."""
    raw = column(content_col).cast("binary")
    kind = column(type_col) if type_col else F.lit(None).cast("string")
    p = payloads.filter(raw.isNotNull())
    url = column(url_col)
    p = p.select(F.unhex(F.sha2(url.cast("binary"), 256)).alias("by_url"), F.unhex(F.sha2(raw, 256)).alias("content_digest"), F.octet_length(raw).cast("long").alias("bytes"), kind.alias("media_type"))
    p = p.select(F.explode(F.array_compact(F.array("by_url", "content_digest"))).alias("digest"), "content_digest", "bytes", "media_type")
    return p.groupBy("digest").agg(F.min(F.struct("content_digest", "bytes", "media_type")).alias("p")).select("digest", "p.*")


def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html", links: bool = False) -> DataFrame:
    """The pages with items in place of their HTML; a page is parsed once."""
    hi, ui = (place(pages, c, ["items"]) for c in (html_col, url_col))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        items = [None if h is None else parse(h, u, links) for h, u in zip(b.column(hi).to_pylist(), b.column(ui).to_pylist())]
        return [*(c for i, c in enumerate(b.columns) if names[i] in kept), pa.array(items, pa.list_(ITEM))]

    names = [c for c in pages.columns if c.lower() != "items" or c in (html_col, url_col)]
    kept = [c for c in names if c != html_col and c.lower() != "items"]
    return with_arrow(pages, make, [("items", f"ARRAY<{ITEM_SQL}>")], (html_col, url_col), keep=kept)


def interleave(pages: DataFrame, payloads: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", links: bool = False) -> DataFrame:
    """The pages without their HTML, with items: (pos, kind, text, url, digest, content_digest, bytes, media_type) in order.

    ``payloads`` comes from ``payload_index``. The pages are parsed once, and their items written. What the digests find is gathered by page; pages
    are shuffled to meet it only if they have references and if it is too large to broadcast: its size is known, as it is a table.
    """
    key = free(pages, "key")
    d = parsed(pages.withColumn(key, F.xxhash64(column(id_col), column(url_col), column(html_col))), url_col, html_col, links)
    kept = [c for c in d.columns if c not in (key, "items")]
    d = written(d, "items", codec="zstd")
    refs = d.select(column(key).alias("key"), F.explode("items").alias("x")).select("key", "x.pos", F.unhex("x.digest").alias("digest")).filter("digest IS NOT NULL").distinct()
    hit = refs.join(payloads, "digest")
    entry = F.struct("pos", F.struct(F.lower(F.hex("content_digest")).alias("content_digest"), "bytes", "media_type"))
    found = written(hit.groupBy("key").agg(F.map_from_entries(F.collect_list(entry)).alias("found")), "found")
    has = free(d, "found")
    found = found.select(F.col("key").alias(f"{has}_key"), F.col("found").alias(has))
    lone = F.coalesce(F.forall("items", lambda x: x["digest"].isNull()), F.lit(True))
    get = lambda x, c: F.try_element_at(F.col(has), x["pos"])[c]
    whole = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "kind", "text", "url", "digest")], *[get(x, c).alias(c) for c in ("content_digest", "bytes", "media_type")]))
    cols = [*(column(c) for c in kept), whole.alias("items")]
    met = d.filter(~lone).join(found, column(key) == column(f"{has}_key"), "left").select(*cols)
    nothing = F.lit(None).cast(found.schema[has].dataType)
    return met.unionByName(d.filter(lone).withColumn(has, nothing).select(*cols))
