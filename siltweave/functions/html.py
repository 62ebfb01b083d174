"""HTML pages: titles, visible text, and links with their anchor and context."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, functions as F

from siltweave.functions.urls import squeeze

BLOCKS = frozenset("p div li td th article section blockquote dd dt figcaption h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset("script style noscript head svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PAGE = "title STRING, text STRING, links ARRAY<STRUCT<url: STRING, anchor_text: STRING, context: STRING>>"


def hrefs(html: Column) -> Column:
    """All link targets by pattern, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)


def title(html: Column) -> Column:
    """The first title by pattern, entities left as they are."""
    return F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1))


def visible_text(html: Column) -> Column:
    """The text by pattern: hidden elements, comments and tags go, entities stay."""
    t = F.regexp_replace(html, r"(?s)<(script|style|noscript|head|svg|iframe)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return squeeze(F.regexp_replace(t, r"<[^>]*>", " "))


class _Node:
    __slots__ = ("tag", "parent", "parts")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.parts = tag, parent, []


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = _Node("[document]", None)
        self.root, self.hidden, self.titles, self.in_title = self.node, 0, [], False
        self.links: list[tuple[str, _Node, _Node]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = not self.titles
            self.titles.append("") if self.in_title else None
        if tag in VOID:
            return
        parent = self.node
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and parent.tag == tag:
            parent = self.node = parent.parent  # these close their like
        self.node = _Node(tag, parent)
        if tag in HIDDEN:
            self.hidden += 1
        href = dict(attrs).get("href") if tag == "a" else None
        if href is not None and not self.hidden:
            self.links.append((href, self.node, parent))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        n = self.node
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is None:
            return
        while self.node is not n.parent:
            self.hidden -= self.node.tag in HIDDEN
            self.node = self.node.parent

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles[-1] += data
        if self.hidden:
            return
        n = self.node
        while n is not None:
            n.parts.append(data)
            n = n.parent


def _text(node: _Node) -> str:
    return " ".join(x for x in (p.strip() for p in node.parts) if x)


def _context(link: _Node, parent: _Node, window: int) -> str:
    block = parent
    while block.tag not in BLOCKS and block.tag not in ("body", "[document]") and block.parent is not None:
        block = block.parent
    text, anchor = _text(block), _text(link)
    at = text.find(anchor)
    if at < 0:
        return text[: 2 * window]
    start = max(0, at - window)
    piece = text[start : at + len(anchor) + window]
    return piece[piece.index(" ") + 1 :] if start and " " in piece else piece


def parse_page(html: str | None, base: str | None, window: int = 200) -> dict:
    """Title, text and links of one page, links once each with their fragment cut off."""
    p = _Page()
    p.feed(html or "")
    p.close()
    seen, links = set(), []
    for href, node, parent in p.links:
        href = href.strip()
        if not href or href.startswith("javascript:") or href == "#":
            continue
        try:
            url = urldefrag(urljoin(base or "", href))[0]
            u = urlparse(url)
        except ValueError:
            continue
        if u.scheme not in ("http", "https") or not u.netloc or url in seen:
            continue
        seen.add(url)
        links.append({"url": url, "anchor_text": " ".join(_text(node).split()), "context": _context(node, parent, window)})
    return {"title": p.titles[0].strip() if p.titles else "", "text": " ".join("".join(f"{x} " for x in p.root.parts).split()), "links": links}


def _parsed(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h, b) for h, b in zip(html, base)], columns=["title", "text", "links"])


def parsed(html: Column, base: Column) -> Column:
    """The page as a struct (title, text, links)."""
    return F.pandas_udf(_parsed, PAGE)(html, base)
