"""Column functions of URLs, link contexts, and messages between nodes."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, functions as F

PARTITIONS = 256
MESSAGE = "url STRING, priority DOUBLE, metadata MAP<STRING, STRING>, forwarded_from STRING"


def url_partition(url: Column) -> Column:
    """MD5 of the URL modulo 256, which is its last byte."""
    return F.conv(F.substring(F.md5(url), 31, 2), 16, 10).cast("int")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port and user, as written; empty without one."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """Exact, case-sensitive match of the netloc; no domains allow all."""
    return netloc(url).isin(domains) if domains else F.lit(True)


def followable(href: Column) -> Column:
    """Links worth resolving: not empty, not a script, not a bare fragment."""
    h = F.trim(href)
    return h.isNotNull() & (h != "") & ~h.startswith("javascript:") & (h != "#")


def absolute(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def resolve_rooted(base: Column, href: Column) -> Column:
    """Resolve absolute, protocol-relative and root-relative links inside the JVM; null for others. Fragments go."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(base), h))
    )


def _resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        try:
            return None if h is None else urldefrag(urljoin(b or "", h.strip()))[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def _plain(base: Column, href: Column) -> Column:
    """Whether joining is a matter of putting strings together: an absolute or rooted link without dots, parameters, or an empty query."""
    h = F.trim(href)
    whole = r"^(https?://[^/?#;\s\[\]\x00-\x20\x7f]+|/(?!/))[^;\s\[\]\\\x00-\x20\x7f]*$"
    return base.rlike(r"^https?://[^/?#\s\[\]]+") & h.rlike(whole) & ~h.rlike(r"(^|/)\.{1,2}(/|\?|#|$)") & ~h.rlike(r"\?(#|$)") & ~h.rlike(r"^https?://[^/?#]*#")


def resolve(base: Column, href: Column) -> Column:
    """Resolve any link as RFC 3986 has it; null if it can't be. Fragments go. Plain links stay in the JVM, the others go to Python."""
    plain = F.coalesce(_plain(base, href), F.lit(False))
    return F.when(plain, resolve_rooted(base, href)).otherwise(F.pandas_udf(_resolve, "string")(base, F.when(~plain, href)))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def url_tokens(url: Column) -> Column:
    """Words of a URL's path and query, in lower case."""
    path = F.regexp_replace(url, "https?://[^/]+", "")
    return F.array_join(F.transform(F.filter(F.split(path, "[^a-zA-Z0-9]+"), lambda t: F.length(t) > 1), F.lower), " ")


def context_around(block: Column, anchor: Column, window: int = 200) -> Column:
    """Text around the first place of the anchor, from a word's beginning; the block's first characters if it isn't there."""
    at = F.instr(block, anchor)
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(block), at - 1 + F.length(anchor) + window)
    piece = F.substring(block, start, end - start + 1)
    space = F.instr(piece, " ")
    cut = F.when((start > 1) & (space > 0), F.substring(piece, space + 1, F.length(piece))).otherwise(piece)
    return F.when(at == 0, F.substring(block, 1, 2 * window)).otherwise(cut)


def surrounding(text: Column, anchor: Column, window: int = 200) -> Column:
    """The same without regard to words; the first ``window`` characters if the anchor isn't there."""
    at = F.instr(text, anchor)
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(text), at - 1 + F.length(anchor) + window)
    return F.when(at == 0, F.substring(text, 1, window)).otherwise(F.substring(text, start, end - start + 1))


def url_context(anchor: Column, around: Column, url: Column, window: int = 200) -> Column:
    """Anchor, surroundings and URL words in one string, empty parts left out."""
    parts = [F.trim(anchor), F.substring(F.trim(around), 1, 2 * window), url_tokens(url)]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def encode_message(url: Column, priority: Column, depth: Column, src: Column, sender: Column) -> Column:
    """A forwarded URL as JSON."""
    meta = F.struct(depth.cast("int").alias("depth"), src.alias("src"))
    return F.to_json(F.struct(url.alias("url"), priority.cast("double").alias("priority"), meta.alias("metadata"), sender.alias("forwarded_from")))


def message_chars(json: Column) -> Column:
    """Characters of the message as most JSON writers put it: a space after each separator, and what isn't ASCII as escapes of six characters, two of them beyond 16 bits."""
    fields = F.coalesce(F.size(F.json_object_keys(F.get_json_object(json, "$.metadata"))), F.lit(0))
    separators = 2 * F.coalesce(F.size(F.json_object_keys(json)), F.lit(0)) - 1 + F.greatest(2 * fields - 1, F.lit(0))
    return F.length(json) + separators + 5 * F.regexp_count(json, F.lit(r"[^\x00-\x7F]")) + 6 * F.regexp_count(json, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def decode_message(raw: Column) -> Column:
    """The message with defaults for what is missing; null if malformed or without URL."""
    m = F.from_json(raw, MESSAGE, {"mode": "PERMISSIVE"})
    whole = F.struct(
        m["url"].alias("url"),
        F.coalesce(m["priority"], F.lit(0.0)).alias("priority"),
        F.coalesce(m["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce(m["forwarded_from"], F.lit("unknown")).alias("forwarded_from"),
    )
    return F.when(m["url"].isNotNull(), whole)


def minute(ts: Column) -> Column:
    """Epoch second of the minute's beginning."""
    return (F.floor(F.unix_seconds(ts) / 60) * 60).cast("long")


def bucket(score: Column, bins: int = 20) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), (score * bins).cast("int")))


def mode_label(mode: Column) -> Column:
    labels = {"bfs": "BFS baseline", "link_priority": "Link-priority", "semantic": "Semantic (ours)"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), mode), mode)


def per_relevant(mb: Column, relevant: Column) -> Column:
    """Two decimals, or the sign of infinity where nothing is relevant."""
    return F.when(relevant > 0, F.format_string("%.2f", mb / relevant)).otherwise(F.lit("∞"))


def split_paths(s: str | None) -> list[str]:
    """A comma-separated option as a list."""
    return [p.strip() for p in (s or "").split(",") if p.strip()]
