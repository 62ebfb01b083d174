"""Crawl frontiers as orders of rows, and membership in what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ORDERS = {
    "bfs": [("seq", True)],
    "priority": [("priority", True), ("seq", True)],
    "semantic": [("score", False), ("seq", True)],
}


def inbound(links: DataFrame) -> DataFrame:
    """(url, inbound) of every link target."""
    return links.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("inbound"))


def first_sightings(urls: DataFrame, url: str = "url", order: str = "seq") -> DataFrame:
    """Each URL once, as it was pushed first."""
    rest = [c for c in urls.columns if c != url]
    d = urls.groupBy(url).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return d.select(*[F.col(f"_r.{c}").alias(c) if c != url else F.col(url) for c in urls.columns])


def unseen(urls: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return urls.join(seen.select(url), url, "left_anti")


def already_seen(urls: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return urls.join(seen.select(url), url, "left_semi")


def ordered(frontier: DataFrame, kind: str | list[Column]) -> DataFrame:
    """The whole frontier in the order of a strategy, by name or as a caller's own sort columns."""
    if not isinstance(kind, str):
        return frontier.orderBy(*kind)
    if kind not in ORDERS:
        raise ValueError(f"there is no frontier {kind!r}; there are {sorted(ORDERS)}")
    return frontier.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in ORDERS[kind]])


def by_inbound(pushes: DataFrame, as_implemented: bool = False) -> DataFrame:
    """(url, inbound, seq), most linked first, then by the last push. Where repeated sightings are dropped before they count, ``as_implemented``, the order is that of first pushes."""
    if as_implemented:
        return pushes.groupBy("url").agg(F.lit(1).cast("long").alias("inbound"), F.min("seq").alias("seq")).orderBy("seq")
    return pushes.groupBy("url").agg(F.count("*").alias("inbound"), F.max("seq").alias("seq")).orderBy(F.desc("inbound"), "seq")


def mock(pushes: DataFrame, mode: str = "semantic") -> DataFrame:
    """Keep the first priority of each URL; highest first, or in order of pushes."""
    if mode not in ("semantic", "bfs"):
        raise ValueError("mode is 'semantic' or 'bfs'")
    d = first_sightings(pushes)
    return d.orderBy(F.desc("priority"), "seq") if mode == "semantic" else d.orderBy("seq")


def top_k(pushes: DataFrame, k: int = 5, mode: str = "semantic") -> DataFrame:
    if mode == "bfs":
        raise ValueError("a breadth-first frontier has no scores")
    return mock(pushes, mode).limit(k)


def budgeted(df: DataFrame, max_pages: int, nodes: int = 1, key: str = "node_id", order: str = "seq") -> DataFrame:
    """The first floor(max_pages / nodes) rows of each node."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max_pages // max(nodes, 1)).drop("_k")
