"""Crawls as rounds over a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siltweave.operators.ordered import running
from siltweave.session import written
from siltweave.sources.crawl_log import fetched


def derived_edges(pages: DataFrame, fan: int = 4, skew: int = 0) -> DataFrame:
    """(src, dst): each page links to ``fan`` others by number, and to one of the first ``skew`` pages."""
    n = pages.agg(F.count("*").alias("n"))
    d = pages.select(F.col("page_id").alias("src")).crossJoin(F.broadcast(n))
    e = d.select("src", F.explode(F.sequence(F.lit(1), F.lit(fan))).alias("k"), "n").select("src", (F.col("src") * 7 + F.col("k") * 13) % F.col("n"))
    e = e.toDF("src", "dst")
    return e.unionByName(d.select("src", (F.col("src") % skew).alias("dst"))) if skew else e


def crawl_bfs(edges: DataFrame, seeds: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(page, depth): breadth first from seeds (page), a round for each depth, up to a budget of pages by depth and id.

    Each round joins the frontier with the links and takes away what was visited. It is written to the
    shared folder, which cuts the lineage and survives the loss of executors.
    """
    visited = written(seeds.select("page", F.lit(0).alias("depth")).distinct(), "crawl-0")
    frontier, depth, count = visited, 0, visited.count()
    while max_pages is None or count < max_pages:
        depth += 1
        found = edges.join(frontier.select(F.col("page").alias("src")), "src", "left_semi").select(F.col("dst").alias("page")).distinct()
        frontier = written(found.join(visited, "page", "left_anti").select("page", F.lit(depth).alias("depth")), f"crawl-{depth}")
        n = frontier.count()
        if not n:
            break
        visited, count = visited.unionByName(frontier), count + n
    return visited if max_pages is None else visited.orderBy("depth", "page").limit(max_pages)


def crawl_best_first(edges: DataFrame, seeds: DataFrame, priority: Callable[[DataFrame, DataFrame], DataFrame], width: int, max_pages: int | None = None) -> DataFrame:
    """(page, round, priority): each round pops the ``width`` best pages of the frontier and pushes what they link to.

    ``priority(frontier, edges_seen)`` gives (page, priority), largest first; ties by page.
    """
    done = written(seeds.select("page", F.lit(0).alias("round"), F.lit(0.0).alias("priority")).distinct(), "popped")
    seen_edges = written(edges.join(done.select(F.col("page").alias("src")), "src", "left_semi"), "seen-edges")
    count, step = done.count(), 0
    while max_pages is None or count < max_pages:
        step += 1
        frontier = seen_edges.select(F.col("dst").alias("page")).distinct().join(done, "page", "left_anti")
        left = width if max_pages is None else min(width, max_pages - count)
        best = priority(frontier, seen_edges).orderBy(F.desc("priority"), "page").limit(left)
        best = written(best.select("page", F.lit(step).alias("round"), F.col("priority").cast("double").alias("priority")), "popped")
        n = best.count()
        if not n:
            break
        count += n
        new = written(edges.join(best.select(F.col("page").alias("src")), "src", "left_semi"), "seen-edges")
        done, seen_edges = done.unionByName(best), seen_edges.unionByName(new)
    return done


def inbound_priority(frontier: DataFrame, seen_edges: DataFrame) -> DataFrame:
    """The links seen so far that lead to each page."""
    n = seen_edges.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("priority"))
    return frontier.join(n, "page")


def score_priority(scores: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A priority looked up in (page, score)."""
    return lambda frontier, _: frontier.join(scores.select("page", F.col("score").alias("priority")), "page")


def process(results: DataFrame, links: DataFrame, seen: DataFrame, relevant: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch of fetch results: log rows, failures too, with running counters, and the new URLs to enqueue."""
    ok = fetched(F.col("status_code"), F.col("html"))
    hit = ok & (relevant if relevant is not None else F.lit(True))
    log = results.withColumns({"is_relevant": F.coalesce(hit, F.lit(False)), "status_code": F.coalesce("status_code", F.lit(0)), "error": F.coalesce("error", F.lit(""))})
    names = [c for c in log.columns if c != "html"]
    log = running(log.select(*names), "node_id", ["seq"], {"cumulative_relevant": F.col("is_relevant").cast("long")})
    log = log.select(*names, (F.col("position") + 1).alias("cumulative_pages"), "cumulative_relevant")
    good = results.filter(ok).select(F.col("url").alias("src"))
    new = links.join(good, "src", "left_semi").groupBy(F.col("dst").alias("url")).agg(F.min("seq").alias("seq"))
    return log, new.join(seen.select("url"), "url", "left_anti")
