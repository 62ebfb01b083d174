"""Fetch results from stored responses: what a crawler keeps of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltweave.sources.crawl_log import allowed_by_robots, fetch_times

MAX_BYTES = 5 * 1024 * 1024
HTML_TYPES = ("text/html", "application/xhtml+xml")


def fetch_results(responses: DataFrame, rules: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(url, html, status_code, byte_size, error) of (url, status_code, content_type, body) rows.

    What the rules forbid has no body; other types than HTML keep their size and status; bodies are cut at
    ``max_bytes`` and read as UTF-8, with the replacement character for what isn't. Rows that failed,
    without status, keep their error.
    """
    d = responses if rules is None else responses.join(allowed_by_robots(responses.select("url").distinct(), rules), "url")
    ok = F.lit(True) if rules is None else F.col("allowed")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    is_html = F.lit(False)
    for t in HTML_TYPES:
        is_html = is_html | kind.contains(t)
    body = F.col("body").cast("binary")
    text = F.decode(F.substring(body, 1, max_bytes), "UTF-8")
    error = F.when(~ok, "robots.txt disallowed").when(F.col("status_code").isNull(), F.coalesce("error", F.lit("unknown"))).when(~is_html, "non-HTML content-type")
    return d.select(
        "url", F.when(ok & is_html & F.col("status_code").isNotNull(), text).alias("html"), F.when(ok, F.col("status_code")).alias("status_code"),
        F.when(ok, F.coalesce(F.octet_length(body), F.lit(0))).otherwise(0).alias("byte_size"), error.alias("error"),
    )


def retries(failures: Column, max_retries: int = 2) -> Column:
    """(attempts, waited, gave_up) of a request that fails so many times: the waits double from one second."""
    n = F.least(failures, F.lit(max_retries))
    return F.struct((n + 1).alias("attempts"), (F.pow(F.lit(2), n) - 1).cast("long").alias("waited"), (failures > max_retries).alias("gave_up"))


def scheduled(requests: DataFrame, delay: float) -> DataFrame:
    """Requests (url, arrival, seq) with their start: one at a time for each host."""
    return fetch_times(requests, delay)
