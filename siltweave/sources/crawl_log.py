"""The crawl log: reading, defaults, adapters, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltweave.functions.urls import netloc, origin
from siltweave.operators.ordered import running

REQUIRED = {"timestamp", "url", "bytes_downloaded", "fetch_latency_ms", "status_code", "is_relevant", "cumulative_pages", "cumulative_relevant"}
MODES = ["bfs", "link_priority", "semantic"]


def missing_columns(df: DataFrame) -> set[str]:
    return REQUIRED - set(df.columns)


def typed_log(raw: DataFrame) -> DataFrame:
    """Check the columns of a log of strings, cast what can be cast, and give the rest its defaults."""
    gone = missing_columns(raw)
    if gone:
        raise ValueError(f"the log lacks the columns {sorted(gone)}")
    number = lambda c, t: F.coalesce(F.expr(f"try_cast(try_cast(`{c}` AS DOUBLE) AS {t})"), F.lit(0).cast(t)).alias(c)
    relevant = F.lower(F.trim(F.col("is_relevant").cast("string"))).isin("true", "1", "1.0")
    cols = [
        F.timestamp_seconds(F.expr("try_cast(`timestamp` AS DOUBLE)")).alias("timestamp"),
        "url",
        *[number(c, t) for c, t in (("bytes_downloaded", "BIGINT"), ("fetch_latency_ms", "DOUBLE"), ("status_code", "INT"), ("cumulative_pages", "BIGINT"), ("cumulative_relevant", "BIGINT"))],
        F.coalesce(relevant, F.lit(False)).alias("is_relevant"),
    ]
    has = set(raw.columns)
    cols.append(F.coalesce("error", F.lit("")).alias("error") if "error" in has else F.lit("").alias("error"))
    cols.append(F.lower(F.trim("mode")).alias("mode") if "mode" in has else F.lit("unknown").alias("mode"))
    cols.append(F.col("node_id") if "node_id" in has else F.lit("node_1").alias("node_id"))
    cols.append(F.expr("coalesce(try_cast(`run` AS INT), 1)").alias("run") if "run" in has else F.lit(1).alias("run"))
    cols.append(F.expr("coalesce(try_cast(`relevance_score` AS DOUBLE), 0)").alias("relevance_score") if "relevance_score" in has else F.coalesce(relevant, F.lit(False)).cast("double").alias("relevance_score"))
    if "page_text" in has:
        cols.append(F.coalesce("page_text", F.lit("")).alias("page_text"))
    return raw.select(*cols)


def read_csv_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A log, or several of the same header; error texts may hold line ends."""
    return typed_log(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_modes(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """Logs by mode: the mode of each file is overwritten, its run is its place in the list."""
    parts = [read_csv_log(spark, p).withColumns({"mode": F.lit(mode), "run": F.lit(i)}) for mode in MODES for i, p in enumerate(files.get(mode, []), 1)]
    if not parts:
        raise ValueError("there are no log files")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def from_events(events: DataFrame) -> DataFrame:
    """A log from the events table."""
    error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("node-"), F.pmod(F.expr("user_id div 3"), F.lit(4))).alias("node_id"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'bfs' WHEN 1 THEN 'link_priority' ELSE 'semantic' END").alias("mode"),
        (1 + F.col("event_id") % 3).cast("int").alias("run"),
        F.concat(F.lit("http://h"), F.col("user_id") % 50, F.lit(".example.com/"), "event_type", F.lit("/"), "event_id").alias("url"),
        F.round(F.col("value") * 1000).cast("bigint").alias("bytes_downloaded"),
        F.col("value").alias("fetch_latency_ms"),
        F.when(error, 0).otherwise(200).alias("status_code"),
        (~error & (F.get_json_object("props", "$.k").cast("int") >= 50)).alias("is_relevant"),
        F.when(error, "fetch failed").otherwise("").alias("error"),
        # what the page says: users, kinds and values come back, so some pages say the same
        F.concat_ws(" ", F.lit("page of user"), "user_id", F.lit("on"), "event_type", F.lit("with about"), F.floor("value").cast("string"), F.lit("points")).alias("page_text"),
    )


def with_counters(log: DataFrame) -> DataFrame:
    """Running pages and relevant pages of each node and run, in order of completion."""
    d = log.withColumn("_log", F.to_json(F.struct("mode", "run", "node_id")))
    d = running(d, "_log", ["seq"], {"cumulative_relevant": F.coalesce(F.col("is_relevant").cast("long"), F.lit(0))})
    return d.select(*log.columns, (F.col("position") + 1).alias("cumulative_pages"), "cumulative_relevant")


def merged(node_logs: list[DataFrame]) -> DataFrame:
    """Logs of several nodes as one; order them by (timestamp, node_id, seq) where order matters."""
    out = node_logs[0]
    for d in node_logs[1:]:
        out = out.unionByName(d)
    return out


def synthetic_log(spark: SparkSession, pages: int = 3000, runs: int = 3) -> DataFrame:
    """A made-up log of three modes with given rates of relevant pages; hashes stand for random numbers."""
    d = spark.range(3 * runs * pages).select(
        (F.col("id") % pages).alias("i"),
        (1 + F.expr(f"id div {pages}") % runs).cast("int").alias("run"),
        F.element_at(F.array(*[F.lit(m) for m in MODES]), (1 + F.expr(f"id div {pages * runs}")).cast("int")).alias("mode"),
        F.md5(F.col("id").cast("string")).alias("h"),
    )
    draw = lambda at, n: F.conv(F.substring("h", at, 7), 16, 10).cast("long") % n
    rate = F.when(F.col("mode") == "bfs", 0.18).when(F.col("mode") == "link_priority", 0.32).otherwise(F.least(F.lit(1.0), 0.61 * (1.4 - 0.8 * F.col("i") / pages)))
    d = d.withColumn("is_relevant", draw(1, 10000) < F.floor(rate * 10000))
    return d.select(
        (F.lit(1_700_000_000.0) + F.col("i") * 0.3 + F.col("run") * 5000).alias("timestamp_s"),
        F.concat(F.lit("https://example.com/"), "mode", F.lit("/"), "run", F.lit("/"), "i").alias("url"),
        (5000 + draw(8, 195000)).alias("bytes_downloaded"),
        (50 + draw(15, 750)).cast("double").alias("fetch_latency_ms"),
        F.lit(200).alias("status_code"),
        "is_relevant",
        "mode",
        F.concat(F.lit("node_"), (1 + draw(22, 4)).cast("string")).alias("node_id"),
        "run",
        F.col("i").alias("seq"),
        F.concat_ws(" ", F.lit("sample text page"), "i", F.lit("mode"), "mode", F.lit("run"), "run").alias("page_text"),
    )


def write_log(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store a log by mode, so that readers of one mode read its folder only."""
    log.write.mode("append").partitionBy("mode").format(fmt).save(path)


def write_summary(summary: DataFrame, path: str, fmt: str = "csv") -> None:
    """A summary is a row per mode: one file."""
    summary.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)


def latest_pages(pages: DataFrame, key: str = "url", order: str = "fetch_time") -> DataFrame:
    """Insert or replace: the last row of each key. Other columns break ties, so that it is the same on each run."""
    rest = [c for c in pages.columns if c != key]
    last = pages.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return last.select(*[F.col(f"_r.{c}").alias(c) if c != key else F.col(key) for c in pages.columns])


def first_links(links: DataFrame, order: str = "seq") -> DataFrame:
    """Insert or ignore: the first row of each (src, dst)."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    first = links.groupBy("src", "dst").agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c not in ("src", "dst") else F.col(c) for c in links.columns])


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with ``allowed``: the first rule (origin, rule_no, prefix, allow) whose prefix fits decides, none allows."""
    path = F.regexp_replace("url", "^[^:/?#]+://[^/?#]*", "")
    u = urls.withColumns({"origin": origin(F.col("url")), "_path": F.when(path == "", "/").otherwise(path)})
    hit = u.join(rules, "origin").filter(F.col("_path").startswith(F.col("prefix"))).groupBy("url").agg(F.min_by("allow", "rule_no").alias("_allow"))
    return urls.join(hit, "url", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def fetch_times(requests: DataFrame, delay: float, url: str = "url", arrival: str = "arrival", order: str = "seq") -> DataFrame:
    """``start``: the earliest times that keep requests to one netloc ``delay`` apart, served by order.

    t(i) = max(arrival(i), t(i-1) + delay) is a running maximum of arrival(i) - i * delay, shifted back.
    """
    d = running(requests.withColumn("_netloc", netloc(F.col(url))), "_netloc", [order], {}).withColumnRenamed("position", "_i").drop("group_size")
    d = running(d, "_netloc", [order], {}, {"_top": F.col(arrival) - F.col("_i") * delay})
    return d.select(*requests.columns, (F.col("_top") + F.col("_i") * delay).alias("start"))


def fetched(status: Column, html: Column) -> Column:
    """A page counts as fetched if it has HTML and a status from 200 to 299."""
    return html.isNotNull() & (status >= 200) & (status < 300)


def status_defaults(log: DataFrame) -> DataFrame:
    return log.withColumns({"status_code": F.coalesce("status_code", F.lit(0)), "error": F.coalesce("error", F.lit(""))})


def clear(spark: SparkSession, prefix: str = "crawl_") -> None:
    """Drop the session's temporary views of a run."""
    for t in spark.catalog.listTables():
        if t.isTemporary and t.name.startswith(prefix):
            spark.catalog.dropTempView(t.name)
