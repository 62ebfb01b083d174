"""Metrics of crawl logs: aggregates by mode, ordered analytics, and the dashboard's figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltweave.functions.urls import bucket, mode_label, per_relevant, url_partition
from siltweave.operators.cluster import assignment
from siltweave.operators import similarity
from siltweave.operators.ordered import running


def relevant() -> Column:
    return F.col("is_relevant").cast("long")


def harvest_rate(log: DataFrame) -> DataFrame:
    return log.groupBy("mode").agg(F.avg(relevant()).alias("harvest_rate"))


def overview(log: DataFrame) -> DataFrame:
    return log.groupBy("mode").agg(F.count("*").alias("pages"), F.sum(relevant()).alias("relevant"), F.bround(F.sum("bytes_downloaded") / 1e6, 1).alias("mb"))


def _throughput() -> Column:
    span = F.max(F.unix_micros("timestamp")) / 1e6 - F.min(F.unix_micros("timestamp")) / 1e6
    nodes = F.greatest(F.count_distinct("node_id"), F.lit(1))
    span = F.when(span <= 0, F.sum("fetch_latency_ms") / 1000 / nodes).otherwise(span)
    return F.bround(F.count("*") / F.greatest(span, F.lit(1.0)) / nodes, 2)


def throughput(log: DataFrame) -> DataFrame:
    """Pages a second and node; the span is that of all runs together."""
    return log.groupBy("mode").agg(_throughput().alias("pages_per_sec_node"))


def _cross() -> Column:
    return (F.count("*") * (1 - 1 / F.greatest(F.count_distinct("node_id"), F.lit(1))) * 0.5 * 100).cast("long")


def cross_node_bytes(log: DataFrame) -> DataFrame:
    """An estimate by formula: half of the links to other nodes, 100 bytes each."""
    return log.groupBy("mode").agg(_cross().alias("cross_node_bytes"))


def mean_std(log: DataFrame, metric: Column) -> DataFrame:
    """Mean and population deviation over runs of an aggregate by mode; empty with fewer than two runs."""
    each = log.groupBy("mode", "run").agg(metric.alias("_m"))
    runs = each.agg(F.count_distinct("run").alias("_runs"))
    return each.groupBy("mode").agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std")).crossJoin(F.broadcast(runs)).filter("_runs >= 2").drop("_runs")


def redundancy(log: DataFrame) -> DataFrame:
    """(mode, redundancy): the share of pages that are near duplicates of an earlier page kept of their mode, by their text or else their URL."""
    text = similarity.url_text(F.col("url"), F.col("page_text") if "page_text" in log.columns else None)
    d = log.select("mode", text.alias("text"), (F.col("run") * F.lit(10**16) + F.unix_micros("timestamp")).alias("at"))
    return similarity.redundancy(d, "at", "text", "mode", short=True).select(F.col("grp").alias("mode"), "redundancy")


def summary(log: DataFrame, redundant: DataFrame | None = None) -> DataFrame:
    """The summary table, numbers first and as text, in a fixed order of modes. Redundancy is the log's own unless it is given."""
    a = log.groupBy("mode").agg(
        F.avg(relevant()).alias("harvest_rate"), (F.sum("bytes_downloaded") / 1e6).alias("mb"), F.sum(relevant()).alias("relevant"),
        _throughput().alias("pages_per_sec_node"), _cross().alias("cross_node_bytes"), F.count("*").alias("pages"),
    )
    a = a.join((redundancy(log) if redundant is None else redundant).select("mode", "redundancy"), "mode", "left")
    place = F.expr("array_position(array('bfs', 'link_priority', 'semantic'), mode)").cast("int")
    return a.filter(place > 0).select(
        place.alias("place"), mode_label(F.col("mode")).alias("mode"), F.format_string("%.1f", F.col("harvest_rate") * 100).alias("harvest_pct"),
        per_relevant(F.col("mb"), F.col("relevant")).alias("mb_per_relevant"), F.format_string("%.1f", F.coalesce("redundancy", F.lit(0.0)) * 100).alias("redundancy_pct"),
        F.format_string("%.2f", "pages_per_sec_node").alias("throughput"), F.format_string("%.1f", F.col("cross_node_bytes") / 1e3).alias("cross_node_kb"), "pages",
    ).orderBy("place")


def run_summary(log: DataFrame) -> DataFrame:
    """One row: pages, relevant, duration and pages a second."""
    d = log.agg(F.count("*").alias("total_pages"), F.coalesce(F.sum(relevant()), F.lit(0)).alias("total_relevant"), F.coalesce((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 1e6, F.lit(0.0)).alias("_span"))
    rate = F.when(F.col("_span") > 0, F.bround(F.col("total_pages") / F.col("_span"), 2)).otherwise(0.0)
    return d.select("total_pages", "total_relevant", F.bround("_span", 2).alias("duration_sec"), rate.alias("pages_per_sec"))


def first_run(log: DataFrame) -> DataFrame:
    """The rows of each mode's first run. The runs are few, so the join is with a tiny aggregate."""
    least = log.groupBy("mode").agg(F.min("run").alias("run"))
    return log.join(F.broadcast(least), ["mode", "run"], "left_semi")


ORDER = ["timestamp", "node_id", "seq"]


def bandwidth(log: DataFrame) -> DataFrame:
    """Bytes and relevant pages so far, and megabytes a relevant page to nine decimals, null before the first; the first run of each mode.

    The quotient is rounded in whole numbers, so that no engine's floating point decides its last place.
    """
    d = running(first_run(log), "mode", ORDER, {"bytes": F.col("bytes_downloaded"), "relevant": relevant()})
    exact = F.expr("CASE WHEN relevant > 0 THEN (2000 * bytes + relevant) div (2 * relevant) END") / F.lit(1e9)
    return d.select("mode", F.col("position").cast("int").alias("position"), "bytes", "relevant", exact.alias("mb_per_relevant"))


def _sampled(d: DataFrame, points: int) -> DataFrame:
    """Rows at floor(j * (n - 1) / (p - 1)) of each mode, p of them, as equal steps give."""
    p = F.least(F.lit(points), F.col("group_size"))
    step = F.col("group_size") - 1
    j = F.ceil(F.col("position") * (p - 1) / F.greatest(step, F.lit(1)))
    return d.filter((step == 0) | (F.floor(j * step / F.greatest(p - 1, F.lit(1))) == F.col("position")))


def relevance_at_depth(log: DataFrame, points: int = 100) -> DataFrame:
    """(mode, position, rate) at sampled positions of the first run, from the stored counters."""
    d = running(first_run(log), "mode", ORDER, {})
    rate = F.when(F.col("cumulative_pages") > 0, F.col("cumulative_relevant") / F.col("cumulative_pages")).otherwise(0.0)
    return _sampled(d, points).select("mode", F.col("position").cast("int").alias("position"), rate.alias("rate"))


def relevance_at_depth_global(log: DataFrame, points: int = 100) -> DataFrame:
    """The same with counters of all nodes together, recomputed in order of time."""
    d = running(first_run(log), "mode", ORDER, {"_r": relevant()})
    return _sampled(d, points).select("mode", F.col("position").cast("int").alias("position"), (F.col("_r") / (F.col("position") + 1)).alias("rate"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_k") <= n).drop("_k")


def page_rate(beats: DataFrame) -> DataFrame:
    """Pages a second since the node's last heartbeat; 0 for the first and where time stands still."""
    d = running(beats, "node_id", ["seq"], {}, before={"_us": F.unix_micros("timestamp"), "_pages": F.col("pages_crawled")})
    dt, dp = (F.unix_micros("timestamp") - F.col("_us")) / 1e6, F.col("pages_crawled") - F.col("_pages")
    return d.select(*beats.columns, F.coalesce(F.when(dt > 0, dp / dt), F.lit(0.0)).alias("pages_per_sec"))


def ratio(part: Column, whole: Column, digits: int = 9) -> Column:
    """part / whole of whole numbers, rounded half up in whole numbers."""
    scaled = part.cast("decimal(38,0)") * F.lit(2 * 10**digits) + whole
    return F.floor(scaled / (whole * 2).cast("decimal(38,0)")).cast("bigint") / F.lit(float(10**digits))


def histogram(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """(bucket, n, pct) of all bins, empty ones too."""
    c = df.filter(F.col(score).isNotNull()).groupBy(bucket(F.col(score), bins).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket"))
    d = every.join(F.broadcast(c), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))  # a row per bin
    total = F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1))
    return d.select("bucket", "n", F.bround(F.col("n") / total * 100, 1).alias("pct"))


def dashboard(nodes: DataFrame) -> DataFrame:
    """Totals of (pages_crawled, relevant_count) rows of nodes."""
    d = nodes.agg(F.coalesce(F.sum("pages_crawled"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum("relevant_count"), F.lit(0)).alias("total_relevant"))
    return d.withColumn("harvest_rate", F.bround(F.col("total_relevant") / F.greatest("total_pages", F.lit(1)), 4))


def kpis(nodes: DataFrame) -> DataFrame:
    """Nodes with the width of their bar and the grade of their harvest rate."""
    top = F.greatest(F.max("pages_per_sec").over(W.partitionBy()), F.lit(1.0))
    grade = F.when(F.col("harvest_rate") > 0.5, "good").when(F.col("harvest_rate") > 0.3, "mid").otherwise("bad")
    return nodes.withColumns({"bar": F.floor(F.col("pages_per_sec") / top * 100 + 0.5).cast("long"), "grade": grade})


def latency(df: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """Mean, median, deviation, nearest-rank 95th percentile, least, largest, and whether the mean is below 10."""
    d = running(df.select(*([key] if key else []), value), key, [value], {})
    p95 = F.max(F.when(F.col("position") == F.floor(F.col("group_size") * 0.95), F.col(value)))
    g = d.groupBy(*([key] if key else []))
    return g.agg(F.avg(value).alias("mean_ms"), F.median(value).alias("median_ms"), F.stddev_samp(value).alias("stdev_ms"), p95.alias("p95_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), (F.avg(value) < 10).alias("passes_10ms"))


def batch_speedup(df: DataFrame) -> DataFrame:
    """(batch_size, total_ms) trials: time a URL and the gain over batches of one."""
    d = df.groupBy("batch_size").agg(F.avg("total_ms").alias("mean_total_ms")).withColumn("mean_per_url_ms", F.col("mean_total_ms") / F.col("batch_size"))
    one = F.max(F.when(F.col("batch_size") == 1, F.col("mean_per_url_ms"))).over(W.partitionBy())
    return d.withColumn("speedup", one / F.col("mean_per_url_ms"))


def scored(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, accuracy and the area under the ROC curve (null with one class), ties at their mean rank."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    counts = df.groupBy(F.col(score).alias("_s")).agg(F.sum(y.cast("long")).alias("_pos"), F.count("*").alias("_n"), F.sum((y & p).cast("long")).alias("_tp"), F.sum(p.cast("long")).alias("_pp"), F.sum((y == p).cast("long")).alias("_ok"))
    r = running(counts, None, ["_s"], {"_upto": F.col("_n")})
    r = r.withColumn("_rank", F.col("_pos") * (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2))
    t = r.agg(*[F.sum(c).alias(c) for c in ("_pos", "_n", "_tp", "_pp", "_ok", "_rank")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = ratio(F.col("_tp"), F.col("_pp")), ratio(F.col("_tp"), F.col("_pos"))
    neg = F.col("_n") - F.col("_pos")
    auc = F.when((F.col("_pos") > 0) & (neg > 0), (F.col("_rank") - F.col("_pos") * (F.col("_pos") + 1) / 2) / (F.col("_pos") * neg))
    return t.select(pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"), ratio(F.col("_ok"), F.col("_n")).alias("accuracy"), auc.alias("roc_auc"))


def experiment(log: DataFrame, node_counts: list[int], url: str = "url") -> DataFrame:
    """Summaries of the same log for several numbers of nodes, its URLs dealt anew."""
    out = None
    for n in node_counts:
        owners = assignment(log.sparkSession, [f"node-{i}" for i in range(n)])
        d = log.drop("node_id").withColumn("partition", url_partition(F.col(url))).join(F.broadcast(owners), "partition")
        s = d.groupBy().agg(F.lit(n).alias("node_count"), F.count("*").alias("pages"), F.sum(relevant()).alias("relevant"), F.count_distinct("node_id").alias("nodes_used"), _throughput().alias("pages_per_sec_node"), _cross().alias("cross_node_bytes"))
        out = s if out is None else out.unionByName(s)
    return out


def by_mode(log: DataFrame, metric: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """A metric of each mode's own rows, as a caller's function has it."""
    return {m: metric(log.filter(F.col("mode") == m)) for m in ("bfs", "link_priority", "semantic")}
