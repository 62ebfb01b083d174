"""Partitions, their owners, liveness of nodes, and traffic between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltweave.functions.urls import PARTITIONS, minute, url_partition


def assignment(spark: SparkSession, nodes: list[str], partitions: int = PARTITIONS) -> DataFrame:
    """(partition, node_id): partitions dealt in turn to the nodes in order of name; none without nodes."""
    names = sorted(set(nodes))
    if not names:
        return spark.createDataFrame([], "partition INT, node_id STRING")
    at = F.array(*[F.lit(n) for n in names])
    return spark.range(partitions).select(F.col("id").cast("int").alias("partition"), F.element_at(at, (F.col("id") % len(names) + 1).cast("int")).alias("node_id"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Partitions that change their owner."""
    a = after.withColumnRenamed("node_id", "new_node")
    return before.withColumnRenamed("node_id", "old_node").join(a, "partition", "full").filter(~F.col("old_node").eqNullSafe(F.col("new_node")))


def owned(urls: DataFrame, owners: DataFrame, me: str | None = None, url: str = "url") -> DataFrame:
    """URLs with partition and node_id; unmapped ones belong to ``me``, or to nobody. Owners have 256 rows, a fixed number."""
    d = urls.drop("node_id").withColumn("partition", url_partition(F.col(url))).join(F.broadcast(owners), "partition", "left")
    return d.withColumn("node_id", F.coalesce("node_id", F.lit(me))) if me is not None else d


def routed(urls: DataFrame, owners: DataFrame, me: str, url: str = "url") -> DataFrame:
    """The same with ``local``, whether this node keeps the URL."""
    return owned(urls, owners, me, url).withColumn("local", F.col("node_id") == me)


def forward(urls: DataFrame, owners: DataFrame, me: str) -> DataFrame:
    """Bring every URL to its owner: a shuffle by node."""
    return owned(urls, owners, me).repartition("node_id")


def is_alive(last_seen: Column, as_of: Column, timeout: int = 30) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(last_seen)) < timeout * 1_000_000


def is_dead(last_seen: Column, as_of: Column, timeout: int = 30) -> Column:
    """Silent for longer than the timeout; at exactly the timeout a node is neither dead nor alive."""
    return (F.unix_micros(as_of) - F.unix_micros(last_seen)) > timeout * 1_000_000


def liveness(beats: DataFrame, as_of: Column | None = None, timeout: int = 30) -> DataFrame:
    """The last heartbeat of each node with ``alive`` and ``dead``; as of the last of all by default."""
    last = beats.groupBy("node_id").agg(F.max("timestamp").alias("last_seen"), F.max_by("pages_crawled", F.struct("timestamp", "seq")).alias("pages_crawled"))
    if as_of is None:
        last = last.crossJoin(F.broadcast(beats.agg(F.max("timestamp").alias("_now"))))
    now = F.col("_now") if as_of is None else as_of
    return last.withColumns({"alive": is_alive(F.col("last_seen"), now, timeout), "dead": is_dead(F.col("last_seen"), now, timeout)}).drop("_now")


def failover(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """The assignment to the nodes that aren't dead. Nodes are a list of machines, so they are brought to the driver."""
    return assignment(spark, [r["node_id"] for r in nodes.filter("NOT dead").select("node_id").collect()])


def cluster_stats(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Nodes with their numbers of partitions, and the totals of the cluster."""
    n = nodes.join(owners.groupBy("node_id").agg(F.count("*").alias("partitions")), "node_id", "left").withColumn("partitions", F.coalesce("partitions", F.lit(0)))
    t = nodes.agg(F.count("*").alias("nodes"), F.sum("pages_crawled").alias("total_pages"))
    return n.crossJoin(F.broadcast(t))


def minute_counters(traffic: DataFrame) -> DataFrame:
    """(node_id, minute, direction, bytes) of (node_id, timestamp, direction, bytes) rows."""
    return traffic.groupBy("node_id", minute(F.col("timestamp")).alias("minute"), "direction").agg(F.sum("bytes").alias("bytes"))


def sent_received(counters: DataFrame) -> DataFrame:
    """Sent bytes of each minute with what was received; minutes with receipts only aren't reported."""
    side = lambda d: counters.filter(F.col("direction") == d).select("node_id", "minute", F.col("bytes").alias(f"{d}_bytes"))
    return side("sent").join(side("recv"), ["node_id", "minute"], "left").withColumn("recv_bytes", F.coalesce("recv_bytes", F.lit(0)))


def totals(counters: DataFrame) -> DataFrame:
    part = lambda d: F.sum(F.when(F.col("direction") == d, F.col("bytes")).otherwise(0))
    return counters.groupBy("node_id").agg(part("sent").alias("sent_bytes"), part("recv").alias("recv_bytes"))
