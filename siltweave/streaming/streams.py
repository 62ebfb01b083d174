"""Streams of crawl events. Each function takes a streaming or a batch DataFrame unless it says otherwise."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltweave.functions.urls import decode_message
from siltweave.operators.cluster import owned
from siltweave.session import delete_path, shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table as a stream of its files."""
    # a pattern, since a plain path may be a single file, which the stream would take for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def ordered_source(spark: SparkSession, path: str, order: str, rows_per_file: int = 50_000, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table as a stream in the order of a column, whatever its files hold and when they were written.

    The rows are dealt into files by ranges. A stream takes files by their times, oldest first, so these follow the ranges.
    """
    root = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex[:8]}"
    d = spark.read.parquet(path)
    d.repartitionByRange(max(1, -(-d.count() // rows_per_file)), order).sortWithinPartitions(order).write.parquet(root)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = int(time.time() - len(files)) * 1000
    for i, f in enumerate(files):
        fs.setTimes(f, first + 1000 * i, -1)
    return source(spark, root, files_per_batch)


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote.

    In append mode every batch is a part of the result; in complete mode the last one is it. A batch
    overwrites its own folder, so one that is run again after a failure leaves nothing twice.
    """
    spark = stream.sparkSession
    root = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        last.append(batch)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    parts = sorted(set(last)) if mode == "append" else [last[-1]]
    return spark.read.schema(stream.schema).parquet(*[f"{root}/out/batch={b}" for b in parts])


def received(raw: DataFrame, col: str = "value") -> DataFrame:
    """Messages with their defaults; malformed ones are passed over."""
    return raw.select(decode_message(F.col(col)).alias("m")).filter("m IS NOT NULL").select("m.*")


def minute_bytes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Bytes by node and minute, with a watermark of an hour as their time to live."""
    w = F.window("timestamp", "1 minute")
    return events.withWatermark("timestamp", late).groupBy("node_id", w.alias("w")).agg(F.sum("bytes").alias("bytes")).select("node_id", F.unix_seconds("w.start").alias("minute"), "bytes")


def first_urls(events: DataFrame) -> DataFrame:
    """Each URL once, over all nodes."""
    return events.dropDuplicates(["url"])


def first_urls_within(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same with state that is dropped after a while."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["url"])


def live_stats(events: DataFrame) -> DataFrame:
    """Counters of each node."""
    return events.groupBy("node_id").agg(F.count("*").alias("pages_crawled"), F.sum(F.col("is_relevant").cast("long")).alias("relevant_count"), F.sum("bytes_downloaded").alias("bytes_downloaded"))


def live_spells(events: DataFrame, ttl: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Statistics of nodes that expire: a node's counters begin anew once it was silent for ``ttl``.

    (node_id, from_us, until_us, mode, pages_crawled, relevant_count, bytes_downloaded, pages_per_sec, harvest_rate). In append mode a spell is
    given when the watermark has passed its end, and its state is dropped.
    """
    w = F.session_window("timestamp", ttl)
    n, hit = F.count("*"), F.sum(F.col("is_relevant").cast("long"))
    span = (F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 1e6
    d = events.withWatermark("timestamp", late).groupBy("node_id", w.alias("w")).agg(
        F.min(F.unix_micros("timestamp")).alias("from_us"), F.max(F.unix_micros("timestamp")).alias("until_us"), F.max_by("mode", "timestamp").alias("mode"), n.alias("pages_crawled"), hit.alias("relevant_count"),
        F.sum("bytes_downloaded").alias("bytes_downloaded"), F.when(span > 0, n / span).otherwise(0.0).alias("pages_per_sec"), (hit / n).alias("harvest_rate"),
    )
    return d.drop("w")


def last_scores(events: DataFrame, keep: int = 500) -> DataFrame:
    """The last scores of each node, after each batch: a state of at most ``keep`` per node. Streaming only."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held += list(zip(f.seq.tolist(), f.score.tolist()))
        held = sorted(held)[-keep:]
        seqs, scores = (list(x) for x in zip(*held))
        state.update((seqs, scores))
        yield pd.DataFrame({"node_id": [key[0]] * len(held), "seq": seqs, "score": scores})

    return events.groupBy("node_id").applyInPandasWithState(run, "node_id STRING, seq BIGINT, score DOUBLE", "seqs ARRAY<BIGINT>, scores ARRAY<DOUBLE>", "update", GroupStateTimeout.NoTimeout)


def liveness(beats: DataFrame, timeout: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Spells in which a node never was silent for the timeout: (node_id, from_s, until_s, beats)."""
    w = F.session_window("timestamp", timeout)
    d = beats.withWatermark("timestamp", late).groupBy("node_id", w.alias("w")).agg(F.count("*").alias("beats"), F.max("timestamp").alias("last"))
    return d.select("node_id", F.unix_seconds("w.start").alias("from_s"), F.unix_seconds("last").alias("until_s"), "beats")


def moving_centroid(events: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each node's centroid, moved by every vector in order of seq. Streaming only.

    The fold depends on the order, so batches must come in it, as those of ``ordered_source`` do; a vector that
    belongs before what was folded by an earlier batch is an error.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c, last = (np.array(state.get[0]), state.get[1]) if state.exists else (None, None)
        parts = [(f.seq.to_numpy(), f.embedding.to_numpy()) for f in frames]  # a batch's rows of a node come in several frames
        seqs, vs = np.concatenate([s for s, _ in parts]), np.concatenate([v for _, v in parts])
        if last is not None and seqs.min() < last:
            raise ValueError(f"a vector of {key[0]} is out of order: {seqs.min()} came after {last}")
        for i in np.argsort(seqs, kind="stable"):
            v = np.asarray(vs[i], float)
            c = v if c is None else (1 - alpha) * c + alpha * v
            c = c / (np.linalg.norm(c) + 1e-10)
        state.update((c.tolist(), int(seqs.max())))
        yield pd.DataFrame({"node_id": [key[0]], "centroid": [c.tolist()]})

    return events.groupBy("node_id").applyInPandasWithState(run, "node_id STRING, centroid ARRAY<DOUBLE>", "c ARRAY<DOUBLE>, last BIGINT", "update", GroupStateTimeout.NoTimeout)


def assigned(events: DataFrame, owners: DataFrame, me: str) -> DataFrame:
    """Events with their owners: a stream-static join."""
    return owned(events, owners, me)


def assigned_live(events: DataFrame, owners_path: str, me: str, out: str) -> StreamingQuery:
    """Start writing events with their owners, (partition, node_id) being read anew for each batch, so that a rebalance counts from the next one on."""

    def write(df: DataFrame, batch: int) -> None:
        now = df.sparkSession.read.schema("partition INT, node_id STRING").parquet(owners_path)
        owned(df, now, me).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()


def simulated(spark: SparkSession, rows_per_second: int = 25) -> DataFrame:
    """Made-up node statistics for trying a dashboard out."""
    return made_up(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load())


def made_up(ticks: DataFrame) -> DataFrame:
    """Node statistics out of (timestamp, value) rows: three of five scores are high."""
    draw = lambda n: F.conv(F.substring(F.md5(F.col("value").cast("string")), 1, 7), 16, 10).cast("bigint") % n
    score = F.when(F.pmod("value", F.lit(5)) < 3, 0.6 + draw(400) / 1000).otherwise(draw(450) / 1000)
    return ticks.select("timestamp", F.concat(F.lit("node-"), F.pmod("value", F.lit(4))).alias("node_id"), F.col("value").alias("seq"), score.alias("score"))


def polled(stats: DataFrame, path: str, every: str = "1 second", keep: int = 120) -> StreamingQuery:
    """Append a snapshot of streaming statistics to a history after each batch, of which the last ``keep`` stay; returns the running query."""

    def snapshot(df: DataFrame, batch: int) -> None:
        df.withColumn("polled_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch >= keep:
            delete_path(df.sparkSession, f"{path}/batch={batch - keep}")

    return stats.writeStream.foreachBatch(snapshot).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(processingTime=every).start()


def drain(query: StreamingQuery, idle_seconds: float = 5.0, step: float = 0.2) -> None:
    """Stop a running query once it has had nothing to do for a while."""
    quiet = 0.0
    while query.isActive and quiet < idle_seconds:
        time.sleep(step)
        p = query.lastProgress
        quiet = quiet + step if p is not None and not p["numInputRows"] and not query.status["isDataAvailable"] else 0.0
    query.stop()
    query.awaitTermination()
