"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot depends on its key alone and never changes. Bytes are summed per
slot, and a map from the slots to shards, stored as a log of (version, slot, shard)
rows, is what rebalancing edits: version v of the map is each slot's last row of a
version up to v, so moving records means appending the few rows of the moved slots.

Defined results: a null key has the slot of the empty string; a null text counts
0 bytes; repeated rows each count; a single slot heavier than a shard's capacity
stays alone where it is; an empty table gives an empty result and leaves the map at
version 0; extra columns pass through, and a column whose name is taken by a result
is replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siltweave.llm.text import column
from siltweave.session import shared_folder, written

SLOTS = 4096
MAP_SCHEMA = "version INT, slot INT, shard INT"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_bytes(df: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of every slot that has records."""
    return (
        df.select(slot_of(column(key), slots).alias("slot"), F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long").alias("b"))
        .groupBy("slot")
        .agg(F.sum("b").alias("bytes"), F.count("*").alias("records"))
    )


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: the slots dealt out in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def map_at(log: DataFrame, version: int | None = None) -> DataFrame:
    """(slot, shard) as of a version, the latest by default."""
    log = log if version is None else log.filter(F.col("version") <= version)
    return log.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The (slot, shard) rows to append so that shards come near equal bytes.

    A shard keeps its slots in order of bytes, largest first, as long as the sum stays
    within ``ceil(total / shards * (1 + tolerance))``, its first slot in any case. The others are
    lined up by their bytes, as is the room that shards have left below the mean, and a
    slot goes to the shard whose room its middle falls into. The windows run over slots
    and shards, of which there are fixed numbers, not over records.
    """
    s = current.join(sizes.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    s = s.crossJoin(s.agg((F.sum("bytes") / shards).alias("mean")))
    before = W.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("upto", F.sum("bytes").over(before)).withColumn("stays", (F.col("upto") <= F.ceil(F.col("mean") * (1 + tolerance))) | (F.col("upto") == F.col("bytes")))
    s = written(s, "slots")
    kept = s.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("kept"))
    everyone = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    mean = s.agg(F.first("mean").alias("mean"))
    room = everyone.join(kept, "shard", "left").crossJoin(mean).select("shard", F.greatest(F.lit(0), F.ceil("mean") - F.coalesce("kept", F.lit(0))).cast("long").alias("room"))
    room = room.withColumn("hi", F.sum("room").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("room"))
    loose = s.filter("NOT stays").drop("shard")
    loose = loose.withColumn("mid", F.sum("bytes").over(W.orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)) - F.floor(F.col("bytes") / 2))
    loose = loose.crossJoin(room.agg(F.max("hi").alias("all"))).withColumn("at", F.least(F.col("mid"), F.col("all") - 1))
    return loose.join(F.broadcast(room), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("slot", "shard")


class SlotMap:
    """The stored map: a folder, to which every edit adds a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> "SlotMap":
        initial_map(spark, shards, slots).coalesce(1).write.parquet(f"{path}/edit-0")
        return cls(spark, path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0]

    def at(self, version: int | None = None) -> DataFrame:
        return map_at(self.log(), version)

    def edit(self, moves: DataFrame) -> int:
        """Append moves, (slot, shard) rows, as the next version; returns it.

        A version is a folder of its own that must not be there yet, so of two writers that make the same one the second fails and can look again.
        """
        v = self.version() + 1
        moves.select(F.lit(v).alias("version"), F.col("slot").cast("int").alias("slot"), F.col("shard").cast("int").alias("shard")).coalesce(1).write.mode("error").parquet(f"{self.path}/edit-{v}")
        return v


def assign(df: DataFrame, mapping: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """Add slot and shard to the records. The map has a row per slot, a fixed number, so it is broadcast."""
    d = df.select(*[column(c).alias(c) for c in df.columns if c == key or c.lower() not in ("slot", "shard")])
    d = d.withColumn("slot", slot_of(column(key), slots))
    return d.join(F.broadcast(mapping.select("slot", "shard")), "slot", "left")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 64, slots: int = SLOTS, key: str = "doc_id", text: str = "text", tolerance: float = 0.02) -> DataFrame:
    """Create a map, rebalance it by the bytes of docs, and give every record its place before and after."""
    sizes = written(slot_bytes(docs, key, text, slots), "slot-bytes")  # a row per slot, used several times
    store = SlotMap.create(spark, f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex[:8]}", shards, slots)
    store.edit(rebalance(store.at(0), sizes, shards, tolerance))
    both = store.at().join(store.at(0).withColumnRenamed("shard", "old_shard"), "slot")
    d = docs.select(column(key), slot_of(column(key), slots).alias("slot"))
    return d.join(F.broadcast(both), "slot", "left").select(column(key).alias(key), "slot", "old_shard", "shard")


def write_shards(df: DataFrame, mapping: DataFrame, path: str, key: str = "doc_id", slots: int = SLOTS) -> None:
    """Write records below ``shard=``; a shuffle by slot keeps heavy shards in several files."""
    assign(df, mapping, key, slots).repartition("shard", "slot").write.partitionBy("shard").parquet(path)
