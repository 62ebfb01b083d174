"""Running sums, maxima and predecessors over large groups, computed in ranges: no task has to hold or sort a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltweave.session import written


def running(df: DataFrame, key: str | None, order: list[str], sums: dict[str, Column], maxima: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """df with ``position`` (from 0) and ``group_size`` in each key's order, and by name the running sums and maxima, the row itself included, and the values of the row before.

    Rows are split into ranges of (key, order). What lies before a range comes from the totals of
    earlier ranges, a row for each key and range, whose table Spark broadcasts if it is small; the rest is a window within
    the range. A mode with all the rows of a log is spread like any other.
    """
    spark = df.sparkSession
    key_col = F.col(key) if key else F.lit(0)
    maxima, prior = maxima or {}, before or {}
    d = df.select("*", key_col.alias("_key"), *[c.alias(f"_v_{k}") for k, c in (sums | maxima | prior).items()])
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = written(d.repartitionByRange(ranges, "_key", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    last = [F.max_by(F.struct(*[f"_v_{k}" for k in prior]), F.struct(*order)).alias("_last")] if prior else []
    each = d.groupBy("_key", "_range").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums], *[F.max(f"_v_{k}").alias(f"_s_{k}") for k in maxima], *last)
    earlier = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    each = each.select(
        F.col("_key").alias("_k"), F.col("_range").alias("_r"), total("_n").alias("_n0"), F.sum("_n").over(W.partitionBy("_key")).alias("group_size"), *[total(f"_s_{k}").alias(f"_s0_{k}") for k in sums],
        *[F.max(f"_s_{k}").over(earlier).alias(f"_s0_{k}") for k in maxima], *([F.last("_last").over(earlier).alias("_last")] if prior else []),
    )
    each = written(each, "totals")
    own = W.partitionBy("_key", "_range").orderBy(*order)
    w = own.rowsBetween(W.unboundedPreceding, 0)
    d = d.join(each, d["_key"].eqNullSafe(each["_k"]) & (d["_range"] == each["_r"]))
    out = [(F.col("_n0") + F.row_number().over(own) - 1).alias("position"), "group_size"]
    out += [(F.col(f"_s0_{k}") + F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0))).alias(k) for k in sums]
    out += [F.greatest(F.col(f"_s0_{k}"), F.max(f"_v_{k}").over(w)).alias(k) for k in maxima]
    out += [F.when(F.row_number().over(own) > 1, F.lag(f"_v_{k}").over(own)).otherwise(F.col(f"_last._v_{k}")).alias(k) for k in prior]
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *out)
