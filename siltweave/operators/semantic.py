"""Topic relevance: centroids, scores, drift, and a classifier over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from siltweave.functions.vectors import TINY, cosine, norm, normalised
from siltweave.operators.ordered import running

ALPHA = 0.05


def centroid(vectors: DataFrame, vec: str = "embedding", key: str | None = None) -> DataFrame:
    """(key, centroid): the mean of vectors, of unit length. Sums by dimension are combined before the shuffle."""
    by = [key] if key else []
    d = vectors.select(*by, F.posexplode(F.col(vec)).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    d = d.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return d.select(*by, normalised(F.col("c")).alias("centroid"))


def drifted(vectors: DataFrame, start: DataFrame, order: str, vec: str = "embedding", key: str | None = None, alpha: float = ALPHA, snapshots: list[int] | None = None) -> DataFrame:
    """(key, n, centroid): the centroid after an ordered fold c <- unit((1 - alpha) c + alpha e) from start's, after all n vectors or after each of the numbers ``snapshots``.

    The fold isn't associative, so a key's vectors go through one task, in order; it holds the centroid only.
    """
    by = [F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]
    d = vectors.select(*by, F.col(order).alias("_o"), F.col(vec).cast("array<double>").alias("_v")).crossJoin(F.broadcast(start.select(F.col("centroid").alias("_c"))))
    d = d.repartition("_key").sortWithinPartitions("_key", "_o")
    at = set(snapshots or ())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, c, out = None, 0, None, []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["_key", "n", "centroid"])
        types = None
        for b in batches:
            types = [b.column("_key").type, pa.int64(), pa.list_(pa.float64())]
            keys, vs = b.column("_key").to_pylist(), b.column("_v")
            for i, k in enumerate(keys):
                if c is None or k != now:
                    if c is not None and not at:
                        out.append((now, n, c.tolist()))
                    now, n, c = k, 0, b.column("_c")[i].values.to_numpy().copy()
                c = (1 - alpha) * c + alpha * vs[i].values.to_numpy()
                c /= np.sqrt((c * c).sum()) + TINY
                n += 1
                if n in at:
                    out.append((now, n, c.tolist()))
            yield give()
            out = []
        if c is not None and not at:
            out.append((now, n, c.tolist()))
            yield give()

    done = d.mapInArrow(fold, f"_key {d.schema['_key'].dataType.simpleString()}, n BIGINT, centroid ARRAY<DOUBLE>")
    return done.withColumnRenamed("_key", key) if key else done.drop("_key")


def scored(vectors: DataFrame, topic: DataFrame, vec: str = "embedding", key: str | None = None) -> DataFrame:
    """Vectors with their cosine to the topic's centroid, a row or a row for each key."""
    d = vectors.join(F.broadcast(topic), key) if key else vectors.crossJoin(F.broadcast(topic))
    return d.withColumn("score", cosine(F.col(vec), F.col("centroid"))).drop("centroid")


def above(scores: DataFrame, threshold: float) -> DataFrame:
    """Those that may move the centroid: without a score, or scored at the threshold at least."""
    return scores.filter(F.col("score").isNull() | (F.col("score") >= threshold))


def score_batches(vectors: DataFrame, topic: DataFrame, batch: str, order: str, vec: str = "embedding", batches: DataFrame | None = None) -> DataFrame:
    """(batch, scores): the cosines of each batch's vectors in order; an empty list for those of ``batches`` that have none."""
    d = scored(vectors, topic, vec).groupBy(batch).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "score"))), lambda x: x["score"]).alias("scores"))
    if batches is None:
        return d
    return batches.select(batch).join(d, batch, "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))


def split(df: DataFrame, key: str, label: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """A stratified split: of each label, the share ``test`` that comes first by the MD5 of the key, rounded; the same on every run."""
    d = running(df.withColumn("_h", F.md5(F.col(key).cast("string"))), label, ["_h", key], {})
    held = F.col("position") < F.floor(F.col("group_size") * test + 0.5)
    return d.filter(~held).select(*df.columns), d.filter(held).select(*df.columns)


def fit(train: DataFrame, features: str, label: str, c: float = 1.0) -> LogisticRegressionModel:
    """Logistic regression that minimises c * sum of losses + half the squared weights."""
    d = train.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    n = d.count()
    if not n:
        raise ValueError("there is nothing to train on")
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000).fit(d)


def predicted(df: DataFrame, model: LogisticRegressionModel | None, features: str) -> DataFrame:
    """df with probability and prediction."""
    if model is None:
        raise RuntimeError("the classifier isn't fitted")
    d = df.withColumn("features", array_to_vector(F.col(features)))
    out = model.transform(d).withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction")


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def projected(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """The first principal components, up to their signs."""
    d = df.withColumn("_f", array_to_vector(F.col(vec)))
    return PCA(k=k, inputCol="_f", outputCol="_p").fit(d).transform(d).withColumn("pca", vector_to_array("_p")).drop("_f", "_p")


def similarity_to(start: Column, now: Column) -> Column:
    """How far a centroid has come: the cosine to where it began."""
    return cosine(start, now)


__all__ = ["TINY", "above", "centroid", "drifted", "fit", "load", "norm", "predicted", "projected", "save", "score_batches", "scored", "similarity_to", "split"]
