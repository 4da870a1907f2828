"""Cosine distance, top-k by it, weighted means; in the JVM, over arrays of any one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def usable(v: Column, dims: int) -> Column:
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, query: list[float] | DataFrame, k: int | None, key: str = "chunk_id", vec: str = "embedding", ts: str | None = "indexed_at",
            dims: int = 64, only: DataFrame | None = None) -> DataFrame:
    """key, distance of the k nearest; the query is a list or a one-row table with column qv. Only keys and distances
    are sorted, payload is joined later; a restriction applies before the top-k."""
    v = vectors.where(F.col(key).isNotNull() & usable(F.col(vec), dims))
    if only is not None:
        v = v.join(only, key, "left_semi")
    if isinstance(query, DataFrame):
        v = v.crossJoin(F.broadcast(query.limit(1)))
        q = F.col("qv")
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
    d = v.select(key, (F.col(ts) if ts else F.lit(0)).alias("_ts"), F.round(cosine_distance(F.col(vec), q), 6).alias("distance"))
    d = d.groupBy(key).agg(F.min_by("distance", F.struct("_ts", "distance")).alias("distance"))
    return d if k is None else d.orderBy("distance", key).limit(k)


def weighted_mean(vectors: DataFrame, group: list[str], vec: str, weight: str) -> DataFrame:
    """The mean of each group's vectors weighted by `weight`, scaled to length 1; partial sums are whole vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = vectors.where(F.col(vec).isNotNull()).select(*group, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"), F.col(weight).cast("double").alias("_w"))
    a = v.groupBy(*group).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("_v")).withColumn("_n", norm(F.col("_v")))
    return a.select(*group, F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v")).alias("mean"))
