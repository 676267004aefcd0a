"""Vector metrics, exact search, incremental bookkeeping and hybrid fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    raise ValueError(f"unknown metric {metric}")


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest; exact, one scan, heap-based top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, distance(F.col(vec_col), q, metric).alias("distance")).orderBy("distance", id_col).limit(k)


def classify(candidates: DataFrame, stored: DataFrame, key: str, model: str) -> DataFrame:
    """(key, state): missing, unverified (no fingerprint), changed or current.

    ``candidates``: key, text_hash; ``stored``: key, text_hash, model.
    """
    s = stored.select(key, F.col("text_hash").alias("_h"), F.col("model").alias("_m"), F.lit(True).alias("_in"))
    state = (
        F.when(F.col("_in").isNull(), "missing").when(F.col("_h").isNull(), "unverified")
        .when((F.col("_h") != F.col("text_hash")) | ~F.col("_m").eqNullSafe(F.lit(model)), "changed").otherwise("current")
    )
    return candidates.join(s, key, "left").select(key, state.alias("state"))


def min_max(score: Column, low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """0..1 over the given range; 1 where all scores are equal."""
    span = high - low
    up = (high - score) / span if lower_is_better else (score - low) / span
    return F.when(F.abs(span) <= 1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(1.0)).otherwise(up)


def fuse(lexical: DataFrame, vector: DataFrame, survivors: DataFrame, alpha: float = 0.6, key: str = "paper_id") -> DataFrame:
    """Survivors of either channel with their fused score.

    ``lexical``: key, score (lower is better); ``vector``: key, similarity.  Filtering comes
    first, each channel is normalised over its own survivors, and a miss counts as 0.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    both = lexical.select(key, "score").join(vector.select(key, "similarity"), key, "full")
    kept = survivors.join(both, key)
    ends = kept.agg(F.min("score").alias("_sl"), F.max("score").alias("_sh"), F.min("similarity").alias("_vl"), F.max("similarity").alias("_vh"))
    x = kept.crossJoin(F.broadcast(ends))
    lex = F.coalesce(min_max(F.col("score"), F.col("_sl"), F.col("_sh"), True), F.lit(0.0))
    vec = F.coalesce(min_max(F.col("similarity"), F.col("_vl"), F.col("_vh")), F.lit(0.0))
    return x.withColumn("bm25_norm", lex).withColumn("vec_norm", vec).withColumn("final", F.lit(alpha) * F.col("vec_norm") + F.lit(1 - alpha) * F.col("bm25_norm")).drop("_sl", "_sh", "_vl", "_vh")
