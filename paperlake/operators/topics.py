"""First-level topic clustering, deterministic naming and projection checks; ``nested.py`` has
the second level."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.operators.storage import cut


def subcluster_count(size: Column) -> Column:
    """Number of second-level clusters by topic size."""
    return (
        F.when(size <= 1, 1).when(size <= 3, size.cast("int")).when(size >= 1200, 5).when(size >= 300, 4).otherwise(3)
    )


def fallback_labels(vectors: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, topic) dealt out by a hash of the id: stable, without a global row number."""
    return vectors.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(k)).cast("int").alias("topic"))


def primary(vectors: DataFrame, k: int = 40, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding", n_init: int = 10) -> DataFrame:
    """(id, topic) by distributed k-means, the best of ``n_init`` starts.

    One cluster for k of 1 or less; as many vectors as clusters or fewer are each their own,
    numbered by id.
    """
    n = vectors.count()
    if k <= 1 or n <= 1:
        return vectors.select(id_col, F.lit(0).alias("topic"))
    if n <= k:  # at most k rows
        return vectors.select(id_col, (F.row_number().over(Window.orderBy(id_col)) - 1).cast("int").alias("topic"))
    # every start reads the vectors several times
    x = cut(vectors.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")))
    models = (KMeans(k=k, seed=seed + i, initSteps=2, maxIter=20).fit(x) for i in range(max(1, n_init)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select(id_col, F.col("prediction").alias("topic"))


#: Settings that a checkpoint of a clustering run must share with the run that goes on from it.
RUN_SETTINGS = ("collection", "fingerprint", "k", "seed", "n_init", "model", "naming")


def resumable(checkpoint: dict | None, settings: dict) -> bool:
    """Whether a run may go on from a checkpoint; else it starts anew."""
    return checkpoint is not None and all(name in checkpoint and checkpoint[name] == settings.get(name) for name in RUN_SETTINGS)


def intact(vectors: DataFrame, dimensions: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(check, passed) of a vector store, by one pass over all of it."""
    from paperlake.operators.evaluate import checks

    v = F.col(vec_col)
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), F.count_if(F.coalesce(F.size(v) != dimensions, F.lit(True))).alias("size"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("odd"))
    return checks([("ids unique", F.col("n") == F.col("ids")), ("dimensions", F.col("size") == 0), ("finite", F.col("odd") == 0)], row)


def names(docs: DataFrame, topics: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(topic, name): the n tokens of largest term frequency times inverse topic frequency."""
    from paperlake.operators.relational import winner
    from paperlake.operators.search import tokens

    t = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).join(topics, key).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    spread = t.groupBy("term").agg(F.countDistinct("topic").alias("df"))
    total = topics.agg(F.countDistinct("topic").alias("k"))
    scored = t.join(spread, "term").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * F.ln(1 + F.col("k") / F.col("df")))
    best = winner(scored, ["topic"], [F.col("w").desc(), F.col("term")], n)
    return best.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))), lambda s: s["term"]), " ").alias("name"))
