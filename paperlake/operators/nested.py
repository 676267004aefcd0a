"""Second-level clusters of all topics at once, with progress stored after each round.

One k-means runs over every topic together: a round assigns each vector to the nearest centre
of its own topic and adds up vectors and counts by (topic, cluster), first in the tasks, so no
topic is ever in one task.  The centres, the counters of the labels and the settings of the
run are published after each round (``streaming.upsert``); a run with the same settings goes
on from the last round, one with others starts anew.

First centres are chosen per topic among a bounded set of rows, those of least hash of the id,
each as far as possible from those before.  Topics of at most three vectors are split into
single ones, in the order of their ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.operators.storage import cut
from paperlake.operators.topics import RUN_SETTINGS, resumable, subcluster_count
from paperlake.streaming.upsert import read_table, write_version

#: Rows that a topic's first centres are chosen among.
SEEDS = 64
ROUNDS = 20
#: Numbers in all centres, which every task holds; more are an error.
FEW_NUMBERS = 20_000_000
_CENTRES = "topic long, cluster int, centre array<double>, size long, round int, moved boolean, settings string"


def _arrays(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _first_centres(x: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic, cluster, centre): a greedy spread over the rows of least hash of each topic."""
    least = Window.partitionBy("topic").orderBy(F.xxhash64("id"), "id")
    rows = x.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= SEEDS).join(sizes.filter("size > 3"), "topic")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        v, k = _arrays(pdf["v"]), int(pdf["k"].iloc[0])
        at = [0]
        near = ((v - v[0]) ** 2).sum(1)
        while len(at) < k:
            at.append(int(near.argmax()))
            near = np.minimum(near, ((v - v[at[-1]]) ** 2).sum(1))
        return pd.DataFrame({"topic": pdf["topic"].iloc[0], "cluster": range(len(at)), "centre": [v[i].tolist() for i in at]})

    return rows.groupBy("topic").applyInPandas(pick, "topic long, cluster int, centre array<double>")


def _assigned(x: DataFrame, centres: list) -> DataFrame:
    """(id, topic, cluster, v): each vector with the nearest centre of its topic, the first of
    equals; topics without centres are left out."""
    by_topic: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for topic in {r["topic"] for r in centres}:
        own = sorted((r["cluster"], r["centre"]) for r in centres if r["topic"] == topic)
        by_topic[topic] = np.array([c for c, _ in own]), np.array([v for _, v in own], float)
    shared = x.sparkSession.sparkContext.broadcast(by_topic)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["topic"].isin(list(shared.value))].reset_index(drop=True)
            if len(pdf):
                v, topic = _arrays(pdf["v"]), pdf["topic"].to_numpy()
                cluster = np.zeros(len(pdf), int)
                for t in np.unique(topic):
                    names, c = shared.value[t]
                    own = topic == t
                    cluster[own] = names[(-2 * v[own] @ c.T + (c * c).sum(1)).argmin(1)]
                pdf["cluster"] = cluster
                yield pdf[["id", "topic", "cluster", "v"]]

    return x.mapInPandas(run, "id long, topic long, cluster int, v array<double>")


def _round(x: DataFrame, centres: DataFrame, number: int, settings: str) -> DataFrame:
    """The centres after one more round; an empty cluster keeps its centre."""
    sums = _assigned(x, centres.collect()).groupBy("topic", "cluster").agg(Summarizer.mean(array_to_vector("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("topic", "cluster", vector_to_array("m").alias("_m"), "n")
    both = centres.select("topic", "cluster", F.col("centre").alias("_old")).join(sums, ["topic", "cluster"], "left")
    new = F.coalesce("_m", "_old")
    shift = F.aggregate(F.zip_with(new, F.col("_old"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return both.select("topic", "cluster", new.alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("size"), F.lit(number).alias("round"), (shift > 1e-18).alias("moved"), F.lit(settings).alias("settings"))


def counters(spark: SparkSession, path: str) -> dict | None:
    """What a stored run has so far: settings, rounds, topics, labels and labelled vectors."""
    t = read_table(spark, f"{path}/centres", _CENTRES)
    row = t and t.agg(F.max("round").alias("rounds"), F.count_distinct("topic").alias("topics"), F.count_if(F.col("size") > 0).alias("labels"), F.sum("size").alias("vectors"), F.bool_or("moved").alias("moving"), F.first("settings").alias("settings")).first()
    return None if row is None or row["rounds"] is None else row.asDict() | {"settings": json.loads(row["settings"])}


def split(vectors: DataFrame, topics: DataFrame, path: str, settings: dict | None = None, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, topic_id, subtopic_id) with ids tNN and tNN_sNN, numbered without gaps.

    ``path``: where the progress is kept; ``settings``: values of ``RUN_SETTINGS`` that a run
    to go on from must share.  The centres, at most five for each topic, are sent to the tasks
    within ``FEW_NUMBERS``.
    """
    spark = vectors.sparkSession
    settings = {name: (settings or {}).get(name) for name in RUN_SETTINGS}
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    x = cut(x.join(topics.select(F.col(id_col).cast("long").alias("id"), F.col("topic").cast("long").alias("topic")), "id"))
    sizes = cut(x.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.max(F.size("v")).alias("dimensions")).withColumn("k", subcluster_count(F.col("size")).cast("int")))
    numbers = sizes.agg(F.sum(F.col("k").cast("long") * F.col("dimensions"))).first()[0] or 0
    if numbers > FEW_NUMBERS:
        raise ValueError(f"{numbers} numbers in all centres: split the topics in parts of at most {FEW_NUMBERS}")
    before = counters(spark, path)
    if before is None or not resumable(before["settings"], settings):
        start = _first_centres(x, sizes).select("topic", "cluster", "centre", F.lit(0).cast("long").alias("size"), F.lit(0).alias("round"), F.lit(True).alias("moved"), F.lit(json.dumps(settings)).alias("settings"))
        write_version(start.coalesce(1), f"{path}/centres")
        before = counters(spark, path)
    while before is not None and before["rounds"] < rounds and before["moving"]:
        made = _round(x, read_table(spark, f"{path}/centres", _CENTRES), before["rounds"] + 1, json.dumps(settings))
        write_version(made.coalesce(1), f"{path}/centres")
        before = counters(spark, path)
    centres = read_table(spark, f"{path}/centres", _CENTRES)
    large = _assigned(x, centres.collect()).select("id", "topic", "cluster")
    small = x.join(sizes.filter("size <= 3"), "topic").select("id", "topic", (F.row_number().over(Window.partitionBy("topic").orderBy("id")) - 1).cast("int").alias("cluster"))
    labels = cut(large.unionByName(small))
    used = labels.select("topic", "cluster").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy("cluster")) - 1)
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    topic = F.concat(F.lit("t"), two(F.col("topic")))
    return labels.join(used, ["topic", "cluster"]).select(F.col("id").alias(id_col), topic.alias("topic_id"), F.concat(topic, F.lit("_s"), two(F.col("_n"))).alias("subtopic_id"))
