"""A stored nearest-neighbour index: vectors in inverted lists by centroid.

Centroids are fitted on a bounded sample; every vector is stored in the list of its nearest
one, a partition of the table, split into files where a list is long.  A search ranks the
lists by their centroids and reads only the nearest; distances of what it reads are exact.
In the exact way it then reads every list that can still hold a nearer vector: by the
triangle inequality, one whose centroid is not farther than its radius and the n-th distance
found together.

Distances of directions are cosine distances.  Vectors that are null, zero or hold a null or
an odd component have no direction and no place in the index.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import vectors as V
from paperlake.operators.storage import STALE, cut, delete, file_stamp
from paperlake.streaming.upsert import read_table, versions, write_version

#: Vectors of the sample for each list; the most lists; lists that a search reads first.
SAMPLE, MOST_LISTS, PROBES = 64, 4096, 8
#: Numbers in all centroids: the driver and every task hold them.
MOST_NUMBERS = 8_000_000


@dataclass(frozen=True)
class Lists:
    spark: SparkSession
    path: str
    folder: str
    key: str
    key_type: str
    stamp: str | None
    centroids: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def rows(self, which: list[int]) -> DataFrame:
        """(key, v) of some lists; only their partitions are read."""
        stored = self.spark.read.schema(f"`{self.key}` {self.key_type}, v array<double>, list int").parquet(f"{self.path}/{self.folder}/lists")
        return stored.filter(F.col("list").isin(which)).drop("list")

    def _ranked(self, query: list[float]) -> tuple[np.ndarray, np.ndarray]:
        q = np.array(query, float)
        away = np.sqrt(((self.centroids - q / np.linalg.norm(q)) ** 2).sum(1))
        return np.argsort(away, kind="stable"), away

    def search(self, query: list[float], n: int, probes: int = PROBES, exact: bool = False, digits: int = 6) -> DataFrame:
        """(key, distance) of the n nearest of the lists read, ties by key; distances are
        compared as rounded to ``digits``."""
        order, away = self._ranked(query)
        first = order[:probes]
        if exact and len(first) < len(order):
            # first as many lists as hold n vectors
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), n)) + 1
            first = order[: max(probes, enough)]
            found = self._nearest(first, query, n, digits).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).first()
            if found["n"] < n:
                first = order
            else:
                # the distance of two directions is the root of twice their cosine distance
                reach = math.sqrt(2 * (found["d"] + 10.0**-digits)) + 1e-9
                first = order[(away[order] <= reach + self.radii[order]) | np.isin(order, first)]
        return self._nearest(first, query, n, digits)

    def _nearest(self, which: np.ndarray, query: list[float], n: int, digits: int) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in query])
        x = self.rows([int(self.numbers[i]) for i in which])
        return x.select(self.key, F.round(V.distance(F.col("v"), q, "cosine"), digits).alias("distance")).orderBy("distance", self.key).limit(n)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), v.alias("v")).filter((F.size("v") > 0) & ~odd)
    return plain.filter(V.dot(F.col("v"), F.col("v")) > 0)


def _directions(column: pd.Series) -> np.ndarray:
    v = np.array(column.tolist(), float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def read(spark: SparkSession, path: str) -> Lists | None:
    found = read_table(spark, f"{path}/manifest", "state string")
    if found is None:
        return None
    state = json.loads(found.first()["state"])
    rows = spark.read.schema("list int, centre array<double>, n long, radius double").parquet(f"{path}/{state['folder']}/centroids").orderBy("list").collect()
    return Lists(spark, path, state["folder"], state["key"], state["key_type"], state["stamp"], np.array([r["centre"] for r in rows], float), np.array([r["list"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["radius"] for r in rows]))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, seed: int = 42) -> Lists:
    """The index of ``vectors``: as it is if their files are the same, else written anew and
    published by a rename.  Lists: the square root of the count, within the bounds."""
    spark, stamp = vectors.sparkSession, file_stamp(vectors)
    old = read(spark, path)
    if old is not None and stamp is not None and old.stamp == stamp:
        return old
    key_type = vectors.schema[id_col].dataType.simpleString()
    x = _usable(vectors, id_col, vec_col)
    row = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e")).first()
    if not row["n"]:
        raise ValueError("no vector to index")
    if row["d"] != row["e"]:
        raise ValueError("vectors of several dimensions")
    k = max(1, min(lists or math.isqrt(row["n"]), MOST_LISTS, MOST_NUMBERS // row["d"]))
    centres = np.zeros((1, row["d"]))
    if k > 1:
        share = min(1.0, SAMPLE * k / row["n"])
        sample = x.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) <= int(share * (1 << 20)))
        norm = F.sqrt(V.dot(F.col("v"), F.col("v")))
        unit = sample.select(F.transform("v", lambda c: c / norm).alias("u"))
        model = KMeans(k=k, seed=seed, initSteps=2, maxIter=15).fit(cut(unit).select(array_to_vector("u").alias("features")))
        centres = np.array(model.clusterCenters())
    shared = spark.sparkContext.broadcast(centres)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                u, c = _directions(pdf["v"]), shared.value
                near = (-2 * u @ c.T + (c * c).sum(1)).argmin(1)
                yield pdf.assign(list=near.astype(np.int32), away=np.sqrt(((u - c[near]) ** 2).sum(1)))

    folder = f"lists-{uuid.uuid4().hex}"
    placed = x.mapInPandas(place, f"`{id_col}` {key_type}, v array<double>, list int, away double")
    placed.write.parquet(f"{path}/{folder}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/{folder}/placed")
    placed.drop("away").repartitionByRange("list", id_col).write.partitionBy("list").parquet(f"{path}/{folder}/lists")
    facts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    named.join(facts, "list").select("list", "centre", "n", "radius").coalesce(1).write.parquet(f"{path}/{folder}/centroids")
    delete(spark, f"{path}/{folder}", lambda n: n == "placed")
    state = json.dumps({"folder": folder, "key": id_col, "key_type": key_type, "stamp": stamp})
    try:
        write_version(spark.createDataFrame([(state,)], "state string").coalesce(1), f"{path}/manifest")
    except OSError:  # another run may have published the same meanwhile
        other = read(spark, path)
        if stamp is None or other is None or other.stamp != stamp:
            raise
        return other
    kept = {json.loads(spark.read.schema("state string").parquet(f"{path}/manifest/v{v:012d}").first()["state"])["folder"] for v in versions(spark, f"{path}/manifest")}
    delete(spark, path, lambda n: n.startswith("lists-") and n not in kept, STALE)
    return read(spark, path)
