"""Helpers shared by the operators: reliable lineage cuts, components, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.storage import shared_dir

#: Words are maximal runs of characters other than space and \x09-\x0D.
WORD_PATTERN = r"[^ \x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Fewer rows in each Arrow batch of what runs inside: whole texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, for small frames read several times."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def cut_table(df: DataFrame, name: str) -> DataFrame:
    """Compressed table in the shared folder, for larger frames read several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/paperlake-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _digest(df: DataFrame) -> tuple[int, int]:
    """Count and an order-free checksum of the rows."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a task holds few texts as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Up to so many links (16 bytes each) one task finds the components; beyond, star rounds do.
ONE_TASK_LINKS = 500_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the links (hi, lo) with the smallest node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["hi", "r"])


def _stars(links: DataFrame, seen: tuple[int, int]) -> DataFrame:
    """(hi, r) by alternating large-star and small-star rounds on the links."""
    while True:
        both = links.union(links.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour is tied to the least of the neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        joined = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(joined.select("hi", F.col("m").alias("lo")))
        links = cut(small.filter("hi != lo").distinct())
        before, seen = seen, _digest(links)
        if before == seen:
            return links.groupBy("hi").agg(F.min("lo").alias("r"))


def components(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, root): the smallest node that each node can reach over undirected edges.

    ``nodes``: one column ``node`` (long); ``edges``: ``a``, ``b`` among the nodes; self
    loops and repeats are harmless.  Few links (checked against ``one_task``) go to one
    task's union-find; more take distributed star rounds, in which every round aggregates a
    minimum with map-side combining, so hubs cost no skewed list.  Nodes without an edge
    are their own root.
    """
    links = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = _digest(links)
    if seen[0] <= one_task:
        roots = links.coalesce(1).mapInArrow(_union, "hi long, r long")
    else:
        roots = _stars(links, seen)
    return nodes.join(roots, nodes["node"] == roots["hi"], "left").select("node", F.coalesce("r", "node").alias("root"))
