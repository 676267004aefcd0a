"""Keyed rows with their order value, in buckets of which a change rewrites only some.

A row is in the bucket of its key's hash.  A batch of changes reads and writes the buckets of
its own keys; of each key the row of the largest order value stays, whenever it comes, so a
late row loses and batches may come in any order.  A deleted key stays as a tombstone, so that
rows older than its deletion lose too.  Which folder has a bucket's rows now is in a manifest,
published by a rename; readers see a batch as a whole or not at all.  One writer at a time.

Ties of the order value go to the deletion, then to the larger hash of the row, so a repeated
batch changes nothing.  Rows of a null key or null order value are errors.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.storage import cut, delete
from paperlake.streaming.upsert import read_table, versions, write_version

_GONE = "_deleted"


@dataclass(frozen=True)
class Keyed:
    """A table of ``schema`` at ``path``; ``folders``: by bucket, where its rows are."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    order: str
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{self.folders[b]}" for b in buckets]
        schema = f"{self.schema}, `{_GONE}` boolean"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The rows of all keys that are not deleted."""
        return self._rows(sorted(self.folders)).filter(f"not {_GONE}").drop(_GONE)

    def find(self, keys: list) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        lits = [F.lit(k) for k in keys]
        wanted = self.spark.range(1).select(F.explode(F.array(*lits).cast(f"array<{self._key_type()}>")).alias(self.key)).select(self._bucket().cast("string").alias("b")).distinct().collect()
        found = self._rows(sorted(b for r in wanted if (b := r["b"]) in self.folders))
        return found.filter(F.col(self.key).isin(keys) & ~F.col(_GONE)).drop(_GONE)

    def _key_type(self) -> str:
        return self.spark.createDataFrame([], self.schema).schema[self.key].dataType.simpleString()

    def apply(self, changes: DataFrame, deleted: str | None = None) -> Keyed:
        """The table after a batch of changes; ``deleted``: a column that marks deletions."""
        gone = F.lit(False) if deleted is None else F.coalesce(F.col(deleted), F.lit(False))
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        known = F.col(self.key).isNotNull() & F.col(self.order).isNotNull()
        key = F.when(known, F.col(self.key)).otherwise(F.raise_error(F.lit("a change without key or order")).cast(self._key_type()))
        new = changes.select(*[key.alias(c) if c == self.key else F.col(c) for c in columns], gone.alias(_GONE))
        # the batch's own last rows, read several times
        new = cut(self._last(new).withColumn("_b", self._bucket()))
        touched = sorted(str(r["_b"]) for r in new.select("_b").distinct().collect())  # at most ``buckets``
        if not touched:
            return self
        old = self._rows([b for b in touched if b in self.folders])
        merged = self._last(old.unionByName(new.drop("_b"))).withColumn("bucket", self._bucket())
        folder = f"rows-{uuid.uuid4().hex}"
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        now = Keyed(self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.folders | {b: f"{folder}/bucket={b}" for b in touched})
        now._publish()
        return now

    def _last(self, rows: DataFrame) -> DataFrame:
        fields = F.struct(*rows.columns)
        rank = F.struct(self.order, _GONE, F.xxhash64(*rows.columns))
        return rows.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(fields, rank).alias("_r")).select("_r.*")

    def _publish(self) -> None:
        state = {k: getattr(self, k) for k in ("schema", "key", "order", "buckets", "folders")}
        write_version(self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1), f"{self.path}/manifest")
        kept: set[str] = set()
        for v in versions(self.spark, f"{self.path}/manifest"):
            text = self.spark.read.schema("state string").parquet(f"{self.path}/manifest/v{v:012d}").first()["state"]
            kept |= {f.partition("/")[0] for f in json.loads(text)["folders"].values()}
        # a folder goes when no bucket in a kept manifest is read from it
        delete(self.spark, self.path, lambda n: n.startswith("rows-") and n not in kept)


def open_keyed(spark: SparkSession, path: str, schema: str | None = None, key: str | None = None, order: str | None = None, buckets: int = 64) -> Keyed:
    """The table at a path; what is given is used if there is none yet."""
    found = read_table(spark, f"{path}/manifest", "state string")
    if found is not None:
        return Keyed(spark, path, **json.loads(found.first()["state"]))
    if schema is None or key is None or order is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    return Keyed(spark, path, schema, key, order, buckets)


def keyed_stream(source: DataFrame, path: str, key: str, order: str, checkpoint: str, deleted: str | None = None, buckets: int = 64):
    """Starts a stream that folds each micro-batch into the keyed table.  A batch that runs
    again changes nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != deleted)

    def fold(batch: DataFrame, batch_id: int) -> None:
        open_keyed(batch.sparkSession, path, schema, key, order, buckets).apply(batch, deleted)

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(batches: list[DataFrame], path: str, key: str, order: str, deleted: str | None = None, buckets: int = 64) -> Keyed:
    """Batches applied one after the other."""
    first = batches[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields if f.name != deleted)
    start = open_keyed(first.sparkSession, path, schema, key, order, buckets)
    return reduce(lambda table, batch: table.apply(batch, deleted), batches, start)
