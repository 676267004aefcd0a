"""Keyed merges and atomic table versions; ``state.py`` has keyed tables for streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(current: DataFrame, changes: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """Current rows with changed ones replaced or added and deleted keys gone."""
    gone = changes.select(key) if deleted is None else changes.select(key).unionByName(deleted.select(key))
    return current.join(gone.distinct(), key, "left_anti").unionByName(changes)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    fields = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(fields, F.struct(order, F.xxhash64(*rows.columns))).alias("_r")).select("_r.*")


#: Versions that stay beside the newest, for readers that have opened them.
KEPT = 2


def _files(spark: SparkSession, table: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    path, fs = _files(spark, table)
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_version(rows: DataFrame, table: str, kept: int = KEPT) -> str:
    """Writes a new version and publishes it by one rename; the old one stays if that fails.

    A version is written under a name of its own and renamed to the next number when it is
    whole.  Nothing is deleted or replaced before, so a crash at any point leaves the newest
    published version as it was.  A table has one writer at a time.  Older versions than the
    ``kept`` last go afterwards.
    """
    spark = rows.sparkSession
    path, fs = _files(spark, table)
    made = f"{table}/_new-{uuid.uuid4().hex}"
    rows.write.parquet(made)
    old = versions(spark, table)
    name = f"v{(old[-1] if old else 0) + 1:012d}"
    of = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(of(f"{table}/{name}")) or not fs.rename(of(made), of(f"{table}/{name}")):
        raise OSError(f"cannot publish {name}")
    for n in old[: len(old) - kept]:
        fs.delete(of(f"{table}/v{n:012d}"), True)
    return name


def read_table(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame | None:
    """The newest published version, or None before the first; a known schema saves a look at
    the files."""
    found = versions(spark, table)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{table}/v{found[-1]:012d}") if found else None


def roll_back(spark: SparkSession, tables: dict[str, int | None]) -> None:
    """Takes back what was published after the given versions, last table first."""
    for table, number in reversed(list(tables.items())):
        _, fs = _files(spark, table)
        for n in reversed(versions(spark, table)):
            if number is None or n > number:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{n:012d}"), True)


def publish_all(made: dict[str, DataFrame], check: Callable[[], None] | None = None) -> None:
    """Publishes several tables in order, or none of them.

    The versions from before are the backup: if writing one table or the check fails, those
    already published are taken back in reverse order and the error goes on.
    """
    if not made:
        return
    spark = next(iter(made.values())).sparkSession
    before = {table: max(versions(spark, table), default=None) for table in made}
    done: dict[str, int | None] = {}
    try:
        for table, rows in made.items():
            done[table] = before[table]
            write_version(rows, table)
        if check is not None:
            check()
    except BaseException:
        roll_back(spark, done)
        raise
