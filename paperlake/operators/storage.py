"""Where tables that outlive one query are kept."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A local session without one gets a temporary folder; on a cluster that would be a folder
    other machines cannot see, so a missing setting is an error there.
    """
    holder = spark.sparkContext._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and holder.isEmpty() and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if holder.isEmpty():
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="paperlake-"))
    return configured or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for a frame that is read several times; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for costly work on them: an input of fewer partitions than
    there are cores is small and is dealt out anew; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: Seconds after which what no manifest names is taken for left over, not for in the making.
STALE = 3 * 86_400


def delete(spark: SparkSession, folder: str, which: Callable[[str], bool], age: float = 0) -> None:
    """Deletes the entries of a folder whose names are asked for, if they are old enough."""
    at, fs = _path(spark, folder)
    if fs.exists(at):
        for status in fs.listStatus(at):
            if status.getModificationTime() / 1000 <= time.time() - age and which(status.getPath().getName()):
                fs.delete(status.getPath(), True)


def file_stamp(df: DataFrame) -> str | None:
    """A fingerprint of the files that a frame reads, by path, size and time; None if there
    are none.  Each folder is listed once; no file is opened."""
    spark = df.sparkSession
    wanted = set(df.inputFiles())
    seen = []
    for folder in sorted({f.rpartition("/")[0] for f in wanted}):
        at, fs = _path(spark, folder)
        for status in fs.listStatus(at):
            seen.append(f"{status.getPath().getName()}:{status.getLen()}:{status.getModificationTime()}")
        seen.append(folder)
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest() if wanted else None


def names(spark: SparkSession, folder: str) -> set[str]:
    """The entries of a folder; none if it is not there."""
    at, fs = _path(spark, folder)
    return {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames to a name that must be free."""
    at, fs = _path(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(to) or not fs.rename(at, to):
        raise OSError(f"cannot rename {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    making = f"{path}.{uuid.uuid4().hex}.part"
    at, fs = _path(spark, making)
    fs.mkdirs(at.getParent())
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, making, path)


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
