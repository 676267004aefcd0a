"""Reports: rendered tables, suites, file fingerprints, failed rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import evaluate as E
from paperlake.operators import index as N

#: Files up to this size are fingerprinted by content, larger ones by size and time.
CONTENT_BYTES = 4 << 20


def markdown(rows: DataFrame, limit: int = 50, width: int = 80) -> str:
    """A page of rows as a Markdown table; longer cells end in an ellipsis."""
    def cell(x: object) -> str:
        s = "; ".join(map(str, x)) if isinstance(x, list) else "" if x is None else str(x)
        s = " ".join(s.split()).replace("|", "\\|")
        return s if len(s) <= width else s[: width - 1] + "…"

    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in rows.limit(limit).collect())]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def file_fingerprints(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(name, fingerprint) of every file below a folder, whose base name ``names`` matches.

    A name is the path below the folder.  Only small files are opened; the size is a filter of
    the scan, so the contents of larger ones are not read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    name = F.when(F.startswith("path", F.lit(root)), F.substring("path", F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path")).alias("name")
    by_content = files.filter(F.col("length") <= CONTENT_BYTES).select(name, F.sha2("content", 256).alias("fingerprint"))
    by_stat = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return by_content.unionByName(files.filter(F.col("length") > CONTENT_BYTES).select(name, by_stat.alias("fingerprint")))


def collection_fingerprint(files: DataFrame) -> DataFrame:
    """One row: a fingerprint of all files' names and fingerprints, whatever their order.

    Each file's digest is cut into numbers, which are added up over all files in partial sums;
    the sums are hashed.  No list of the files is made.
    """
    each = files.select(F.sha2(F.to_json(F.struct("name", "fingerprint")), 256).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 13 * i, 13), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]
    return each.agg(F.sha2(F.concat_ws(":", *parts, F.count(F.lit(1)).cast("string")), 256).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def failed_rows(rows: DataFrame) -> DataFrame:
    """Rows whose status is failed."""
    return rows.filter(F.col("status") == "failed")


def backup(spark: SparkSession, path: str, root: str, run: str) -> str:
    """Copies a file or folder to ``root/run`` before it is written over; where the copy is.

    A backup that a run has already made stays: it is the state from before the run.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(f"{root}/{run}/{path.rstrip('/').rpartition('/')[2]}")
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    if not to.exists(target):
        making = hadoop.Path(f"{root}/{run}/_making-{uuid.uuid4().hex}")
        hadoop.FileUtil.copy(fs, source, to, making, False, conf)
        if not to.rename(making, target):
            raise OSError(f"cannot back up {path}")
    return target.toString()


def write_back(rows: DataFrame, path: str, root: str, run: str) -> str | None:
    """Writes a payload folder over after backing it up; where the backup is.

    The new files are written whole before the old ones go, so rows may come from them.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = backup(spark, path, root, run) if fs.exists(at) else None
    making = f"{path.rstrip('/')}._new-{uuid.uuid4().hex}"
    rows.write.json(making)
    fs.delete(at, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(making), at):
        raise OSError(f"cannot write back {path}")
    return kept


def suites(papers: DataFrame, cases: list[E.Case], which: str = "offline", healthy: bool = True, index: N.Index | None = None) -> DataFrame:
    """(suite, cases, passed): offline forces plain search; online runs only if healthy."""
    if which not in ("offline", "online", "all"):
        raise ValueError(f"unknown suite {which}")
    wanted = ["offline", "online"] if which == "all" else [which]
    out: DataFrame | None = None
    for name in wanted:
        if name == "online" and not healthy:
            row = papers.sparkSession.createDataFrame([(name, 0, False)], "suite string, cases long, passed boolean")
        else:
            row = E.run_cases(papers, cases, index).agg(F.count(F.lit(1)).alias("cases"), F.bool_and("passed").alias("passed")).select(F.lit(name).alias("suite"), "cases", "passed")
        out = row if out is None else out.unionByName(row)
    return out


def status(report: DataFrame, recorded: dict[str, str] | None, current: dict[str, str]) -> str:
    """One line: passed or failed suites, and whether the report is out of date."""
    rows = report.collect()
    state = "pass" if all(r["passed"] for r in rows) else "fail"
    return f"{state} ({', '.join(r['suite'] for r in rows)})" + (", stale" if E.stale(recorded, current) else "")
