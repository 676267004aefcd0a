"""Named queries over the standard tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.index import Index, refresh, source_name
from paperlake.operators.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under a name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scalar(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None) -> None:
    """A query of column functions over one table, with the SQL of each column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[c.alias(k) for k, c in columns().items()])

    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT {key}, " + ", ".join(f"{s} AS {k}" for k, s in sql.items()) + f" FROM {source}"


def search_index(spark: SparkSession, sf_dir: str) -> Index:
    """The lasting full-text index of a folder's papers, brought up to date if they changed."""
    path = f"{shared_dir(spark).rstrip('/')}/search-{source_name(sf_dir)}"
    return refresh(papers(spark, sf_dir, labelled=False).select("paper_id", "title", "abstract"), path)


#: Papers as the standard tables give them; the same rows in both languages.
PAPERS_SQL = """papers AS (
  SELECT d.doc_id AS paper_id, split_part(d.text, chr(10), 1) AS title,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS abstract,
         upper(d.lang) AS venue, CAST(2000 + d.doc_id % 25 AS INTEGER) AS year, d.source AS track,
         CASE WHEN d.doc_id % 3 = 0 THEN 'oral' WHEN d.doc_id % 7 = 0 THEN 'bestpaper' ELSE 'poster' END AS presentation_level,
         CAST(l.quality AS BIGINT) AS citation_count, CASE WHEN l.toxic = 1 THEN 'placeholder' ELSE 'resolved' END AS record_status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def papers(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """documents and labels as papers: first line the title, the rest the abstract."""
    d = table(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    none = F.lit(None).cast("int")
    x = d.join(table(spark, sf_dir, "labels"), "doc_id", "left") if labelled else d.withColumns({"quality": none, "toxic": none})
    return x.select(
        F.col("doc_id").alias("paper_id"), title.alias("title"), F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("abstract"),
        F.upper("lang").alias("venue"), (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"), F.col("source").alias("track"),
        F.when(F.col("doc_id") % 3 == 0, "oral").when(F.col("doc_id") % 7 == 0, "bestpaper").otherwise("poster").alias("presentation_level"),
        F.col("quality").cast("long").alias("citation_count"),
        F.when(F.col("toxic") == 1, "placeholder").otherwise("resolved").alias("record_status"),
    )
