"""Catalog of canonical papers: build, validate, reindex, stats, search, export, doctor.

A catalog is a folder of versioned Parquet tables; a build writes new versions and moves the
pointers last, so a failed build leaves the old tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions.ids import sorted_json
from paperlake.operators import evaluate as E
from paperlake.operators import index as N
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.streaming.upsert import read_table, write_version

LISTS = ("authors", "keywords", "institutions", "quality_flags")


def children(papers: DataFrame, name: str) -> DataFrame:
    """(paper_id, idx, value) of a list column, blanks left out."""
    x = papers.select("paper_id", F.posexplode(name).alias("idx", "value"))
    return x.filter(F.trim("value") != "")


def build(papers: DataFrame, path: str) -> None:
    """All tables of the catalog from canonical papers."""
    made = {"papers": papers.drop(*LISTS, "source_ids")}
    made |= {name: children(papers, name) for name in LISTS}
    made["source_ids"] = papers.select("paper_id", F.explode("source_ids").alias("source_key", "source_value"))
    for name in sorted(made, key="papers".__eq__):  # the papers come last
        write_version(made[name], f"{path}/{name}")
    reindex(papers.sparkSession, path)


def reindex(spark: SparkSession, path: str) -> N.Index:
    """The index brought up to date with the stored papers; only what changed is read anew."""
    return N.refresh(load(spark, path, "papers"), f"{path}/index")


def index_of(spark: SparkSession, path: str) -> N.Index:
    found = N.read(spark, f"{path}/index")
    if found is None:
        raise FileNotFoundError(f"{path} has no index: build the catalog first")
    return found


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = read_table(spark, f"{path}/{name}")
    if df is None:
        raise FileNotFoundError(f"{path} has no table {name}: build the catalog first")
    return df


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, n): totals, counts by status and by venue and year, indexed papers."""
    p = load(spark, path, "papers")
    rows = F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("status").alias("kind"), F.col("record_status").alias("name")),
        F.struct(F.lit("venue-year").alias("kind"), F.concat_ws("-", "venue", F.col("year").cast("string")).alias("name"))))
    out = p.select(rows.alias("r")).groupBy("r.kind", "r.name").agg(F.count(F.lit(1)).alias("n")).select("kind", "name", "n")
    return out.unionByName(spark.createDataFrame([("indexed", "", index_of(spark, path).n)], "kind string, name string, n long"))


def validate(spark: SparkSession, path: str, papers: DataFrame) -> DataFrame:
    """(check, passed): the stored tables against the canonical papers."""
    stored = load(spark, path, "papers")
    raw = papers.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.size(c)).alias(c) for c in LISTS])
    row = raw.crossJoin(stored.agg(F.count(F.lit(1)).alias("m"), F.countDistinct("paper_id").alias("u"), F.count_if(F.trim("title") == "").alias("blank")))
    row = row.crossJoin(index_of(spark, path).texts().join(stored.select("paper_id"), "paper_id", "left_semi").agg(F.count(F.lit(1)).alias("found")))
    row = row.withColumn("indexed", F.when(F.col("found") == index_of(spark, path).n, F.col("found")))
    checks: list[tuple[str, Column]] = [("papers", F.col("n") == F.col("m")), ("ids unique", F.col("m") == F.col("u")), ("titles", F.col("blank") == 0), ("index aligned", F.col("m") == F.col("indexed"))]
    for c in LISTS:
        row = row.crossJoin(load(spark, path, c).agg(F.count(F.lit(1)).alias(f"{c}_n")))
        checks.append((c, F.col(c) == F.col(f"{c}_n")))
    return E.checks(checks, row)


def search(spark: SparkSession, path: str, text: str, filters: S.Filters | None = None, by: str = "bm25", top_k: int = 20, offset: int = 0) -> DataFrame:
    """One page of hits from the stored index; texts and lists are read for the page alone."""
    papers = load(spark, path, "papers")
    wide = ["title", "abstract"]
    page = S.page(N.find(papers.drop(*wide), index_of(spark, path), text, filters), S.order(by), top_k, offset)
    return hydrate(spark, path, N.with_columns(page, papers, "paper_id", wide).select(*papers.columns, "score", "rank"), ("authors", "keywords"))


def hydrate(spark: SparkSession, path: str, page: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """A page's rows with their lists."""
    for name in lists:
        kids = load(spark, path, name).join(F.broadcast(page.select("paper_id")), "paper_id", "left_semi")
        page = R.with_children(page, R.ordered_children(kids, "paper_id", "idx", "value", name), "paper_id", name)
    return page


def get(spark: SparkSession, path: str, paper_id: str) -> DataFrame:
    """One paper with all its lists."""
    return hydrate(spark, path, load(spark, path, "papers").filter(F.col("paper_id") == paper_id), LISTS)


def export(rows: DataFrame, groups: list[tuple[str, list[str]]], topics: DataFrame | None = None) -> DataFrame:
    """Rows as TSV cells with the first matching label and, if known, the topic."""
    text = F.concat_ws(" ", "title", "abstract", F.array_join("keywords", " "))
    x = rows.withColumn("label", X.first_label(text, groups))
    if topics is not None:
        x = x.join(topics.groupBy("paper_id").agg(F.min_by("topic_name", "ord").alias("topic_name")), "paper_id", "left")
    else:
        x = x.withColumn("topic_name", F.lit(""))
    cells = {"array<string>": lambda c: F.array_join(c, "; "), "map<string,string>": lambda c: sorted_json(F.col(c))}
    return x.select(*[X.tsv_cell(cells.get(f.dataType.simpleString(), lambda c: F.col(c).cast("string"))(f.name)).alias(f.name) for f in x.schema.fields])


def write_tsv(rows: DataFrame, path: str, order: list[str]) -> None:
    rows.repartitionByRange(1, *order).sortWithinPartitions(*order).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def doctor(spark: SparkSession, path: str, vectors: DataFrame | None = None) -> DataFrame:
    """(check, severity, passed): table readability, index alignment, vector coverage."""
    rows: list[tuple[str, str, bool]] = []
    for name in ("papers", "index", *LISTS, "source_ids"):
        try:
            (index_of(spark, path).texts() if name == "index" else load(spark, path, name)).limit(1).collect()
            rows.append((f"table {name}", "error", True))
        except Exception:  # noqa: BLE001  any failure to read is the finding
            rows.append((f"table {name}", "error", False))
    out = spark.createDataFrame(rows, "check string, severity string, passed boolean")
    if vectors is not None:
        expected = load(spark, path, "papers").filter("record_status <> 'placeholder'")
        sides = R.id_coverage(expected, vectors, "paper_id").agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))
        out = out.unionByName(E.checks([("no vector missing", F.col("missing") == 0), ("no vector extra", F.col("extra") == 0)], sides).withColumn("severity", F.lit("warning")).select("check", "severity", "passed"))
    return out
