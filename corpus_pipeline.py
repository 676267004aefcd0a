"""The corpus pipeline: five stages over ``documents``, each calling one operator.

A caller may write each stage's rows as Parquet and read them again as the next one's docs.
All stages but the last return the columns of ``documents``.

Defined results: rows without a letter are rejected by the first stage; repeated rows are
near-duplicates of each other, and of several rows with the smallest id the one of least text
hash, then the first by all columns, stays; null texts have no language and go; an empty table passes
through every stage as an empty table; further columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm import language, mixing, pieces, pii, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects go."""
    model = language.train(docs, ~language.held_out())
    return language.predict(docs, model, keep=COLUMNS).filter("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of smallest id.

    Documents are near duplicates if their fingerprints differ in at most four bits or their
    five-word shingles are similar to at least 0.8.
    """
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("mark"))
    found = simhash.near_copies(docs)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("s")).select("s.*")
    kept = marked.join(stays, marked["doc_id"].eqNullSafe(stays["doc_id"]) & (marked["mark"] == stays["mark"]), "left_semi")
    # rows of equal text may share the smallest id; the first by all columns stays
    first = Window.partitionBy("doc_id", "mark").orderBy(*COLUMNS)
    return kept.withColumn("row", F.row_number().over(first)).filter("row = 1").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date."""
    model = pii.train(docs)
    return pii.redact(docs.select(*COLUMNS), model).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.withColumn("copy", F.explode(F.expr("array_repeat(0, repeats)"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; every text must decode to itself."""
    model = pieces.Pieces.load()
    x = pieces.encode(docs.select(*COLUMNS), model, check="same")
    checked = F.when(F.coalesce("same", F.lit(True)), F.col("ids")).otherwise(F.raise_error(F.lit("a text does not decode to itself")).cast("array<int>"))
    return x.select(*COLUMNS, checked.alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: No stage can be expressed in SQL; tests/llm compares them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
