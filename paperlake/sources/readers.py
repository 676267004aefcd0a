"""Readers of source payloads, tables and markup, and the publishing of table versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.ids import text_of_positions
from paperlake.functions.text import absolute, squeeze, unescape, unlatex

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "abstract", "doi", "url", "source_provider", "track", "track_group", "presentation_level", "record_status")] + [
    T.StructField(n, T.ArrayType(T.StringType())) for n in ("authors", "keywords", "institutions", "quality_flags")] + [
    T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("source_ids", "field_provenance")] + [T.StructField("citation_count", T.LongType())])
PAYLOAD = T.StructType([
    T.StructField("query", T.StructType([T.StructField("venue_code", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("provider", T.StringType())])),
    T.StructField("generated_at_utc", T.StringType()), T.StructField("papers", T.ArrayType(RECORD)), T.StructField("_corrupt_record", T.StringType()),
])


def payloads(spark: SparkSession, glob: str) -> DataFrame:
    """One row per payload file with its path; none at all is an error."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", "[!._]*").schema(PAYLOAD).json(glob).withColumn("path", F.col("_metadata.file_path"))
    if df.isEmpty():
        raise FileNotFoundError(glob)
    return df


def records(files: DataFrame) -> DataFrame:
    """One row per paper; venue and year from the payload, else from the file's name."""
    name = F.regexp_extract("path", r"([A-Za-z]+)[-_/]?([0-9]{4})[^/]*\.json$", 1)
    year = F.regexp_extract("path", r"([A-Za-z]+)[-_/]?([0-9]{4})[^/]*\.json$", 2)
    return files.select(
        F.coalesce("query.venue_code", F.upper(F.nullif(name, F.lit("")))).alias("venue"), F.coalesce("query.year", year.try_cast("int")).alias("year"),
        F.col("generated_at_utc").alias("collected_at"), "path", F.posexplode("papers").alias("ord", "paper")).select("venue", "year", "collected_at", "path", "ord", "paper.*")


def tsv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """Tab-separated rows with a header; missing columns are an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df


def dblp(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """inproceedings and article elements of DBLP XML: kind, title, authors, year, doi."""
    schema = "title string, author array<string>, year int, ee array<string>, _key string"
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("kind", F.lit(tag))
    df = read("inproceedings").unionByName(read("article"))
    link = F.get(F.filter("ee", lambda e: e.contains("doi.org/")), F.lit(0))
    df = df.select("kind", F.col("_key").alias("key"), F.regexp_replace("title", r"\.$", "").alias("title"), F.col("author").alias("authors"), "year", F.nullif(F.regexp_extract(link, r"doi\.org/(10\..+)$", 1), F.lit("")).alias("doi"))
    return df if year is None else df.filter(F.col("year") == year)


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"(\w+)\s*=\s*")


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, key, fields) of each entry; values in balanced braces or quotes."""
    for m in _ENTRY.finditer(text):
        fields, at = {}, m.end()
        while f := _FIELD.search(text, at):
            if "}" in re.sub(r"[^}]", "", text[at : f.start()]):
                break
            i, depth, quoted = f.end(), 0, text[f.end() : f.end() + 1] == '"'
            start = i + 1 if quoted or text[i : i + 1] == "{" else i
            i = start
            while i < len(text):
                ch = text[i]
                if ch == "{":
                    depth += 1
                elif ch == "}" and depth:
                    depth -= 1
                elif (ch == '"' and quoted and not depth) or (ch == "}" and not quoted and not depth) or (ch == "," and start == f.end() and not depth):
                    break
                i += 1
            fields[f[1].lower()] = " ".join(text[start:i].split())
            at = i + 1
        yield m[1].lower(), m[2], fields


def bibtex(files: DataFrame, text: str = "value") -> DataFrame:
    """(kind, bib_key, title, authors, doi, abstract) of whole-file BibTeX texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, key, f.get("title"), f.get("author", ""), f.get("doi"), f.get("abstract")) for t in pdf[text] for k, key, f in bibtex_entries(t or "")]
            yield pd.DataFrame(rows, columns=["kind", "bib_key", "title", "author", "doi", "abstract"])

    x = files.select(text).mapInPandas(run, "kind string, bib_key string, title string, author string, doi string, abstract string")
    return x.select("kind", "bib_key", unlatex("title").alias("title"), F.filter(F.split("author", r"\s+and\s+"), lambda a: a != "").alias("authors"), "doi", unlatex("abstract").alias("abstract"))


def links(html: Column, url: Column) -> Column:
    """All anchors as (href, text), hrefs absolute."""
    hrefs = F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")), lambda z: F.struct(absolute(url, z["h"]).alias("href"), squeeze(unescape(z["t"])).alias("text")))


def meta_value(html: Column, *names: str) -> Column:
    """Content of the first of the named meta tags that is there, attributes in any order."""
    name = lambda n: rf"""\b(?:name|property)\s*=\s*["']{re.escape(n)}["']"""
    content = r"""\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""

    def value(n: str) -> Column:
        tag = F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*{name(n)})[^>]*>", 0)
        return F.nullif(F.concat(F.regexp_extract(tag, f"(?is){content}", 1), F.regexp_extract(tag, f"(?is){content}", 2)), F.lit(""))

    found = [value(n) for n in names]
    return unescape(F.coalesce(*found)) if len(found) > 1 else unescape(found[0])


def embedded_json(html: Column, script_id: str) -> Column:
    """Text of the JSON script with an id."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def cards(html: Column, start: str, fields: dict[str, str]) -> Column:
    """Cards of a listing page, as an array of structs.

    ``start``: pattern of a card's opening tag; a card reaches to the next one.  ``fields``:
    for each name the pattern whose first group is its markup; tags and entities go, runs of
    white space become one space, and what is not found is null.
    """
    parts = F.slice(F.split(html, start), F.lit(2), F.greatest(F.size(F.split(html, start)), F.lit(0)))
    text = lambda x: F.nullif(squeeze(unescape(F.regexp_replace(x, "<[^>]+>", " "))), F.lit(""))
    return F.transform(parts, lambda p: F.struct(*[text(F.regexp_extract(p, pattern, 1)).alias(name) for name, pattern in fields.items()]))


def corrupt_count(files: DataFrame) -> DataFrame:
    """One row: files and how many of them could not be read as a payload."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("_corrupt_record").isNotNull() & F.col("papers").isNull()).alias("corrupt"))


#: What of a saved API answer is the list of works (fixed values: field names of the APIs).
_WORKS = {"openalex": "results", "crossref": "message.items", "semantic_scholar": "data", "openreview": "notes"}
_SHAPES = {
    "openalex": "results array<struct<id:string,title:string,publication_year:int,doi:string,cited_by_count:long,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>>",
    "crossref": "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,`is-referenced-by-count`:long,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>>>",
    "semantic_scholar": "data array<struct<paperId:string,title:string,abstract:string,year:int,citationCount:long,externalIds:map<string,string>,authors:array<struct<name:string>>>>",
    "openreview": "notes array<struct<id:string,forum:string,content:map<string,string>>>",
}


def api_works(spark: SparkSession, path: str, api: str) -> DataFrame:
    """(path, id, title, authors, abstract, doi, year, citation_count) of saved API answers.

    ``api``: openalex, crossref, semantic_scholar, openreview (whole JSON answers) or arxiv
    (Atom).  A field an API does not have is null; an answer that is no JSON gives no rows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    if api == "arxiv":
        shape = "id string, title string, summary string, published string, author array<struct<name:string>>"
        x = spark.read.format("xml").option("rowTag", "entry").schema(shape).load(path)
        x = x.select(F.col("_metadata.file_path").alias("path"), "*")
        number = F.regexp_extract("id", r"abs/(.+?)(?:v[0-9]+)?$", 1)
        return x.select("path", number.alias("id"), squeeze(F.col("title")).alias("title"), F.transform("author", lambda a: squeeze(a["name"])).alias("authors"), squeeze(F.col("summary")).alias("abstract"), none("string").alias("doi"), F.substring("published", 1, 4).try_cast("int").alias("year"), none("long").alias("citation_count"))
    if api not in _WORKS:
        raise ValueError(f"unknown API {api}")
    x = spark.read.option("multiLine", True).schema(_SHAPES[api]).json(path)
    w = x.select(F.col("_metadata.file_path").alias("path"), F.explode(_WORKS[api]).alias("w")).select("path", "w.*")
    doi = lambda c: F.nullif(F.lower(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", "")), F.lit(""))
    if api == "openalex":
        words = F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("positions")))
        return w.select("path", F.regexp_extract("id", "([^/]*)$", 1).alias("id"), squeeze(F.col("title")).alias("title"), F.transform("authorships", lambda a: squeeze(a["author"]["display_name"])).alias("authors"), text_of_positions(words).alias("abstract"), doi(F.col("doi")).alias("doi"), F.col("publication_year").alias("year"), F.col("cited_by_count").alias("citation_count"))
    if api == "crossref":
        name = F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
        plain = squeeze(unescape(F.regexp_replace("abstract", "<[^>]+>", " ")))
        return w.select("path", F.lower("DOI").alias("id"), squeeze(F.get("title", F.lit(0))).alias("title"), name.alias("authors"), plain.alias("abstract"), doi(F.col("DOI")).alias("doi"), F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.col("`is-referenced-by-count`").alias("citation_count"))
    if api == "semantic_scholar":
        return w.select("path", F.col("paperId").alias("id"), squeeze(F.col("title")).alias("title"), F.transform("authors", lambda a: a["name"]).alias("authors"), "abstract", doi(F.col("externalIds")["DOI"]).alias("doi"), "year", F.col("citationCount").alias("citation_count"))
    # a note's fields are values or objects that hold one
    field = lambda name: F.coalesce(F.get_json_object(F.col("content")[name], "$.value"), F.col("content")[name])
    return w.select("path", F.coalesce("id", "forum").alias("id"), squeeze(field("title")).alias("title"), F.from_json(field("authors"), "array<string>").alias("authors"), field("abstract").alias("abstract"), none("string").alias("doi"), none("int").alias("year"), none("long").alias("citation_count"))


def with_doi_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of one proceedings, all of whose DOIs must start with its prefix."""
    wrong = F.raise_error(F.concat(F.lit(f"a DOI without {prefix}: "), F.coalesce("doi", F.lit("none")))).cast("string")
    return rows.withColumn("doi", F.when(F.coalesce(F.col("doi").startswith(prefix), F.lit(False)), F.col("doi")).otherwise(wrong))


def first_non_empty(candidates: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The first of several ways to select the same records that finds any; else the last."""
    for name, rows in candidates:
        if not rows.isEmpty():
            return name, rows
    return candidates[-1]


def largest(candidates: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The way that finds most records, the first of equals."""
    sizes = [rows.count() for _, rows in candidates]
    return candidates[sizes.index(max(sizes))]


def write_payloads(records: DataFrame, path: str) -> None:
    """One JSON payload for each venue and year, in folders by venue and year.

    Lists of papers are put together by venue and year, which editions bound.
    """
    fields = [f for f in records.columns if f not in ("venue", "year", "path", "ord", "collected_at")]
    papers = F.transform(F.array_sort(F.collect_list(F.struct("path", "ord", F.to_json(F.struct(*fields)).alias("p")))), lambda s: s["p"])
    at = F.to_json(F.struct(F.struct(F.col("venue").alias("venue_code"), F.col("year")).alias("query"), F.max("collected_at").alias("generated_at_utc")))
    text = F.concat(F.regexp_replace(at, r"\}$", ""), F.lit(',"papers":['), F.array_join(papers, ","), F.lit("]}"))
    made = records.groupBy("venue", "year").agg(text.alias("value"))
    made.withColumns({"_venue": F.col("venue"), "_year": F.col("year")}).select("value", "_venue", "_year").write.mode("overwrite").partitionBy("_venue", "_year").text(path)
