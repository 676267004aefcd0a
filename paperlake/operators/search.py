"""Full-text search: query phrases, boolean AND match, BM25, filters, paging, candidates.

Tokens are runs of letters and digits, lower-cased, Latin accents folded.  Every word of a
query is a literal AND term; parts of a word joined by ``_`` form a phrase, which occurs where
they stand next to each other in one field, and counts as one term.  N, document frequencies
and the average length are those of the whole table, whatever filters a search has.

The functions here scan the texts; ``index.py`` has the stored index.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _accents() -> tuple[str, str]:
    plain = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0xC0, 0x250)}
    pairs = [(a, b) for a, b in plain.items() if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(x: Column) -> Column:
    """Lower-cased without Latin accents; plain ASCII texts skip the character map."""
    low = F.lower(x)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_accents())).otherwise(low)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@cache
def _folding() -> dict[int, str]:
    return str.maketrans(*_accents())


def fold_text(text: str) -> str:
    """``fold`` for one string."""
    low = text.lower()
    return low if low.isascii() else low.translate(_folding())


def query_phrases(text: str) -> list[tuple[str, ...]]:
    """The query's words in order, repeats included; each is a phrase of one or more terms.

    Words are runs of letters, digits and ``_``; the parts between ``_`` must stand next to
    each other.  A query without a word is an error; a word without a part asks for nothing.
    """
    words = re.findall(r"\w+", text)
    if not words:
        raise ValueError("the query has no token")
    found = (tuple(re.findall(r"[^\W_]+", fold_text(w))) for w in words)
    return [p for p in found if p]


def document(title: str = "title", abstract: str = "abstract") -> Column:
    return F.concat_ws(" ", title, abstract)


@dataclass(frozen=True)
class Filters:
    """Optional AND-ed conditions; placeholders are left out unless asked for."""

    venues: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    track: str | None = None
    presentation_level: str | None = None
    include_placeholder: bool = False

    def condition(self) -> Column:
        c = F.lit(True)
        if self.venues:
            c = c & F.col("venue").isin(*self.venues)
        if self.year_from is not None:
            c = c & (F.col("year") >= self.year_from)
        if self.year_to is not None:
            c = c & (F.col("year") <= self.year_to)
        if self.track is not None:
            c = c & (F.col("track") == self.track)
        if self.presentation_level is not None:
            c = c & (F.col("presentation_level") == self.presentation_level)
        if not self.include_placeholder:
            c = c & (F.col("record_status") != "placeholder")
        return c


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def weight(tf: Column, dl: Column, df: Column, n: Column, average: Column) -> Column:
    """What a phrase adds to a match."""
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _count(phrase: tuple[str, ...]) -> Column:
    """How often a phrase occurs in the token lists ``_t0`` (title) and ``_t1`` (abstract)."""
    def here(name: str) -> Column:
        return F.size(F.filter(name, lambda v, i: all_of([(v if k == 0 else F.coalesce(F.get(F.col(name), i + k), F.lit(""))) == t for k, t in enumerate(phrase)])))

    return here("_t0") + here("_t1")


def matches(papers: DataFrame, text: str, filters: Filters | None = None) -> DataFrame:
    """Papers that hold every phrase and pass the filters, by a scan."""
    x = papers.filter((filters or Filters()).condition()).withColumns({"_t0": tokens(F.col("title")), "_t1": tokens(F.col("abstract"))})
    phrases = query_phrases(text)
    return x.filter(all_of([_count(p) > 0 for p in phrases]) if phrases else F.lit(False)).drop("_t0", "_t1")


def bm25(papers: DataFrame, text: str, filters: Filters | None = None) -> DataFrame:
    """Matching papers with their score (lower is better), by a scan of all texts.

    Global figures come from one aggregation to a single row, joined by broadcast.
    """
    asked = query_phrases(text)
    phrases = list(dict.fromkeys(asked))
    x = papers.withColumns({"_t0": tokens(F.col("title")), "_t1": tokens(F.col("abstract"))})
    counted = x.withColumns({f"_tf{i}": _count(p) for i, p in enumerate(phrases)}).withColumn("dl", F.size("_t0") + F.size("_t1")).drop("_t0", "_t1")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
    hit = all_of([F.col(f"_tf{i}") > 0 for i in range(len(phrases))]) if phrases else F.lit(False)
    total = F.lit(0.0)
    for i, p in enumerate(phrases):
        total = total - asked.count(p) * weight(F.col(f"_tf{i}"), F.col("dl"), F.col(f"_df{i}"), F.col("_n"), F.col("_avg"))
    rows = counted.filter((filters or Filters()).condition()).filter(hit).crossJoin(F.broadcast(stats))
    return rows.select(*papers.columns, total.alias("score"))


#: Sort orders by name; every one ends in the id, so results are deterministic.
def order(by: str, key: str = "paper_id") -> list[Column]:
    cited = F.coalesce(F.col("citation_count"), F.lit(-1)).desc()
    if by == "bm25":
        return [F.round("score", 9).asc(), F.col("year").desc(), cited, F.col(key).asc()]
    if by == "year":
        return [F.col("year").desc(), cited, F.col(key).asc()]
    if by == "citation":
        return [cited, F.col("year").desc(), F.col(key).asc()]
    raise ValueError(f"unknown order {by}")


def page(rows: DataFrame, by: list[Column], top_k: int = 20, offset: int = 0) -> DataFrame:
    """Rows of one page with 1-based ranks; ranks are numbered on the page alone."""
    if top_k <= 0 or offset < 0:
        raise ValueError("top_k must be positive and offset not negative")
    cut = rows.orderBy(*by).offset(offset).limit(top_k)
    return cut.withColumn("rank", (F.row_number().over(Window.orderBy(*by)) + offset).cast("int"))


def candidate_union(papers: DataFrame, texts: list[str], key: str = "paper_id") -> DataFrame:
    """Papers found by any of several searches, with the first search that found each, by a scan."""
    x = papers.filter(Filters().condition()).withColumns({"_t0": tokens(F.col("title")), "_t1": tokens(F.col("abstract"))})
    hits = [F.when(all_of([_count(p) > 0 for p in ps]), F.lit(i)) for i, ps in enumerate(map(query_phrases, texts)) if ps]
    return x.withColumn("query_ord", F.coalesce(*hits)).filter("query_ord is not null").drop("_t0", "_t1")
