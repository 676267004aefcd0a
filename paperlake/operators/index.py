"""A lasting full-text index in immutable segments.

A segment holds the postings of some texts, with positions, dealt out by a hash of the term
into partitions, sorted by term and split where a term is frequent; and one row for each of
its texts with a fingerprint and length.  A change of the corpus writes a segment of the new
and changed texts and tombstones for the old ones; nothing else is touched, until segments of
similar size are merged.  One small manifest names the segments; it is published by a rename
(``streaming.upsert.write_version``), so a reader sees the old state or the new one, and a
run that dies leaves the old one.  An index has one writer at a time.

A refresh compares the source's files first, by path, size and time: if they are those of the
last refresh, no row is read.  Otherwise the fingerprints of all texts are compared.

Frequencies and lengths are those of the texts that live now, whatever the segments: a
search reads only the partitions of its terms, and its document counts come from there.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import search as S
from paperlake.operators.storage import STALE, cut, delete, file_stamp, spread
from paperlake.streaming.upsert import read_table, versions, write_version

#: Tokens whose postings one partition of terms is to hold, and the most such partitions.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 1024
#: A segment is rewritten if more than this share of its texts is dead.
DEAD_SHARE = 0.25
#: Tombstones up to this count are sent to every task; more are joined by shuffle.
FEW_DEAD = 500_000


@dataclass(frozen=True)
class Segment:
    name: str
    buckets: int
    docs: int
    tokens: int
    dead: int = 0


@dataclass(frozen=True)
class Index:
    """The state that a manifest names; ``n`` texts of ``tokens`` tokens live."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    stamp: str | None = None
    segments: tuple[Segment, ...] = ()
    tombstones: str | None = None
    n: int = 0
    tokens: int = 0

    @property
    def average(self) -> float:
        return self.tokens / self.n if self.n else 0.0

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment) without those of dead texts."""
        if self.tombstones is None:
            return rows
        dead = self.spark.read.schema(f"`{self.key}` {self.key_type}, segment string").parquet(f"{self.path}/{self.tombstones}")
        few = sum(s.dead for s in self.segments) <= FEW_DEAD
        return rows.join(F.broadcast(dead) if few else dead, [self.key, "segment"], "left_anti")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, key, dl, tf, positions) of the living texts, for some terms or all."""
        schema = f"term string, `{self.key}` {self.key_type}, dl long, tf long, positions array<int>, bucket int"
        parts = []
        for s in self.segments:
            x = self.spark.read.schema(schema).parquet(f"{self.path}/{s.name}/postings")
            if terms is not None:
                x = x.filter(F.col("bucket").isin(sorted({bucket_of(self.spark, t, s.buckets) for t in terms})) & F.col("term").isin(terms))
            parts.append(x.drop("bucket").withColumn("segment", F.lit(s.name)))
        if not parts:
            return self.spark.createDataFrame([], schema).drop("bucket")
        return self._alive(reduce(DataFrame.unionByName, parts)).drop("segment")

    def texts(self) -> DataFrame:
        """(key, fingerprint, dl, segment) of the living texts."""
        schema = f"`{self.key}` {self.key_type}, fingerprint string, dl long"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s.name}/texts").withColumn("segment", F.lit(s.name)) for s in self.segments]
        if not parts:
            return self.spark.createDataFrame([], schema + ", segment string")
        return self._alive(reduce(DataFrame.unionByName, parts))


_BUCKETS: dict[tuple[str, int], int] = {}


def bucket_of(spark: SparkSession, term: str, buckets: int) -> int:
    """The partition of a term; Spark's own hash, worked out once for each term."""
    if buckets == 1:
        return 0
    at = (term, buckets)
    if at not in _BUCKETS:
        if len(_BUCKETS) > 100_000:
            _BUCKETS.clear()
        _BUCKETS[at] = spark.range(1).select(_bucket(F.lit(term), buckets)).first()[0]
    return _BUCKETS[at]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


_TOKEN = re.compile(r"[^\W_]+")


def positions(title: str | None, abstract: str | None) -> tuple[dict[str, list[int]], int]:
    """Places of each term, and the number of tokens.  One place stays free between title
    and abstract, so that no phrase leads from one into the other."""
    out: dict[str, list[int]] = {}
    at = total = 0
    for text in (title, abstract):
        found = _TOKEN.findall(S.fold_text(text)) if text else []
        for t in found:
            out.setdefault(t, []).append(at)
            at += 1
        total += len(found)
        at += 1
    return out, total


def _tokenised(papers: DataFrame, key: str) -> DataFrame:
    """One row for each term of each text, and one with the fingerprint (term null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                b = whole.slice(first, 64)
                keep: list[int] = []
                term, fingerprint, dl, tf, places = [], [], [], [], []
                for i, (title, abstract, mark) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    found, n = positions(title, abstract)
                    rows = len(found) + 1
                    keep += [i] * rows
                    term += [None, *found]
                    fingerprint += [mark, *[None] * len(found)]
                    dl += [n] * rows
                    tf += [0, *map(len, found.values())]
                    places += [None, *found.values()]
                cols = [b.column(0).take(pa.array(keep, pa.int64())), pa.array(term, pa.string()), pa.array(fingerprint, pa.string()), pa.array(dl, pa.int64()), pa.array(tf, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, [key, "term", "fingerprint", "dl", "tf", "positions"])

    kind = papers.schema[key].dataType.simpleString()
    return spread(papers.select(key, "title", "abstract", _fingerprint().alias("fingerprint"))).mapInArrow(run, f"`{key}` {kind}, term string, fingerprint string, dl long, tf long, positions array<int>")


def _fingerprint() -> Column:
    return F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit("\x00"), F.coalesce("abstract", F.lit(""))))


def _write_segment(index: Index, postings: DataFrame, texts: DataFrame) -> Segment | None:
    """A segment of stored (term, key, dl, tf, positions) and (key, fingerprint, dl)."""
    name = f"segment-{uuid.uuid4().hex}"
    docs, tokens = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not docs:
        return None
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < tokens:
        buckets *= 2
    # by ranges of terms and then keys, so that a frequent term's postings are several files
    x = postings.select("term", index.key, "dl", "tf", "positions", _bucket(F.col("term"), buckets).alias("bucket"))
    x = x.repartitionByRange("bucket", "term", index.key).sortWithinPartitions("bucket", "term", index.key)
    x.write.partitionBy("bucket").parquet(f"{index.path}/{name}/postings")
    texts.select(index.key, "fingerprint", "dl").write.parquet(f"{index.path}/{name}/texts")
    return Segment(name, buckets, docs, tokens)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _commit(index: Index, stamp: str | None, tombstones: DataFrame | None, making: str | None = None) -> Index:
    """Publishes the state and drops what no kept manifest names."""
    dead_docs = sum(s.dead for s in index.segments)
    name = None
    if tombstones is not None and dead_docs:
        name = f"tombstones-{uuid.uuid4().hex}"
        tombstones.write.parquet(f"{index.path}/{name}")
    n = sum(s.docs for s in index.segments) - dead_docs
    index = replace(index, stamp=stamp, tombstones=name, n=n)
    tokens = index.texts().agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0] if dead_docs else sum(s.tokens for s in index.segments)
    index = replace(index, tokens=tokens)
    state = {k: v for k, v in asdict(replace(index, spark=None)).items() if k not in ("spark", "path")}
    write_version(index.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1), f"{index.path}/manifest")
    _sweep(index, making)
    return index


def _sweep(index: Index, making: str | None) -> None:
    """Deletes what this refresh has made on the way, and old segments and tombstones that
    none of the kept manifests names."""
    named: set[str] = set()
    delete(index.spark, index.path, lambda n: n == making)
    for v in versions(index.spark, f"{index.path}/manifest"):
        state = json.loads(index.spark.read.schema("state string").parquet(f"{index.path}/manifest/v{v:012d}").first()["state"])
        named |= {s["name"] for s in state["segments"]} | {state["tombstones"]}
    delete(index.spark, index.path, lambda name: name.startswith(("segment-", "tombstones-", "making-")) and name not in named, STALE)


def read(spark: SparkSession, path: str) -> Index | None:
    """The index as last published, or None before the first refresh."""
    found = read_table(spark, f"{path}/manifest", "state string")
    if found is None:
        return None
    state = json.loads(found.first()["state"])
    segments = tuple(Segment(**s) for s in state.pop("segments"))
    return Index(spark, path, segments=segments, **state)


def refresh(papers: DataFrame, path: str, key: str = "paper_id") -> Index:
    """The index of ``papers`` (key, title, abstract): as it is if their files are the same,
    else brought up to date.  A key is unique; rows of null key are left out."""
    spark = papers.sparkSession
    stamp = file_stamp(papers)
    index = read(spark, path) or Index(spark, path, key, papers.schema[key].dataType.simpleString())
    if stamp is not None and index.stamp == stamp:
        return index
    papers = papers.filter(F.col(key).isNotNull()).select(key, "title", "abstract")
    making = f"making-{uuid.uuid4().hex}"
    old_dead = spark.read.schema(f"`{key}` {index.key_type}, segment string").parquet(f"{path}/{index.tombstones}") if index.tombstones else None
    segments, tombstones = list(index.segments), old_dead
    if segments:
        now = papers.select(key, _fingerprint().alias("_now"))
        both = now.join(index.texts(), key, "full").filter(~F.col("_now").eqNullSafe(F.col("fingerprint")))
        changed = cut(both.select(key, F.col("_now").isNotNull().alias("_add"), "segment"))
        gone = changed.filter("segment is not null").select(key, "segment")
        by_segment = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        segments = [replace(s, dead=s.dead + by_segment.get(s.name, 0)) for s in segments]
        if by_segment:
            tombstones = gone if old_dead is None else old_dead.unionByName(gone)
        papers = papers.join(changed.filter("_add").select(key), key, "left_semi")
    rows = _stored(_tokenised(papers, key), f"{path}/{making}/rows")
    made = _write_segment(index, rows.filter("term is not null"), rows.filter("term is null"))
    try:
        index = _commit(replace(index, segments=tuple([*segments, *([made] if made else [])])), stamp, tombstones, making)
    except OSError:  # another run may have published the same meanwhile
        other = read(spark, path)
        if stamp is None or other is None or other.stamp != stamp:
            raise
        return other
    return merge(index)


def _to_merge(segments: tuple[Segment, ...]) -> list[Segment]:
    """Segments to be rewritten as one: the newest ones while one is not twice as large as
    those after it together, and any with many dead texts."""
    last = len(segments) - 1
    alive = [s.docs - s.dead for s in segments]
    while last > 0 and alive[last - 1] < 2 * sum(alive[last:]):
        last -= 1
    tail = list(segments[last:]) if last < len(segments) - 1 else []
    return [s for s in segments if s in tail or s.dead > DEAD_SHARE * s.docs]


def merge(index: Index) -> Index:
    """Rewrites segments that are due as one segment of their living texts."""
    due = _to_merge(index.segments)
    if not due:
        return index
    names = [s.name for s in due]
    part = replace(index, segments=tuple(due))
    made = _write_segment(index, part.postings(), part.texts())
    kept = [s for s in index.segments if s.name not in names]
    tombstones = None
    if index.tombstones:
        all_dead = index.spark.read.schema(f"`{index.key}` {index.key_type}, segment string").parquet(f"{index.path}/{index.tombstones}")
        tombstones = all_dead.filter(~F.col("segment").isin(names))
    first = next((i for i, s in enumerate(index.segments) if s.name == names[0]), 0)
    before = [s for s in index.segments[:first] if s in kept]
    after = [s for s in index.segments[first:] if s in kept]
    return _commit(replace(index, segments=tuple([*before, *([made] if made else []), *after])), index.stamp, tombstones)


# Searching


def _frequency(phrase: tuple[str, ...], number: dict[str, int]) -> Column:
    """How often a phrase occurs, from the positions of its terms."""
    if len(phrase) == 1:
        return F.coalesce(F.col(f"_tf{number[phrase[0]]}"), F.lit(0))
    starts = F.col(f"_at{number[phrase[0]]}")
    for k, term in enumerate(phrase[1:], 1):
        starts = F.array_intersect(starts, F.transform(F.col(f"_at{number[term]}"), lambda p: p - k))  # noqa: B023
    return F.coalesce(F.size(starts).cast("long"), F.lit(0))


def frequencies(index: Index, phrases: list[tuple[str, ...]]) -> DataFrame:
    """(key, dl, f0, f1, ...): how often each phrase occurs, for texts with any of the terms."""
    terms = sorted({t for p in phrases for t in p})
    number = {t: i for i, t in enumerate(terms)}
    adjacent = {t for p in phrases if len(p) > 1 for t in p}
    own = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    columns = [own(t, "tf").alias(f"_tf{i}") for t, i in number.items()] + [own(t, "positions").alias(f"_at{number[t]}") for t in sorted(adjacent)]
    x = index.postings(terms).groupBy(index.key, "dl").agg(*columns)
    return x.select(index.key, "dl", *[_frequency(p, number).alias(f"f{i}") for i, p in enumerate(phrases)])


def scored(index: Index, text: str) -> DataFrame:
    """(key, score) of the living texts that hold every phrase of the query; lower is better."""
    asked = S.query_phrases(text)
    phrases = list(dict.fromkeys(asked))
    if not phrases:
        return index.texts().limit(0).select(index.key, F.lit(0.0).alias("score"))
    x = frequencies(index, phrases)
    held = F.broadcast(x.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))]))  # one row
    total = F.lit(0.0)
    for i, p in enumerate(phrases):
        total = total - asked.count(p) * S.weight(F.col(f"f{i}"), F.col("dl"), F.col(f"_df{i}"), F.lit(index.n), F.lit(index.average))
    return x.filter(S.all_of([F.col(f"f{i}") > 0 for i in range(len(phrases))])).crossJoin(held).select(index.key, total.alias("score"))


def find(papers: DataFrame, index: Index, text: str, filters: S.Filters | None = None) -> DataFrame:
    """Papers that match and pass the filters, with their score.

    A search reads as few columns of the papers as what follows needs; texts are best joined
    to a page of ids (``with_columns``).
    """
    return papers.filter((filters or S.Filters()).condition()).join(scored(index, text), index.key)


def with_columns(page: DataFrame, papers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A page's rows with further columns of the papers; the page is sent to the papers."""
    ids = F.broadcast(page.select(key))
    return page.join(papers.select(key, *columns).join(ids, key, "left_semi"), key)


def first_of(papers: DataFrame, index: Index, texts: list[str], filters: S.Filters | None = None) -> DataFrame:
    """Papers that any of several searches finds, with the number of the first one."""
    asked = [list(dict.fromkeys(S.query_phrases(t))) for t in texts]
    phrases = list(dict.fromkeys(p for ps in asked for p in ps))
    x = frequencies(index, phrases)
    number = F.coalesce(*(F.when(S.all_of([F.col(f"f{phrases.index(p)}") > 0 for p in ps]), F.lit(i)) for i, ps in enumerate(asked) if ps))
    found = x.select(index.key, number.alias("query_ord")).filter("query_ord is not null")
    return papers.filter((filters or S.Filters()).condition()).join(found, index.key)


def source_name(path: str) -> str:
    """A folder name for the index of a source."""
    return hashlib.sha256(path.encode()).hexdigest()[:24]
