"""Retrieval evaluation: fixed cases, sampled topic queries, freshness and run records."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import spaced_key
from paperlake.operators import index as N
from paperlake.operators import search as S


@dataclass(frozen=True)
class Case:
    """A fixed retrieval case."""

    case_id: str
    query: str
    mode: str = "search"
    filters: S.Filters = field(default_factory=S.Filters)
    top_k: int = 50
    expect_min_results: int = 1
    any_fragments: tuple[str, ...] = ()
    all_fragments: tuple[str, ...] = ()

    @classmethod
    def load(cls, row: dict) -> Case:
        """Checked case of a mapping; unknown modes and missing queries are errors."""
        if not str(row.get("query") or "").strip() or row.get("mode", "search") not in ("search", "hybrid"):
            raise ValueError(f"bad case {row.get('case_id')!r}")
        f = dict(row.get("filters") or {})
        f["venues"] = tuple(v.strip().upper() for v in f.pop("venue", ()) if v.strip())
        return cls(
            str(row["case_id"]), row["query"], row.get("mode", "search"), S.Filters(**f), int(row.get("top_k", 50)), int(row.get("expect_min_results", 1)),
            tuple(row.get("expect_any_title_fragments") or ()), tuple(row.get("expect_all_title_fragments") or ()),
        )


def _fragment(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def expectations(titles: Column, any_of: tuple[str, ...], all_of: tuple[str, ...]) -> Column:
    """Whether an array of titles holds one of the first fragments and each of the second."""
    keys = F.transform(titles, spaced_key)
    holds = lambda f: F.exists(keys, lambda t: t.contains(_fragment(f)))
    ok = F.lit(True)
    if any_of:
        hit = F.lit(False)
        for f in any_of:
            hit = hit | holds(f)
        ok = ok & hit
    for f in all_of:
        ok = ok & holds(f)
    return ok


def expected_over(titles: Column, any_of: tuple[str, ...], all_of: tuple[str, ...]) -> Column:
    """The same as an aggregate over any number of titles, without a list of them."""
    key = spaced_key(titles)
    ok = F.bool_or(_any([key.contains(_fragment(f)) for f in any_of])) if any_of else F.lit(True)
    for f in all_of:
        ok = ok & F.bool_or(key.contains(_fragment(f)))
    return ok


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def run_cases(papers: DataFrame, cases: list[Case], index: N.Index | None = None) -> DataFrame:
    """(case_id, requested_mode, total, passed), one row per case, in one lazy union; from
    the stored index if there is one, else by a scan of the texts for each case."""
    out: DataFrame | None = None
    for case in cases:
        hits = S.bm25(papers, case.query, case.filters) if index is None else N.find(papers.drop("title", "abstract"), index, case.query, case.filters)
        top = hits.orderBy(*S.order("bm25")).limit(case.top_k)
        if index is not None:  # titles of the page alone
            top = N.with_columns(top, papers, index.key, ["title"])
        top = top.agg(F.count(F.lit(1)).alias("total"), F.collect_list("title").alias("titles"))
        passed = (F.col("total") >= case.expect_min_results) & expectations(F.col("titles"), case.any_fragments, case.all_fragments)
        row = top.select(F.lit(case.case_id).alias("case_id"), F.lit(case.mode).alias("requested_mode"), "total", passed.alias("passed"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no cases")
    return out


def sample_queries(topics: list[tuple[str, list[str]]], n_topics: int, n_subtopics: int, seed: int = 42) -> list[tuple[str, str]]:
    """Reproducible (topic, subtopic) picks."""
    rng = random.Random(seed)
    out = []
    for topic, subs in rng.sample(sorted(topics), min(n_topics, len(topics))):
        out += [(topic, s) for s in rng.sample(sorted(subs), min(n_subtopics, len(subs)))]
    return out


def sampled_suite(members: DataFrame, hits: DataFrame, threshold: float = 0.9, key: str = "paper_id") -> DataFrame:
    """(topic, found, passed): how many hits of a topic's query are members of the topic; one
    passes with one such hit.  A last row, of null topic, has the passed queries and whether
    they are the ``threshold``.  ``members``, ``hits``: topic, key; a topic without members is
    not asked for."""
    right = hits.distinct().join(members.distinct(), ["topic", key], "left_semi").groupBy("topic").agg(F.count(F.lit(1)).alias("found"))
    each = members.select("topic").distinct().join(right, "topic", "left").select("topic", F.coalesce("found", F.lit(0)).alias("found"))
    each = each.withColumn("passed", F.col("found") >= 1)
    rate = each.agg(F.count_if("passed").alias("found"), (F.count_if("passed") >= threshold * F.count(F.lit(1))).alias("passed"))
    return each.unionByName(rate.select(F.lit(None).cast(each.schema["topic"].dataType).alias("topic"), "found", "passed"))


def fingerprint(payload: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def stale(recorded: dict[str, str] | None, current: dict[str, str]) -> bool:
    """Whether a report was made from other inputs than the current ones."""
    return not recorded or any(recorded.get(k) != v for k, v in current.items())


def checks(rows: list[tuple[str, Column]], over: DataFrame) -> DataFrame:
    """(check, passed): named conditions over a one-row frame."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rows]))
    return over.select(named.alias("r")).select("r.*")


def exit_code(report: DataFrame, strict: bool = False) -> int:
    """0 if all checks hold, 1 if any fails (2 under strict)."""
    return 0 if report.filter("not passed").isEmpty() else 2 if strict else 1
