"""Corpus lifecycle: inspect, plan, prepare, validate, reconcile, publish.

``normalise`` is one lazy plan over all venues and years at once: transform, title-key
dedupe with survivor merge, re-identification, canonical projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.operators import dedupe as D
from paperlake.operators import relational as R
from paperlake.operators.storage import cut

#: Columns of a canonical record, in contract order (fixed values).
CANONICAL = (
    "paper_id", "title", "authors", "venue", "year", "abstract", "doi", "url", "citation_count", "source_provider", "source_ids", "field_provenance", "keywords",
    "track", "track_display_name", "track_group", "presentation_level", "institutions", "record_status", "quality_flags", "collected_at",
)
#: Flags that are derived; others are custom and stay (fixed values).
DERIVED_FLAGS = ["missing_authors", "missing_abstract", "missing_doi", "missing_url", "missing_year", "placeholder"]
#: Venues by family of their sources (fixed values).
VENUES = {
    "html": ("AAAI", "ACL", "AISTATS", "CVPR", "ICCV", "IJCAI"), "dblp": ("KDD", "TPAMI", "SIGIR", "ACMMM", "WWW", "ICDE"), "official_json": ("ICLR", "ICML", "NEURIPS", "ECCV", "VLDB"),
}
#: Names of payload files below a root: a folder by venue and one file.
PAYLOAD_SHAPE = r"[^/]+/[^/]+\.json"
AUTHORS_LEAST, ABSTRACTS_LEAST = 90.0, 85.0


def family(venue: str) -> str:
    """Source family of a venue; an unknown venue is an error."""
    for name, venues in VENUES.items():
        if venue.upper() in venues:
            return name
    raise ValueError(f"unknown venue {venue}")


def years(expression: str) -> list[int]:
    """Distinct years of a comma list with inclusive ranges, ascending, 1900 to 2100."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in expression.split(","))):
        m = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", part)
        if not m or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"bad years {part!r}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    if not out or any(not 1900 <= y <= 2100 for y in out):
        raise ValueError(f"bad years {expression!r}")
    return sorted(set(out))


def plan(targets: dict[str, str]) -> list[tuple[str, int, str]]:
    """(venue, year, family) of every collection to run."""
    return [(v.upper(), y, family(v)) for v in sorted(targets) for y in years(targets[v])]


def _authors(rows: DataFrame) -> DataFrame:
    lists = ("authors", "keywords", "institutions", "quality_flags")
    for name in lists:
        rows = rows.withColumn(name, F.coalesce(X.distinct_folded(F.col(name)), F.array().cast("array<string>")))
    return rows


def transform(records: DataFrame) -> DataFrame:
    """Records with cleaned fields, tracks, levels, status, identifiers and flags."""
    empty = F.expr("map()").cast("map<string,string>")
    x = _authors(records).withColumn("title", X.clean("title")).withColumn("abstract", X.clean("abstract")).withColumn("doi", X.doi("doi")).withColumn("url", X.blank_to_null("url"))
    x = x.withColumn("source_ids", I.clean_map(F.coalesce("source_ids", empty))).withColumn("field_provenance", F.coalesce("field_provenance", empty))
    x = x.withColumn("source_provider", X.clean("source_provider"))
    bare = (F.size("authors") == 0) & (F.col("abstract") == "") & F.col("doi").isNull() & ~F.map_contains_key("source_ids", F.lit("openreview_id")) & F.col("url").isNotNull()
    status = F.when(bare, F.lit("placeholder")).otherwise(I.record_status(F.col("record_status")))
    x = x.withColumn("record_status", status)
    x = x.withColumn("track_display_name", X.display_name("track")).withColumn("track_group", X.track_group("track")).withColumn("track", X.track("track"))
    x = x.withColumn("presentation_level", X.presentation_level("presentation_level", "venue"))
    derived = I.quality_flags(F.size("authors") == 0, F.col("abstract"), F.col("doi"), F.col("url"), F.col("year"), F.col("record_status"))
    x = x.withColumn("quality_flags", I.merge_flags(derived, F.col("quality_flags"), DERIVED_FLAGS))
    named = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(f) for f in ("abstract", "authors", "url")]), F.array(*[F.when(c, I.provenance(F.col("source_provider"))) for c in (F.col("abstract") != "", F.size("authors") > 0, F.col("url").isNotNull())])),
        lambda k, v: v.isNotNull())
    return x.withColumn("field_provenance", I.with_defaults(F.col("field_provenance"), named))


def _identifiers() -> list:
    return [X.doi_key("doi"), X.blank_to_null(F.col("source_ids")["openreview_id"]), X.blank_to_null(F.col("source_ids")["openalex_id"])]


def normalise(records: DataFrame) -> DataFrame:
    """Canonical records with ``duplicates_removed``, one per venue, year and title key.

    Records without a key keep to themselves; equal scores keep input order (path, ord).
    """
    x = transform(records).withColumn("_ord", F.row_number().over(_input_order()))
    unique = F.concat_ws("#", "path", F.col("ord").cast("string"))
    x = x.withColumn("_key", F.concat_ws("|", "venue", F.col("year").cast("string"), I.dedupe_key(F.col("title"), _identifiers(), unique)))
    score = D.survivor_score(
        [F.col("title") != "", F.size("authors") > 0, F.col("abstract") != ""],
        [F.size("keywords") > 0, F.size("institutions") > 0, F.col("doi").isNotNull(), F.map_contains_key("source_ids", F.lit("openreview_id")), F.map_contains_key("source_ids", F.lit("openalex_id")), F.col("record_status") != "placeholder"],
        F.col("record_status") == "repaired")
    scalars = ["title", "abstract", "doi", "url", "source_provider", "track", "track_group", "presentation_level", "record_status", "venue", "year", "citation_count", "collected_at"]
    m = D.merge_groups(x, "_key", score, "_ord", scalars, ["authors", "keywords", "institutions", "quality_flags"], ["source_ids", "field_provenance"])
    again = transform(m)
    pid = I.paper_id(F.col("venue"), F.col("year"), F.col("title"), [*_identifiers(), F.col("url")])
    return again.withColumn("paper_id", pid).select(*CANONICAL, "duplicates_removed")


def _input_order():
    from pyspark.sql.window import Window

    return Window.partitionBy("venue", "year").orderBy("path", "ord")


def inspect(canonical: DataFrame) -> DataFrame:
    """Coverage of every venue and year, counts before and after deduplication."""
    has, open_ = F.col("abstract") != "", F.col("record_status") != "placeholder"
    m = canonical.groupBy("venue", "year").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~open_).alias("placeholder_total"), F.count_if(open_).alias("resolved_total"), F.count_if(open_ & has).alias("_abs"),
        F.count_if(open_ & (F.size("authors") > 0)).alias("_aut"), (F.count(F.lit(1)) - F.countDistinct(X.title_key("title"))).alias("duplicate_title_count"), F.sum("duplicates_removed").alias("duplicates_removed"))
    return m.withColumn("resolved_abstract_coverage", I.coverage(F.col("_abs"), F.col("resolved_total"))).withColumn("resolved_authors_coverage", I.coverage(F.col("_aut"), F.col("resolved_total"))).drop("_abs", "_aut")


def validate(canonical: DataFrame, official: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(venue, year, issues, warnings, passed): hard gates and, if given, official counts.

    ``official``: venue, year, n.  A count that differs warns, and fails under ``strict``.
    """
    q = inspect(canonical)
    issue = lambda bad, name: F.when(bad, F.lit(name))
    issues = [issue(F.col("duplicate_title_count") > 0, "duplicates"), issue(F.col("resolved_authors_coverage") < AUTHORS_LEAST, "authors"), issue(F.col("resolved_abstract_coverage") < ABSTRACTS_LEAST, "abstracts")]
    aligned = F.lit(None).cast("boolean")
    if official is not None:
        q = q.join(official.withColumnRenamed("n", "_official"), ["venue", "year"], "left")
        aligned = R.alignment(F.col("total"), F.col("_official"))
    off = issue(~aligned, "count")
    issues = [*issues, off] if strict else issues
    warnings = F.array_compact(F.array(F.lit(None).cast("string") if strict else off))
    q = q.withColumn("issues", F.array_compact(F.array(*issues))).withColumn("warnings", warnings)
    return q.select("venue", "year", "issues", "warnings", (F.size("issues") == 0).alias("passed"))


def verify_files(prepared: DataFrame, present: DataFrame, shape: str | None = None) -> None:
    """Stops unless the files present are those prepared, with the same content.

    Both: (name, fingerprint), of the files below a folder, as ``report.file_fingerprints``
    gives them; names are relative, each once, lead nowhere outside the folder and match
    ``shape`` as a whole, if given (``PAYLOAD_SHAPE`` for payloads).
    """
    parts = F.split("name", "/")
    bad_path = F.col("name").startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, ".") | F.array_contains(parts, "") | F.col("name").contains(":/")
    if shape is not None:
        bad_path = bad_path | ~F.col("name").rlike(f"^(?:{shape})$")
    if paths := [r["name"] for r in prepared.unionByName(present).filter(bad_path).select("name").distinct().limit(8).collect()]:
        raise ValueError(f"paths outside the folder: {sorted(paths)}")
    for files in (prepared, present):
        if twice := files.groupBy("name").count().filter("count > 1").limit(8).collect():
            raise ValueError(f"paths given twice: {sorted(r['name'] for r in twice)}")
    both = prepared.select("name", F.col("fingerprint").alias("_a")).join(present.select("name", F.col("fingerprint").alias("_b")), "name", "full")
    state = F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "changed")
    found = both.select("name", state.alias("state")).filter("state is not null").orderBy("name").limit(8).collect()
    if found:
        raise ValueError("files differ from those prepared: " + ", ".join(f"{r['name']} {r['state']}" for r in found))


def chains(pages: DataFrame, listing: str = "listing", url: str = "url", link: str = "next", items: str = "items") -> DataFrame:
    """(listing, pages, items, reached, problem) of stored pages, for any number of listings.

    ``pages``: one row per page with its listing, its address, the address of the next one
    (null on the last) and the number of items.  ``problem`` is null, or the first that holds
    of: a next page on another host, one that was not stored, an address stored twice, no or
    several first pages, two pages with the same next one, and pages that the first one does
    not lead to (``reached`` counts those it does), which is how a loop beside the chain shows.

    The way from the first page is found by pointer doubling: in each round every page jumps
    to where its jump's jump leads, so the rounds are the logarithm of the longest listing.
    """
    host = lambda c: F.lower(F.regexp_extract(c, "^(?:https?://)?([^/?#:]+)", 1))
    p = cut(pages.select(F.col(listing).alias("l"), F.col(url).alias("u"), F.col(link).alias("n"), F.col(items).cast("long").alias("i")))
    stored = p.groupBy("l", "u").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    into = p.filter("n is not null").groupBy("l", "n").agg(F.count(F.lit(1)).alias("links"))
    marked = stored.join(into.withColumnRenamed("n", "u"), ["l", "u"], "left")
    missing = into.join(stored.select("l", F.col("u").alias("n")), ["l", "n"], "left_anti").groupBy("l").agg(F.count(F.lit(1)).alias("missing"))
    facts = marked.groupBy("l").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(host(F.col("n")) != host(F.col("u"))).alias("strange"), F.count_if(F.col("copies") > 1).alias("copied"), F.count_if(F.col("links").isNull()).alias("starts"),
        F.count_if(F.col("links") > 1).alias("twice"), F.min(F.when(F.col("links").isNull(), F.col("u"))).alias("first"))
    jumps = stored.select("l", "u", F.col("n").alias("to"), F.lit(1).cast("long").alias("steps"))
    longest = facts.agg(F.max("pages")).first()[0] or 0
    for _ in range(max(0, (longest - 1).bit_length())):
        ahead = jumps.select("l", F.col("u").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        jumps = cut(jumps.join(ahead, ["l", "to"], "left").select("l", "u", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    found = facts.join(p.groupBy("l").agg(F.coalesce(F.sum("i"), F.lit(0)).alias("items")), "l").join(missing, "l", "left").join(jumps.select("l", F.col("u").alias("first"), F.col("to").alias("end"), "steps"), ["l", "first"], "left")
    reached = F.when(F.col("starts") == 1, F.least("steps", "pages")).otherwise(0)
    problem = F.when(F.col("strange") > 0, "a next page on another host").when(F.col("missing") > 0, "a next page that is not stored").when(F.col("copied") > 0, "a page stored twice") \
        .when(F.col("starts") != 1, "no first page or several: a loop").when(F.col("twice") > 0, "two pages with the same next one: a loop").when(reached < F.col("pages"), "pages beside the chain: a loop")
    return found.select(F.col("l").alias(listing), "pages", "items", reached.alias("reached"), problem.alias("problem"))


def complete(pages: DataFrame, link: str = "next", url: str = "url", expected: int | None = None, items: str = "items") -> dict[str, int]:
    """Checks that stored pages of one listing are all of it; gives pages and items.

    An error is what ``chains`` finds, and fewer items than the listing says it has.
    """
    found = chains(pages.withColumn("_listing", F.lit(0)), "_listing", url, link, items).first()
    row = found.asDict() if found else {"pages": 0, "items": 0, "problem": None}
    if row["problem"]:
        raise ValueError(row["problem"])
    if expected is not None and row["items"] < expected:
        raise ValueError(f"{row['items']} items of {expected}")
    return {"pages": row["pages"], "items": row["items"]}


def publish(new: DataFrame, old: DataFrame | None, allowed_removals: DataFrame, write: Callable[[DataFrame], str]) -> str:
    """Writes the new records unless old ones would vanish without permission."""
    if old is not None:
        gone = old.select("paper_id").join(new.select("paper_id"), "paper_id", "left_anti").join(allowed_removals.select("paper_id"), "paper_id", "left_anti").limit(8).collect()
        if gone:
            raise ValueError(f"unknown removals blocked: {sorted(r[0] for r in gone)}")
    return write(new)


_SECRET = re.compile(r"key|token|secret|password", re.I)


@dataclass
class Manifest:
    """Record of a run; secrets are never written."""

    command: str
    settings: dict = field(default_factory=dict)
    status: str = "running"
    steps: list[dict] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)

    def step(self, name: str, **metrics: object) -> None:
        self.steps.append({"name": name, "at": datetime.now(timezone.utc).isoformat(), **metrics})

    def finish(self, issues: list[str] | None = None, failed: bool = False) -> int:
        """Exit code: 0 success, 1 issues, 2 failure."""
        self.issues += issues or []
        self.status = "failed" if failed else "issues" if self.issues else "success"
        return {"success": 0, "issues": 1, "failed": 2}[self.status]

    def as_dict(self) -> dict:
        hidden = {k: "***" if _SECRET.search(k) else v for k, v in self.settings.items()}
        return {"command": self.command, "settings": hidden, "status": self.status, "steps": self.steps, "issues": self.issues}
