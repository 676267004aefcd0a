"""Identifiers, hashes, maps, JSON cells, flags and small arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import blank_to_null, clean, doi_key, slug, title_key


def paper_id(venue: Column, year: Column, title: Column, fallbacks: list[Column]) -> Column:
    """Stable id from venue, year and title key, else the first identifier, else a constant."""
    key = F.coalesce(F.nullif(title_key(title), F.lit("")), *fallbacks, F.lit("missing-title"))
    return F.concat(F.lit("S2-"), F.substring(F.sha1(F.concat_ws(":", venue, year.cast("string"), key)), 1, 16))


def dedupe_key(title: Column, fallbacks: list[Column], unique: Column) -> Column:
    """Title key; without one the first identifier, marked; else the row alone."""
    marked = [F.concat(F.lit("__id__"), f) for f in fallbacks]
    return F.coalesce(F.nullif(title_key(title), F.lit("")), *marked, F.concat(F.lit("__row__"), unique.cast("string")))


def sorted_json(m: Column) -> Column:
    """Compact JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def payload_hash(m: Column) -> Column:
    return F.sha2(sorted_json(m), 256)


def clean_map(m: Column) -> Column:
    """Trimmed values; blank keys and values dropped."""
    return F.map_filter(F.transform_values(m, lambda k, v: clean(v)), lambda k, v: (F.trim(k) != "") & (v != ""))


def count_map(m: Column) -> Column:
    """Slug keys; values that are whole numbers."""
    return F.map_filter(F.transform_values(F.transform_keys(m, lambda k, v: slug(k)), lambda k, v: F.trim(v).try_cast("long")), lambda k, v: v.isNotNull())


def with_defaults(have: Column, derived: Column) -> Column:
    """The map with derived entries where it has none."""
    return F.map_concat(F.map_filter(derived, lambda k, v: ~F.map_contains_key(have, k)), have)


def cell_map(x: Column) -> Column:
    """A JSON object cell as a map of text; malformed or null cells are empty."""
    parsed = F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.expr("map()").cast("map<string,string>"))


def unwrapped(x: Column, key: str) -> Column:
    """$.key.value if wrapped, else $.key."""
    return F.coalesce(F.get_json_object(x, f"$.{key}.value"), F.get_json_object(x, f"$.{key}"))


def first_object(x: Column) -> Column:
    """First to last brace of a text, without code fences."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def coverage(hits: Column, total: Column) -> Column:
    """Per cent with two digits, halves to even; 0 for an empty total."""
    return F.when(total > 0, F.bround(100.0 * hits / total, 2)).otherwise(F.lit(0.0))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def quality_flags(authors: Column, abstract: Column, doi: Column, url: Column, year: Column, status: Column) -> Column:
    """Flags in fixed order."""
    return F.array_compact(F.array(
        F.when(authors, F.lit("missing_authors")),
        F.when(clean(abstract) == "", F.lit("missing_abstract")),
        F.when(blank_to_null(doi).isNull(), F.lit("missing_doi")),
        F.when(blank_to_null(url).isNull(), F.lit("missing_url")),
        F.when(year.isNull(), F.lit("missing_year")),
        F.when(status == "placeholder", F.lit("placeholder")),
    ))


def merge_flags(derived: Column, existing: Column, rules: list[str]) -> Column:
    """Derived flags, then the custom ones already there."""
    return F.array_union(derived, F.filter(existing, lambda f: ~f.isin(*rules)))


def record_status(status: Column) -> Column:
    s = F.lower(clean(status))
    return F.when(s.isin("placeholder", "repaired"), s).otherwise(F.lit("resolved"))


#: Providers by the provenance they stand for (fixed values).
PROVENANCE = {"official": ("openreview", "cvf", "pmlr", "acl", "aaai", "ijcai", "pvldb", "official"), "dblp": ("dblp",), "openalex": ("openalex",), "crossref": ("crossref",), "semantic_scholar": ("semantic_scholar", "s2")}


def provenance(provider: Column) -> Column:
    p, out = F.lower(clean(provider)), F.lit("venue_special")
    for name, providers in PROVENANCE.items():
        out = F.when(p.isin(*providers), F.lit(name)).otherwise(out)
    return out


def full_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def text_of_positions(entries: Column) -> Column:
    """Text of an inverted index: array of (token, positions); a later token wins a place."""
    spots = F.flatten(F.transform(entries, lambda e, i: F.transform(e["positions"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["token"].alias("t")))))
    ordered = F.array_sort(spots)
    after = F.slice(F.transform(ordered, lambda s: s["p"]), F.lit(2), F.greatest(F.size(spots), F.lit(0)))
    paired = F.zip_with(ordered, after, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    last = F.filter(paired, lambda z: ~z["s"]["p"].eqNullSafe(z["p"]))
    return F.array_join(F.transform(last, lambda z: z["s"]["t"]), " ")


def stable_ids(paper: Column, doi: Column, openreview: Column, ids: Column, keys: tuple[str, ...] = ("openreview_id", "arxiv_id", "dblp_key", "acl_id")) -> Column:
    """All identifiers that name the same record across snapshots."""
    named = [F.when(blank_to_null(ids[k]).isNotNull(), F.concat(F.lit(f"{k}:"), clean(ids[k]))) for k in keys]
    return F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("paper:"), blank_to_null(paper)), F.concat(F.lit("doi:"), doi_key(doi)), F.concat(F.lit("openreview_id:"), blank_to_null(openreview)), *named
    )))
