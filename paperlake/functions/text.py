"""Text functions on columns: keys, slugs, identifiers, links, tracks and levels.

Every function takes and returns a Column and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENTATION_LEVELS = ("poster", "oral", "bestpaper", "unknown", "not_applicable")


def lit(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """Trimmed of white space; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(lit(x), r"^\s+|\s+$", ""), F.lit(""))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(clean(x), F.lit(""))


def squeeze(x: Column | str) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(lit(x), r"\s+", " "))


def title_key(x: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(lit(x)), "[^a-z0-9]+", "")


def spaced_key(x: Column | str) -> Column:
    """Lower-case words of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(lit(x)), "[^a-z0-9]+", " "))


def folded_key(x: Column | str) -> Column:
    """White space collapsed, lower-cased, sharp s spelled out."""
    return F.replace(F.lower(squeeze(x)), F.lit("ß"), F.lit("ss"))


def ending_key(x: Column | str) -> Column:
    """Folded key without trailing blanks, dots, colons and semicolons."""
    return F.regexp_replace(folded_key(x), r"[ .:;]+$", "")


def one_dot_less(x: Column | str) -> Column:
    """Without one trailing dot."""
    return F.regexp_replace(clean(x), r"\.$", "")


def slug(x: Column | str, default: str = "unknown") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(lit(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def file_slug(x: Column | str, limit: int = 120, default: str = "paper") -> Column:
    """Slug cut to ``limit`` characters without a trailing underscore."""
    s = F.regexp_replace(F.substring(slug(x, ""), 1, limit), "_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


#: Character entities that are decoded (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def unescape(x: Column | str) -> Column:
    out = lit(x)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def strip_tags(x: Column | str, gap: str = " ") -> Column:
    """Tags replaced by ``gap``, entities decoded, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(lit(x), "<[^>]+>", gap)))


def doi(x: Column | str) -> Column:
    """DOI without resolver or scheme prefix, case kept; blank becomes null."""
    return F.nullif(F.regexp_replace(clean(x), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""), F.lit(""))


def doi_key(x: Column | str) -> Column:
    """Lower-case DOI that starts as DOIs do, else null."""
    d = F.lower(doi(x))
    return F.when(d.startswith("10."), d)


def find_doi(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(lit(x), r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), F.lit(""))


def arxiv_id(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(lit(x), r"[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?", 0), F.lit(""))


def query_value(url: Column | str, name: str) -> Column:
    """Value of a query parameter, or null."""
    return F.nullif(F.regexp_extract(lit(url), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def openreview_id(mapped: Column, url: Column | str) -> Column:
    """The mapped id if there is one, else the forum or note id of an OpenReview link."""
    from_url = F.when(lit(url).contains("openreview.net"), query_value(url, "id"))
    return F.coalesce(blank_to_null(mapped), from_url)


#: Track names that mean another one (fixed values).
TRACK_ALIASES = (("conference", "main"), ("main_conference", "main"), ("main_track", "main"), ("research", "main"), ("research_track", "main"), ("proceedings", "main"))


def track(x: Column | str) -> Column:
    s = slug(x, "main")
    out = s
    for alias, name in TRACK_ALIASES:
        out = F.when(s == alias, F.lit(name)).otherwise(out)
    return out


def track_group(x: Column | str) -> Column:
    return F.when(track(x) == "main", F.lit("main")).otherwise(F.lit("other"))


def display_name(x: Column | str) -> Column:
    return F.initcap(F.replace(track(x), F.lit("_"), F.lit(" ")))


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Value of the first rule whose word occurs in the text."""
    out = default
    for word, value in reversed(rules):
        out = F.when(text.contains(word), F.lit(value)).otherwise(out)
    return out


#: Words that decide a track, in order (fixed values).
TRACK_RULES = [("workshop", "workshop"), ("demo", "demo"), ("tutorial", "tutorial"), ("industry", "industry"), ("dataset", "datasets_and_benchmarks"), ("benchmark", "datasets_and_benchmarks"), ("journal", "journal"), ("position", "position")]
#: Words that decide a presentation level, in order (fixed values).
LEVEL_RULES = [("best paper", "bestpaper"), ("bestpaper", "bestpaper"), ("award", "bestpaper"), ("oral", "oral"), ("spotlight", "oral"), ("poster", "poster")]
JOURNALS = ("TPAMI", "VLDB")


def infer_track(x: Column | str, default: str = "main") -> Column:
    return first_rule(F.lower(F.coalesce(lit(x), F.lit(""))), TRACK_RULES, F.lit(default))


def presentation_level(x: Column | str, venue: Column | str) -> Column:
    """Level named by the text; journals have none; nothing is invented."""
    named = first_rule(F.lower(clean(x)), LEVEL_RULES, F.lit("unknown"))
    return F.when(F.upper(lit(venue)).isin(*JOURNALS), F.lit("not_applicable")).otherwise(named)


def subject_class(x: Column | str) -> Column:
    """(track_group, level) of a subject line."""
    s = F.lower(clean(x))
    group = F.when(s.startswith("workshop") | s.contains("demo"), F.lit("other")).otherwise(F.lit("main"))
    return F.concat_ws("/", group, first_rule(s, LEVEL_RULES, F.lit("unknown")))


def first_label(text: Column, groups: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """Label of the first group with an alias inside the folded text."""
    hay = folded_key(text)
    out = F.lit(default)
    for label, aliases in reversed(groups):
        hit = F.lit(False)
        for a in aliases:
            hit = hit | hay.contains(a.lower().replace("ß", "ss"))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def has_labels(text: Column, groups: list[tuple[str, list[str]]], required: list[str]) -> Column:
    """Whether every required label has an alias inside the folded text."""
    out = F.lit(True)
    for label in required:
        out = out & (first_label(text, [(g, a) for g, a in groups if g == label], "") == label)
    return out


def ellipsis(x: Column | str, n: int) -> Column:
    c = lit(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def tsv_cell(x: Column | str) -> Column:
    return F.translate(F.coalesce(lit(x), F.lit("")), "\t\r\n", "   ")


#: Map keys that hold a PDF link, in order of trust (fixed values).
PDF_KEYS = ("pdf_url", "cvf_pdf_url", "acl_pdf_url", "pmlr_pdf_url", "aaai_pdf_url", "ijcai_pdf_url", "openreview_pdf_url", "neurips_pdf_url", "vldb_pdf_url", "acm_pdf_url", "ieee_pdf_url")


def pdf_link(ids: Column, url: Column) -> Column:
    """(url, resolver) of a record's PDF: mapped links, derived links, rewritten page."""
    def option(value: Column, resolver: Column | str) -> Column:
        name = F.lit(resolver) if isinstance(resolver, str) else resolver
        return F.when(value.isNotNull(), F.struct(value.alias("url"), name.alias("resolver")))

    mapped = [option(blank_to_null(ids[k]), f"source_ids:{k}") for k in PDF_KEYS]
    others = F.array_sort(F.filter(F.map_keys(ids), lambda k: k.endswith("_pdf_url") & (F.trim(ids[k]) != "")))
    other = F.get(others, F.lit(0))
    any_link = F.when(other.isNotNull(), F.struct(F.try_element_at(ids, other).alias("url"), F.concat(F.lit("source_ids:"), other).alias("resolver")))
    note = openreview_id(ids["openreview_id"], url)
    paper = F.coalesce(blank_to_null(ids["arxiv_id"]), F.when(url.contains("arxiv.org"), arxiv_id(url)))
    page = (
        F.when(url.contains("openaccess.thecvf.com"), F.replace(F.replace(url, F.lit("/html/"), F.lit("/papers/")), F.lit(".html"), F.lit(".pdf")))
        .when(url.contains("aclanthology.org"), F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".pdf")))
        .when(url.contains("proceedings.mlr.press"), F.replace(url, F.lit(".html"), F.lit(".pdf")))
        .when(url.endswith(".pdf"), url)
    )
    return F.coalesce(
        *mapped, any_link,
        option(F.concat(F.lit("https://openreview.net/pdf?id="), note), "derived:openreview_id"),
        option(F.concat(F.lit("https://arxiv.org/pdf/"), paper, F.lit(".pdf")), "derived:arxiv_id"),
        option(page, "derived:page_url"),
    )


def absolute(base: Column | str, link: Column | str) -> Column:
    """An absolute link; root-relative and plain ones are put after the base's origin."""
    origin = F.regexp_extract(lit(base), r"^(https?://[^/?#]+)", 1)
    x = lit(link)
    return F.when(x.rlike("^https?://"), x).when(x.startswith("//"), F.concat(F.lit("https:"), x)).when(
        x.startswith("/"), F.concat(origin, x)).otherwise(F.concat(origin, F.lit("/"), x))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(lit(url), r"^https?://([^/?#:]+)", 1))


def in_domain(url: Column | str, domains: list[str]) -> Column:
    """Whether the link's host is one of the domains or below one."""
    h = host(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | h.endswith("." + d)
    return hit


def redact_query(url: Column | str) -> Column:
    return F.regexp_replace(lit(url), r"((?:api_key|apikey|token|key|secret|password)=)[^&#]*", "$1***")


def people(x: Column | str) -> Column:
    """Names between commas and the word and."""
    parts = F.transform(F.split(squeeze(x), r",\s*|\s+and\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def profile_name(x: Column | str) -> Column:
    """Readable name of a ~First_Last1 profile id."""
    return F.trim(F.replace(F.regexp_replace(lit(x), "^~|[0-9]+$", ""), F.lit("_"), F.lit(" ")))


#: LaTeX spellings that are decoded (fixed values).
LATEX = ((r'\"a', "ä"), (r'\"o', "ö"), (r'\"u', "ü"), (r"\'e", "é"), (r"\`e", "è"), (r"\'a", "á"), (r"\~n", "ñ"), (r"\c c", "ç"), (r"\ss", "ß"), (r"\&", "&"), (r"\%", "%"), (r"\_", "_"), ("--", "-"))


def unlatex(x: Column | str) -> Column:
    out = F.regexp_replace(lit(x), r"[{}]", "")
    for tex, char in LATEX:
        out = F.replace(out, F.lit(tex), F.lit(char))
    return squeeze(out)


def number_in(x: Column | str, pattern: str = r"([0-9][0-9,]*)") -> Column:
    """First number with thousands separators in prose."""
    return F.replace(F.regexp_extract(lit(x), pattern, 1), F.lit(","), F.lit("")).try_cast("long")


def endpoint(x: Column | str) -> Column:
    """Service address without a trailing /embeddings or slashes, https only."""
    out = F.regexp_replace(F.regexp_replace(clean(x), "/+$", ""), "/embeddings$", "")
    return F.regexp_replace(F.regexp_replace(out, "/+$", ""), "^http://", "https://")


def distinct_folded(xs: Column) -> Column:
    """First occurrences of an array's non-blank values, compared without case."""
    kept = F.filter(F.transform(xs, clean), lambda v: v != "")
    # sorted by key and place, each compared with the one before: no search for every value
    keyed = F.array_sort(F.transform(kept, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(keyed, lambda s: s["k"]))
    paired = F.zip_with(keyed, before, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    first = F.filter(paired, lambda z: z["s"].isNotNull() & ~z["s"]["k"].eqNullSafe(z["p"]))
    return F.transform(F.array_sort(F.transform(first, lambda z: F.struct(z["s"]["i"].alias("i"), z["s"]["v"].alias("v")))), lambda s: s["v"])
