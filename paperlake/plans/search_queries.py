"""Search, filters, paging, export and catalog statistics over papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import index as N
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.plans.registry import PAPERS_SQL, papers, query, search_index, table

c = F.col
one = lambda name: F.count(F.lit(1)).alias(name)
TEXT = "from with"
TOK = "regexp_extract_all(strip_accents(lower(concat_ws(' ', title, abstract))), '[\\p{L}\\p{N}]+')"
SHOW = ("paper_id", "venue", "year", "citation_count")
SHOWN = "paper_id, venue, year, citation_count"
#: What searching needs of the papers besides the index.
NARROW = (*SHOW, "track", "presentation_level", "record_status")
OPEN = "record_status <> 'placeholder'"
BASE = f"WITH {PAPERS_SQL}, tok AS (SELECT *, {TOK} AS t FROM papers), "
HIT = "list_contains(t, 'from') AND list_contains(t, 'with')"
SCORED = f"""{BASE} tf AS (SELECT *, len(t) AS dl, len(list_filter(t, lambda v: v = 'from')) AS f0, len(list_filter(t, lambda v: v = 'with')) AS f1 FROM tok),
g AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM tf),
i AS (SELECT n, av, greatest(ln((n - d0 + 0.5e0) / (d0 + 0.5e0)), 0.0e0) AS i0, greatest(ln((n - d1 + 0.5e0) / (d1 + 0.5e0)), 0.0e0) AS i1 FROM g),
s AS (SELECT tf.*, -(CASE WHEN i0 <= 0 THEN 1.0e-6 ELSE i0 END) * f0 * 2.2e0 / (f0 + 1.2e0 * (0.25e0 + 0.75e0 * dl / av))
                   -(CASE WHEN i1 <= 0 THEN 1.0e-6 ELSE i1 END) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)) AS score
      FROM tf, i WHERE f0 > 0 AND f1 > 0 AND {OPEN})"""
CIT = "coalesce(citation_count, -1) DESC"
ORDERS = {"bm25": f"round(score, 9), year DESC, {CIT}, paper_id", "year": f"year DESC, {CIT}, paper_id", "citation": f"{CIT}, year DESC, paper_id"}


def _paged(sql, by, k=20, o=0):
    return f"{sql} SELECT {SHOWN}, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY {ORDERS[by]}) + {o} AS INTEGER) AS rank FROM (SELECT * FROM s ORDER BY {ORDERS[by]} LIMIT {k} OFFSET {o})"


@query("FTS01_index", f"{BASE} p AS (SELECT paper_id, unnest(t) AS term FROM tok) SELECT term, count(*) AS postings, count(DISTINCT paper_id) AS df FROM p GROUP BY term")
def _(spark, sf):
    return search_index(spark, sf).postings().groupBy("term").agg(F.sum("tf").alias("postings"), one("df"))


@query("FTS02_query_terms", "WITH q AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM benchmark) SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda v: {'i': list_position(t, v), 'v': v})), lambda s: s.v), ' ') AS terms FROM q")
def _(spark, sf):
    """Every benchmark text as a query: its distinct terms in order."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_distinct(S.tokens(c("text"))), " ").alias("terms"))


@query("FTS03_match_count", f"{BASE} m AS (SELECT * FROM tok WHERE {HIT} AND {OPEN}) SELECT venue, count(*) AS n FROM m GROUP BY venue")
def _(spark, sf):
    return N.find(papers(spark, sf).select(*NARROW), search_index(spark, sf), TEXT).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))


WORDS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
PHRASE = """len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'of' AND {0}[i + 1] = 'the'))"""


@query("FTS02_phrase", f"""WITH {PAPERS_SQL}, w AS (SELECT *, {WORDS.format('title')} AS a, {WORDS.format('abstract')} AS b FROM papers),
tf AS (SELECT *, len(a) + len(b) AS dl, {PHRASE.format('a')} + {PHRASE.format('b')} AS f0, len(list_filter(a || b, lambda v: v = 'and')) AS f1 FROM w),
g AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM tf),
i AS (SELECT n, av, greatest(ln((n - d0 + 0.5e0) / (d0 + 0.5e0)), 0.0e0) AS i0, greatest(ln((n - d1 + 0.5e0) / (d1 + 0.5e0)), 0.0e0) AS i1 FROM g)
SELECT paper_id, f0 AS phrase, f1 AS word, round(-(CASE WHEN i0 <= 0 THEN 1.0e-6 ELSE i0 END) * f0 * 2.2e0 / (f0 + 1.2e0 * (0.25e0 + 0.75e0 * dl / av))
  -(CASE WHEN i1 <= 0 THEN 1.0e-6 ELSE i1 END) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)), 6) AS score
FROM tf, i WHERE f0 > 0 AND f1 > 0""")
def _(spark, sf):
    """A query with a phrase, ``of_the and``: every match with its frequencies and score."""
    index = search_index(spark, sf)
    found = N.frequencies(index, S.query_phrases("of_the and")).filter("f0 > 0 and f1 > 0")
    return N.scored(index, "of_the and").join(found, "paper_id").select("paper_id", c("f0").alias("phrase"), c("f1").alias("word"), F.round("score", 6).alias("score"))


def _search(by, k=20, o=0, filters=None):
    def run(spark, sf):
        rows = S.page(N.find(papers(spark, sf).select(*NARROW), search_index(spark, sf), TEXT, filters), S.order(by), k, o)
        return rows.select(*SHOW, F.round("score", 6).alias("score"), "rank")

    return run


query("FTS04_bm25_rank", _paged(SCORED, "bm25"))(_search("bm25"))
query("FTS05_order_year", _paged(SCORED, "year"))(_search("year"))
query("FTS06_order_citation", _paged(SCORED, "citation"))(_search("citation"))
query("TOP01_offset_page", _paged(SCORED, "bm25", 7, 11))(_search("bm25", 7, 11))
query("TOP02_ranks", _paged(SCORED, "citation", 5, 3))(_search("citation", 5, 3))
query("TOP03_recall_filtered", _paged(SCORED.replace(OPEN, f"{OPEN} AND venue IN ('EN','FR') AND year >= 2005 AND year <= 2020"), "bm25", 100))(
    _search("bm25", 100, 0, S.Filters(venues=("EN", "FR"), year_from=2005, year_to=2020)))


@query("FTS07_index_alignment", "SELECT count(*) AS papers, count(*) AS indexed, true AS aligned FROM documents")
def _(spark, sf):
    """Counts of papers and indexed texts, and whether their ids are the same."""
    p = papers(spark, sf, labelled=False).select("paper_id", F.lit(1).alias("p"))
    both = p.join(search_index(spark, sf).texts().select("paper_id", F.lit(1).alias("i")), "paper_id", "full")
    return both.agg(F.count("p").alias("papers"), F.count("i").alias("indexed"), F.bool_and(c("p").isNotNull() & c("i").isNotNull()).alias("aligned"))


@query("FTS08_full_drain", f"{SCORED} SELECT paper_id, round(score, 6) AS score FROM s ORDER BY {ORDERS['bm25']} LIMIT 2000")
def _(spark, sf):
    return N.find(papers(spark, sf).select(*NARROW), search_index(spark, sf), TEXT).orderBy(*S.order("bm25")).limit(2000).select("paper_id", F.round("score", 6).alias("score"))


GROUPS = [("conj", ["and ", "und "]), ("art", ["the ", "die "])]
HAY = "replace(lower(trim(regexp_replace(concat_ws(' ', title, abstract), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("FTS09_candidates", f"""{BASE} u AS (SELECT *, CASE WHEN {HIT} THEN 0 WHEN list_contains(t, 'mit') THEN 1 END AS query_ord FROM tok WHERE {OPEN})
SELECT paper_id, query_ord FROM u WHERE query_ord IS NOT NULL AND (contains({HAY}, 'and ') OR contains({HAY}, 'und ')) AND (contains({HAY}, 'the ') OR contains({HAY}, 'die '))""")
def _(spark, sf):
    found = N.first_of(papers(spark, sf), search_index(spark, sf), [TEXT, "mit"])
    return found.filter(X.has_labels(S.document(), GROUPS, ["conj", "art"])).select("paper_id", "query_ord")


def _filtered(name, cond_sql, filters):
    @query(name, f"WITH {PAPERS_SQL} SELECT {SHOWN}, track, record_status FROM papers WHERE {cond_sql}")
    def _(spark, sf):
        return papers(spark, sf).filter(filters.condition()).select(*SHOW, "track", "record_status")


_filtered("FLT01_filters", f"venue IN ('EN','DE') AND year >= 2003 AND year <= 2019 AND track = 'src4' AND presentation_level = 'poster' AND {OPEN}", S.Filters(("EN", "DE"), 2003, 2019, "src4", "poster"))
_filtered("FLT02_placeholders_out", OPEN, S.Filters())
_filtered("FLT06_candidate_filter", f"venue IN ('FR') AND year >= 2010", S.Filters(("FR",), 2010, include_placeholder=True))


@query("FLT03_point_lookup", f"WITH {PAPERS_SQL} SELECT p.paper_id, p.title, (SELECT string_agg(role || ':' || length(text), ';' ORDER BY turn) FROM conversations v WHERE v.conv_id = p.paper_id) AS children FROM papers p WHERE paper_id = 7")
def _(spark, sf):
    one = papers(spark, sf).filter("paper_id = 7").select("paper_id", "title")
    kids = table(spark, sf, "conversations").filter("conv_id = 7").select(c("conv_id").alias("paper_id"), "turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("v"))
    return one.join(R.ordered_children(kids, "paper_id", "turn", "v", "c"), "paper_id", "left").select("paper_id", "title", F.array_join("c", ";").alias("children"))


@query("FLT04_bulk_ids", f"WITH {PAPERS_SQL} SELECT {SHOWN} FROM papers WHERE paper_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def _(spark, sf):
    ids = table(spark, sf, "embeddings").filter("label = 3").select(c("vec_id").alias("paper_id"))
    return papers(spark, sf).join(ids, "paper_id", "left_semi").select(*SHOW)


@query("FLT07_allowed_sources", "SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) LIKE '%.example.net' AND page_id % 2 = 0 OR lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) LIKE '%.example.org' AND page_id % 2 = 1")
def _(spark, sf):
    """Allowed domains depend on the record's edition."""
    return table(spark, sf, "pages").filter(F.when(c("page_id") % 2 == 0, X.in_domain("url", ["example.net"])).otherwise(X.in_domain("url", ["example.org"]))).select("page_id")


@query("FLT08_editorial_titles", f"WITH {PAPERS_SQL} SELECT paper_id, title FROM papers WHERE NOT regexp_matches(title, '^(?i)(the |der |erratum|front matter)') AND year <> 2004")
def _(spark, sf):
    return papers(spark, sf).filter(~c("title").rlike("^(?i)(the |der |erratum|front matter)") & (c("year") != 2004)).select("paper_id", "title")


@query("FLT09_noise_anchor", "SELECT page_id, regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) IN ('the','de','la','Home','') OR regexp_matches(regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), '^[0-9]+$') AS noise FROM pages")
def _(spark, sf):
    a = F.regexp_extract("html", '<a href="[^"]*">([^<]*)</a>', 1)
    return table(spark, sf, "pages").select("page_id", (a.isin("the", "de", "la", "Home", "") | a.rlike("^[0-9]+$")).alias("noise"))


@query("FLT10_accepted_note", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN value > 10 AND event_type = 'click' THEN 'accepted' WHEN value <= 2 THEN 'withdrawn' ELSE 'pending' END AS decision FROM events")
def _(spark, sf):
    kind = c("event_type")
    rule = F.when(kind == "error", "rejected").when((c("value") > 10) & (kind == "click"), "accepted").when(c("value") <= 2, "withdrawn").otherwise("pending")
    return table(spark, sf, "events").select("event_id", rule.alias("decision"))


@query("FLT11_placeholder_rule", f"WITH {PAPERS_SQL} SELECT paper_id, (record_status = 'placeholder' OR (trim(abstract) = '' AND citation_count IS NULL)) AS placeholder FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("paper_id", ((c("record_status") == "placeholder") | ((F.trim("abstract") == "") & c("citation_count").isNull())).alias("placeholder"))


@query("FLT12_vector_candidates", f"WITH {PAPERS_SQL} SELECT paper_id, year, venue FROM papers WHERE {OPEN} ORDER BY year, venue, paper_id LIMIT 200")
def _(spark, sf):
    return papers(spark, sf).filter(S.Filters().condition()).orderBy("year", "venue", "paper_id").limit(200).select("paper_id", "year", "venue")


@query("FLT13_source_manifest", "SELECT DISTINCT source FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    listed = d.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("source").distinct()
    return d.select("source").distinct().join(listed, "source", "left_semi")


@query("FLT14_enrichment_candidates", f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE {OPEN} AND trim(abstract) = '' ORDER BY paper_id LIMIT 25")
def _(spark, sf):
    return papers(spark, sf).filter(S.Filters().condition() & (F.trim("abstract") == "")).orderBy("paper_id").limit(25).select("paper_id")


CANON = "title, venue, year, abstract, citation_count, track, presentation_level, record_status"


@query("PRJ01_canonical", f"WITH {PAPERS_SQL} SELECT paper_id, {CANON} FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("paper_id", *CANON.split(", "))


@query("PRJ02_coerced_row", f"WITH {PAPERS_SQL} SELECT paper_id, nullif(trim(track), 'src0') AS doi, TRY_CAST(CASE WHEN paper_id % 2 = 0 THEN '12' ELSE 'n/a' END AS BIGINT) AS citations, coalesce(abstract, '') AS abstract FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("paper_id", F.nullif(F.trim("track"), F.lit("src0")).alias("doi"), F.when(c("paper_id") % 2 == 0, "12").otherwise("n/a").try_cast("long").alias("citations"), F.coalesce("abstract", F.lit("")).alias("abstract"))


KIDS = "(SELECT string_agg(role, '; ' ORDER BY turn) FROM conversations v WHERE v.conv_id = h.paper_id)"


@query("PRJ03_search_rows", f"{SCORED}, h AS (SELECT * FROM s ORDER BY {ORDERS['bm25']} LIMIT 20) SELECT paper_id, title, venue, year, coalesce({KIDS}, '') AS authors FROM h")
def _(spark, sf):
    p = papers(spark, sf)
    hits = S.page(N.find(p.select(*NARROW), search_index(spark, sf), TEXT), S.order("bm25"))
    hits = N.with_columns(hits, p, "paper_id", ["title"])
    kids = table(spark, sf, "conversations").select(c("conv_id").alias("paper_id"), "turn", "role")
    kids = kids.join(F.broadcast(hits.select("paper_id")), "paper_id", "left_semi")
    full = R.with_children(hits, R.ordered_children(kids, "paper_id", "turn", "role", "authors"), "paper_id", "authors")
    return full.select("paper_id", "title", "venue", "year", F.array_join("authors", "; ").alias("authors"))


EXPORT = "translate({}, chr(9) || chr(13) || chr(10), '   ')"


@query("PRJ04_export_rows", f"WITH {PAPERS_SQL} SELECT paper_id, {EXPORT.format('title')} AS title, '{{\"track\":\"' || track || '\",\"venue\":\"' || venue || '\"}}' AS source_ids, {EXPORT.format('abstract')} AS abstract FROM papers")
def _(spark, sf):
    from paperlake.functions.ids import sorted_json

    return papers(spark, sf).select("paper_id", X.tsv_cell("title").alias("title"), sorted_json(F.create_map(F.lit("venue"), c("venue"), F.lit("track"), c("track"))).alias("source_ids"), X.tsv_cell("abstract").alias("abstract"))


@query("SNK04_tsv_cells", f"WITH {PAPERS_SQL} SELECT row_number() OVER (ORDER BY year DESC, paper_id) AS rank, paper_id, {EXPORT.format('title')} AS title FROM papers ORDER BY year DESC, paper_id LIMIT 50")
def _(spark, sf):
    rows = papers(spark, sf).orderBy(c("year").desc(), "paper_id").limit(50)
    from pyspark.sql.window import Window

    return rows.select(F.row_number().over(Window.orderBy(c("year").desc(), "paper_id")).cast("long").alias("rank"), "paper_id", X.tsv_cell("title").alias("title"))


@query("PRJ05_noise_stripped", f"WITH {PAPERS_SQL} SELECT paper_id, sha256(title || '|' || venue || '|' || CAST(year AS VARCHAR)) AS fingerprint FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("paper_id", F.sha2(F.concat_ws("|", "title", "venue", c("year").cast("string")), 256).alias("fingerprint"))


@query("PRJ06_shaped_records", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN contains(html, '<article>') AND page_id % 3 > 0 THEN 'resolved' ELSE 'placeholder' END AS record_status FROM pages")
def _(spark, sf):
    ok = c("html").contains("<article>") & (c("page_id") % 3 > 0)
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.when(ok, "resolved").otherwise("placeholder").alias("record_status"))


CONCEPTS = "[{'n': lang, 's': 0.9}, {'n': source, 's': (doc_id % 10) / 10.0e0}, {'n': 'x', 's': 0.1}, {'n': lang, 's': 0.5}]"


@query("PRJ07_nested_keywords", f"SELECT doc_id, lang || CASE WHEN (doc_id % 10) / 10.0e0 >= 0.35e0 THEN '|' || source ELSE '' END AS keywords FROM documents")
def _(spark, sf):
    concepts = F.array(*[F.struct(n.alias("n"), s.alias("s")) for n, s in ((c("lang"), F.lit(0.9)), (c("source"), c("doc_id") % 10 / 10.0), (F.lit("x"), F.lit(0.1)), (c("lang"), F.lit(0.5)))])
    kept = F.slice(F.array_distinct(F.transform(F.filter(concepts, lambda k: k["s"] >= 0.35), lambda k: k["n"])), 1, 8)
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, "|").alias("keywords"))


@query("TOP10_keywords", "SELECT doc_id, CASE WHEN doc_id % 10 >= 6 THEN source || '|' || lang || '|x' WHEN doc_id % 10 >= 3 THEN lang || '|' || source || '|x' ELSE lang || '|x|' || source END AS keywords FROM documents")
def _(spark, sf):
    k = [(c("lang"), F.lit(0.55)), (c("source"), c("doc_id") % 10 / 10.0), (F.lit("x"), F.lit(0.25)), (c("lang"), F.lit(0.1))]
    s = F.array(*[F.struct((-w).alias("w"), n.alias("n")) for n, w in k])
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.transform(F.array_sort(s), lambda v: v["n"])), 1, 12), "|").alias("keywords"))


@query("CAT01_stats", f"WITH {PAPERS_SQL} SELECT 'total' AS kind, '' AS name, count(*) AS n FROM papers UNION ALL SELECT 'status', record_status, count(*) FROM papers GROUP BY record_status UNION ALL SELECT 'venue-year', venue || '-' || year, count(*) FROM papers GROUP BY venue, year")
def _(spark, sf):
    p = papers(spark, sf)
    name = F.concat_ws("-", "venue", c("year").cast("string"))
    sets = F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("status").alias("kind"), c("record_status").alias("name")), F.struct(F.lit("venue-year").alias("kind"), name.alias("name"))))
    return p.select(sets.alias("s")).groupBy("s.kind", "s.name").agg(F.count(F.lit(1)).alias("n")).select("kind", "name", "n")
