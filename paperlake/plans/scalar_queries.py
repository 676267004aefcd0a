"""Column functions over the standard tables, one query per function family."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.plans.registry import query, scalar, table

c = F.col
HEAD = "text"
head = lambda: F.col("text")
RX = "regexp_replace"
KEY = f"{RX}(lower({{}}), '[^a-z0-9]+', '', 'g')"


def D(name, columns, sql):
    scalar(name, "documents", "doc_id", columns, sql)


def P(name, columns, sql):
    scalar(name, "pages", "page_id", columns, sql)


def squeezed(x):
    return f"trim({RX}({x}, '\\s+', ' ', 'g'))"


def slugged(x, default):
    return f"coalesce(nullif({RX}({RX}(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{default}')"


folded = f"replace(lower({squeezed(HEAD)}), 'ß', 'ss')"
padded = lambda: F.concat(F.lit("  \t"), head(), F.lit("\n "))

D("STR01_clean", lambda: {"v": X.clean(padded()), "blank": X.blank_to_null(F.lit(" \t"))},
  {"v": f"{RX}('  ' || chr(9) || {HEAD} || chr(10) || ' ', '^\\s+|\\s+$', '', 'g')", "blank": "CAST(NULL AS VARCHAR)"})
D("STR02_title_key", lambda: {"v": X.title_key(head())}, {"v": KEY.format(HEAD)})
D("STR03_spaced_key", lambda: {"v": X.spaced_key(head())}, {"v": f"trim({RX}(lower({HEAD}), '[^a-z0-9]+', ' ', 'g'))"})
D("STR04_folded_keys", lambda: {"folded": X.folded_key(head()), "ending": X.ending_key(head()), "dotless": X.one_dot_less(head())},
  {"folded": folded, "ending": f"{RX}({folded}, '[ .:;]+$', '')", "dotless": f"{RX}({RX}({HEAD}, '^\\s+|\\s+$', '', 'g'), '\\.$', '')"})
D("STR05_slug", lambda: {"v": X.slug(head()), "o": X.slug(F.lit("--"), "other")}, {"v": slugged(HEAD, "unknown"), "o": "'other'"})
D("STR06_file_slug", lambda: {"v": X.file_slug(head())},
  {"v": f"coalesce(nullif({RX}(substr({slugged(HEAD, '')}, 1, 120), '_+$', ''), ''), 'paper')"})
ents = "{}"
for name_, char_ in X.ENTITIES:
    ents = "replace({}, '{}', '{}')".format(ents, name_, char_.replace("'", "''"))
P("STR07_strip_tags", lambda: {"spaced": X.strip_tags("html"), "tight": X.strip_tags("html", "")},
  {"spaced": squeezed(ents.format(f"{RX}(html, '<[^>]+>', ' ', 'g')")), "tight": squeezed(ents.format(f"{RX}(html, '<[^>]+>', '', 'g')"))})
mixed = lambda: F.concat(F.when(c("doc_id") % 3 == 0, "https://doi.org/10.1109/CVPR.").when(c("doc_id") % 3 == 1, "doi:10.1/X").otherwise(""), c("doc_id").cast("string"))
MIXED = "(CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1109/CVPR.' WHEN doc_id % 3 = 1 THEN 'doi:10.1/X' ELSE '' END || CAST(doc_id AS VARCHAR))"
DOI = f"nullif({RX}({MIXED}, '^(https?://(dx\\.)?doi\\.org/|doi:)', '', 'i'), '')"
D("STR08_doi", lambda: {"v": X.doi(mixed()), "k": X.doi_key(mixed())}, {"v": DOI, "k": f"CASE WHEN starts_with(lower({DOI}), '10.') THEN lower({DOI}) END"})
note = lambda: F.concat(F.lit("see 10.1109/abc.("), c("doc_id").cast("string"), F.lit(") and 2401."), F.lpad(c("doc_id").cast("string"), 5, "0"), F.lit("v2 ok"))
NOTE = "('see 10.1109/abc.(' || CAST(doc_id AS VARCHAR) || ') and 2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v2 ok')"
D("STR09_find_doi", lambda: {"v": X.find_doi(note())}, {"v": f"nullif(regexp_extract({NOTE}, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'), '')"})
D("STR10_arxiv_id", lambda: {"v": X.arxiv_id(note())}, {"v": f"nullif(regexp_extract({NOTE}, '[0-9]{{4}}\\.[0-9]{{4,5}}(v[0-9]+)?'), '')"})
P("STR11_query_value", lambda: {"page": X.query_value("url", "page"), "ref": X.query_value("url", "ref"),
                        "note": X.openreview_id(F.lit(None).cast("string"), F.concat(F.lit("https://openreview.net/forum?id=N"), c("page_id").cast("string")))},
  {"page": "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')", "ref": "nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '')",
   "note": "'N' || CAST(page_id AS VARCHAR)"})
raw_track = lambda: F.when(c("doc_id") % 4 == 0, "Conference").when(c("doc_id") % 4 == 1, "Research Track").otherwise(c("source"))
SLUGT = slugged("(CASE WHEN doc_id % 4 = 0 THEN 'Conference' WHEN doc_id % 4 = 1 THEN 'Research Track' ELSE source END)", "main")
MEANT = ", ".join(f"'{a}'" for a, _ in X.TRACK_ALIASES)
TRACK = f"(CASE WHEN {SLUGT} IN ({MEANT}) THEN 'main' ELSE {SLUGT} END)"
D("STR12_track", lambda: {"track": X.track(raw_track()), "grp": X.track_group(raw_track()), "shown": X.display_name(raw_track())},
  {"track": TRACK, "grp": f"CASE WHEN {TRACK} = 'main' THEN 'main' ELSE 'other' END", "shown": f"upper({TRACK}[1]) || substr({TRACK}, 2)"})


def rules(x, pairs, default):
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{v}'" for w, v in pairs) + f" ELSE {default} END"


words = lambda: F.concat(c("source"), F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in ("Oral talk", "a Workshop demo", "Poster", "Best Paper", "dataset", "plain")]), (c("doc_id") % 6 + 1).cast("int")))
WORDS = "(source || ' ' || list_extract(['Oral talk','a Workshop demo','Poster','Best Paper','dataset','plain'], doc_id % 6 + 1))"
D("STR13_infer_track", lambda: {"v": X.infer_track(words())}, {"v": rules(f"lower({WORDS})", X.TRACK_RULES, "'main'")})
LEVEL = rules(f"lower({WORDS})", X.LEVEL_RULES, "'unknown'")
venue = lambda: F.when(c("doc_id") % 5 == 0, "TPAMI").otherwise("ICLR")
D("STR14_presentation_level", lambda: {"v": X.presentation_level(words(), venue())}, {"v": f"CASE WHEN doc_id % 5 = 0 THEN 'not_applicable' ELSE {LEVEL} END"})
GROUPS = [("articles", ["the ", "der "]), ("joins", ["and", "und", " et "]), ("rest", ["qu"])]


def labelled(x):
    arms = " ".join("WHEN " + " OR ".join(f"contains({x}, '{a}')" for a in al) + f" THEN '{g}'" for g, al in GROUPS)
    return f"CASE {arms} ELSE 'Other' END"


D("STR15_first_label", lambda: {"v": X.first_label(head(), GROUPS), "both": X.has_labels(head(), GROUPS, ["articles", "joins"])},
  {"v": labelled(folded), "both": f"(contains({folded}, 'the ') OR contains({folded}, 'der ')) AND (contains({folded}, 'and') OR contains({folded}, 'und') OR contains({folded}, ' et '))"})
D("STR16_cells", lambda: {"short": X.ellipsis(head(), 40), "cell": X.tsv_cell(head())},
  {"short": f"CASE WHEN length({HEAD}) > 40 THEN substr({HEAD}, 1, 39) || '…' ELSE {HEAD} END", "cell": f"translate({HEAD}, chr(9) || chr(13) || chr(10), '   ')"})


def _links():
    n, m = c("doc_id").cast("string"), c("doc_id") % 6
    ids = F.when(m == 0, F.create_map(F.lit("cvf_pdf_url"), F.concat(F.lit("https://x/"), n))).when(m == 1, F.create_map(F.lit("openreview_id"), n)).when(
        m == 2, F.create_map(F.lit("arxiv_id"), n)).when(m == 3, F.create_map(F.lit("my_pdf_url"), n)).otherwise(F.create_map(F.lit("none"), n))
    url = F.when(m == 4, F.concat(F.lit("https://aclanthology.org/"), n, F.lit("/"))).otherwise(F.lit("https://h/p"))
    return X.pdf_link(ids, url)


D("STR17_pdf_link", lambda: {"url": _links()["url"], "resolver": _links()["resolver"]},
  {"url": "CASE doc_id % 6 WHEN 0 THEN 'https://x/' || doc_id WHEN 1 THEN 'https://openreview.net/pdf?id=' || doc_id WHEN 2 THEN 'https://arxiv.org/pdf/' || doc_id || '.pdf' WHEN 3 THEN CAST(doc_id AS VARCHAR) WHEN 4 THEN 'https://aclanthology.org/' || doc_id || '.pdf' END",
   "resolver": "CASE doc_id % 6 WHEN 0 THEN 'source_ids:cvf_pdf_url' WHEN 1 THEN 'derived:openreview_id' WHEN 2 THEN 'derived:arxiv_id' WHEN 3 THEN 'source_ids:my_pdf_url' WHEN 4 THEN 'derived:page_url' END"})
link = lambda: F.regexp_extract("html", r'href="([^"]+)"', 1)
P("STR18_page_link", lambda: {"v": X.absolute("url", link())}, {"v": "regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(html, 'href=\"([^\"]+)\"', 1)"})
kind = lambda: F.element_at(F.array(F.lit("/a"), F.lit("b"), F.lit("//c.d/e"), F.lit("https://f/g")), (c("page_id") % 4 + 1).cast("int"))
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
P("STR19_absolute", lambda: {"v": X.absolute("url", kind())}, {"v": f"CASE page_id % 4 WHEN 0 THEN {ORIGIN} || '/a' WHEN 1 THEN {ORIGIN} || '/b' WHEN 2 THEN 'https://c.d/e' ELSE 'https://f/g' END"})
HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
P("STR20_in_domain", lambda: {"host": X.host("url"), "ok": X.in_domain("url", ["example.net", "example.org"])},
  {"host": HOST, "ok": f"{HOST} IN ('example.net','example.org') OR ends_with({HOST}, '.example.net') OR ends_with({HOST}, '.example.org')"})
P("STR21_redact_query", lambda: {"v": X.redact_query(F.concat(c("url"), F.lit("&api_key=abc&x=1")))}, {"v": f"{RX}(url || '&api_key=abc&x=1', '((?:api_key|apikey|token|key|secret|password)=)[^&#]*', '\\1***', 'g')"})
names = lambda: F.concat(c("source"), F.lit(",  A and "), c("lang"), F.lit(", B C"))
D("STR22_people", lambda: {"v": F.array_join(X.people(names()), "|"), "p": X.profile_name(F.concat(F.lit("~Ann_"), c("lang"), F.lit("_B1")))},
  {"v": "source || '|A|' || lang || '|B C'", "p": "'Ann ' || lang || ' B'"})
D("STR23_unlatex", lambda: {"v": X.unlatex(F.concat(F.lit("{M\\\"uller} \\& \\'ecole--"), c("source"), F.lit(" 25\\%")))}, {"v": "'Müller & école-' || source || ' 25%'"})


@query("STR24_sequence_ratio")
def sequence_ratios(spark, sf_dir):
    """Each benchmark text against the one before it."""
    from paperlake.functions.python_functions import sequence_ratio

    b = table(spark, sf_dir, "benchmark")
    before = b.select((c("item_id") + 1).alias("item_id"), c("text").alias("before"))
    return b.join(before, "item_id").select("item_id", F.round(sequence_ratio("before", "text"), 6).alias("v"))



D("STR25_subject_class", lambda: {"v": X.subject_class(words())}, {"v": f"CASE WHEN contains(lower({WORDS}), 'demo') THEN 'other' ELSE 'main' END || '/' || {LEVEL}"})
P("STR26_abstract_markup", lambda: {"v": X.strip_tags(F.regexp_extract("html", "<article>(.*)</article>", 1))}, {"v": squeezed(ents.format(f"{RX}(regexp_extract(html, '<article>(.*)</article>', 1), '<[^>]+>', ' ', 'g')"))})
P("STR27_extracted_ids", lambda: {"tail": F.regexp_extract("url", "/([0-9]+)", 1), "part": F.split_part("url", F.lit("/"), F.lit(4)), "pages": F.regexp_extract(F.concat(F.lit("pages = {"), c("page_id").cast("string"), F.lit("--99},")), r"pages\s*=\s*\{([0-9]+)-+([0-9]+)\}", 1)},
  {"tail": "regexp_extract(url, '/([0-9]+)', 1)", "part": "split_part(url, '/', 4)", "pages": "CAST(page_id AS VARCHAR)"})
D("STR28_number", lambda: {"v": X.number_in(F.concat(F.lit("accepted "), F.format_number(c("n_chars") * 1000, 0), F.lit(" papers")))}, {"v": "CAST(n_chars * 1000 AS BIGINT)"})
D("STR29_endpoint", lambda: {"v": X.endpoint(F.concat(F.lit(" http://"), c("source"), F.lit("/v1/embeddings/ ")))}, {"v": "'https://' || source || '/v1'"})
D("STR30_note_fields", lambda: {"level": X.presentation_level(F.concat_ws(" ", F.lit(None).cast("string"), words()), F.lit("ICLR")), "track": X.infer_track(F.concat_ws(" ", words(), c("source")))},
  {"level": LEVEL, "track": rules(f"lower({WORDS})", X.TRACK_RULES, "'main'")})
D("STR31_display_people", lambda: {"v": F.array_join(X.people(X.strip_tags(F.concat(F.lit("<i>"), names(), F.lit("</i>")))), "|")}, {"v": "source || '|A|' || lang || '|B C'"})
D("STR32_either_id", lambda: {"v": F.coalesce(X.blank_to_null(F.when(c("doc_id") % 2 == 0, c("source")).otherwise(F.lit(" "))), F.create_map(F.lit("openreview_id"), c("lang"))["openreview_id"])},
  {"v": "CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END"})

IDSQL = "'S2-' || substr(sha1(upper(lang) || ':' || CAST(2000 + doc_id % 25 AS VARCHAR) || ':' || {}), 1, 16)"
T1 = "split_part(text, chr(10), 1)"
t1 = lambda: F.split_part("text", F.lit("\n"), F.lit(1))
D("HSH01_paper_id", lambda: {"v": I.paper_id(F.upper("lang"), 2000 + c("doc_id") % 25, t1(), [c("source")]), "w": I.paper_id(F.upper("lang"), 2000 + c("doc_id") % 25, F.lit("日本"), [F.lit(None).cast("string")])},
  {"v": IDSQL.format(f"coalesce(nullif({KEY.format(T1)}, ''), source)"), "w": IDSQL.format("'missing-title'")})
D("HSH02_payload_hash", lambda: {"v": I.payload_hash(F.create_map(F.lit("b"), c("source"), F.lit("a"), c("lang")))}, {"v": "sha256('{\"a\":\"' || lang || '\",\"b\":\"' || source || '\"}')"})
D("HSH04_content_hash", lambda: {"v": F.sha2(F.encode("text", "UTF-8"), 256)}, {"v": "sha256(text)"})
D("MTH02_source_score", lambda: {"v": F.when(c("lang") == "en", 8).otherwise(0) + 5 * (F.when(c("source").contains("1"), 1).otherwise(0) + F.when(c("source").contains("2"), 1).otherwise(0)) + F.when(c("doc_id") % 2 == 0, 2).otherwise(0) + F.least(F.lit(3.0), c("n_chars") / 50000)},
  {"v": "CAST(CASE WHEN lang = 'en' THEN 8 ELSE 0 END + 5 * (CASE WHEN contains(source, '1') THEN 1 ELSE 0 END + CASE WHEN contains(source, '2') THEN 1 ELSE 0 END) + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS DOUBLE) + least(3.0e0, n_chars / 50000.0e0)"})
anchor = lambda: F.regexp_extract("html", "<title>([^<]*)</title>", 1)
ANCHOR = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
P("MTH03_anchor_score", lambda: {"v": F.least(F.length(anchor()), F.lit(80)) + 2 * F.size(F.split(X.squeeze(anchor()), " ")) - 3 * F.regexp_count(anchor(), F.lit("[0-9]")) - F.regexp_count(anchor(), F.lit("[!?*#%$]"))},
  {"v": f"CAST(least(length({ANCHOR}), 80) + 2 * len(string_split({squeezed(ANCHOR)}, ' ')) - 3 * len(regexp_extract_all({ANCHOR}, '[0-9]')) - len(regexp_extract_all({ANCHOR}, '[!?*#%$]')) AS INTEGER)"})
scalar("MTH04_similarity", "events", "event_id", lambda: {"v": F.round(I.similarity(c("value") - 5), 9)}, {"v": "round(1.0e0 / (1.0e0 + greatest(value - 5, 0.0e0)), 9)"})
spots = lambda: F.transform(F.split("text", " "), lambda t, i: F.struct(t.alias("token"), F.array((F.lit(7919).cast("long") * i + 13) % 1000003, F.lit(2000000).cast("long") + i).alias("positions")))
D("ARR01_positions_to_text", lambda: {"v": I.text_of_positions(spots())},
  {"v": "(SELECT string_agg(t, ' ' ORDER BY p) FROM (SELECT t, p FROM (SELECT unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) - 1 AS i) s, LATERAL (SELECT unnest([(7919 * i + 13) % 1000003, 2000000 + i]) AS p) q))"})
D("ARR02_list_coercion", lambda: {"v": F.array_join(F.coalesce(F.from_json(_poly := F.when(c("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(c("lang")), "array<string>"), F.array(_poly)), "|")},
  {"v": "CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE lang END"})
have = lambda: F.create_map(F.lit("a"), c("lang"), F.lit("b"), F.lit(" "))
D("MAP01_defaults", lambda: {"v": I.sorted_json(I.with_defaults(have(), F.create_map(F.lit("a"), F.lit("x"), F.lit("c"), c("source"))))}, {"v": "'{\"a\":\"' || lang || '\",\"b\":\" \",\"c\":\"' || source || '\"}'"})
D("MAP02_clean_map", lambda: {"v": I.sorted_json(I.clean_map(have()))}, {"v": "'{\"a\":\"' || lang || '\"}'"})
D("MAP03_count_map", lambda: {"v": I.sorted_json(I.count_map(F.create_map(F.lit("Main Track"), c("n_chars").cast("string"), F.lit("x"), F.lit("true"))))}, {"v": "'{\"main_track\":' || n_chars || '}'"})
scalar("JSN01_cell_map", "events", "event_id", lambda: {"v": I.cell_map(F.when(c("event_id") % 5 == 0, "{broken").otherwise(c("props")))["k"]}, {"v": "CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END"})
scalar("JSN02_unwrap", "events", "event_id", lambda: {"v": I.unwrapped(F.when(c("event_id") % 2 == 0, F.concat(F.lit('{"k":{"value":'), c("event_id").cast("string"), F.lit("}}"))).otherwise(c("props")), "k")},
       {"v": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE json_extract_string(props, '$.k') END"})
scalar("JSN03_first_object", "events", "event_id", lambda: {"v": I.first_object(F.concat(F.lit("```json\n"), c("props"), F.lit("\n``` done")))}, {"v": "props"})
FL = lambda: I.quality_flags(c("doc_id") % 5 == 0, F.when(c("doc_id") % 4 == 0, " ").otherwise(c("text")), F.when(c("doc_id") % 3 == 0, F.lit(None)).otherwise(c("lang")), c("source"), c("n_chars"), F.lit("resolved"))
D("FLG01_quality_flags", lambda: {"v": F.array_join(I.merge_flags(FL(), F.array(F.lit("missing_doi"), F.lit("custom")), ["missing_authors", "missing_abstract", "missing_doi", "missing_url", "missing_year", "placeholder"]), ",")},
  {"v": "array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'missing_authors' END, CASE WHEN doc_id % 4 = 0 OR trim(text) = '' THEN 'missing_abstract' END, CASE WHEN doc_id % 3 = 0 THEN 'missing_doi' END, 'custom'], lambda x: x IS NOT NULL), ',')"})
D("FLG02_record_transform", lambda: {"id": I.paper_id(F.upper("lang"), 2000 + c("doc_id") % 25, t1(), [c("source")]), "doi": X.doi(mixed()), "status": I.record_status(F.when(c("doc_id") % 7 == 0, "Repaired ").otherwise(c("source"))), "track": X.track(raw_track()), "level": X.presentation_level(words(), F.lit("ICLR"))},
  {"id": IDSQL.format(f"coalesce(nullif({KEY.format(T1)}, ''), source)"), "doi": DOI, "status": "CASE WHEN doc_id % 7 = 0 THEN 'repaired' ELSE 'resolved' END", "track": TRACK, "level": LEVEL})
target = lambda: F.concat(F.upper("lang"), F.lit("-"), F.lpad((c("doc_id") % 25).cast("string"), 2, "0"))
D("DAT02_target", lambda: {"venue": F.regexp_extract(target(), "^([A-Z]+)-([0-9]+)$", 1), "year": I.full_year(F.regexp_extract(target(), "^([A-Z]+)-([0-9]+)$", 2).cast("int"))}, {"venue": "upper(lang)", "year": "CAST(2000 + doc_id % 25 AS INTEGER)"})
D("DAT03_volume", lambda: {"v": ((2000 + c("doc_id") % 25) - 2007).cast("int")}, {"v": "CAST(doc_id % 25 - 7 AS INTEGER)"})
D("FLT05_csv_list", lambda: {"v": F.array_join(F.filter(F.transform(F.split(F.concat(c("lang"), F.lit(", ,x ,"), c("source")), ","), lambda v: F.upper(F.trim(v))), lambda v: v != ""), "|")}, {"v": "upper(lang) || '|X|' || upper(source)"})
D("REC15_provenance", lambda: {"v": I.provenance(F.when(c("doc_id") % 3 == 0, "OpenReview").when(c("doc_id") % 3 == 1, "dblp").otherwise(c("source")))}, {"v": "CASE doc_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'dblp' ELSE 'venue_special' END"})
D("DED11_ordered_distinct", lambda: {"v": F.array_join(X.distinct_folded(F.split("text", " ")), " "), "w": F.array_join(F.array_distinct(F.split("text", " ")), " ")},
  {"v": "(SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT arg_min(t, i) AS t, min(i) AS i FROM (SELECT regexp_replace(unnest(string_split(" + HEAD + ", ' ')), '^\\s+|\\s+$', '', 'g') AS t, generate_subscripts(string_split(" + HEAD + ", ' '), 1) AS i) WHERE t <> '' GROUP BY lower(t)))",
   "w": "(SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(string_split(" + HEAD + ", ' ')) AS t, generate_subscripts(string_split(" + HEAD + ", ' '), 1) AS i) GROUP BY t))"})
D("MTH01_coverage", lambda: {"v": I.coverage(c("n_chars") % 97, c("doc_id") % 320)}, {"v": "CASE WHEN doc_id % 320 > 0 THEN round_even(100.0e0 * (n_chars % 97) / (doc_id % 320), 2) ELSE 0.0e0 END"})
D("VEC01_vector_text", lambda: {"v": F.sha2(X.clean(F.concat(t1(), F.lit("\n\n"), F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)"))), 256)},
  {"v": f"sha256({RX}({T1} || chr(10) || chr(10) || substr(text, length({T1}) + 2), '^\\s+|\\s+$', '', 'g'))"})
D("VEC02_text_hash", lambda: {"v": F.sha2("text", 256)}, {"v": "sha256(text)"})


@query("SRC03_source_key", "SELECT 'documents' AS source_key, count(*) AS n FROM documents")
def source_key(spark, sf_dir):
    """Identity of the source file whatever path it was read by."""
    name = F.regexp_extract(c("_metadata.file_path"), r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return table(spark, sf_dir, "documents").select(name.alias("source_key")).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
