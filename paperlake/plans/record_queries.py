"""Deduplication, reconciliation, gates and enrichment over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.operators import dedupe as D
from paperlake.operators import relational as R
from paperlake.operators.storage import cut
from paperlake.plans.aggregate_queries import KEY, PCT, QUALITY, quality
from paperlake.plans.registry import PAPERS_SQL, papers, query, table

c = F.col
one = lambda name: F.count(F.lit(1)).alias(name)
SCORE = "(CASE WHEN trim(title) <> '' THEN 6 ELSE 0 END + CASE WHEN trim(abstract) <> '' THEN 6 ELSE 0 END + CASE WHEN citation_count IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN record_status <> 'placeholder' THEN 2 ELSE 0 END)"
KEYED = f"WITH {PAPERS_SQL}, k AS (SELECT *, coalesce(nullif({KEY}, ''), '__row__' || paper_id) AS k, {SCORE} AS score FROM papers)"


def keyed(spark, sf):
    p = papers(spark, sf)
    score = D.survivor_score([F.trim("title") != "", F.trim("abstract") != ""], [c("citation_count").isNotNull(), c("record_status") != "placeholder"], F.lit(False))
    return p.withColumn("k", I.dedupe_key(c("title"), [], c("paper_id"))).withColumn("score", score)


@query("DED01_title_dedupe", f"{KEYED} SELECT k, arg_min(paper_id, (-score, paper_id)) AS paper_id, count(*) - 1 AS duplicates_removed FROM k GROUP BY k")
def _(spark, sf):
    return keyed(spark, sf).groupBy("k").agg(F.min_by("paper_id", F.struct(-c("score"), "paper_id")).alias("paper_id"), (F.count(F.lit(1)) - 1).alias("duplicates_removed"))


@query("DED02_survivor_score", f"{KEYED} SELECT paper_id, score FROM k")
def _(spark, sf):
    return keyed(spark, sf).select("paper_id", "score")


@query("DED03_survivor_merge", f"""{KEYED} SELECT k, arg_min(title, (-score, paper_id)) AS title, arg_min(citation_count, (-score, paper_id)) FILTER (citation_count IS NOT NULL) AS citation_count,
 bool_and(record_status = 'placeholder') AS external_only, count(*) - 1 AS duplicates_removed,
 (SELECT string_agg(v, ',' ORDER BY o) FROM (SELECT track AS v, min((-score * 10000000 + paper_id)) AS o FROM k j WHERE j.k = k.k GROUP BY track)) AS tracks FROM k GROUP BY k""")
def _(spark, sf):
    rows = keyed(spark, sf).withColumn("tracks", F.array("track")).withColumn("external_only", c("record_status") == "placeholder").withColumn("ids", F.create_map(F.lit("venue"), c("venue")))
    m = D.merge_groups(rows, "k", c("score"), "paper_id", ["title", "citation_count"], ["tracks"], ["ids"], ["external_only"])
    return m.select("k", "title", "citation_count", "external_only", "duplicates_removed", F.array_join("tracks", ",").alias("tracks"))


@query("DED04_last_wins", f"WITH {PAPERS_SQL} SELECT lower(title) AS k, max(paper_id) AS paper_id, arg_max(venue, paper_id) AS venue FROM papers GROUP BY 1")
def _(spark, sf):
    return papers(spark, sf).groupBy(F.lower("title").alias("k")).agg(F.max("paper_id").alias("paper_id"), F.max_by("venue", "paper_id").alias("venue"))


RANK = "CASE presentation_level WHEN 'bestpaper' THEN 3 WHEN 'oral' THEN 2 ELSE 1 END"


@query("DED05_best_level", f"{KEYED} SELECT k, arg_min(paper_id, (-score, paper_id)) AS paper_id, max({RANK}) AS level_rank FROM k GROUP BY k")
def _(spark, sf):
    rank = F.when(c("presentation_level") == "bestpaper", 3).when(c("presentation_level") == "oral", 2).otherwise(1)
    return keyed(spark, sf).groupBy("k").agg(F.min_by("paper_id", F.struct(-c("score"), "paper_id")).alias("paper_id"), F.max(rank).alias("level_rank"))


@query("DED06_score_tuple", f"{KEYED} SELECT k, arg_min(paper_id, (-{RANK}, -score, paper_id)) AS paper_id, count(*) > 1 AS repeated FROM k GROUP BY k")
def _(spark, sf):
    rank = F.when(c("presentation_level") == "bestpaper", 3).when(c("presentation_level") == "oral", 2).otherwise(1)
    return keyed(spark, sf).groupBy("k").agg(F.min_by("paper_id", F.struct(-rank, -c("score"), "paper_id")).alias("paper_id"), (F.count(F.lit(1)) > 1).alias("repeated"))


@query("DED07_memberships", f"{KEYED} SELECT k, arg_min(track, (length(track), track)) AS track, (SELECT string_agg(track, ',' ORDER BY length(track), track) FROM (SELECT DISTINCT track FROM k j WHERE j.k = k.k)) AS memberships FROM k GROUP BY k")
def _(spark, sf):
    g = keyed(spark, sf).groupBy("k").agg(F.array_sort(F.collect_set(F.struct(F.length("track").alias("p"), "track"))).alias("m"))
    return g.select("k", c("m")[0]["track"].alias("track"), F.array_join(F.transform("m", lambda v: v["track"]), ",").alias("memberships"))


@query("DED08_newest_note", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("DED09_first_wins", "SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("DED10_title_conflicts", "SELECT c_nationkey % 5 AS k, count(DISTINCT c_mktsegment) > 1 AS conflict FROM customer GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy((c("c_nationkey") % 5).alias("k")).agg((F.countDistinct("c_mktsegment") > 1).alias("conflict"))


ST = "(SELECT paper_id, unnest(['paper:' || paper_id, 'key:' || {0}]) AS id FROM papers)".format(KEY)


@query("REC01_stable_ids", f"WITH {PAPERS_SQL} SELECT paper_id, 'paper:' || paper_id || ',doi:10.1/' || paper_id || ',arxiv_id:' || venue AS ids FROM papers")
def _(spark, sf):
    n = c("paper_id").cast("string")
    ids = I.stable_ids(n, F.concat(F.lit("10.1/"), n), F.lit(""), F.create_map(F.lit("arxiv_id"), c("venue"), F.lit("other"), c("track")))
    return papers(spark, sf).select("paper_id", F.array_join(ids, ",").alias("ids"))


#: Two snapshots of all papers: in the new one the German titles have changed; the policy
#: approves the changes of cited papers.
NEWER = "CASE WHEN venue = 'DE' THEN 'New ' || title ELSE title END"
OLD = f"WITH {PAPERS_SQL}, o AS (SELECT paper_id AS old, {KEY} AS k, title FROM papers), n AS (SELECT new, {KEY} AS k, title FROM (SELECT paper_id + 100000 AS new, {NEWER} AS title FROM papers)), pol AS (SELECT paper_id AS old, 'New ' || title AS id FROM papers WHERE citation_count = 1)"
UO = "(SELECT k AS id, min(old) AS old FROM o WHERE k <> '' GROUP BY k HAVING count(DISTINCT old) = 1)"
M1 = f"m1 AS (SELECT old, min(new) AS new FROM (SELECT n.new, u.old FROM n JOIN {UO} u ON n.k = u.id) GROUP BY old)"
MR = "mr AS (SELECT old, min(new) AS new FROM (SELECT n.new, u.old FROM (SELECT * FROM n WHERE new NOT IN (SELECT new FROM m1)) n JOIN (SELECT id, min(old) AS old FROM pol WHERE old NOT IN (SELECT old FROM m1) GROUP BY id HAVING count(DISTINCT old) = 1) u ON n.title = u.id) GROUP BY old)"
M2 = "d2 AS (SELECT old, new FROM m1 UNION ALL SELECT old, new FROM mr), m2 AS (SELECT old, min(new) AS new FROM (SELECT n.new, u.old FROM (SELECT * FROM n WHERE new NOT IN (SELECT new FROM d2)) n JOIN (SELECT title, min(old) AS old FROM o GROUP BY title HAVING count(DISTINCT old) = 1) u ON n.title = u.title) WHERE old NOT IN (SELECT old FROM d2) GROUP BY old)"
ALL = f"{OLD}, {M1}, {MR}, {M2}, d3 AS (SELECT old, new FROM d2 UNION ALL SELECT old, new FROM m2), r AS (SELECT old, new, 'stable_id' AS method FROM m1 UNION ALL SELECT old, new, 'approved_retitle' FROM mr UNION ALL SELECT old, new, 'exact_title' FROM m2 UNION ALL SELECT NULL, new, 'added' FROM n WHERE new NOT IN (SELECT new FROM d3) UNION ALL SELECT old, NULL, 'removed' FROM o WHERE old NOT IN (SELECT old FROM d3))"


def reconciled(spark, sf):
    """All three passes: identifiers, approved retitles, equal titles."""
    p = papers(spark, sf)
    # titles and keys are compared by their hashes, so that the texts are read once
    same = lambda x: F.sha2(x, 256)
    renamed = F.concat(F.lit("New "), "title")
    both = p.select("paper_id", "citation_count", "title", F.when(c("venue") == "DE", renamed).otherwise(c("title")).alias("later"), renamed.alias("approved"))
    keyed = lambda t: F.when(X.title_key(t) != "", same(X.title_key(t)))
    both = cut(both.select("paper_id", "citation_count", keyed("title").alias("k"), same("title").alias("title"), keyed("later").alias("later_k"), same("later").alias("later"), same("approved").alias("approved")))
    o = both.select(c("paper_id").alias("old"), "k", "title")
    n = both.select((c("paper_id") + 100000).alias("new"), c("later_k").alias("k"), c("later").alias("title"))
    policy = both.filter("citation_count = 1").select(c("paper_id").alias("old"), c("title").alias("old_title"), c("approved").alias("new_title"))
    by_key = lambda x, s: x.filter("k is not null").select(s, c("k").alias("id"))
    by_title = lambda x, s: x.select(s, c("title").alias("id"))
    passes = [("stable_id", by_key(o, "old"), by_key(n, "new")), ("approved_retitle", *D.retitle_ids(o, n, policy)), ("exact_title", by_title(o, "old"), by_title(n, "new"))]
    return D.settled(D.reconcile(o.select("old"), n.select("new"), passes))


@query("JOI14_identity_reconcile", f"{ALL} SELECT old, new, method FROM r")
def _(spark, sf):
    return reconciled(spark, sf).select("old", "new", "method")


@query("REC02_stable_pass", f"{ALL} SELECT old, new FROM r WHERE method = 'stable_id'")
def _(spark, sf):
    return reconciled(spark, sf).filter("method = 'stable_id'").select("old", "new")


@query("REC03_approved_retitles", f"{ALL} SELECT old, new FROM r WHERE method = 'approved_retitle'")
def _(spark, sf):
    return reconciled(spark, sf).filter("method = 'approved_retitle'").select("old", "new")


@query("REC04_title_pass", f"{ALL} SELECT old, new FROM r WHERE method = 'exact_title'")
def _(spark, sf):
    return reconciled(spark, sf).filter("method = 'exact_title'").select("old", "new")


@query("REC05_completeness_merge", f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN track ELSE venue END AS field, '{{\"a\":\"' || CASE WHEN paper_id % 2 = 0 THEN venue ELSE 'old' END || '\",\"b\":\"' || track || '\"}}' AS ids FROM papers")
def _(spark, sf):
    new = F.when(c("paper_id") % 3 == 0, " ").otherwise(c("venue"))
    over = F.when(c("paper_id") % 2 == 0, F.create_map(F.lit("a"), c("venue"))).otherwise(F.expr("map()").cast("map<string,string>"))
    ids = D.overriding_maps(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), c("track")), over)
    return papers(spark, sf).select("paper_id", D.completeness_merge(c("track"), new).alias("field"), I.sorted_json(ids).alias("ids"))


@query("REC06_author_similarity")
def _(spark, sf):
    """Pages of similar titles with their navigation entries as names: how far titles, names
    and both together agree."""
    # the pages are read once, their titles and names are small
    p = cut(table(spark, sf, "pages").select("page_id", X.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("k"), F.regexp_extract_all("html", F.lit("<li><a [^>]*>([^<]*)</a>"), F.lit(1)).alias("names")))
    side = lambda s: p.select(c("page_id").alias(s), c("k").alias(f"k{s}"), c("names").alias(f"n{s}"))
    x = R.similar_titles(p, "page_id", "k", R.TITLE_RULES[0][1]).join(side("a"), "a").join(side("b"), "b")
    return x.select("a", "b", F.round("ratio", 6).alias("title"), F.round(D.author_similarity("na", "nb"), 6).alias("authors"), F.round(D.fuzzy_score(("ka", "kb"), ("na", "nb")), 6).alias("score"))


@query("REC07_blocked_removals", f"{ALL} SELECT old FROM r WHERE method = 'removed' AND old NOT IN (SELECT paper_id FROM papers WHERE presentation_level = 'poster')")
def _(spark, sf):
    allowed = papers(spark, sf).filter("presentation_level = 'poster'").select(c("paper_id").alias("old"))
    return D.blocked_removals(reconciled(spark, sf), allowed)


@query("REC08_change_report", f"{ALL} SELECT method, count(*) AS n FROM r GROUP BY method")
def _(spark, sf):
    return reconciled(spark, sf).groupBy("method").agg(one("n"))


GATE = "CASE WHEN duplicates > 0 THEN 'duplicates,' ELSE '' END || CASE WHEN resolved_coverage < 85 THEN 'abstracts,' ELSE '' END"


@query("REC10_quality_gate", f"{QUALITY}, q AS (SELECT venue, year, coalesce(duplicates, 0) AS duplicates, {PCT.format('resolved_abstracts', 'resolved')} AS resolved_coverage FROM m LEFT JOIN dup USING (venue, year)) SELECT venue, year, {GATE} AS issues, {GATE} = '' AS passed FROM q")
def _(spark, sf):
    issues = F.concat(F.when(c("duplicates") > 0, "duplicates,").otherwise(""), F.when(c("resolved_coverage") < 85, "abstracts,").otherwise(""))
    return quality(papers(spark, sf)).select("venue", "year", issues.alias("issues"), (issues == "").alias("passed"))


@query("REC11_two_pass_validate", f"{QUALITY} SELECT 'staged' AS side, count(*) AS files, CAST(sum(total) AS BIGINT) AS total FROM m WHERE year >= 2010 UNION ALL SELECT 'source', count(*), CAST(sum(total) AS BIGINT) FROM m")
def _(spark, sf):
    q = quality(papers(spark, sf))
    s = q.filter("year >= 2010").agg(one("files"), F.sum("total").alias("total")).select(F.lit("staged").alias("side"), "files", "total")
    return s.unionByName(q.agg(one("files"), F.sum("total").alias("total")).select(F.lit("source").alias("side"), "files", "total"))


@query("REC12_catalog_checks", "SELECT 'papers' AS name, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS actual, (SELECT count(*) = count(text) FROM documents) AS pass UNION ALL SELECT 'vectors', (SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents) = (SELECT count(*) FROM embeddings)")
def _(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    n = d.agg(one("d"), F.count("text").alias("t")).crossJoin(e.agg(one("e")))
    rows = F.explode(F.array(F.struct(F.lit("papers").alias("name"), c("d").alias("expected"), c("t").alias("actual")), F.struct(F.lit("vectors").alias("name"), c("d").alias("expected"), c("e").alias("actual"))))
    return n.select(rows.alias("r")).select("r.*").withColumn("pass", c("expected").eqNullSafe(c("actual")))


@query("REC13_provenance_contract", f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN 'bogus' ELSE '' END AS invalid_fields, CASE WHEN trim(abstract) <> '' AND paper_id % 3 = 0 THEN 'abstract' ELSE '' END AS missing FROM papers")
def _(spark, sf):
    prov = F.map_concat(
        F.when(c("paper_id") % 3 == 0, F.expr("map()").cast("map<string,string>")).otherwise(F.create_map(F.lit("abstract"), F.lit("official"))),
        F.when(c("paper_id") % 4 == 0, F.create_map(F.lit("bogus"), F.lit("official"))).otherwise(F.expr("map()").cast("map<string,string>")))
    invalid = F.array_except(F.map_keys(prov), F.array(*[F.lit(x) for x in ("abstract", "authors", "url", "track_group", "presentation_level")]))
    populated = F.filter(F.array(F.when(F.trim("abstract") != "", F.lit("abstract"))), lambda f: f.isNotNull())
    return papers(spark, sf).select("paper_id", F.array_join(invalid, ",").alias("invalid_fields"), F.array_join(F.array_except(populated, F.map_keys(prov)), ",").alias("missing"))


@query("REC14_provenance_migration", f"WITH {PAPERS_SQL} SELECT paper_id, '{{\"abstract\":\"' || CASE WHEN paper_id % 2 = 0 THEN 'dblp' ELSE 'official' END || '\",\"url\":\"official\"}}' AS prov FROM papers")
def _(spark, sf):
    default = I.provenance(F.lit("openreview"))
    have = F.when(c("paper_id") % 2 == 0, F.create_map(F.lit("abstract"), F.lit("dblp"))).otherwise(F.expr("map()").cast("map<string,string>"))
    return papers(spark, sf).select("paper_id", I.sorted_json(I.with_defaults(have, F.create_map(F.lit("abstract"), default, F.lit("url"), default))).alias("prov"))


CAS = "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS v FROM documents), f AS (SELECT x.*, CASE WHEN e.label < 3 THEN 'a' || e.label END AS a, CASE WHEN e.label < 6 THEN 'b' || e.label END AS b, l.quality AS q FROM x LEFT JOIN embeddings e ON x.doc_id = e.vec_id LEFT JOIN labels l ON x.doc_id = l.doc_id)"


@query("REC16_backfill_cascade", f"{CAS} SELECT doc_id, coalesce(nullif(v, ''), a, b, 'c' || q) AS v, CASE WHEN v = '' THEN CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' WHEN q IS NOT NULL THEN 'third' END END AS hit_source FROM f")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, "").otherwise(c("lang")).alias("v"))
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    say = lambda p, x: F.concat(F.lit(p), c(x).cast("string")).alias("v")
    looks = [("first", e.filter("label < 3").select("doc_id", say("a", "label"))), ("second", e.filter("label < 6").select("doc_id", say("b", "label"))), ("third", table(spark, sf, "labels").select("doc_id", say("c", "quality")))]
    return D.cascade(d, "v", looks, "doc_id").select("doc_id", "v", "hit_source")


@query("REC17_fill_only_merge", "SELECT d.doc_id, greatest(d.doc_id % 9, coalesce(l.quality * 5, 0)) AS citations, coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END, ''), CAST(l.toxic AS VARCHAR)) AS doi FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    doi = F.when(c("doc_id") % 2 == 0, "").otherwise(c("lang"))
    return x.select("doc_id", F.greatest(c("doc_id") % 9, F.coalesce(c("quality") * 5, F.lit(0))).alias("citations"), F.coalesce(F.nullif(doi, F.lit("")), c("toxic").cast("string")).alias("doi"))


@query("REC18_normalise_pipeline", f"{KEYED}, w AS (SELECT k, arg_min(paper_id, (-score, paper_id)) AS paper_id FROM k GROUP BY k) SELECT 'S2-' || substr(sha1(p.venue || ':' || p.year || ':' || coalesce(nullif({KEY}, ''), 'missing-title')), 1, 16) AS id, p.title, p.venue, p.year FROM w JOIN papers p USING (paper_id)")
def _(spark, sf):
    """Transform, dedupe, re-identify and sort in one plan."""
    best = keyed(spark, sf).groupBy("k").agg(F.min_by(F.struct("title", "venue", "year"), F.struct(-c("score"), "paper_id")).alias("r"))
    rows = best.select("r.*").withColumn("id", I.paper_id(c("venue"), c("year"), c("title"), []))
    return rows.select("id", "title", "venue", "year").orderBy("venue", "year", "title")


@query("REC19_count_gates", "SELECT n.n_nationkey AS grp, count(c_custkey) AS actual, 60 AS expected, count(c_custkey) - 60 AS diff FROM nation n LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf):
    n, k = table(spark, sf, "nation"), table(spark, sf, "customer").groupBy("c_nationkey").agg(one("n"))
    x = n.join(k, n["n_nationkey"] == k["c_nationkey"], "left").select(c("n_nationkey").alias("grp"), F.coalesce("n", F.lit(0)).alias("actual"), F.lit(60).alias("expected"))
    return x.withColumn("diff", c("actual") - c("expected"))


@query("REC20_hold_out_split", f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN starts_with(lower(title), 'the') THEN 'held' ELSE 'kept' END AS side FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("paper_id", F.when(F.lower("title").startswith("the"), "held").otherwise("kept").alias("side"))


@query("REC21_unreached_groups", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)")
def _(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey < 20").select(c("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey").join(s, "n_nationkey", "left_anti")


@query("REC22_author_signature")
def _(spark, sf):
    from paperlake.functions.python_functions import compatibility_key

    v = table(spark, sf, "conversations").select("conv_id", compatibility_key("text").alias("k"))
    return v.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("signature"))


@query("REC23_stamped_provenance", f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN trim(abstract) <> '' THEN '{{\"abstract\":\"openalex\",\"url\":\"dblp\"}}' ELSE '{{\"url\":\"dblp\"}}' END AS prov FROM papers")
def _(spark, sf):
    stamp = F.map_filter(F.create_map(F.lit("abstract"), F.when(F.trim("abstract") != "", F.lit("openalex"))), lambda k, v: v.isNotNull())
    return papers(spark, sf).select("paper_id", I.sorted_json(D.overriding_maps(F.create_map(F.lit("url"), F.lit("dblp")), stamp)).alias("prov"))


@query("REC24_inventory", f"{QUALITY} SELECT venue, CAST(sum(total) AS BIGINT) AS total, CAST(sum(coalesce(duplicates, 0)) AS BIGINT) AS duplicates FROM m LEFT JOIN dup USING (venue, year) GROUP BY venue")
def _(spark, sf):
    return quality(papers(spark, sf)).groupBy("venue").agg(F.sum("total").alias("total"), F.sum("duplicates").alias("duplicates"))
