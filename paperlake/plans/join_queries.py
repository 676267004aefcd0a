"""Joins and lookups over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import index as N
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.plans.registry import PAPERS_SQL, papers, query, search_index, table
from paperlake.plans.search_queries import ORDERS, SCORED

c = F.col


def _children(spark, sf):
    return table(spark, sf, "conversations").select(c("conv_id").alias("paper_id"), "turn", "role")


def _vectors(spark, sf, times=1):
    return table(spark, sf, "embeddings").select((c("vec_id") * times).alias("paper_id"), "label")


@query("JOI01_hits_join", f"{SCORED} SELECT s.paper_id, d.n_chars FROM (SELECT * FROM s ORDER BY {ORDERS['bm25']} LIMIT 50) s JOIN documents d ON s.paper_id = d.doc_id")
def _(spark, sf):
    hits = N.find(papers(spark, sf).select("paper_id", "venue", "year", "track", "presentation_level", "record_status", "citation_count"), search_index(spark, sf), "from with").orderBy(*S.order("bm25")).limit(50).select("paper_id")
    d = table(spark, sf, "documents").select(c("doc_id").alias("paper_id"), "n_chars")
    return d.join(F.broadcast(hits), "paper_id").select("paper_id", "n_chars")


@query("JOI02_ordered_children", "SELECT d.doc_id AS paper_id, coalesce((SELECT string_agg(role, ';' ORDER BY turn) FROM conversations v WHERE v.conv_id = d.doc_id), '') AS roles FROM documents d")
def _(spark, sf):
    parents = table(spark, sf, "documents").select(c("doc_id").alias("paper_id"))
    full = R.with_children(parents, R.ordered_children(_children(spark, sf), "paper_id", "turn", "role", "roles"), "paper_id", "roles")
    return full.select("paper_id", F.array_join("roles", ";").alias("roles"))


@query("JOI03_exists", "SELECT doc_id, EXISTS (SELECT 1 FROM conversations v WHERE v.conv_id = d.doc_id) AS has_children FROM documents d")
def _(spark, sf):
    kids = _children(spark, sf).select("paper_id").distinct().withColumn("k", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(kids, d["doc_id"] == kids["paper_id"], "left").select("doc_id", F.coalesce("k", F.lit(False)).alias("has_children"))


@query("JOI04_metadata_pivot", "SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS user_text, max(CASE WHEN role = 'assistant' THEN text END) AS assistant_text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max(F.when(c("role") == "user", c("text"))).alias("user_text"), F.max(F.when(c("role") == "assistant", c("text"))).alias("assistant_text"))


COVER = "(SELECT vec_id * 3 AS paper_id FROM embeddings)"


@query("JOI05_id_coverage", f"SELECT doc_id AS paper_id, 'missing' AS side FROM documents WHERE doc_id NOT IN {COVER} UNION ALL SELECT DISTINCT paper_id, 'extra' FROM {COVER} WHERE paper_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return R.id_coverage(papers(spark, sf).select("paper_id"), _vectors(spark, sf, 3), "paper_id").select("paper_id", "side")


@query("JOI06_first_match", "SELECT o_orderkey, coalesce((SELECT min(n_name) FROM nation WHERE n_nationkey = o_custkey % 40), (SELECT min(r_name) FROM region WHERE r_regionkey = o_orderkey % 7)) AS place FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (c("o_custkey") % 40).alias("a"), (c("o_orderkey") % 7).alias("b"))
    n = table(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("a"), c("n_name").alias("place"))
    r = table(spark, sf, "region").select(c("r_regionkey").cast("long").alias("b"), c("r_name").alias("place"))
    return R.first_match(o, [(n, "a"), (r, "b")], "place").select("o_orderkey", "place")


@query("JOI07_fill_blank", "SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN d.doc_id % 2 = 0 THEN ' ' ELSE d.lang END), ''), CAST(e.label AS VARCHAR)) AS v FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, " ").otherwise(c("lang")).alias("v"))
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("doc_id"), c("label").cast("string").alias("v"))
    return R.fill_blank(d, e, "doc_id", "v").select("doc_id", "v")


@query("JOI08_required_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    """Inner join whose right side must be complete; a left row without one is an error."""
    k, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = F.coalesce("n_name", F.raise_error(F.lit("a customer has no nation")).cast("string"))
    return k.join(n, k["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", name.alias("n_name"))


@query("JOI09_supplement_counts", "SELECT count(*) AS papers, count(label) AS matched, count(label) >= 10 AS enough FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def _(spark, sf):
    p = papers(spark, sf).select("paper_id").join(_vectors(spark, sf), "paper_id", "left")
    return p.agg(F.count(F.lit(1)).alias("papers"), F.count("label").alias("matched"), (F.count("label") >= 10).alias("enough"))


@query("JOI10_heading_before", "SELECT conv_id, turn, (SELECT arg_max(text, turn) FROM conversations h WHERE h.conv_id = v.conv_id AND h.role = 'user' AND h.turn <= v.turn) AS heading FROM conversations v WHERE role = 'assistant'")
def _(spark, sf):
    v = table(spark, sf, "conversations").select("conv_id", "turn", "role", c("text").alias("heading"))
    return R.heading_before(v.filter("role = 'assistant'"), v.filter("role = 'user'"), "conv_id", "turn", "heading").select("conv_id", "turn", "heading")


KA, KB = ("regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')".format(x) for x in ("d.text", "b.text"))


@query("JOI11_checklist", f"WITH a AS (SELECT DISTINCT {KA} AS k FROM documents d), o AS (SELECT DISTINCT {KB} AS k FROM benchmark b UNION SELECT DISTINCT {KA} FROM documents d JOIN labels USING (doc_id)) SELECT coalesce(a.k, o.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'extra' ELSE 'matched' END AS state FROM a FULL JOIN o ON a.k = o.k")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.title_key("text").alias("k"))
    b = table(spark, sf, "benchmark").select(X.title_key("text").alias("k"))
    return R.checklist(d, d.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("k").union(b), "k").select("k", "state")


OVER = f"WITH {PAPERS_SQL}, o AS (SELECT vec_id AS paper_id, CASE WHEN label < 5 THEN 'oral' ELSE 'poster' END AS level FROM embeddings)"


@query("JOI12_official_overlay", f"{OVER} SELECT coalesce(p.paper_id, o.paper_id) AS paper_id, coalesce(o.level, p.presentation_level) AS level, CASE WHEN p.paper_id IS NULL THEN 'added' WHEN o.paper_id IS NULL THEN 'unofficial' ELSE 'updated' END AS state FROM papers p FULL JOIN o ON p.paper_id = o.paper_id")
def _(spark, sf):
    p = papers(spark, sf).select("paper_id", "presentation_level")
    o = _vectors(spark, sf).select("paper_id", F.when(c("label") < 5, "oral").otherwise("poster").alias("level"))
    state = F.when(c("presentation_level").isNull(), "added").when(c("level").isNull(), "unofficial").otherwise("updated")
    return p.join(o, "paper_id", "full").select("paper_id", F.coalesce("level", "presentation_level").alias("level"), state.alias("state"))


@query("JOI13_track_overlay", f"{OVER} SELECT count(*) FILTER (o.level IS NOT NULL AND o.level <> p.presentation_level) AS conflicts, count(o.level) AS covered FROM papers p LEFT JOIN o ON p.paper_id = o.paper_id")
def _(spark, sf):
    o = _vectors(spark, sf).select("paper_id", F.when(c("label") < 5, "oral").otherwise("poster").alias("level"))
    x = papers(spark, sf).join(o, "paper_id", "left")
    return x.agg(F.count_if(c("level") != c("presentation_level")).alias("conflicts"), F.count("level").alias("covered"))


@query("JOI15_fuzzy_title")
def _(spark, sf):
    """Each page title's best other title, with the strictest rule that takes it."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = table(spark, sf, "pages").select("page_id", X.title_key(title).alias("k"))
    x = R.similar_titles(p, "page_id", "k", R.TITLE_RULES[0][1])
    x = x.unionByName(x.select(c("b").alias("a"), c("a").alias("b"), "ratio"))
    best = x.groupBy(c("a").alias("page_id")).agg(F.max_by("b", F.struct("ratio", -c("b"))).alias("other"), F.max("ratio").alias("ratio"))
    rule = F.coalesce(*[F.when(c("ratio") >= least, F.lit(name)) for name, least in reversed(R.TITLE_RULES)])
    return best.select("page_id", "other", F.round("ratio", 6).alias("ratio"), rule.alias("rule"))


SETS = "list_sort(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')))"


@query("JOI16_token_jaccard", f"WITH r AS (SELECT t, min(doc_id) AS doc_id, len(t) AS n FROM (SELECT doc_id, {SETS} AS t FROM documents) GROUP BY t) SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.doc_id < b.doc_id AND a.n >= 0.9e0 * b.n AND b.n >= 0.9e0 * a.n WHERE len(list_intersect(a.t, b.t)) >= 0.9e0 * (a.n + b.n - len(list_intersect(a.t, b.t)))")
def _(spark, sf):
    """Pairs of documents, one for each distinct token set, whose sets agree to nine tenths."""
    d = table(spark, sf, "documents").select("doc_id", F.split(X.spaced_key("text"), " ").alias("t"))
    return R.similar_sets(d, "doc_id", "t", 0.9).select("a", "b")


@query("JOI17_topic_membership", "SELECT e.label AS topic, count(*) AS found FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang = 'en' GROUP BY e.label")
def _(spark, sf):
    hits = table(spark, sf, "documents").filter("lang = 'en'").select(c("doc_id").alias("paper_id"))
    return _vectors(spark, sf).join(hits, "paper_id", "left_semi").groupBy(c("label").alias("topic")).agg(F.count(F.lit(1)).alias("found"))


@query("JOI18_first_assignment", "WITH a AS (SELECT vec_id // 2 AS paper_id, vec_id AS ord, label FROM embeddings) SELECT d.doc_id, (SELECT arg_min(label, ord) FROM a WHERE a.paper_id = d.doc_id) AS topic FROM documents d")
def _(spark, sf):
    a = table(spark, sf, "embeddings").groupBy(F.floor(c("vec_id") / 2).alias("doc_id")).agg(F.min_by("label", "vec_id").alias("topic"))
    return table(spark, sf, "documents").select("doc_id").join(a, "doc_id", "left").select("doc_id", "topic")


@query("JOI19_reuse_or_refetch", f"WITH {PAPERS_SQL} SELECT e.vec_id, CASE WHEN p.paper_id IS NULL THEN 'new' WHEN trim(p.abstract) <> '' AND p.record_status = 'resolved' THEN 'reuse' ELSE 'refetch' END AS action FROM embeddings e LEFT JOIN papers p ON e.vec_id * 3 = p.paper_id")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (c("vec_id") * 3).alias("paper_id"))
    p = papers(spark, sf).select("paper_id", "abstract", "record_status")
    done = (F.trim("abstract") != "") & (c("record_status") == "resolved")
    return e.join(p, "paper_id", "left").select("vec_id", F.when(c("record_status").isNull(), "new").when(done, "reuse").otherwise("refetch").alias("action"))


@query("JOI20_patch_by_key", f"WITH {PAPERS_SQL}, f AS (SELECT vec_id AS paper_id, max('found ' || label) AS fill FROM embeddings GROUP BY vec_id), x AS (SELECT p.paper_id, p.record_status, CASE WHEN p.paper_id % 2 = 0 THEN '' ELSE p.venue END AS abstract, fill FROM papers p LEFT JOIN f ON p.paper_id = f.paper_id) SELECT paper_id, CASE WHEN abstract = '' AND fill IS NOT NULL THEN fill ELSE abstract END AS abstract, CASE WHEN abstract = '' AND fill IS NOT NULL THEN 'kept' ELSE 'missing_abstract,kept' END AS flags, CASE WHEN abstract = '' AND fill IS NOT NULL THEN 'resolved' ELSE record_status END AS record_status FROM x")
def _(spark, sf):
    p = papers(spark, sf).select("paper_id", F.when(c("paper_id") % 2 == 0, "").otherwise(c("venue")).alias("abstract"), F.array(F.lit("missing_abstract"), F.lit("kept")).alias("quality_flags"), "record_status", F.array("venue").alias("authors"))
    fills = _vectors(spark, sf).select("paper_id", F.concat(F.lit("found "), c("label").cast("string")).alias("abstract"))
    return R.patch(p, fills, "paper_id").select("paper_id", "abstract", F.array_join("quality_flags", ",").alias("flags"), "record_status")


@query("JOI21_first_candidate", "WITH k AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, min(o_orderkey) AS first_hit FROM k GROUP BY o_custkey")
def _(spark, sf):
    """The first candidate that matches, not the best one."""
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_hit"))


@query("JOI22_three_tiers", "WITH l1 AS (SELECT vec_id AS doc_id, 'detail ' || label AS v FROM embeddings WHERE label < 4), l2 AS (SELECT vec_id AS doc_id, 'lookup ' || label AS v FROM embeddings WHERE label < 7), l3 AS (SELECT vec_id // 2 AS doc_id, max_by('title ' || label, label * 100000 - vec_id) AS v FROM embeddings WHERE label >= 5 GROUP BY vec_id // 2) SELECT d.doc_id, coalesce(l1.v, l2.v, l3.v) AS v FROM documents d LEFT JOIN l1 ON d.doc_id = l1.doc_id LEFT JOIN l2 ON d.doc_id = l2.doc_id LEFT JOIN l3 ON d.doc_id = l3.doc_id")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    say = lambda tier: F.concat(F.lit(tier + " "), c("label").cast("string"))
    l1 = e.filter("label < 4").select(c("vec_id").alias("doc_id"), say("detail").alias("v1"))
    l2 = e.filter("label < 7").select(c("vec_id").alias("doc_id"), say("lookup").alias("v2"))
    l3 = e.filter("label >= 5").groupBy(F.floor(c("vec_id") / 2).alias("doc_id")).agg(F.max_by(say("title"), F.struct("label", -c("vec_id"))).alias("v3"))
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(l1, "doc_id", "left").join(l2, "doc_id", "left").join(l3, "doc_id", "left").select("doc_id", F.coalesce("v1", "v2", "v3").alias("v"))


@query("JOI23_institutions", "SELECT doc_id, CASE WHEN upper(lang) = upper(source) THEN lang ELSE lang || ';' || source END AS v FROM documents")
def _(spark, sf):
    people = F.array(*[F.struct(n.alias("institution")) for n in (c("lang"), F.upper("lang"), F.lit(" "), c("source"))])
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.distinct_folded(F.transform(people, lambda a: a["institution"])), ";").alias("v"))
