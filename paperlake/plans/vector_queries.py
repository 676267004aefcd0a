"""Vectors, hybrid search, topics, evaluation and diagnostics over the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperlake.operators import evaluate as E
from paperlake.operators import index as N
from paperlake.operators import lists, nested
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.operators import topics as T
from paperlake.operators import vectors as V
from paperlake.operators.index import source_name
from paperlake.operators.storage import shared_dir
from paperlake.plans.registry import PAPERS_SQL, papers, query, search_index, table
from paperlake.plans.search_queries import ORDERS, SCORED
from paperlake.streaming.state import replay

c = F.col
one = lambda name: F.count(F.lit(1)).alias(name)
Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 4)"


def _query_vector(spark, sf, vec=4):
    return table(spark, sf, "embeddings").filter(c("vec_id") == vec).select(c("embedding").alias("q"))


def _with_distance(spark, sf, metric):
    e = table(spark, sf, "embeddings")
    return e.crossJoin(F.broadcast(_query_vector(spark, sf))).select("vec_id", "label", V.distance(c("embedding"), c("q"), metric).alias("d"))


CLASS = "WITH p AS (SELECT doc_id, sha256(text) AS h FROM documents), s AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'old' ELSE (SELECT sha256(text) FROM documents d WHERE d.doc_id = e.vec_id) END AS h, CASE WHEN vec_id % 11 = 0 THEN 'other' ELSE 'm' END AS m FROM embeddings e), k AS (SELECT p.doc_id, CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN s.h IS NULL THEN 'unverified' WHEN s.h <> p.h OR s.m <> 'm' THEN 'changed' ELSE 'current' END AS state FROM p LEFT JOIN s ON p.doc_id = s.doc_id)"


def _states(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("doc_id")).join(p, "doc_id", "left")
    h = F.when(c("doc_id") % 10 == 0, F.lit(None)).when(c("doc_id") % 7 == 0, "old").otherwise(c("text_hash"))
    s = e.select("doc_id", h.alias("text_hash"), F.when(c("doc_id") % 11 == 0, "other").otherwise("m").alias("model"))
    return V.classify(p, s, "doc_id", "m")


@query("VEC03_incremental_states", f"{CLASS} SELECT doc_id, state FROM k")
def _(spark, sf):
    return _states(spark, sf).select("doc_id", "state")


@query("VEC04_stale_vectors", "SELECT DISTINCT vec_id * 3 AS id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return table(spark, sf, "embeddings").select((c("vec_id") * 3).alias("id")).distinct().join(table(spark, sf, "documents").select(c("doc_id").alias("id")), "id", "left_anti")


@query("VEC05_marker_fast_path", f"{CLASS} SELECT source, bool_and(state = 'current') AS all_current FROM k JOIN documents d ON k.doc_id = d.doc_id GROUP BY source")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return _states(spark, sf).join(d, "doc_id").groupBy("source").agg(F.bool_and(c("state") == "current").alias("all_current"))


@query("VEC06_embedding")
def _(spark, sf):
    """Batched embedding by an injected function; offline a hash projection stands in."""
    return embed(table(spark, sf, "documents").select("doc_id", "text"), hashed_embedding)


def hashed_embedding(texts: list[str], dim: int = 16) -> list[list[float]]:
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 1024 else -1.0
        out.append(v)
    return out


def embed(rows, function, batch: int = 128):
    """(doc_id, embedding) by calling a function on batches of texts, three tries each."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            made = []
            for i in range(0, len(pdf), batch):
                for attempt in range(3):
                    try:
                        made += function(pdf["text"].iloc[i : i + batch].tolist())
                        break
                    except OSError:
                        if attempt == 2:
                            raise
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "embedding": made})

    return rows.mapInPandas(run, "doc_id long, embedding array<double>")


@query("VEC07_knn", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance, round(1.0e0 / (1.0e0 + greatest(round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6), 0.0e0)), 6) AS similarity FROM embeddings, {Q} ORDER BY distance, vec_id LIMIT 100")
def _(spark, sf):
    x = _with_distance(spark, sf, "cosine").withColumn("distance", F.round("d", 6))
    return x.orderBy("distance", "vec_id").limit(100).select("vec_id", "distance", F.round(1.0 / (1.0 + F.greatest("distance", F.lit(0.0))), 6).alias("similarity"))


@query("VEC07_knn_indexed", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, {Q} ORDER BY distance, vec_id LIMIT 20")
def _(spark, sf):
    """The exact way of the stored index: only lists that may hold one of the nearest are read."""
    index = lists.build(table(spark, sf, "embeddings"), f"{shared_dir(spark).rstrip('/')}/vectors-{source_name(sf)}")
    return index.search(list(_query_vector(spark, sf).first()["q"]), 20, exact=True)


@query("VEC08_metrics", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine, round(power(list_distance(embedding::DOUBLE[], q), 2), 6) AS l2sq FROM embeddings, {Q}")
def _(spark, sf):
    e = table(spark, sf, "embeddings").crossJoin(F.broadcast(_query_vector(spark, sf)))
    return e.select("vec_id", F.round(V.distance(c("embedding"), c("q"), "cosine"), 6).alias("cosine"), F.round(V.distance(c("embedding"), c("q"), "l2sq"), 6).alias("l2sq"))


HYB = f"""{SCORED}, lex AS (SELECT paper_id, round(score, 9) AS score FROM s ORDER BY {ORDERS['bm25']} LIMIT 100),
vec AS (SELECT vec_id AS paper_id, 1.0e0 / (1.0e0 + greatest(d, 0.0e0)) AS similarity FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS d FROM embeddings, {Q}) ORDER BY d, vec_id LIMIT 100),
b AS (SELECT coalesce(l.paper_id, v.paper_id) AS paper_id, score, similarity FROM lex l FULL JOIN vec v ON l.paper_id = v.paper_id),
k AS (SELECT p.paper_id, p.year, p.citation_count, score, similarity FROM b JOIN papers p ON b.paper_id = p.paper_id WHERE p.record_status <> 'placeholder'),
e AS (SELECT min(score) AS sl, max(score) AS sh, min(similarity) AS vl, max(similarity) AS vh FROM k),
f AS (SELECT k.*, coalesce(CASE WHEN sh - sl = 0 THEN 1.0e0 ELSE (sh - score) / (sh - sl) END, 0.0e0) AS bn, coalesce(CASE WHEN vh - vl = 0 THEN 1.0e0 ELSE (similarity - vl) / (vh - vl) END, 0.0e0) AS vn FROM k, e)"""


def _fused(spark, sf):
    p = papers(spark, sf)
    lex = N.find(p, search_index(spark, sf), "from with").withColumn("score", F.round("score", 9)).orderBy(*S.order("bm25")).limit(100)
    d = _with_distance(spark, sf, "cosine").withColumn("d", F.round("d", 6)).orderBy("d", "vec_id").limit(100)
    vec = d.select(c("vec_id").alias("paper_id"), (1.0 / (1.0 + F.greatest("d", F.lit(0.0)))).alias("similarity"))
    survivors = p.filter(S.Filters().condition()).select("paper_id", "year", "citation_count")
    return V.fuse(lex, vec, survivors)


@query("VEC09_hybrid", f"{HYB} SELECT paper_id, round(0.6e0 * vn + 0.4e0 * bn, 6) AS final FROM f ORDER BY final DESC, year DESC, coalesce(citation_count, 0) DESC, paper_id LIMIT 20")
def _(spark, sf):
    x = _fused(spark, sf).withColumn("final", F.round("final", 6))
    return x.orderBy(c("final").desc(), c("year").desc(), F.coalesce("citation_count", F.lit(0)).desc(), "paper_id").limit(20).select("paper_id", "final")


@query("VEC10_min_max", f"{HYB} SELECT paper_id, round(bn, 6) AS bm25_norm, round(vn, 6) AS vec_norm FROM f")
def _(spark, sf):
    return _fused(spark, sf).select("paper_id", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("vec_norm", 6).alias("vec_norm"))


@query("VEC11_id_scan", "SELECT vec_id FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id")


@query("CLU01_kmeans")
def _(spark, sf):
    return T.primary(table(spark, sf, "embeddings"), 10)


COUNT = "CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN n WHEN n >= 1200 THEN 5 WHEN n >= 300 THEN 4 ELSE 3 END"


@query("CLU08_store_integrity", "SELECT 'ids unique' AS \"check\", count(*) = count(DISTINCT vec_id) AS passed FROM embeddings UNION ALL SELECT 'dimensions', count(*) FILTER (len(embedding) IS DISTINCT FROM 64) = 0 FROM embeddings UNION ALL SELECT 'finite', count(*) FILTER (NOT coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)) = 0 FROM embeddings")
def _(spark, sf):
    return T.intact(table(spark, sf, "embeddings"), 64)


@query("CLU02_subcluster_count", f"SELECT source, n, CAST({COUNT} AS INTEGER) AS k FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(one("n")).withColumn("k", T.subcluster_count(c("n")).cast("int"))


@query("CLU03_nested_topics")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    path = f"{shared_dir(spark).rstrip('/')}/nested-{uuid.uuid4().hex}"
    return nested.split(e, e.select("vec_id", c("label").alias("topic")), path)


@query("CLU07_run_counters", f"SELECT count(*) AS topics, CAST(sum(n) AS BIGINT) AS vectors, CAST(sum({{0}}) AS BIGINT) AS labels, true AS resumed FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 3)".format(COUNT))
def _(spark, sf):
    """The counters of a run that is stopped after two rounds and goes on."""
    e = table(spark, sf, "embeddings")
    path = f"{shared_dir(spark).rstrip('/')}/nested-{uuid.uuid4().hex}"
    topics = e.select("vec_id", c("label").alias("topic"))
    nested.split(e, topics, path, {"k": 10}, rounds=2)
    before = nested.counters(spark, path)["rounds"]
    nested.split(e, topics, path, {"k": 10}, rounds=4)
    found = nested.counters(spark, path)
    return spark.createDataFrame([(found["topics"], found["vectors"], found["labels"], before == 2 and found["rounds"] >= 2)], "topics long, vectors long, labels long, resumed boolean")


@query("CLU04_topic_names")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return T.names(d, d.select("doc_id", c("source").alias("topic")), "doc_id", "text")


@query("CLU05_projection_checks", "SELECT 'every vector assigned' AS \"check\", (SELECT count(*) = count(label) FROM embeddings) AS passed UNION ALL SELECT 'ids unique', (SELECT count(*) = count(DISTINCT vec_id) FROM embeddings) UNION ALL SELECT 'as many as papers', (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents)")
def _(spark, sf):
    x = table(spark, sf, "embeddings").agg(one("n"), F.count("label").alias("l"), F.countDistinct("vec_id").alias("u")).crossJoin(table(spark, sf, "documents").agg(one("p")))
    return E.checks([("every vector assigned", c("n") == c("l")), ("ids unique", c("n") == c("u")), ("as many as papers", c("n") == c("p"))], x)


@query("CLU06_page_paths", "SELECT 'topics/' || lang || '.md' AS path, 'missing' AS side FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('en', 'xx') UNION ALL SELECT 'topics/xx.md', 'extra'")
def _(spark, sf):
    want = table(spark, sf, "documents").select(F.concat(F.lit("topics/"), "lang", F.lit(".md")).alias("path"))
    return R.id_coverage(want, spark.createDataFrame([("topics/en.md",), ("topics/xx.md",)], "path string"), "path").select("path", "side")


@query("SNK07_cache_pages", "SELECT label, count(*) AS papers, sha256(string_agg('- ' || vec_id, chr(10) ORDER BY vec_id)) AS page FROM embeddings GROUP BY label")
def _(spark, sf):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: F.concat(F.lit("- "), v.cast("string"))), "\n")
    return table(spark, sf, "embeddings").groupBy("label").agg(one("papers"), F.sha2(lines, 256).alias("page"))


@query("SNK05_vector_upsert", "SELECT vec_id, max(label) AS label FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 10 = 0) GROUP BY vec_id")
def _(spark, sf):
    """Vectors as a keyed table: all, then deletions, then changes, then all again as late rows."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    step = lambda rows, at, label, gone=False: rows.select("vec_id", label.cast("int").alias("label"), F.lit(at).alias("at"), F.lit(gone).alias("gone"))
    batches = [
        step(e, 2, c("label")), step(e.filter("vec_id % 5 = 0 and vec_id % 10 <> 0"), 4, F.lit(None), True), step(e.filter("vec_id % 10 = 0"), 3, F.lit(99)), step(e, 1, F.lit(-1)),
    ]
    path = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    return replay(batches, path, "vec_id", "at", "gone", 8).rows().select("vec_id", "label")


CASES = [E.Case("plain", "from with", expect_min_results=5), E.Case("french", "avec", filters=S.Filters(("FR",)), any_fragments=("de la", "zzz")), E.Case("none", "zzzzqqq")]


@query("EVA03_fixed_cases", f"WITH {PAPERS_SQL}, t AS (SELECT *, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, abstract))), '[\\p{{L}}\\p{{N}}]+') AS t FROM papers WHERE record_status <> 'placeholder') SELECT 'plain' AS case_id, least(count(*), 50) AS total, least(count(*), 50) >= 5 AS passed FROM t WHERE list_contains(t, 'from') AND list_contains(t, 'with') UNION ALL SELECT 'none', 0, false")
def _(spark, sf):
    return E.run_cases(papers(spark, sf), [CASES[0], CASES[2]], search_index(spark, sf)).select("case_id", "total", "passed")


@query("EVA02_title_fragments", "SELECT source, bool_or(contains(k, 'the')) AND bool_or(contains(k, 'en')) AS ok FROM (SELECT source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(E.expected_over(c("text"), (), ("the", "en")).alias("ok"))


@query("EVA04_offline_suite")
def _(spark, sf):
    """Every case as plain search, whatever mode it asked for."""
    return E.run_cases(papers(spark, sf), [E.Case("h", "avec", mode="hybrid"), CASES[1]], search_index(spark, sf))


@query("EVA05_sampled_queries")
def _(spark, sf):
    """Topics and subtopics are those of the vectors: a bounded, small catalogue."""
    e = table(spark, sf, "embeddings").select(c("label").cast("string").alias("t"), F.concat_ws("/", c("label").cast("string"), (c("vec_id") % 3).cast("string")).alias("s")).distinct()
    topics = e.groupBy("t").agg(F.array_sort(F.collect_list("s")).alias("subs")).orderBy("t").collect()
    return spark.createDataFrame(E.sample_queries([(r["t"], r["subs"]) for r in topics], 5, 2), "topic string, subtopic string")


@query("EVA06_membership", "SELECT CAST(label AS VARCHAR) AS topic, vec_id FROM embeddings UNION SELECT label || '/' || (vec_id % 3), vec_id FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(c("label").cast("string").alias("topic"), "vec_id").unionByName(e.select(F.concat_ws("/", c("label").cast("string"), (c("vec_id") % 3).cast("string")).alias("topic"), "vec_id")).distinct()


@query("EVA07_sampled_suite", """WITH h AS (SELECT e.label AS topic, count(d.doc_id) AS found FROM embeddings e LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'es' AND source = 'src0') d ON e.vec_id = d.doc_id GROUP BY 1)
SELECT topic, found, found >= 1 AS passed FROM h UNION ALL SELECT NULL, count(*) FILTER (found >= 1), count(*) FILTER (found >= 1) >= 0.9e0 * count(*) FROM h""")
def _(spark, sf):
    """Labels as topics; the hits of every topic's query are the documents of one source."""
    members = table(spark, sf, "embeddings").select(c("label").alias("topic"), c("vec_id").alias("paper_id"))
    found = table(spark, sf, "documents").filter("lang = 'es' and source = 'src0'").select(c("doc_id").alias("paper_id"))
    return E.sampled_suite(members, members.join(found, "paper_id", "left_semi").select("topic", "paper_id"))


@query("DOC02_vector_contract", "SELECT 'missing' AS \"check\", (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n UNION ALL SELECT 'extra', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'short', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64)")
def _(spark, sf):
    d, e = table(spark, sf, "documents").select(c("doc_id").alias("id")), table(spark, sf, "embeddings")
    sides = R.id_coverage(d, e.select(c("vec_id").alias("id")), "id").groupBy("side").agg(one("n"))
    names = spark.createDataFrame([("missing",), ("extra",)], "side string")
    cover = F.broadcast(names).join(sides, "side", "left").select(c("side").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    return cover.unionByName(e.agg(F.count_if(F.size("embedding") != 64).alias("n")).select(F.lit("short").alias("check"), "n"))


@query("SRC21_key_lookup", "SELECT d.doc_id, e.label FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def _(spark, sf):
    keys = table(spark, sf, "documents").select("doc_id").distinct()
    e = table(spark, sf, "embeddings")
    return keys.join(e, keys["doc_id"] == e["vec_id"], "left").select("doc_id", "label")


@query("SRC23_id_list", f"WITH {PAPERS_SQL}, w(ord, paper_id) AS (VALUES (0, 5), (1, 999999), (2, 2)) SELECT CAST(w.ord AS INTEGER) AS ord, CAST(w.paper_id AS BIGINT) AS paper_id, p.title FROM w LEFT JOIN papers p ON w.paper_id = p.paper_id")
def _(spark, sf):
    want = spark.createDataFrame([(0, 5), (1, 999999), (2, 2)], "ord int, paper_id long")
    return want.join(papers(spark, sf).select("paper_id", "title"), "paper_id", "left").orderBy("ord").select("ord", "paper_id", "title")


@query("SRC24_level_overrides", "SELECT k, arg_max(level, (src, ord)) AS level FROM (SELECT vec_id % 40 AS k, label AS ord, CASE label % 3 WHEN 0 THEN 'oral' WHEN 1 THEN 'poster' ELSE 'bestpaper' END AS level, label % 3 AS src FROM embeddings) GROUP BY k")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("k", c("vec_id") % 40)
    lists = [e.filter(c("label") % 3 == i).select("k", F.lit(level).alias("level"), F.lit(i).alias("src"), c("label").alias("ord")) for i, level in enumerate(("oral", "poster", "bestpaper"))]
    both = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return both.groupBy("k").agg(F.max_by("level", F.struct("src", "ord")).alias("level"))


@query("SNK11_run_audit", "SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(c("user_id").alias("run")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("HSH03_file_fingerprints")
def _(spark, sf):
    from paperlake.operators.report import collection_fingerprint, file_fingerprints

    return collection_fingerprint(file_fingerprints(spark, sf, "*.parquet"))


@query("EVA08_suites")
def _(spark, sf):
    from paperlake.operators.report import suites

    return suites(papers(spark, sf), [CASES[0], CASES[2]], "all", healthy=False, index=search_index(spark, sf))


@query("DOC04_profile", "SELECT 'documents' AS \"check\", (SELECT count(*) > 0 FROM documents) AS passed UNION ALL SELECT 'titles', (SELECT count(*) FILTER (trim(split_part(text, chr(10), 1)) = '') = 0 FROM documents)")
def _(spark, sf):
    x = papers(spark, sf).agg(one("n"), F.count_if(F.trim("title") == "").alias("blank"))
    return E.checks([("documents", c("n") > 0), ("titles", c("blank") == 0)], x)
