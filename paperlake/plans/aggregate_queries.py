"""Counts, coverage, gates, alignment and ranked picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.operators import relational as R
from paperlake.plans.registry import PAPERS_SQL, papers, query, table

c = F.col
one = lambda name: F.count(F.lit(1)).alias(name)
KEY = "regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')"
PCT = "CASE WHEN {1} > 0 THEN round_even(100.0e0 * {0} / {1}, 2) ELSE 0.0e0 END"


@query("AGG01_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "conversations", "labels", "benchmark")))
def _(spark, sf):
    names = ("documents", "embeddings", "conversations", "labels", "benchmark")
    frames = [table(spark, sf, t).agg(one("n")).select(F.lit(t).alias("name"), "n") for t in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("AGG02_count_by", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(one("n")).orderBy("o_orderstatus")


@query("AGG03_venue_year", f"WITH {PAPERS_SQL} SELECT venue || '-' || year AS venue_year, count(*) AS n FROM papers GROUP BY venue, year")
def _(spark, sf):
    return papers(spark, sf).groupBy("venue", "year").agg(one("n")).select(F.concat_ws("-", "venue", c("year").cast("string")).alias("venue_year"), "n")


@query("AGG04_duplicate_keys", f"WITH {PAPERS_SQL} SELECT count(*) AS duplicate_keys FROM (SELECT {KEY} AS k FROM papers GROUP BY 1 HAVING count(*) > 1)")
def _(spark, sf):
    return papers(spark, sf).groupBy(X.title_key("title").alias("k")).agg(one("n")).filter("n > 1").agg(one("duplicate_keys"))


@query("AGG05_blank_fields", f"WITH {PAPERS_SQL} SELECT count(*) FILTER (citation_count IS NULL OR trim(title) = '' OR trim(abstract) = '') AS blank FROM papers")
def _(spark, sf):
    return papers(spark, sf).agg(F.count_if(c("citation_count").isNull() | (F.trim("title") == "") | (F.trim("abstract") == "")).alias("blank"))


@query("AGG06_category_counts", "SELECT lower(p_type) AS category, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return R.count_by(table(spark, sf, "part"), F.lower("p_type"), "category").orderBy(c("n").desc(), "category")


@query("AGG07_default_category", "SELECT coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END, ''), 'unknown') AS category, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return R.count_by(table(spark, sf, "part"), F.coalesce(F.nullif(F.when(c("p_size") % 5 == 0, "").otherwise(c("p_type")), F.lit("")), F.lit("unknown")), "category")


@query("AGG08_fixed_domain", "SELECT d.o_orderstatus, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(o_orderstatus) LEFT JOIN orders o ON o.o_orderstatus = d.o_orderstatus GROUP BY 1")
def _(spark, sf):
    return R.fixed_domain_counts(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


QUALITY = f"""WITH {PAPERS_SQL}, k AS (SELECT venue, year, {KEY} AS k, count(*) AS n FROM papers GROUP BY 1, 2, 3),
dup AS (SELECT venue, year, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM k WHERE k <> '' GROUP BY 1, 2),
m AS (SELECT venue, year, count(*) AS total, count(*) FILTER (record_status = 'placeholder') AS placeholders, count(*) FILTER (record_status <> 'placeholder') AS resolved,
 count(*) FILTER (trim(abstract) <> '') AS abstracts, count(*) FILTER (trim(abstract) <> '' AND record_status <> 'placeholder') AS resolved_abstracts FROM papers GROUP BY 1, 2)"""


def quality(rows):
    """Coverage of every venue and year, and titles that repeat."""
    has = F.trim("abstract") != ""
    open_ = c("record_status") != "placeholder"
    m = rows.groupBy("venue", "year").agg(one("total"), F.count_if(~open_).alias("placeholders"), F.count_if(open_).alias("resolved"), F.count_if(has).alias("abstracts"), F.count_if(has & open_).alias("resolved_abstracts"))
    k = rows.groupBy("venue", "year", X.title_key("title").alias("k")).agg(one("n")).filter("k <> ''").groupBy("venue", "year").agg(F.sum(c("n") - 1).alias("duplicates"))
    return m.join(k, ["venue", "year"], "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0))).withColumn(
        "abstract_coverage", I.coverage(c("abstracts"), c("total"))).withColumn("resolved_coverage", I.coverage(c("resolved_abstracts"), c("resolved")))


@query("AGG09_quality_metrics", f"{QUALITY} SELECT m.*, coalesce(duplicates, 0) AS duplicates, {PCT.format('abstracts', 'total')} AS abstract_coverage, {PCT.format('resolved_abstracts', 'resolved')} AS resolved_coverage FROM m LEFT JOIN dup USING (venue, year)")
def _(spark, sf):
    return quality(papers(spark, sf))


@query("AGG10_duplicate_titles", f"{QUALITY} SELECT CAST(sum(duplicates) AS BIGINT) AS duplicates FROM dup")
def _(spark, sf):
    return quality(papers(spark, sf)).agg(F.sum("duplicates").alias("duplicates"))


@query("AGG11_raw_and_unique", f"WITH {PAPERS_SQL} SELECT venue, count(*) AS raw, count(DISTINCT {KEY}) AS uniq FROM papers GROUP BY venue")
def _(spark, sf):
    last = papers(spark, sf).groupBy("venue", X.title_key("title").alias("k")).agg(one("n"), F.max_by("title", "paper_id").alias("title"))
    return last.groupBy("venue").agg(F.sum("n").alias("raw"), one("uniq"))


A, O = "(SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)", "(SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' GROUP BY 1)"


def _sides(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", c("o_orderpriority"))
    a = o.filter("o_orderstatus <> 'F' and k <> '5-LOW'").groupBy("k").agg(one("n"))
    return a, o.filter("o_orderstatus <> 'O' and k <> '1-URGENT'").groupBy("k").agg(one("n"))


@query("AGG12_map_diff", f"SELECT coalesce(a.k, o.k) AS k, coalesce(a.n, 0) - coalesce(o.n, 0) AS diff FROM {A} a FULL JOIN {O} o ON a.k = o.k")
def _(spark, sf):
    return R.count_diff(*_sides(spark, sf), "k")


@query("AGG13_alignment", f"SELECT a.k, CASE WHEN o.n IS NULL THEN NULL ELSE a.n = o.n END AS aligned FROM {A} a LEFT JOIN {O} o ON a.k = o.k")
def _(spark, sf):
    a, o = _sides(spark, sf)
    return a.join(o.withColumnRenamed("n", "m"), "k", "left").select("k", R.alignment(c("n"), c("m")).alias("aligned"))


@query("AGG14_run_summary", f"{QUALITY} SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(placeholders) AS BIGINT) AS placeholders, CAST(sum(abstracts) AS BIGINT) AS abstracts FROM m")
def _(spark, sf):
    return quality(papers(spark, sf)).agg(one("files"), F.sum("total").alias("total"), F.sum("placeholders").alias("placeholders"), F.sum("abstracts").alias("abstracts"))


@query("AGG15_ordered_list", "SELECT conv_id, string_agg(role || '@' || turn, '; ' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def _(spark, sf):
    v = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("@", "role", c("turn").cast("string")).alias("v"))
    return R.ordered_children(v, "conv_id", "turn", "v", "x").select("conv_id", F.array_join("x", "; ").alias("turns"))


@query("AGG16_assignment_groups", "SELECT label AS topic, vec_id % 3 AS subtopic, count(*) AS n, string_agg(vec_id, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY 1, 2")
def _(spark, sf):
    g = table(spark, sf, "embeddings").groupBy(c("label").alias("topic"), (c("vec_id") % 3).alias("subtopic"))
    return g.agg(one("n"), F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",").alias("members"))


@query("AGG17_cluster_sizes", "SELECT label AS topic, count(*) AS size, count(DISTINCT vec_id % 3) AS subtopics FROM embeddings GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "embeddings").groupBy(c("label").alias("topic")).agg(one("size"), F.countDistinct(c("vec_id") % 3).alias("subtopics"))


@query("AGG18_pass_rate", "SELECT source, count(*) FILTER (n_chars > 1000) AS passed, round(avg(CASE WHEN n_chars > 1000 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pass_rate FROM documents GROUP BY source")
def _(spark, sf):
    ok = c("n_chars") > 1000
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"))


@query("AGG19_score_range", "SELECT min(value) AS lo, max(value) AS hi FROM events")
def _(spark, sf):
    return table(spark, sf, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("AGG20_unique_index", "SELECT c_acctbal AS k, min(c_custkey) AS v FROM (SELECT CAST(round(c_acctbal) AS BIGINT) AS c_acctbal, c_custkey FROM customer) GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf):
    x = table(spark, sf, "customer").select(F.round("c_acctbal").cast("long").alias("k"), c("c_custkey").alias("v"))
    return R.unique_only(x, "k", "v")


@query("AGG21_collection_fingerprint", "SELECT lang, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS fingerprint FROM documents GROUP BY lang")
def _(spark, sf):
    """Order-free fingerprint of each language's texts from per-row hashes."""
    rows = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return rows.groupBy("lang").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("fingerprint"))


@query("AGG22_raw_decisions", "SELECT coalesce(event_type, 'unknown') AS decision, count(*) AS raw, count(DISTINCT user_id) AS uniq FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("decision")).agg(one("raw"), F.countDistinct("user_id").alias("uniq"))


@query("AGG23_coverage_audit", "SELECT count(*) AS expected, count(vec_id) AS covered, count(DISTINCT label) AS groups FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def _(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left").agg(one("expected"), F.count("vec_id").alias("covered"), F.countDistinct("label").alias("groups"))


@query("TOP04_vector_top", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS distance FROM embeddings WHERE vec_id <> 1 ORDER BY distance, vec_id LIMIT 20")
def _(spark, sf):
    from paperlake.operators import vectors as V

    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id = 1").select(c("embedding").alias("q"))
    x = e.filter("vec_id <> 1").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.distance(c("embedding"), c("q"), "cosine"), 6).alias("distance"))
    return x.orderBy("distance", "vec_id").limit(20)


@query("TOP05_composite_sort", f"WITH {PAPERS_SQL} SELECT paper_id, row_number() OVER (ORDER BY year % 5 DESC, year DESC, coalesce(citation_count, 0) DESC, paper_id) AS rank FROM papers QUALIFY rank <= 30")
def _(spark, sf):
    from pyspark.sql.window import Window

    by = [(c("year") % 5).desc(), c("year").desc(), F.coalesce("citation_count", F.lit(0)).desc(), c("paper_id")]
    return papers(spark, sf).orderBy(*by).limit(30).withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long")).select("paper_id", "rank")


@query("TOP06_page_orders", "SELECT label, string_agg(vec_id, ',' ORDER BY vec_id % 7 DESC, vec_id) AS page FROM embeddings GROUP BY label")
def _(spark, sf):
    s = F.array_sort(F.collect_list(F.struct((-(c("vec_id") % 7)).alias("a"), "vec_id")))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.array_join(F.transform(s, lambda v: v["vec_id"].cast("string")), ",").alias("page"))


@query("TOP07_representatives", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 80")
def _(spark, sf):
    return R.winner(table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], [c("vec_id")], 80)


@query("TOP08_distinct_titles", f"WITH {PAPERS_SQL}, f AS (SELECT track, lower(title) AS k, min(paper_id) AS paper_id FROM papers GROUP BY 1, 2) SELECT track, paper_id FROM f QUALIFY row_number() OVER (PARTITION BY track ORDER BY paper_id) <= 18")
def _(spark, sf):
    first = papers(spark, sf).groupBy("track", F.lower("title").alias("k")).agg(F.min("paper_id").alias("paper_id"))
    return R.winner(first, ["track"], [c("paper_id")], 18).select("track", "paper_id")


@query("TOP09_source_pick", "SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS pick FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -c("o_orderkey"))).alias("pick"))


@query("TOP11_winner", f"WITH {PAPERS_SQL} SELECT venue, year, arg_max(paper_id, (CASE WHEN record_status = 'resolved' THEN 1 ELSE 0 END, coalesce(citation_count, -1), -paper_id)) AS best FROM papers GROUP BY 1, 2")
def _(spark, sf):
    score = F.struct((c("record_status") == "resolved").cast("int"), F.coalesce("citation_count", F.lit(-1)), -c("paper_id"))
    return papers(spark, sf).groupBy("venue", "year").agg(F.max_by("paper_id", score).alias("best"))
