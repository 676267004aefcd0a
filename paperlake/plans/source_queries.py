"""Markup extraction over the pages table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperlake.corpus import chains
from paperlake.functions import text as X
from paperlake.operators.storage import shared_dir
from paperlake.plans.registry import query, table
from paperlake.plans.scalar_queries import ents
from paperlake.sources import cards as C
from paperlake.sources import readers as R

c = F.col
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("SRC05_tsv_missing_ids", "SELECT CAST(i AS BIGINT) AS page_id, CAST(i AS BIGINT) NOT IN (SELECT page_id FROM pages) AS missing FROM (VALUES (3), (100000), (1)) v(i)")
def _(spark, sf):
    """A list of ids from a tab-separated file; ids without a page are named."""
    path = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    spark.createDataFrame([("3", "x"), ("100000", "y"), ("1", "z")], "page_id string, note string").coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    want = R.tsv(spark, path, ("page_id",)).select(c("page_id").cast("long").alias("page_id"))
    have = table(spark, sf, "pages").select("page_id", F.lit(True).alias("h"))
    return want.join(have, "page_id", "left").select("page_id", c("h").isNull().alias("missing"))


@query("SRC08_cards", "SELECT page_id, CAST(len(x) AS BIGINT) AS n, array_to_string(x, '|') AS cards FROM (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>(.*?)</a>', 1) AS x FROM pages)")
def _(spark, sf):
    x = table(spark, sf, "pages").select("page_id", R.cards(c("html"), "<li>", {"title": "<a [^>]*>(.*?)</a>"}).alias("x"))
    return x.select("page_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda s: s["title"]), "|").alias("cards"))


#: Markup allows some references without their semicolon.
REF = "regexp_replace({}, '&(amp|lt|gt|quot)([^;a-zA-Z0-9]|$)', '&\\1;\\2', 'g')"
CARD = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', {})"


@query("SRC08_card_parser", f"""WITH x AS (SELECT page_id, {CARD.format(1)} AS l, {CARD.format(2)} AS t FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS card, nullif(trim({ents.format(REF.format('t[i + 1]'))}), '') AS title, l[i + 1] AS link FROM (SELECT *, unnest(range(len(t))) AS i FROM x)
UNION ALL SELECT page_id, -1, nullif(trim({ents.format(REF.format("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)"))}), ''), CAST(len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')) AS VARCHAR) FROM pages""")
def _(spark, sf):
    """Every navigation entry as a card; and the article, with its paragraphs, which may lack
    their end tags."""
    p = table(spark, sf, "pages").select("page_id", "html")
    entry = C.Rule(C.Select("li"), {"title": C.Select("a"), "link@href": C.Select("a")})
    article = C.Rule(C.Select("article"), {"title": C.Select("h1"), "paragraph": C.Select("p")})
    entries = C.cards(p, entry).select("page_id", "card", C.one("title").alias("title"), C.one("link").alias("link"))
    bodies = C.cards(p, article).select("page_id", F.lit(-1).alias("card"), C.one("title").alias("title"), F.size(c("fields")["paragraph"]).cast("string").alias("link"))
    return entries.unionByName(bodies)


LINKS = """p AS (SELECT c_nationkey AS listing, c_custkey AS k FROM customer)"""


@query("SRC13_complete_listing", f"""WITH {LINKS}, g AS (SELECT listing, count(*) AS pages, sum(k % 7) AS items FROM p GROUP BY listing)
SELECT listing, pages, CAST(items AS BIGINT) AS items, CAST(CASE listing % 4 WHEN 0 THEN pages WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN pages < 3 THEN pages ELSE 0 END ELSE CASE WHEN pages < 3 THEN pages ELSE 2 END END AS BIGINT) AS reached,
  CASE listing % 4 WHEN 1 THEN 'no first page or several: a loop' WHEN 2 THEN CASE WHEN pages >= 3 THEN 'no first page or several: a loop' END WHEN 3 THEN CASE WHEN pages >= 3 THEN 'pages beside the chain: a loop' END END AS problem FROM g""")
def _(spark, sf):
    """Customers of a nation as the pages of a listing, by key: whole chains, chains that are
    closed to a loop, chains without the link to their third page, and chains of two pages
    beside a loop of all others."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    x = table(spark, sf, "customer").select(c("c_nationkey").alias("listing"), c("c_custkey").alias("k"), F.lead("c_custkey").over(w).alias("k2"), F.row_number().over(w).alias("r"), F.first("c_custkey").over(w).alias("k0"), F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")).alias("n"), F.nth_value("c_custkey", 3).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("third"))
    kind, long = c("listing") % 4, c("n") >= 3
    after = F.when((kind == 1) & c("k2").isNull(), c("k0")).when((kind == 2) & (c("r") == 2) & long, None).when((kind == 3) & long & (c("r") == 2), None).when((kind == 3) & long & c("k2").isNull(), c("third")).otherwise(c("k2"))
    at = lambda k: F.concat(F.lit("https://list.example.org/"), k.cast("string"))
    return chains(x.select("listing", at(c("k")).alias("url"), at(after).alias("next"), (c("k") % 7).alias("items")))


@query("SRC09_html_blocks", "SELECT page_id, len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS n, array_to_string(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a>', 2), '|') AS items FROM pages")
def _(spark, sf):
    pattern = F.lit('<li><a href="([^"]*)">([^<]*)</a>')
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", pattern, F.lit(1))).cast("long").alias("n"), F.array_join(F.regexp_extract_all("html", pattern, F.lit(2)), "|").alias("items"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("SRC10_meta", f"SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset, nullif({ents.format(TITLE)}, '') AS title FROM pages")
def _(spark, sf):
    """The second of two names is there, its content before its name."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    page = F.concat(F.lit("<meta content='"), F.replace(title, F.lit("'"), F.lit("&#39;")), F.lit("' name=\"citation_title\">"), c("html"))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"), R.meta_value(page, "dc_title", "citation_title").alias("title"))


@query("SRC11_embedded_json")
def _(spark, sf):
    page = F.concat(c("html"), F.lit('<script id="__NEXT_DATA__" type="application/json">{"t": '), c("page_id").cast("string"), F.lit("}</script>"))
    return table(spark, sf, "pages").select("page_id", F.get_json_object(R.embedded_json(page, "__NEXT_DATA__"), "$.t").cast("long").alias("t"))


@query("SRC16_two_passes")
def _(spark, sf):
    """Title index of the pages, then the abstract of each title's first page."""
    p = table(spark, sf, "pages").select("page_id", X.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("k"), "html")
    first = p.groupBy("k").agg(F.min("page_id").alias("page_id"))
    return first.join(p.select("page_id", X.strip_tags(F.regexp_extract("html", "<article>(.*)</article>", 1)).alias("abstract")), "page_id").select("k", "page_id", F.length("abstract").alias("n"))


@query("SRC17_anchors", f"WITH a AS (SELECT page_id, {ORIGIN} AS o, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)) AS h FROM pages) SELECT page_id, count(*) AS n, min(o || h) AS least FROM a GROUP BY page_id")
def _(spark, sf):
    x = table(spark, sf, "pages").select("page_id", F.explode(R.links(c("html"), c("url"))).alias("a"))
    return x.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("a.href").alias("least"))


@query("SRC19_volume_tags", "SELECT page_id, array_to_string(regexp_extract_all('vols: v2 v10 v' || page_id || ' x3', 'v([0-9]+)', 1), ',') AS tags FROM pages")
def _(spark, sf):
    text = F.concat(F.lit("vols: v2 v10 v"), c("page_id").cast("string"), F.lit(" x3"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.regexp_extract_all(text, F.lit("v([0-9]+)"), F.lit(1)), ",").alias("tags"))
