"""Readers of saved API answers, cards and meta tags."""

import json

import pytest
from pyspark.sql import functions as F

from paperlake.sources import readers

ANSWERS = {
    "openalex": {"results": [{"id": "https://openalex.org/W7", "title": "One  two", "publication_year": 2021, "doi": "https://doi.org/10.5/AB", "cited_by_count": 3, "abstract_inverted_index": {"world": [1], "Hello": [0, 2]}, "authorships": [{"author": {"display_name": "Ann B"}}]}]},
    "crossref": {"message": {"items": [{"DOI": "10.5/AB", "title": ["One two"], "abstract": "<jats:p>Hello world</jats:p>", "is-referenced-by-count": 3, "author": [{"given": "Ann", "family": "B"}], "issued": {"date-parts": [[2021, 4]]}}]}},
    "semantic_scholar": {"data": [{"paperId": "p7", "title": "One two", "abstract": "Hello world", "year": 2021, "citationCount": 3, "externalIds": {"DOI": "10.5/ab"}, "authors": [{"name": "Ann B"}]}]},
    "openreview": {"notes": [{"id": "n7", "content": {"title": {"value": "One two"}, "authors": {"value": ["Ann B"]}, "abstract": "Hello world"}}]},
}
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00007v2</id><published>2021-01-02T00:00:00Z</published>
<title>One
 two</title><summary> Hello world </summary><author><name>Ann B</name></author></entry></feed>"""


@pytest.mark.parametrize("api", [*ANSWERS, "arxiv"])
def test_saved_answers(spark, tmp_path, api):
    f = tmp_path / "a.dat"
    f.write_text(ATOM if api == "arxiv" else json.dumps(ANSWERS[api]))
    (r,) = readers.api_works(spark, str(tmp_path), api).collect()
    assert (r.title, r.authors) == ("One two", ["Ann B"]) and r.path.endswith("a.dat")
    assert r.abstract == ("Hello world Hello" if api == "openalex" else "Hello world")
    assert r.id == {"openalex": "W7", "crossref": "10.5/ab", "semantic_scholar": "p7", "openreview": "n7", "arxiv": "2101.00007"}[api]
    assert r.doi == (None if api in ("openreview", "arxiv") else "10.5/ab")
    assert r.year == (None if api == "openreview" else 2021) and r.citation_count == (3 if api in ("openalex", "crossref", "semantic_scholar") else None)


def test_unknown_api_and_broken_answers(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.api_works(spark, str(tmp_path), "else")
    (tmp_path / "x.json").write_text("{no json")
    assert readers.api_works(spark, str(tmp_path), "openalex").collect() == []


def test_cards_and_meta(spark):
    html = '<ul><li class="card"><h3>A &amp; <b>B</b></h3><span class="p">1-9</span></li><li class="card"><h3>C</h3></li></ul>'
    got = spark.range(1).select(readers.cards(F.lit(html), '<li class="card">', {"title": "<h3>(.*?)</h3>", "pages": 'class="p">([^<]*)<'}).alias("c")).first().c
    assert [(c.title, c.pages) for c in got] == [("A & B", "1-9"), ("C", None)]
    meta = """<META content='x y' data-z=1 name="citation_title"><meta property="og:title" content="other">"""
    one = lambda *n: spark.range(1).select(readers.meta_value(F.lit(meta), *n).alias("v")).first().v
    assert one("citation_title") == "x y" and one("nope", "og:title") == "other" and one("nope") is None


def test_dblp_articles(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<dblp><article key="a/1"><author>Ann</author><title>T.</title><year>2020</year><ee>https://doi.org/10.1/x</ee></article><inproceedings key="c/1"><title>U.</title><year>2020</year></inproceedings></dblp>')
    got = {r.key: (r.kind, r.title, r.doi) for r in readers.dblp(spark, str(tmp_path / "d.xml")).collect()}
    assert got == {"a/1": ("article", "T", "10.1/x"), "c/1": ("inproceedings", "U", None)}


def test_payloads_written_are_read_again(spark, tmp_path):
    rows = [("ICLR", 2024, "a", 0, "T1", ["Ann"]), ("ICLR", 2024, "a", 1, 'T"2', []), ("KDD", 2023, "b", 0, "U", None)]
    r = spark.createDataFrame(rows, "venue string, year int, path string, ord int, title string, authors array<string>").withColumn("collected_at", F.lit("2024"))
    readers.write_payloads(r, str(tmp_path / "p"))
    got = readers.records(readers.payloads(spark, str(tmp_path / "p/*/*/*.txt"))).collect()
    assert sorted((x.venue, x.year, x.ord, x.title, x.authors or []) for x in got) == sorted((v, y, o, t, a or []) for v, y, _, o, t, a in rows)
    assert readers.corrupt_count(readers.payloads(spark, str(tmp_path / "p/*/*/*.txt"))).first().asDict() == {"files": 2, "corrupt": 0}


def test_ways_to_select_and_prefixes(spark):
    none, two, three = spark.range(0), spark.range(2), spark.range(3)
    assert readers.first_non_empty([("a", none), ("b", two), ("c", three)])[0] == "b" and readers.first_non_empty([("a", none)])[0] == "a"
    assert readers.largest([("a", two), ("b", three), ("c", three)])[0] == "b"
    d = spark.createDataFrame([("10.1/a",)], "doi string")
    assert readers.with_doi_prefix(d, "10.1/").count() == 1
    for bad in ("10.2/a", None):
        with pytest.raises(Exception, match="without"):
            readers.with_doi_prefix(spark.createDataFrame([(bad,)], "doi string"), "10.1/").collect()


def test_clusters_of_few_vectors_and_checkpoints(spark):
    from paperlake.operators import topics

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in (5, 3, 9)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.topic for r in topics.primary(v, 3).collect()} == {3: 0, 5: 1, 9: 2}
    assert {r.topic for r in topics.primary(v, 1).collect()} == {0}
    assert len({r.topic for r in topics.primary(v, 2, n_init=2).collect()}) == 2
    s = {name: 1 for name in topics.RUN_SETTINGS}
    assert topics.resumable(s, s) and not topics.resumable(None, s) and not topics.resumable({**s, "k": 2}, s) and not topics.resumable({}, s)
    assert {r["check"]: r.passed for r in topics.intact(v, 3).collect()} == {"ids unique": True, "dimensions": False, "finite": True}
