"""Small fixtures with known answers."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.operators import dedupe as D
from paperlake.operators import evaluate as E
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.operators import vectors as V
from paperlake.sources import readers
from paperlake.streaming import state

#: Two rows tie in year and citations; one has an accent and no abstract; one was withdrawn.
PAPERS = [
    ("b7", "Émile's Guide to Lattice Sorting", "VLDB", 2017, None, "poster", "resolved", ""),
    ("k1", "Lattice Walks", "SIGIR", 2019, 12, "poster", "resolved", "A lattice of records, a walk, and no sorting at all."),
    ("a2", "Sorting Rivers of Records", "VLDB", 2019, 12, "oral", "resolved", "Rivers of records are sorted while they flow."),
    ("z0", "Withdrawn: Lattice Sorting", "WWW", 2018, 3, "poster", "placeholder", "Lattice sorting, withdrawn."),
    ("m5", "On Rivers", "WWW", 2016, 40, "oral", "resolved", "River records; emile sorted none."),
    ("c3", "lattice lattice sorting", "SIGIR", 2018, 0, "poster", "resolved", "Sorting a lattice by a lattice."),
]


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, "paper_id string, title string, venue string, year int, citation_count long, presentation_level string, record_status string, abstract string").withColumn("track", F.lit("conference")).cache()


def ids(df):
    return [r["paper_id"] for r in df.collect()]


def test_search(papers):
    assert set(ids(S.bm25(papers, "lattice sorting"))) == {"b7", "k1", "c3"}
    assert set(ids(S.bm25(papers, "SORTING, lattice", S.Filters(include_placeholder=True)))) == {"b7", "k1", "c3", "z0"}
    assert set(ids(S.matches(papers, "emile"))) == set(ids(S.matches(papers, "ÉMILE"))) == {"b7", "m5"}
    assert ids(S.matches(papers, "sorting", S.Filters(venues=("SIGIR", "WWW"), year_to=2018))) == ["c3"]
    assert ids(S.matches(papers, "lattice_sorting", S.Filters(presentation_level="poster", year_from=2018))) == ["c3"]
    assert ids(S.matches(papers, "lattice rivers")) == []
    ranked = lambda by, k=9, o=0: [(r["paper_id"], r["rank"]) for r in S.page(S.bm25(papers, "records"), S.order(by), k, o).orderBy("rank").collect()]
    assert ranked("year") == [("a2", 1), ("k1", 2), ("m5", 3)]
    assert ranked("citation") == [("m5", 1), ("a2", 2), ("k1", 3)]
    assert ranked("citation", 1, 1) == [("a2", 2)] and ranked("year", 5, 7) == []
    for bad in (" ?! ", ""):
        with pytest.raises(ValueError):
            S.query_phrases(bad)
    for k, o in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            S.page(papers, [F.col("paper_id")], k, o)


def test_scores_are_those_of_a_full_text_engine(papers):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(id unindexed, title, abstract, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.executemany("insert into f values (?, ?, ?)", [(p[0], p[1], p[7]) for p in PAPERS])
    want = dict(con.execute("select id, bm25(f) from f where f match 'lattice sorting'").fetchall())
    got = {r["paper_id"]: r["score"] for r in S.bm25(papers, "lattice sorting", S.Filters(include_placeholder=True)).collect()}
    assert got == pytest.approx(want)


def test_hybrid(spark, papers):
    distances = [("m5", 0.25), ("z0", 0.0), ("c3", 3.0), ("k1", 1.0)]
    vec = spark.createDataFrame(distances, "paper_id string, d double").select("paper_id", (1 / (1 + F.col("d"))).alias("similarity"))
    lex = S.bm25(papers, "lattice sorting")
    kept = papers.filter(S.Filters().condition()).select("paper_id")
    got = {r["paper_id"]: r for r in V.fuse(lex, vec, kept).collect()}
    assert set(got) == {"b7", "k1", "c3", "m5"}  # one by words alone, one by its vector alone
    assert got["m5"]["vec_norm"] == 1 and got["m5"]["bm25_norm"] == 0 and got["m5"]["final"] == pytest.approx(0.6)
    assert got["c3"]["bm25_norm"] == 1 and got["c3"]["vec_norm"] == 0 and got["c3"]["final"] == pytest.approx(0.4)
    assert got["k1"]["vec_norm"] == pytest.approx((0.5 - 0.25) / (0.8 - 0.25))
    alone = papers.filter("paper_id = 'c3'").select("paper_id")
    assert [r["final"] for r in V.fuse(lex, vec, alone).collect()] == [1.0]


def test_incremental_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, text_hash string")
    old = spark.createDataFrame([("b", None, "m"), ("c", "x", "m"), ("d", "4", "m")], "k string, text_hash string, model string")
    assert {r["k"]: r["state"] for r in V.classify(now, old, "k", "m").collect()} == {"a": "missing", "b": "unverified", "c": "changed", "d": "current"}


def test_scalars(spark):
    row = spark.range(1).select(
        X.title_key(F.lit("A Simple, Strong Baseline!")).alias("k"), X.doi(F.lit("https://doi.org/10.1109/CVPR.2016.90")).alias("d"), X.doi(F.lit("")).alias("n"),
        X.presentation_level(F.lit(""), F.lit("ICLR")).alias("u"), X.presentation_level(F.lit("poster"), F.lit("TPAMI")).alias("j"), X.presentation_level(F.lit(None).cast("string"), F.lit("VLDB")).alias("v"),
        I.coverage(F.lit(1), F.lit(32)).alias("c"), X.unlatex(F.lit(r"{M\"uller} grew 25.27\%")).alias("t"),
    ).first()
    assert (row.k, row.d, row.n, row.u, row.j, row.v) == ("asimplestrongbaseline", "10.1109/CVPR.2016.90", None, "unknown", "not_applicable", "not_applicable")
    assert row.c == 3.12 and row.t == "Müller grew 25.27%"


def test_pdf_links(spark):
    m = "map<string,string>"
    df = spark.createDataFrame([("D1", {"cvf_pdf_url": "https://c/x.pdf"}, ""), ("D2", {"openreview_id": "OR-D2"}, ""), ("D3", {"arxiv_id": "2401.01234"}, ""), ("D4", {}, "")], f"id string, ids {m}, url string")
    got = {r["id"]: (r["l"] and tuple(r["l"])) for r in df.select("id", X.pdf_link(F.col("ids"), F.col("url")).alias("l")).collect()}
    assert got == {"D1": ("https://c/x.pdf", "source_ids:cvf_pdf_url"), "D2": ("https://openreview.net/pdf?id=OR-D2", "derived:openreview_id"), "D3": ("https://arxiv.org/pdf/2401.01234.pdf", "derived:arxiv_id"), "D4": None}


def test_survivor_merge(spark):
    df = spark.createDataFrame([("k", 0, "T", "", ["A"], {"x": "1"}, True), ("k", 1, "T", "abs", [], {"x": "2", "y": "3"}, False)], "k string, ord int, title string, abstract string, authors array<string>, ids map<string,string>, external_only boolean")
    score = D.survivor_score([F.trim("title") != "", F.size("authors") > 0, F.trim("abstract") != ""], [], F.lit(False))
    r = D.merge_groups(df, "k", score, "ord", ["title", "abstract"], ["authors"], ["ids"], ["external_only"]).first()
    assert (r.abstract, r.authors, r.ids, r.external_only, r.duplicates_removed) == ("abs", ["A"], {"x": "1", "y": "3"}, False, 1)


def test_reconcile_and_gate(spark):
    old = spark.createDataFrame([(1, "or:1", "A"), (2, "or:2", "B"), (3, "or:3", "C")], "old long, i string, t string")
    new = spark.createDataFrame([(11, "or:1", "A2"), (12, "or:9", "B"), (13, "or:8", "New")], "new long, i string, t string")
    pair = lambda c: (old.select("old", F.col(c).alias("id")), new.select("new", F.col(c).alias("id")))
    got = D.reconcile(old.select("old"), new.select("new"), [("stable_id", *pair("i")), ("exact_title", *pair("t"))])
    assert {(r.old, r.new, r.method) for r in got.collect()} == {(1, 11, "stable_id"), (2, 12, "exact_title"), (None, 13, "added"), (3, None, "removed")}
    none = spark.createDataFrame([], "old long")
    assert [r.old for r in D.blocked_removals(got, none).collect()] == [3]
    assert D.blocked_removals(got, spark.createDataFrame([(3,)], "old long")).isEmpty()


def test_evaluation(spark, papers):
    cases = [E.Case.load({"case_id": "a", "query": "lattice", "expect_any_title_fragments": ["lattice: WALKS", "zzz"]}), E.Case.load({"case_id": "b", "query": "lattice", "expect_all_title_fragments": ["nothing"]})]
    assert {r.case_id: r.passed for r in E.run_cases(papers, cases).collect()} == {"a": True, "b": False}
    got = {r.case_id: r.passed for r in E.run_cases(papers, [E.Case("c", "records", any_fragments=("rivers of",)), E.Case("d", "zzz")]).collect()}
    assert got == {"c": True, "d": False}
    assert E.sample_queries([("t", ["a", "b"])] , 1, 1, 3) == E.sample_queries([("t", ["b", "a"])], 1, 1, 3)
    assert E.stale(None, {"a": "1"}) and E.stale({"a": "2"}, {"a": "1"}) and not E.stale({"a": "1", "b": "9"}, {"a": "1"})
    with pytest.raises(ValueError):
        E.Case.load({"case_id": "x", "query": " "})


def test_sources(spark, tmp_path):
    (tmp_path / "ICLR-2024.json").write_text('{"query": {"venue_code": "ICLR", "year": 2024}, "papers": [{"title": "T", "authors": ["A"]}, {"title": "U"}]}')
    got = readers.records(readers.payloads(spark, str(tmp_path / "*.json"))).collect()
    assert [(r.venue, r.year, r.title) for r in got] == [("ICLR", 2024, "T"), ("ICLR", 2024, "U")]
    (tmp_path / "d.xml").write_text('<dblp><inproceedings key="k1"><author>A</author><author>B</author><title>X.</title><year>2020</year><ee>https://doi.org/10.1/z</ee></inproceedings><inproceedings key="k2"><title>Y</title><year>2019</year></inproceedings></dblp>')
    r = readers.dblp(spark, str(tmp_path / "d.xml"), 2020).collect()
    assert [(x.key, x.title, x.authors, x.doi) for x in r] == [("k1", "X", ["A", "B"], "10.1/z")]
    bib = '@inproceedings{k3, title = {A {Nested} Title}, author = "Ann Lee and Bo Wu", doi={10.1/q}, abstract = {Up 25.27\\%}}'
    b = readers.bibtex(spark.createDataFrame([(bib,)], "value string")).first()
    assert (b.bib_key, b.title, b.authors, b.doi, b.abstract) == ("k3", "A Nested Title", ["Ann Lee", "Bo Wu"], "10.1/q", "Up 25.27%")


def test_streamed_upserts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "id long, v string, seq long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(src)
    run = lambda: state.keyed_stream(spark.readStream.schema(schema).parquet(src), out, "id", "seq", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], schema).write.mode("append").parquet(src)
    run()
    assert {r.id: r.v for r in state.open_keyed(spark, out).rows().collect()} == {1: "a", 2: "c", 3: "d"}


def test_heading_before(spark):
    items = spark.createDataFrame([("g", 3), ("g", 9)], "g string, p int")
    heads = spark.createDataFrame([("g", 1, "A"), ("g", 5, "B")], "g string, p int, h string")
    assert {r.p: r.h for r in R.heading_before(items, heads, "g", "p", "h").collect()} == {3: "A", 9: "B"}


def test_reports(spark, papers, tmp_path):
    from paperlake.operators import report as P

    text = P.markdown(papers.filter("paper_id = 'b7'").select("paper_id", "title", "citation_count"))
    assert text.splitlines() == ["| paper_id | title | citation_count |", "| --- | --- | --- |", "| b7 | Émile's Guide to Lattice Sorting |  |"]
    (tmp_path / "a").write_text("x")
    one = P.collection_fingerprint(P.file_fingerprints(spark, str(tmp_path))).first()
    (tmp_path / "a").write_text("y")
    assert one.files == 1 and P.collection_fingerprint(P.file_fingerprints(spark, str(tmp_path))).first() != one
    s = P.suites(papers, [E.Case("a", "sorting")], "all", healthy=False)
    assert {r.suite: r.passed for r in s.collect()} == {"offline": True, "online": False} and P.status(s, {}, {"a": "1"}) == "fail (offline, online), stale"
