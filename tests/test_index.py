"""The lasting index against SQLite's full-text module and against scans, and its upkeep."""

import os
import random
import sqlite3

import pytest

from paperlake.operators import index as N
from paperlake.operators import search as S

COLUMNS = "paper_id long, title string, abstract string, venue string, year int, track string, presentation_level string, record_status string, citation_count long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, "V", 2020, "t", "poster", "placeholder" if i % 7 == 3 else "resolved", i) for i, t, a in rows], COLUMNS)


def texts(n, seed=6):
    rng = random.Random(seed)
    words = "ab cd éf gh x2 the_the".split()
    text = lambda k: rng.choice([None, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, k))) for _ in range(5)]])
    return [(i, text(3), text(9)) for i in range(n)]


def everything(papers, text):
    return {r.paper_id: round(r.score, 9) for r in S.bm25(papers, text, S.Filters(include_placeholder=True)).collect()}


def indexed(index, text):
    return {r.paper_id: round(r.score, 9) for r in N.scored(index, text).collect()}


QUERIES = ["ab", "cd ef", "ab_cd", "ab_cd gh", "ab ab", "CD_éf_ab", "the", "the_the", "x2_", "nothing", "nothing_ab", "_", "ab _"]


def test_words_phrases_and_scores_equal_sqlite(spark, tmp_path):
    rows = texts(120)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, title, abstract, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?, ?)", rows)
    papers = frame(spark, rows)
    index = N.refresh(papers, str(tmp_path / "i"))
    for q in QUERIES:
        want = {i: round(s, 9) for i, s in con.execute("select id, bm25(f) from f where f match ?", (q,)).fetchall()}
        got, scan = indexed(index, q), everything(papers, q)
        assert set(got) == set(scan) == set(want), q
        assert got == pytest.approx(want, abs=1e-8) and scan == pytest.approx(want, abs=1e-8), q
    assert indexed(index, "ab_cd") and indexed(index, "ab_cd gh")
    with pytest.raises(ValueError):
        N.scored(index, " ?! ")


def test_searches_follow_the_tables(spark, tmp_path):
    rows = dict((i, (t, a)) for i, t, a in texts(80))
    at = str(tmp_path / "i")
    rng = random.Random(1)
    for step in range(5):
        papers = frame(spark, [(i, *x) for i, x in sorted(rows.items())])
        index = N.refresh(papers, at)
        assert index.n == len(rows) and index.texts().count() == len(rows)
        for q in ("ab_cd gh",):
            assert indexed(index, q) == pytest.approx(everything(papers, q), abs=1e-9)
        if step == 3:  # most texts change at once: the dead ones are cleared away
            rows = {i: (f"new ab {t or ''}", a) for i, (t, a) in rows.items()}
            continue
        for i in rng.sample(sorted(rows), 6):
            rows[i] = texts(1, rng.random())[0][1:]
        del rows[rng.choice(sorted(rows))]
        rows[1000 + step] = ("ab cd", None)
    assert len(index.segments) < 5
    rows.clear()
    empty = N.refresh(frame(spark, []), at)
    assert empty.n == 0 and indexed(empty, "ab") == {}
    assert indexed(N.refresh(frame(spark, [(1, "ab", None)]), at), "ab")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_nothing_is_built_twice_and_a_little_more_writes_little(spark, tmp_path):
    table, at = str(tmp_path / "papers"), str(tmp_path / "i")
    rows = texts(400)
    frame(spark, rows).write.parquet(table)
    one = N.refresh(spark.read.parquet(table), at)
    before = files(at)
    assert N.refresh(spark.newSession().read.parquet(table), at).segments == one.segments  # another session
    assert files(at) == before
    frame(spark, [(1000 + i, "ab", "cd gh") for i in range(4)]).write.mode("append").parquet(table)
    two = N.refresh(spark.read.parquet(table), at)
    assert [s.docs for s in two.segments] == [400, 4] and two.segments[0] == one.segments[0]
    after = files(at)
    assert all(after[f] == t for f, t in before.items())
    rows_of = lambda s: spark.read.parquet(f"{at}/{s.name}/postings").count()
    assert rows_of(two.segments[1]) == 12 < 0.02 * rows_of(two.segments[0])
    assert set(indexed(two, "cd_gh")) >= {1000, 1001, 1002, 1003}


def test_a_search_reads_the_partitions_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_ROWS", 50)
    index = N.refresh(frame(spark, texts(200)), str(tmp_path / "i"))
    assert index.segments[0].buckets > 4
    plan = index.postings(["ab"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]
    assert indexed(index, "ab_cd") == pytest.approx(everything(frame(spark, texts(200)), "ab_cd"), abs=1e-9)


def test_first_search_that_finds_a_paper(spark, tmp_path):
    papers = frame(spark, texts(60))
    index = N.refresh(papers, str(tmp_path / "i"))
    asked = ["cd_ef gh", "cd ef", "ab"]
    got = {r.paper_id: r.query_ord for r in N.first_of(papers, index, asked).collect()}
    assert got and got == {r.paper_id: r.query_ord for r in S.candidate_union(papers, asked).collect()}


def test_a_refresh_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "i")
    one = N.refresh(frame(spark, texts(30)), at)
    monkeypatch.setattr(N, "write_version", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        N.refresh(frame(spark, texts(40, 9)), at)
    assert N.read(spark, at) == one
    monkeypatch.undo()
    papers = frame(spark, texts(40, 9))
    two = N.refresh(papers, at)
    assert indexed(two, "ab") == pytest.approx(everything(papers, "ab"), abs=1e-9)
