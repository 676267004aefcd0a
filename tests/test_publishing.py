"""Publishing of table versions, and the checks before it."""

import os
import subprocess
import sys

import pytest

from paperlake import corpus
from paperlake.operators import report
from paperlake.streaming import commit, upsert


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(spark, table):
    return sorted(r.v for r in upsert.read_table(spark, table).collect())


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    assert upsert.read_table(spark, table) is None
    for n in (1, 2, 3, 4):
        upsert.write_version(rows(spark, n), table)
    assert held(spark, table) == [4] and upsert.versions(spark, table) == [2, 3, 4]
    bad = rows(spark, 5).selectExpr("raise_error('no') as v")
    with pytest.raises(Exception, match="no"):
        upsert.write_version(bad, table)
    assert held(spark, table) == [4]
    # a writer that dies after the data and before the rename
    monkeypatch.setattr(upsert, "versions", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        upsert.write_version(rows(spark, 6), table)
    monkeypatch.undo()
    assert held(spark, table) == [4]
    upsert.write_version(rows(spark, 7), table)
    assert held(spark, table) == [7]


def test_several_tables_or_none(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    upsert.publish_all({a: rows(spark, 1)})
    with pytest.raises(Exception, match="no"):
        upsert.publish_all({a: rows(spark, 2), b: rows(spark, 1).selectExpr("raise_error('no') as v")})
    assert held(spark, a) == [1] and upsert.read_table(spark, b) is None

    def check():
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        upsert.publish_all({a: rows(spark, 2), b: rows(spark, 3)}, check)
    assert held(spark, a) == [1] and upsert.read_table(spark, b) is None
    upsert.publish_all({a: rows(spark, 2), b: rows(spark, 3)})
    assert held(spark, a) == [2] and held(spark, b) == [3]


def test_a_commit_of_several_tables_or_none(spark, tmp_path):
    a, b, log = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "log")
    commit.publish({a: rows(spark, 1)}, log)
    with pytest.raises(Exception, match="no"):
        commit.publish({a: rows(spark, 2), b: rows(spark, 1).selectExpr("raise_error('no') as v")}, log)

    def check():
        assert held(spark, a) == [2] and sorted(r.v for r in commit.read(spark, a, log).collect()) == [1]  # not yet for readers of the log
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        commit.publish({a: rows(spark, 2), b: rows(spark, 3)}, log, check)
    assert held(spark, a) == [1] and upsert.read_table(spark, b) is None and commit.read(spark, b, log) is None
    assert [n for n in os.listdir(a) if n.startswith("_new")] == [] and commit.intents(spark, log) == {}
    commit.publish({a: rows(spark, 2), b: rows(spark, 3)}, log)
    assert held(spark, a) == [2] and held(spark, b) == [3]


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from paperlake.streaming import commit
a, b, log, where = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = lambda v: spark.createDataFrame([(v,)], "v long")
done, real = [], commit.rename

def rename(spark, old, new):
    if where == "between" and done:
        os._exit(9)
    real(spark, old, new)
    done.append(new)

commit.rename = rename
commit.publish({a: rows(2), b: rows(3)}, log, lambda: os._exit(9))
"""


@pytest.mark.parametrize("where", ["between", "before the mark"])
def test_a_killed_driver_leaves_nothing_behind(spark, tmp_path, where):
    a, b, log = (str(tmp_path / x) for x in ("a", "b", "log"))
    commit.publish({a: rows(spark, 1)}, log)
    done = subprocess.run([sys.executable, "-c", KILLED, a, b, log, where], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, timeout=300)
    assert done.returncode == 9, done.stderr[-800:]
    assert held(spark, a) == [2] and (upsert.read_table(spark, b) is None) == (where == "between")  # half a commit, for who does not know the log
    assert [r.v for r in commit.read(spark, a, log).collect()] == [1] and commit.read(spark, b, log) is None
    assert len(commit.recover(spark, log)) == 1 and commit.recover(spark, log) == []
    assert held(spark, a) == [1] and upsert.read_table(spark, b) is None
    assert os.listdir(b) == [] and sorted(n for n in os.listdir(a) if not n.startswith(".")) == ["v000000000001"]
    commit.publish({a: rows(spark, 4), b: rows(spark, 5)}, log)
    assert held(spark, a) == [4] and held(spark, b) == [5]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for venue, text in (("ICLR", "a"), ("ICML", "b")):
        (tmp_path / venue).mkdir()
        (tmp_path / venue / "2024.json").write_text(text)
    found = report.file_fingerprints(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["ICLR/2024.json", "ICML/2024.json"]
    corpus.verify_files(found, found, corpus.PAYLOAD_SHAPE)
    before = report.collection_fingerprint(found).first()
    kept = spark.createDataFrame(found.collect())
    (tmp_path / "ICLR" / "2024.json").write_text("b")
    (tmp_path / "ICML" / "2024.json").write_text("a")
    assert report.collection_fingerprint(report.file_fingerprints(spark, str(tmp_path))).first() != before
    with pytest.raises(ValueError, match="ICLR/2024.json changed, ICML/2024.json changed"):
        corpus.verify_files(kept, report.file_fingerprints(spark, str(tmp_path)))
    for bad in ("2024.json", "a/b/c.json", "ICLR/2024.txt", "./2024.json", "ICLR//x.json"):
        one = spark.createDataFrame([(bad, "1")], "name string, fingerprint string")
        with pytest.raises(ValueError, match="outside"):
            corpus.verify_files(one, one, corpus.PAYLOAD_SHAPE)
    with pytest.raises(ValueError, match="twice"):
        corpus.verify_files(kept.union(kept), kept)


def test_large_files_are_not_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "CONTENT_BYTES", 10)
    (tmp_path / "small").write_text("x")
    (tmp_path / "large").write_text("x" * 100)
    got = {r.name: r.fingerprint for r in report.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got["large"].startswith("100:") and len(got["small"]) == 64


def test_files_must_be_those_prepared(spark):
    files = lambda *x: spark.createDataFrame(list(x), "name string, fingerprint string")
    good = files(("a/x.json", "1"), ("b.json", "2"))
    corpus.verify_files(good, good)
    for other, why in ((files(("a/x.json", "1")), "b.json missing"), (files(("a/x.json", "9"), ("b.json", "2")), "a/x.json changed"), (files(("a/x.json", "1"), ("b.json", "2"), ("c", "3")), "c unexpected")):
        with pytest.raises(ValueError, match=why):
            corpus.verify_files(good, other)
    with pytest.raises(ValueError, match="outside"):
        corpus.verify_files(files(("../x", "1")), files(("../x", "1")))


def test_a_listing_must_be_complete(spark):
    pages = lambda *x: spark.createDataFrame(list(x), "url string, next string, items long")
    h = "https://h.org/p"
    good = pages((h + "1", h + "2", 20), (h + "2", h + "3", 20), (h + "3", None, 4))
    assert corpus.complete(good, expected=44) == {"pages": 3, "items": 44}
    with pytest.raises(ValueError, match="44 items of 45"):
        corpus.complete(good, expected=45)
    with pytest.raises(ValueError, match="another host"):
        corpus.complete(pages((h + "1", "https://else.org/2", 1), ("https://else.org/2", None, 1)))
    with pytest.raises(ValueError, match="not stored"):
        corpus.complete(pages((h + "1", h + "2", 1)))
    for loop in (pages((h + "1", h + "2", 1), (h + "2", h + "1", 1)), pages((h + "1", h + "2", 1), (h + "2", h + "2", 1))):
        with pytest.raises(ValueError, match="loop"):
            corpus.complete(loop)
    assert corpus.complete(good.limit(0)) == {"pages": 0, "items": 0}


def test_a_backup_is_the_state_before_the_run(spark, tmp_path):
    path, root = str(tmp_path / "2024.json"), str(tmp_path / "backups")
    read = lambda p: sorted(r.v for r in spark.read.json(p).collect())
    assert report.write_back(rows(spark, 1), path, root, "run1") is None
    kept = report.write_back(spark.read.json(path).selectExpr("v + 1 as v"), path, root, "run1")
    assert read(path) == [2] and read(kept) == [1]
    assert report.write_back(rows(spark, 3), path, root, "run1") == kept and read(kept) == [1] and read(path) == [3]
    with pytest.raises(Exception, match="no"):
        report.write_back(rows(spark, 4).selectExpr("raise_error('no') as v"), path, root, "run2")
    assert read(path) == [3] and read(f"{root}/run2/2024.json") == [3]
