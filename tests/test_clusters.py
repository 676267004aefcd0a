"""Second-level clusters of all topics at once, and the stored nearest-neighbour index."""

import numpy as np
import pytest

from paperlake.operators import lists as L
from paperlake.operators import nested as N
from paperlake.operators import topics as T
from paperlake.operators import vectors as V


@pytest.fixture(scope="module")
def points(spark):
    """Topic 0: three far groups of 40; topic 1: 400 around four places; 2, 3: 3 and 1 rows; 4: equal rows."""
    rng = np.random.default_rng(4)
    rows = [(i, 0, (np.eye(6)[i % 3] * 10 + rng.normal(0, 0.1, 6)).tolist()) for i in range(120)]
    rows += [(1000 + i, 1, (np.eye(6)[i % 4] * 10 + rng.normal(0, 0.1, 6)).tolist()) for i in range(400)]
    rows += [(2000 + i, 2, [1.0] * 6) for i in range(3)] + [(3000, 3, [2.0] * 6)] + [(4000 + i, 4, [3.0] * 6) for i in range(10)]
    return spark.createDataFrame(rows, "vec_id long, topic int, embedding array<double>").repartition(5).cache()


def labels(df):
    return {r.vec_id: (r.topic_id, r.subtopic_id) for r in df.collect()}


def test_every_topic_is_split_on_its_own(points, tmp_path):
    got = labels(N.split(points, points.select("vec_id", "topic"), str(tmp_path / "p")))
    assert len(got) == points.count()
    for rows, groups in ((range(0, 120), 3), (range(1000, 1400), 4)):
        found = [{got[i][1] for i in rows if i % groups == g} for g in range(groups)]
        assert all(len(f) == 1 for f in found) and len(set.union(*found)) == groups
    assert {got[i] for i in range(1000, 1400)} == {("t01", f"t01_s0{k}") for k in range(4)}
    assert [got[2000 + i][1] for i in range(3)] == ["t02_s00", "t02_s01", "t02_s02"] and got[3000] == ("t03", "t03_s00")
    assert {got[4000 + i] for i in range(10)} == {("t04", "t04_s00")}


def test_a_stopped_run_ends_like_an_unbroken_one(spark, points, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    topics = df.selectExpr("vec_id", "vec_id % 2 as topic")
    whole = labels(N.split(df, topics, str(tmp_path / "a"), {"k": 2}))
    at, real, calls = str(tmp_path / "b"), N._round, []

    def dies(x, centres, number, settings):
        calls.append(number)
        if number == 4:
            raise OSError("killed")
        return real(x, centres, number, settings)

    monkeypatch.setattr(N, "_round", dies)
    with pytest.raises(OSError):
        N.split(df, topics, at, {"k": 2})
    c = N.counters(spark, at)
    assert c["rounds"] == 3 and c["topics"] == 2 and c["vectors"] == 500 and c["labels"] == 6
    calls.clear()
    monkeypatch.setattr(N, "_round", lambda x, c, n, s: calls.append(n) or real(x, c, n, s))
    assert labels(N.split(df, topics, at, {"k": 2})) == whole and calls[0] == 4
    calls.clear()
    N.split(df, topics, at, {"k": 3}, rounds=1)  # other settings: from the start
    assert calls == [1] and N.counters(spark, at)["settings"]["k"] == 3


def test_both_levels(points, tmp_path):
    got = labels(N.split(points, T.primary(points, 4, n_init=2), str(tmp_path / "p")))
    assert set(got) == {r.vec_id for r in points.select("vec_id").collect()} and len({t for t, _ in got.values()}) == 4


@pytest.fixture(scope="module")
def directions(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (30, 16))
    v = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.35, (3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, v[7].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache(), v


def test_recall_and_the_exact_way(directions, tmp_path):
    df, v = directions
    index = L.build(df, str(tmp_path / "i"))
    assert len(index.centroids) == 54 or len(index.centroids) <= 55
    hits = 0
    for i in (7, 100, 2000, 2999):
        q = v[i].tolist()
        want = [(r.vec_id, round(r.distance, 6)) for r in V.nearest(df.filter("vec_id < 5001 or vec_id > 5002").filter("embedding is not null"), q, 20).collect()]
        key = lambda x: (x[1], x[0])
        exact = [(r.vec_id, r.distance) for r in index.search(q, 20, exact=True).collect()]
        assert exact == sorted(want, key=key)
        hits += len({r.vec_id for r in index.search(q, 20).collect()} & {x for x, _ in want})
    assert hits / 80 >= 0.95
    assert len(index.search(v[3].tolist(), 10_000, exact=True).collect()) == 3001


def test_a_search_reads_few_partitions(directions, tmp_path):
    df, v = directions
    index = L.build(df, str(tmp_path / "i"))
    plan = index.search(v[7].tolist(), 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:60]
    assert index.rows([int(index.numbers[0])]).count() == index.sizes[0] < 1000


def test_built_once_for_the_same_files(spark, directions, tmp_path):
    df, _ = directions
    df.write.parquet(str(tmp_path / "t"))
    one = L.build(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "i"))
    assert L.build(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "i")).folder == one.folder
    df.limit(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert L.build(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "i")).folder != one.folder
    with pytest.raises(ValueError):
        L.build(df.limit(0), str(tmp_path / "none"))
