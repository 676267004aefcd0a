"""Keyed tables: order of batches, late rows, deletions, untouched buckets."""

import itertools
import os

import pytest

from paperlake.streaming import state as T

SCHEMA = "id long, t long, v string"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], SCHEMA + ", gone boolean")


def held(table):
    return sorted((r.id, r.t, r.v) for r in table.rows().collect())


def test_a_late_row_loses(spark, tmp_path):
    at = str(tmp_path / "t")
    T.replay([batch(spark, (1, 10, "new")), batch(spark, (1, 5, "late"), (2, 1, "x"))], at, "id", "t", "gone", 4)
    assert held(T.open_keyed(spark, at)) == [(1, 10, "new"), (2, 1, "x")]


def test_any_order_of_batches_gives_the_same_table(spark, tmp_path):
    batches = [batch(spark, (1, 3, "a"), (2, 1, "b"), (1, 4, "c")), batch(spark, (1, 9, None, True), (3, 2, "d"), (2, 5, "e")), batch(spark, (1, 8, "f"), (3, 1, "g"), (2, 5, "e")), batch(spark, (3, 7, None, True), (3, 8, "back"))]
    seen = [held(T.replay([batches[i] for i in order], str(tmp_path / f"t{n}"), "id", "t", "gone", 3)) for n, order in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 9))]
    assert all(x == [(2, 5, "e"), (3, 8, "back")] for x in seen)


def test_a_repeated_batch_and_ties(spark, tmp_path):
    at = str(tmp_path / "t")
    b = batch(spark, (1, 3, "a"), (1, 3, "b"), (2, 3, "c"), (2, 3, None, True))
    one = held(T.replay([b], at, "id", "t", "gone", 2))
    assert one == held(T.open_keyed(spark, at).apply(b, "gone")) and [r[0] for r in one] == [1]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    at = str(tmp_path / "t")
    one = T.replay([batch(spark, *[(i, 1, f"v{i}") for i in range(200)])], at, "id", "t", "gone", 16)
    assert len(one.folders) == 16
    files = lambda x: {b: sorted(f for f in os.listdir(f"{at}/{d}") if f.endswith(".parquet")) for b, d in x.folders.items()}
    before = files(one)
    two = one.apply(batch(spark, (7, 2, "changed")), "gone")
    after = files(two)
    assert [b for b in before if before[b] != after[b]] == [b for b in one.folders if one.folders[b] != two.folders[b]]
    assert sum(before[b] != after[b] for b in before) == 1
    assert held(two) == sorted([(i, 1, f"v{i}") for i in range(200) if i != 7] + [(7, 2, "changed")])
    assert {(r.id, r.v) for r in two.find([7, 8, 999]).collect()} == {(7, "changed"), (8, "v8")}
    for t in range(3, 8):  # folders of earlier states go in time
        two = two.apply(batch(spark, *[(i, t, "all") for i in range(200)]), "gone")
    assert len([d for d in os.listdir(at) if d.startswith("rows-")]) <= 3


def test_errors_and_empty_batches(spark, tmp_path):
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        T.open_keyed(spark, at)
    table = T.open_keyed(spark, at, SCHEMA, "id", "t", 2)
    assert held(table) == [] and table.apply(batch(spark).limit(0), "gone").folders == {}
    with pytest.raises(Exception, match="without key or order"):
        table.apply(batch(spark, (None, 1, "x")), "gone")


def test_stream(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "t")

    def run(*rows):
        batch(spark, *rows).write.mode("append").parquet(src)
        source = spark.readStream.schema(SCHEMA + ", gone boolean").parquet(src)
        T.keyed_stream(source, at, "id", "t", str(tmp_path / "cp"), "gone", 4).awaitTermination()
        return held(T.open_keyed(spark, at))

    assert run((1, 10, "a"), (2, 1, "b")) == [(1, 10, "a"), (2, 1, "b")]
    assert run((1, 5, "late"), (2, 2, None, True)) == [(1, 10, "a")]
    assert run((2, 1, "older than its deletion")) == [(1, 10, "a")]
