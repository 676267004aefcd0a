import math
import os
import random
import zlib

import duckdb
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paperlake.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def text(rng, good):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
    if good:
        return " ".join(words).capitalize() + "."
    return rng.choice([lambda: " ".join(words).upper() + "!!", lambda: "### ".join(words) + "$$$", lambda: " ".join(words[:3] * 30), lambda: " | ".join(words)])()


def sample(n=400):
    rng = random.Random(8)
    docs = [(i, text(rng, i % 4 != 0), "en", "s") for i in range(n)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(n) if rng.random() < 0.7]
    return docs, labels


def run(spark, docs, labels):
    return Q.quality_query(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = sample()
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "some words", "en", "s"), (1003, "x" * 3_000_000, "en", "s"), (1004, "word " * 300_000, "en", "s"), (3, docs[3][1], "en", "s"), (1005, "\n\n \t", None, None)]
    got = run(spark, docs + odd, [*labels, (3, 1, 0), (5, None, 0), (6, 7, 0), (None, 0, 0), (999_999, 1, 0)])
    assert len(got) == len(docs) + len(odd)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1000]["score"] == by_id[1001]["score"]
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    held = [by_id[i] for i, *_ in docs if by_id[i]["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95


def test_labels_held_out_change_nothing(spark):
    docs, labels = sample(150)
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    turned = [(i, 1 - q if i in held else q, 1 - t) for i, q, t in labels]
    one, two = (sorted((r["doc_id"], r["score"]) for r in run(spark, docs, x)) for x in (labels, turned))
    assert one == two


def test_one_label_no_label_and_no_rows(spark):
    docs, _ = sample(30)
    assert {r["score"] for r in run(spark, docs, [])} == {0.5}
    ones = run(spark, docs, [(i, 1, 0) for i in range(30)])
    k = sum(not r["held_out"] for r in ones)
    assert {round(r["score"], 9) for r in ones} == {round((k + 0.5) / (k + 1), 9)}
    assert run(spark, [], [(1, 1, 0)]) == []


def test_conflicting_labels_take_the_majority(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (4, 2, 0), (None, 1, 0)], LABELS)
    assert {r["doc_id"]: r["label"] for r in Q.majority(labels, "quality").collect()} == {1: 0.0, 2: 1.0}


def test_rules_are_the_paths_of_the_trees(spark):
    """The rules of a tree's leaves split the rows, and lead to the tree's own predictions."""
    docs, labels = sample(200)
    described = Q.statistics(spark.createDataFrame(docs, DOCS)).join(Q.majority(spark.createDataFrame(labels, LABELS), "quality"), "doc_id")
    vectors = VectorAssembler(inputCols=list(Q.STATISTICS), outputCol="features").transform(described).cache()
    tree = RandomForestClassifier(numTrees=1, maxDepth=3, seed=1).fit(vectors).trees[0]
    printed = tree.toDebugString.splitlines()
    rules = Q.tree_rules(tree.toDebugString)
    assert len(rules) == tree.numNodes - 1
    path, leaves = [], []  # a second reading of the printed tree
    for line in printed[1:]:
        depth, body = len(line) - len(line.lstrip()), line.strip()
        path = path[: depth - 2]
        if body.startswith("Predict"):
            leaves.append((list(path), float(body.split()[1])))
        else:
            feature, sign, bound = body[body.index("(") + 1 : -1].split()[1:]
            path.append((Q.STATISTICS[int(feature)], sign, float(bound)))
    plain = F.lit(None).cast("double")
    for conditions, value in leaves:
        assert Q._simple([(n, s == "<=", b) for n, s, b in conditions]) in rules
        plain = F.when(Q.rule_column(tuple((n, s == "<=", b) for n, s, b in conditions)), value).otherwise(plain)
    assert tree.transform(vectors).filter(~F.col("prediction").eqNullSafe(plain)).count() == 0


def test_the_score_column_is_the_weighted_sum(spark):
    rule = (("capitals", False, 0.5), ("letters", True, 0.9))
    model = Q.Model(0.25, ((rule, -2.0), ((("digits", True, 0.1),), 1.5)))
    df = spark.createDataFrame([(0.7, 0.8, 0.0), (0.5, 0.8, 0.2), (0.7, 0.95, 0.1)], "capitals double, letters double, digits double")
    want = [1 / (1 + math.exp(-x)) for x in (0.25 - 2 + 1.5, 0.25, 0.25 + 1.5)]
    assert [r[0] for r in df.select(model.column()).collect()] == pytest.approx(want)
    assert model.text().splitlines()[1] == "-2.000 if capitals > 0.5 and letters <= 0.9"


def test_statistics_of_small_texts():
    one = dict(zip(Q.STATISTICS, Q.describe("AB c\nAB É 1".encode()), strict=True))
    assert one["letters"] == 6 / 11 and one["capitals"] == 4 / 6 and one["digits"] == 1 / 11
    assert one["distinct_words"] == 4 / 5 and one["commonest_word"] == 2 / 5 and one["distinct_lines"] == 1
    assert set(Q.describe(b"")) == {0.0}


def test_further_columns(spark):
    docs, labels = sample(30)
    df = spark.createDataFrame([(*d, 1.0, 2.0) for d in docs], DOCS + ", label double, letters double")
    assert len(Q.quality_query(df, spark.createDataFrame(labels, LABELS)).collect()) == 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_rows_of_the_standard_tables(spark):
    at = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.quality_query(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).collect()}
    known = duckdb.sql(f"select doc_id, quality from '{at}/labels.parquet'").fetchall()
    held = [(got[i], q) for i, q in known if i in got and got[i]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.93
