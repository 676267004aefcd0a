"""A quality classifier as a sparse ensemble of rules, scored by Spark column expressions.

Each text is described by a few statistics of its bytes, words and lines.  A random forest
over the statistics of the labelled texts proposes rules: every path from a root to a node is
a conjunction of comparisons.  A logistic model with a lasso penalty over the rules' truth
values keeps few of them, with weights; the score is one column expression over statistics.

The statistics are computed once for every whole text, in one pass, and stored; fitting and
scoring read that narrow table.  All labelled rows are used, on the executors: the driver
sees trees and weights, whose sizes are parameters.

Defined results: a null text counts as the empty one and has a score; labels other than 0 and
1 are ignored; an id with several labels counts with their majority, a tie as 1; rows of null
id have no label; equal texts get equal scores; without rows of both labels all texts get
the smoothed share of label 1 (0.5 without any); an empty table has no rows.  Further columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import cut_table, sliced
from paperlake.llm.language import held_out

#: Statistics of a text, in the order of ``describe``.
STATISTICS = (
    "letters", "capitals", "digits", "stops", "symbols", "spaces", "beyond_ascii", "entropy", "squeezed", "log_words", "word_bytes", "longest_word",
    "one_byte_words", "distinct_words", "distinct_pairs", "commonest_word", "log_lines", "words_by_line", "distinct_lines",
)
TREES, DEPTH, PENALTY = 20, 3, 0.002
#: Rules that hold for a smaller share of the labelled texts, or for all but it, are dropped.
SUPPORT = 0.002

_CAPITALS = slice(65, 91)
_STOPS = list(b".,;:!?'\"()-")
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS]


def describe(text: bytes) -> list[float]:
    """The statistics of a UTF-8 text; all 0 if it is empty."""
    if not text:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text) - int(count[128:192].sum())  # characters
    letters, capitals = int(count[65:91].sum() + count[97:123].sum() + count[192:].sum()), int(count[_CAPITALS].sum())
    share = count[count > 0] / len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w, often = len(words), Counter(words)
    return [
        letters / n, capitals / max(letters, 1), int(count[48:58].sum()) / n, int(count[_STOPS].sum()) / n, int(count[_SYMBOLS].sum()) / n, int(count[[9, 10, 11, 12, 13, 32]].sum()) / n, int(count[192:].sum()) / n,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / len(text), float(np.log1p(w)), sum(map(len, words)) / max(w, 1), float(max(map(len, often), default=0)),
        sum(k for x, k in often.items() if len(x) == 1) / max(w, 1), len(often) / max(w, 1), len(set(zip(words, words[1:], strict=False))) / max(w - 1, 1), max(often.values(), default=0) / max(w, 1),
        float(np.log1p(len(lines))), w / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
    ]


def statistics(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, *STATISTICS) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            found = np.array([describe(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], [row_id, *STATISTICS])

    kind = docs.schema[row_id].dataType.simpleString()
    plain = docs.select(row_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, f"`{row_id}` {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A comparison: statistic, whether at most (else more than) the bound, bound.
Comparison = tuple[str, bool, float]
#: A rule: the comparisons that must hold, at most two for a statistic.
Rule = tuple[Comparison, ...]


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for name, at_most, bound in rule:
        out = out & (F.col(name) <= bound if at_most else F.col(name) > bound)
    return out


def _simple(path: Sequence[Comparison]) -> Rule:
    """The same conjunction with one bound for each statistic and direction, in one order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, at_most, bound in path:
        before = bounds.get((name, at_most), bound)
        bounds[name, at_most] = min(bound, before) if at_most else max(bound, before)
    return tuple((name, at_most, bound) for (name, at_most), bound in sorted(bounds.items()))


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def tree_rules(text: str, names: Sequence[str] = STATISTICS) -> list[Rule]:
    """Every path from the root to a node, from a tree as Spark prints it."""
    path: list[tuple[int, Comparison]] = []
    out = []
    for line in text.splitlines():
        if found := _TEST.match(line):
            depth = len(found[1])
            path = [(d, c) for d, c in path if d < depth] + [(depth, (names[int(found[2])], found[3] == "<=", float(found[4])))]
            out.append(_simple([c for _, c in path]))
    return out


@dataclass(frozen=True)
class Model:
    """Weighted rules; the score is the logistic function of bias and sum."""

    bias: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def text(self) -> str:
        """One line for each rule, the heaviest first."""
        lines = [f"{w:+.3f} if " + " and ".join(f"{n} {'<=' if a else '>'} {b:.4g}" for n, a, b in rule) for rule, w in sorted(self.weights, key=lambda x: -abs(x[1]))]
        return "\n".join([f"{self.bias:+.3f}", *lines])


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 12) -> Model:
    """A model of ``rows``: ``label`` (0 or 1, double) and the statistics."""
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Model(float(np.log((ones + 0.5) / (n - ones + 0.5))))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    held = rows.agg(*(F.count_if(rule_column(r)).alias(str(i)) for i, r in enumerate(rules))).first() if rules else ()
    by_rows: dict[int, list[Rule]] = {}
    for rule, k in zip(rules, held, strict=True):
        if SUPPORT * n <= min(k, n - k):
            by_rows.setdefault(k, []).append(rule)
    rules = sorted(r for found in by_rows.values() for r in found)
    if not rules:
        return Model(float(np.log((ones + 0.5) / (n - ones + 0.5))))
    truth = rows.select("label", array_to_vector(F.array(*(rule_column(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5).fit(cut_table(truth, "quality-rules"))
    weights = zip(rules, lasso.coefficients.toArray().tolist(), strict=True)
    return Model(float(lasso.intercept), tuple((r, w) for r, w in weights if w))


def majority(labels: DataFrame, label: str, row_id: str = "doc_id") -> DataFrame:
    """(row_id, label): one label of 0 or 1 for each id."""
    plain = labels.filter(F.col(row_id).isNotNull() & F.col(label).isin(0, 1))
    return plain.groupBy(row_id).agg((F.avg(label) >= 0.5).cast("double").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", row_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(row_id, score, predicted) of every row, learnt from the labels of ``usable`` rows."""
    described = cut_table(statistics(docs, text, row_id), "quality-statistics")
    rows = described.filter(usable).join(majority(labels, label, row_id), row_id).select("label", *STATISTICS)
    model = fit(cut_table(rows, "quality-labelled"))
    scored = described.select(row_id, model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's quality, learnt from the labelled documents not held out."""
    held = held_out(parts=3, part=1)
    return classify(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")
