"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams; every language
is described by several centroids from spherical k-means; a text takes the language of the
centroid with the largest cosine and is rejected if it lies much further from that centroid
than nearly all training texts of the language.

The classifier is fitted on a bounded sample of labelled rows (``max_train`` in total): of
each language's texts of at least FULL grams those of least hash of id and text, or its FEW
longest texts if it has fewer than that; so every label of a text with a letter has a
centroid, however often its rows repeat.  With more labels than ``max_train`` each has one
row.  The rows are picked and counted on the executors: the driver gets no text, but at
most ``max_train`` rows of at most DIMENSIONS counts, however often an id occurs.
Prediction covers every row and whole texts and sees nothing but the text.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected;
a table without labelled text gives ``und`` everywhere; repeated rows get equal predictions;
an empty table has no rows; further columns are ignored unless they are kept; ties go to the first label in code
point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import sliced

DIMENSIONS = 1 << 14
MAX_TRAIN = 800
CENTROIDS = 4
#: A text is rejected below MARGIN times the cosine that all but a share INNER of its
#: language's training texts reach; smaller clusters than a share RARE are dropped.
MARGIN, INNER, RARE = 0.45, 0.02, 0.02
#: Grams from which on a text's distance is taken in full; shorter texts get slack in proportion.
FULL = 600
#: Texts of FULL grams from which on a language is fitted on those alone.
FEW = 10 * CENTROIDS
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-gram ids of the lower-cased letters, runs of others as one space.

    None if there is no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(points, 0x10FFFF)]
    if not is_letter.any():
        return None
    x = np.where(is_letter, points, 32).astype(np.uint32)
    x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]])
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    a = x * np.uint32(2654435761)
    two = (a[:-1] ^ (x[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (x[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([a >> np.uint32(18), two >> np.uint32(18), three >> np.uint32(18)]).astype(np.int64)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Dampened counts (rows x DIMENSIONS, float32) and each row's number of grams."""
    out, total = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ids = grams(t)
        if ids is not None:
            total[i] = len(ids)
            out[i] = np.log1p(np.bincount(ids, minlength=DIMENSIONS))
    return out, total


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, cosines in 0..1 and whether each text is rejected."""
        tf, total = counts(texts)
        some = total > 0
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = _unit(tf * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        label = [self.labels[self.owner[b]] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
        return label, np.where(some, score, 0.0), ~some | (score < MARGIN * self.reach[best] * np.minimum(1.0, total / FULL))


def fit(texts: list[str], labels: list[str], k: int = CENTROIDS, rounds: int = 10) -> Model:
    """Several spherical k-means centroids for each label."""
    return fit_counts(*counts(texts), labels, k, rounds)


def fit_counts(tf: np.ndarray, total: np.ndarray, labels: list[str], k: int = CENTROIDS, rounds: int = 10) -> Model:
    """The same from dampened counts and numbers of grams."""
    some = total > 0
    rows, names = tf[some], np.array([x for x, s in zip(labels, some, strict=True) if s], object)
    found = sorted(set(names.tolist()))
    if not found:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    del tf
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    rows *= idf  # in place: the driver holds these rows once
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(norms > 0, norms, 1)
    unit = rows
    centroids, owner, reach = [], [], []
    for n, name in enumerate(found):
        x = unit[names == name]
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]  # rows come in hash order
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            c = _unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
        c = c[size >= min(size.max(), max(2, RARE * len(x)))]  # a few odd texts are no cluster
        inner = float(np.quantile((x @ c.T).max(axis=1), INNER))
        centroids += list(c)
        owner += [n] * len(c)
        reach += [inner] * len(c)
    return Model(found, idf, np.stack(centroids).astype(np.float32), np.array(owner), np.array(reach))


def train(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang", row_id: str = "doc_id", max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most ``max_train`` labelled rows, evenly over the labels."""
    # a text's grams are 3 * (size + 2) - 3
    size = F.char_length(F.trim(F.regexp_replace(F.col(text), r"[^\p{L}]+", " ")))
    rows = docs.filter(usable & F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(row_id), F.col(text)), F.lit(1 << 30)).alias("h"), size.alias("size")
    )
    full = F.col("size") >= FULL // 3 - 1
    sizes = {r["label"]: (r["full"], r["least"]) for r in rows.groupBy("label").agg(F.count_if(full).alias("full"), F.count_if(F.col("size") > 0).alias("some"), F.min(F.when(full, F.col("h"))).alias("least")).filter("some > 0").collect()}
    if not sizes:
        return fit([], [])
    quota = max(1, max_train // len(sizes))
    few = min(FEW, quota)
    short = sorted(name for name, (n, _) in sizes.items() if n < few)
    # a hash below the label's threshold admits about twice the quota, and the least hash of a
    # label always, as repeated rows have one hash; the window takes the quota of those, first
    # in every task, so that equal hashes fill no task either
    limits = [F.when(F.col("label") == name, max(least + 1, min(1 << 30, int((2 * quota + 20) / n * (1 << 30))))) for name, (n, least) in sorted(sizes.items()) if n >= few]
    first = Window.partitionBy("label").orderBy("h", "text")
    longest = Window.partitionBy("label").orderBy(F.desc("size"), "h", "text")
    taken = rows.filter(F.col("h") < F.coalesce(*limits)).filter(full).withColumn("row", F.row_number().over(first)).filter(F.col("row") <= quota) if limits else None
    if short:
        long_ones = rows.filter(F.col("label").isin(short) & (F.col("size") > 0)).withColumn("row", F.row_number().over(longest)).filter(F.col("row") <= few)
        taken = long_ones if taken is None else taken.unionByName(long_ones)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            out: list[tuple] = []
            for name, t, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                tf, total = counts([t])
                at = np.flatnonzero(tf[0]).astype(np.int32)
                out.append((name, h, int(total[0]), at.tobytes(), tf[0, at].tobytes()))
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["label", "h", "total", "ids", "counts"])

    chosen = sorted(taken.select("label", "text", "h").mapInArrow(count, "label string, h long, total long, ids binary, counts binary").collect(), key=lambda r: (r["label"], r["h"], bytes(r["ids"]), bytes(r["counts"])))
    tf = np.zeros((len(chosen), DIMENSIONS), np.float32)
    for i, r in enumerate(chosen):
        tf[i, np.frombuffer(r["ids"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    return fit_counts(tf, np.array([r["total"] for r in chosen], np.int64), [r["label"] for r in chosen])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch: int = 64) -> DataFrame:
    """(*keep, lang_pred, score, rejected) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(len(keep)).to_pylist()
            label: list[str] = []
            score, rejected = [], []
            for i in range(0, len(texts), batch):
                x, s, r = shared.value.predict(texts[i : i + batch])
                label += x
                score.append(s)
                rejected.append(r)
            new = [pa.array(label, pa.string()), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([np.zeros(0, bool), *rejected]))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *new], [*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def held_out(row_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def language_query(docs: DataFrame) -> DataFrame:
    """Every document's predicted language, learnt from the documents not held out."""
    model = train(docs, ~held_out())
    x = predict(docs.select("doc_id", "text"), model)
    return x.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
