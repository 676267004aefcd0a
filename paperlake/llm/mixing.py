"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted in words.  Weights are turned into word targets, a target above
``max_repeats`` times its source is cut there and the excess reshared.  A source's target is
met by whole passes over it and, for the rest, by a subset of its documents: documents are
counted by exact size, an equal share of each size is taken, and a bounded-knapsack dynamic
programme over the left-over counts fills the remaining budget as closely as sizes allow.
Which documents of a size are taken is decided by a seeded hash of their id, then of their text.

Defined results: a null text has size 0; null is a source of its own, after all others; a
source of size 0 has target 0; documents of size 0 follow their source's share; repeated
rows are separate documents; an empty table gives no rows; reruns agree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import WORD_PATTERN, cut_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hash buckets that documents of one size fall into; only one bucket per size is ranked.
BUCKETS = 4096
#: The dynamic programme spans at least so many words, and always twice the longest document.
REACH = 1 << 15


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Words wanted of each source; the sources' total is shared out by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size, total = dict(order), sum(n for _, n in order)
    out: dict[str | None, float] = {}
    while True:
        open_ = [s for s in size if s not in out]
        left = total - sum(out.values())
        shared = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / shared for s in open_}
        over = [s for s in open_ if want[s] > most * size[s]]
        if not over:
            return out | want
        out |= {s: float(most * size[s]) for s in over}


def fit_budget(hist: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that their sizes sum near the budget.

    ``hist``: (size, documents).  An equal share of every size is taken first; the rest is
    filled by a subset-sum dynamic programme over the documents left, on bit sets, with
    each size's count split into powers of two.  It holds the square root of the bit sets
    at once, each of at most as many bits as twice the longest text has words.
    """
    total = sum(s * n for s, n in hist)
    if budget <= 0 or total == 0:
        return {}
    if budget >= total:
        return dict(hist)
    share = budget / total
    reach = max(REACH, 2 * max(s for s, _ in hist))
    take = {s: min(n, int(n * share)) for s, n in hist}
    rest = budget - sum(s * n for s, n in take.items())
    for s, n in sorted(hist, reverse=True):  # largest first, until the programme can span the rest
        more = min(n - take[s], max(0, rest - reach) // s) if s else 0
        take[s] += more
        rest -= more * s
    items = []  # (words, size, documents)
    for s, n in sorted(hist, reverse=True):
        left, step = (min(n - take[s], rest // s), 1) if s else (0, 1)
        while left:
            k = min(step, left)
            items.append((s * k, s, k))
            left, step = left - k, step * 2
    # a bit set is as wide as the rest, and that as the longest text: only every step-th is
    # kept, and those between are made again on the way back
    mask, step = (1 << rest + 1) - 1, math.isqrt(len(items)) + 1
    marks, reached, done = [1], 1, 0
    for words, _, _ in items:
        reached = (reached | reached << words) & mask
        done += 1
        if done % step == 0:
            marks.append(reached)
        if reached >> rest & 1:
            break
    at = reached.bit_length() - 1
    for first in range((done - 1) // step * step, -1, -step):
        block = items[first : min(first + step, done)]
        sets = [marks[first // step]]
        for words, _, _ in block[:-1]:
            sets.append((sets[-1] | sets[-1] << words) & mask)
        for (words, s, k), before in zip(reversed(block), reversed(sets), strict=True):
            if not before >> at & 1:
                take[s] += k
                at -= words
    return {s: n for s, n in take.items() if n}


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7,
        row_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, size, source_size, target, repeats, taken): how often each document is taken.

    Collected to the driver: one row per source, as a mixture's weights are.  The histogram
    by size is fitted in one task per source; it has one row per distinct size.
    """
    h = F.xxhash64(F.col(row_id), F.lit(seed))
    facts_ = [
        # null sources get a key that no text has
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), h.alias("h"), F.xxhash64(F.col(text)).alias("tie"),
    ]
    # the texts are read once: what follows needs a few numbers of each document, unless the
    # caller keeps the text itself, which is then read again rather than stored
    small = text not in keep
    facts = cut_table(docs.select(*([F.struct(*keep).alias("kept")] if small else []), *facts_), "sizes")
    rows = facts if small else docs.select(F.struct(*keep).alias("kept"), *facts_)
    buckets = facts.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = buckets.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sizes = {r["key"]: int(r["words"]) for r in hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    want = targets([(k[1:] if k != "-" else None, n) for k, n in sizes.items()], weights, most) if sizes else {}
    want = {k: want[k[1:] if k != "-" else None] for k in sizes}

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, words = key[0], sizes[key[0]]
        passes = min(most, int(want[name] // words)) if words else 1
        take = fit_budget(list(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), round(want[name]) - passes * words) if passes < most else {}
        return pd.DataFrame({"key": name, "size": pdf["size"], "passes": passes, "take": [take.get(s, 0) for s in pdf["size"].tolist()]})

    plans = hist.groupBy("key").applyInPandas(plan, "key string, size long, passes int, take long")
    upto = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        buckets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .join(plans, ["key", "size"])
        .select("key", "size", "bucket", "n", "passes", F.least("n", F.greatest(F.lit(0), F.col("take") - F.col("before"))).alias("quota"))
    )
    placed = rows.join(quota, ["key", "size", "bucket"])
    whole = placed.filter("quota = 0 or quota = n").withColumn("extra", (F.col("quota") > 0).cast("int"))
    rank = Window.partitionBy("key", "size", "bucket").orderBy("h", "tie")
    split = placed.filter("quota > 0 and quota < n").withColumn("extra", (F.row_number().over(rank) <= F.col("quota")).cast("int"))
    known = docs.sparkSession.createDataFrame([(k, sizes[k], float(want[k])) for k in sizes], "key string, source_size long, target double")
    return (
        whole.unionByName(split)
        .join(F.broadcast(known), "key")
        .withColumn("repeats", F.col("passes") + F.col("extra"))
        .select(*(F.col("kept")[c].alias(c) for c in keep), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def mixing_query(docs: DataFrame) -> DataFrame:
    """The mix of all documents by source."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")
