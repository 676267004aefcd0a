"""How the sources of a language differ in their words: pairwise distances and telling terms.

Each (language, source) group gives every kept term a smoothed share in billionths.  Two
groups are as far apart as the absolute differences of their shares, summed over all kept
terms; a term tells a group from its language by how much its share there is larger.

Terms are split by the number of groups that use them.  *Heavy* terms, in more than ``heavy``
groups, are cut into tiles of about ``tile`` terms; a task holds the dense matrix of a tile's
shares for two blocks of at most ``block`` sources and sums the differences with numpy.
*Rare* terms are never laid out densely.  As if no group used any term, every pair gets the
difference of the shares of absent terms, once for each kept term; all else corrects that: a
dense tile by its terms' differences, each group's histogram of rare shares for rare terms
that one of two groups uses, and a join of postings for those that both use, at most
``heavy`` squared rows for a term.  All sums are whole numbers, so the parts add up exactly.

Texts are read once: a task counts its terms by group in a dictionary of bounded size and
passes partial counts on, so that a source with most rows is no hot key.  What is shuffled
grows with the distinct terms of groups, not with the words.

Defined results: null text, language and source are empty strings; terms are runs of ASCII
letters and characters from U+0080 on, with A to Z lower-cased; a group without kept terms
takes part with every count at zero; without kept terms in the language all distances are 0;
ties go to the smaller item by UTF-8 bytes; repeated rows count as often as they occur; an
empty table has no rows.  Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import cut_table, sliced

#: A term is kept in a language if at least so many of its documents have it.
MIN_DOCS = 30
#: Added to every count.
SMOOTH = 5
BILLION = 1_000_000_000
#: Terms in more groups than this are heavy; terms of a dense tile; sources of one side of a tile.
HEAVY, TILE, BLOCK = 6, 512, 256
#: Distinct (group, term) entries that a task holds before it passes them on.
HELD = 200_000

# every byte of a term as itself or in lower case, all others as a space
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, text: str = "text", group: tuple[str, str] = ("lang", "source"), held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group.

    A group's row of the empty term, without occurrences, stands for the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        in_docs: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for key, counter in n.items():
                found = [b"", *counter]
                have = in_docs[key]
                cols = [[key[0]] * len(found), [key[1]] * len(found), found, [counter[t] for t in found], [have[t] for t in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "docs"])
            n.clear()
            in_docs.clear()

        size = 0
        for b in batches:
            for s in sliced(iter([b]), 64):
                for lang, source, t in zip(*(s.column(i).to_pylist() for i in range(3)), strict=True):
                    key = (lang, source)
                    if key not in n:
                        n[key], in_docs[key] = Counter(), Counter()
                        size += 1
                    own, before = Counter(terms(t)), len(n[key])
                    n[key].update(own)
                    in_docs[key].update(own.keys())
                    size += len(n[key]) - before
                    if size >= held:
                        yield from rows()
                        size = 0
        yield from rows()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(group, ("lang", "source"), strict=True)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    partial = plain.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, mass: str) -> F.Column:
    """One more than a smoothed share in billionths, rounded down; exact for any count."""
    return F.expr(f"CAST(1 + (CAST({count} + {SMOOTH} AS DECIMAL(20, 0)) * {BILLION}) DIV CAST({mass} AS DECIMAL(20, 0)) AS BIGINT)")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, groups): the terms that a language keeps."""
    by_term = counts.filter("length(term) > 0").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("_docs"), F.count(F.lit(1)).alias("groups"))
    return by_term.filter(F.col("_docs") >= min_docs).drop("_docs")


def tables(docs: DataFrame, min_docs: int = MIN_DOCS, heavy: int = HEAVY, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Stored (groups, postings).

    groups: lang, source, sid (place in the language), v (kept terms), tiles, absent (share of a term that the group lacks).  postings: lang, term, term_id, source, sid,
    groups (that have the term), p (share in the group), q (share in the language), absent,
    tiles.
    """
    counts = cut_table(term_counts(docs), "divergence-counts")
    kept = cut_table(kept_terms(counts, min_docs).withColumn("term_id", F.monotonically_increasing_id()), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total"), F.count_if(F.col("groups") <= heavy).alias("rare"))
    used = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "groups", "total")
    masses = used.groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    groups = counts.filter("length(term) = 0").select("lang", "source").join(masses, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("mass", F.lit(0)).alias("mass"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("total", F.lit(0)).alias("all")
    ).select("*", (F.col("mass") + SMOOTH * F.col("v")).alias("own_mass"), (F.col("all") + SMOOTH * F.col("v")).alias("lang_mass"))
    place = Window.partitionBy("lang").orderBy("source")
    groups = groups.select(
        "lang", "source", (F.row_number().over(place) - 1).alias("sid"), "v", F.ceil((F.col("v") - F.col("rare")) / tile).alias("tiles"),
        F.when(F.col("v") > 0, _share("0", "own_mass")).otherwise(0).alias("absent"), "own_mass", "lang_mass",
    )
    groups = cut_table(groups, "divergence-groups")
    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "term", "term_id", "source", "sid", "groups", _share("n", "own_mass").alias("p"), _share("total", "lang_mass").alias("q"), "absent", "tiles"
    )
    return groups, cut_table(shares, "divergence-shares")


def telling_terms(postings: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): terms more frequent in a group than in its language."""
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    x = postings.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return x.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


_ABSENT, _HISTOGRAM, _CELL = 0, 1, 2


def _blocks(x: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Every row once for each pair of source blocks (one <= two) that its own block is in."""
    own = F.floor(F.col("sid") / block)
    return x.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).withColumns({"one": F.least(own, "other"), "two": F.greatest(own, "other")}).drop("other", "last")


def _tile(block: int):
    """What one tile adds to the distances of all pairs of sources of its two blocks."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        lang, tile, one, two = key
        kind, sid, slot, p, n = (x[c].to_numpy() for c in ("kind", "sid", "slot", "p", "n"))
        sources = kind == _ABSENT
        ids = np.sort(sid[sources])
        absent = p[sources][np.argsort(sid[sources])]
        rows = np.searchsorted(ids, sid)
        left, right = np.flatnonzero(ids // block == one), np.flatnonzero(ids // block == two)
        gap = np.abs(absent[left][:, None] - absent[right])
        if tile >= 0:  # heavy terms: a dense matrix
            names, column = np.unique(slot[kind == _CELL], return_inverse=True)
            dense = np.repeat(absent[:, None], len(names), axis=1)
            dense[rows[kind == _CELL], column] = p[kind == _CELL]
            total = -len(names) * gap
            for i, a in enumerate(left):
                total[i] += np.abs(dense[right] - dense[a]).sum(axis=1)
        else:  # all kept terms as if absent, and the rare ones that one of the two uses
            total = n[sources][:1].sum() * gap
            some = kind == _HISTOGRAM
            order = np.lexsort((p[some], rows[some]))
            at, value, weight = rows[some][order], p[some][order], n[some][order]
            start = np.searchsorted(at, np.arange(len(ids) + 1))

            def used_by(a: int, others: np.ndarray) -> np.ndarray:
                """Sum over the rare terms of a of |p - absent in b| - |absent in a - absent in b|."""
                v, w = value[start[a] : start[a + 1]], weight[start[a] : start[a + 1]]
                count, mass = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(v * w)])
                z = absent[others]
                below = np.searchsorted(v, z)
                away = z * count[below] - mass[below] + (mass[-1] - mass[below]) - z * (count[-1] - count[below])
                return away - count[-1] * np.abs(absent[a] - z)

            for i, a in enumerate(left):
                total[i] += used_by(a, right)
            for j, b in enumerate(right):
                total[:, j] += used_by(b, left)
        i, j = np.nonzero(ids[left][:, None] < ids[right])
        return pd.DataFrame({"lang": lang, "a": ids[left][i], "b": ids[right][j], "value": total[i, j]})

    return run


def distances(groups: DataFrame, postings: DataFrame, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value): the distance of every two sources a < b (their sid) of a language."""
    blocks = groups.groupBy("lang").agg(F.floor(F.max("sid") / block).alias("last"))
    none = F.lit(0).cast("long")
    # the sources of every tile; -1 is the tile of all rare terms
    sources = groups.select("lang", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit(_ABSENT).alias("kind"), "sid", none.alias("slot"), F.col("absent").alias("p"), F.col("v").alias("n"))
    dense, rare = postings.filter(F.col("groups") > heavy), postings.filter(F.col("groups") <= heavy)
    cells = dense.select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), F.lit(_CELL).alias("kind"), "sid", F.col("term_id").alias("slot"), "p", none.alias("n"))
    histogram = rare.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(-1).cast("long").alias("tile"), F.lit(_HISTOGRAM).alias("kind"), "sid", none.alias("slot"), "p", "n")
    tiles = _blocks(sources.unionByName(cells).unionByName(histogram), blocks, block)
    parts = tiles.groupBy("lang", "tile", "one", "two").applyInPandas(_tile(block), "lang string, a int, b int, value long")
    x, y = (rare.select("lang", "term_id", F.col("sid").alias(k), F.col("p").alias(f"p{k}"), F.col("absent").alias(f"z{k}")) for k in "ab")
    gap = lambda s, t: F.abs(F.col(s) - F.col(t))
    both = x.join(y, ["lang", "term_id"]).filter("a < b").select("lang", "a", "b", (gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value"))
    return parts.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 50, heavy: int = HEAVY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources, telling terms."""
    groups, postings = tables(docs, min_docs, heavy, tile)
    half = distances(groups, postings, heavy, block)
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda sid, c: groups.select("lang", F.col("sid").alias(sid), F.col("source").alias(c))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    found = telling_terms(postings, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(found)


def divergence_query(docs: DataFrame) -> DataFrame:
    """The audit of all documents."""
    return divergence(docs)
