"""Joins, lookups, ranked picks and aggregations over keyed frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.functions.python_functions import ratio_if_possible
from paperlake.operators import titles
from paperlake.operators.storage import cut, spread


def ordered_children(children: DataFrame, key: str, idx: str, value: str, into: str) -> DataFrame:
    """One row per parent with its child values in order."""
    return children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda s: s[value]).alias(into))


def with_children(parents: DataFrame, grouped: DataFrame, key: str, into: str) -> DataFrame:
    """Parents with their child lists, an empty one where there are none."""
    return parents.join(grouped, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def id_coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(side, key): ids missing from the actual rows and extra ones."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def winner(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key under a total order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def unique_only(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys seen exactly once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)).filter("_n = 1").drop("_n")


def first_match(left: DataFrame, lookups: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """Left rows with the value of the first lookup (frame, key) that has one; each lookup
    is reduced to one row per key first."""
    out, found = left, []
    for i, (frame, key) in enumerate(lookups):
        one = frame.groupBy(key).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, key, "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_v{i}" for i in range(len(lookups))])


def fill_blank(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left rows whose blank column is filled from the right side."""
    r = right.select(key, F.col(column).alias("_fill"))
    return left.join(r, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), "_fill")).drop("_fill")


def heading_before(items: DataFrame, headings: DataFrame, group: str, pos: str, heading: str) -> DataFrame:
    """Each item with the last heading at or before its position, per group."""
    both = items.select(group, pos, F.lit(1).alias("_item"), F.lit(None).cast("string").alias(heading)).unionByName(headings.select(group, pos, F.lit(0).alias("_item"), heading))
    w = Window.partitionBy(group).orderBy(pos, "_item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(heading, F.last(heading, ignorenulls=True).over(w)).filter("_item = 1").drop("_item")


def checklist(actual: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """(key, state): matched, missing from the actual rows, or extra there.

    Keys may be long: they are grouped and joined by their hashes.
    """
    one = lambda x, name: x.groupBy(F.md5(F.col(key)).alias("_h")).agg(F.first(key).alias(name), F.lit(1).alias(f"{name}n"))
    both = one(actual, "_a").join(one(official, "_o"), "_h", "full")
    state = F.when(F.col("_an").isNull(), "missing").when(F.col("_on").isNull(), "extra").otherwise("matched")
    return both.select(F.coalesce("_a", "_o").alias(key), state.alias("state"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Buckets of token hashes whose frequencies order the tokens of ``similar_sets``, and words of 64
#: bits of a set's wide parity sketch; they change the cost and never the result.
TOKEN_BUCKETS, SKETCH_WORDS = 1 << 22, 8


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often the hashes of each bucket occur, up to 127 exactly and then by logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKEN_BUCKETS, np.int32)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy().view(np.uint64) % np.uint64(TOKEN_BUCKETS), minlength=TOKEN_BUCKETS).astype(np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["w", "n"])

    counted = sets.select("_t").mapInArrow(run, "w int, n int").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    level = F.when(F.col("n") < 128, F.col("n")).otherwise(F.least(F.lit(255), F.floor(F.log2("n") * 16) + 16)).cast("short")
    out = np.zeros(TOKEN_BUCKETS, np.uint8)
    found = counted.select("w", level.alias("level")).toArrow()
    out[found.column("w").to_numpy()] = found.column("level").to_numpy()
    return out


def _parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parities of the tokens by bucket, as words of 64 bits: two sets differ in at least as many
    tokens as these in bits."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * words), minlength=64 * words) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _heads(sets: DataFrame, key: str, least: float, often: np.ndarray) -> DataFrame:
    """(_w, key, _n, _p, _s): the tokens at which a set is looked up, its rarest ones, by their
    hashes, with their place in that order and the set's parities."""
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            ends = np.cumsum(b.column(1).value_lengths().to_numpy())
            for i, hashes in enumerate(np.split(b.column(1).flatten().to_numpy(), ends[:-1])):
                n = len(hashes)
                keep = n - math.ceil(round(least * n, 9)) + 1  # rounding first: 0.9 * 10 is not quite 9
                rare = hashes[np.lexsort((hashes, often[hashes.view(np.uint64) % np.uint64(TOKEN_BUCKETS)]))[:keep]]
                for col, x in zip(cols, (rare, np.full(keep, i), np.full(keep, n), np.arange(keep), np.full(keep, _parities(hashes, 1)[0])), strict=True):
                    col.append(x)
            w, at, n, p, s = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(p, pa.int32()), pa.array(s, pa.int64())], ["_w", key, "_n", "_p", "_s"])

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "_t").mapInArrow(run, f"_w long, `{key}` {kind}, _n int, _p int, _s long")


def _wide(sets: DataFrame, key: str) -> DataFrame:
    """(key, _q): the wide parity sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(1).value_lengths().to_numpy())
            found = [_parities(hashes, SKETCH_WORDS) for hashes in np.split(b.column(1).flatten().to_numpy(), ends[:-1])] if len(ends) else []
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SKETCH_WORDS, pa.int32()), flat)], [key, "_q"])

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "_t").mapInArrow(run, f"`{key}` {kind}, _q array<bigint>")


def candidate_sets(sets: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b) of the distinct sets (key, _t) that can be so similar.

    They share a token of both heads, and the places of the first such one leave room for as
    many shared tokens as the similarity takes; no more bits differ in their parities than
    tokens may in the sets.
    """
    head = _heads(sets, key, least, _frequencies(sets))
    other = head.toDF("_w", "b", "_m", "_o", "_z")
    sizes = F.col("_n") + F.col("_m")
    shared, apart = F.ceil(F.round(sizes * (least / (1 + least)), 9)), F.floor(F.round(sizes * ((1 - least) / (1 + least)), 9))
    near = (F.col("a") < F.col("b")) & (F.col("_n") >= least * F.col("_m")) & (F.col("_m") >= least * F.col("_n"))
    near &= (F.least(F.col("_n") - F.col("_p"), F.col("_m") - F.col("_o")) >= shared) & (F.bit_count(F.col("_s").bitwiseXOR(F.col("_z"))) <= apart)
    pairs = head.withColumnRenamed(key, "a").join(other, "_w").filter(near).select("a", "b", apart.alias("_d")).distinct()
    wide = cut(_wide(sets, key))
    both = pairs.join(wide.toDF("a", "_x"), "a").join(wide.toDF("b", "_y"), "b")
    bits = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    return both.filter(bits <= F.col("_d")).select("a", "b")


def similar_sets(rows: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity) of distinct token sets with a Jaccard similarity of at least ``least``.

    Rows of equal sets are one class, named by its least key, so copies make no pairs.  Two
    sets so similar share one of the first n - ceil(least * n) + 1 of their n tokens in any
    one order; tokens go from rare to frequent, so candidates meet at rare ones, and sketches
    turn most of them down before sets are sent.  Sets are held as sorted token hashes of 64
    bits; a pair that they accept is decided on them.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    sets = rows.filter(F.size(tokens) > 0).select(key, hashed.alias("_t"))
    # one row for each distinct set, by its digest; the tokens are looked up again by key
    sets = cut(spread(sets).groupBy(F.xxhash64("_t").alias("_d"), F.size("_t").alias("_s"), F.md5(F.array_join(F.transform("_t", lambda t: t.cast("string")), " ")).alias("_m")).agg(F.min(F.struct(key, "_t")).alias("r")).select("r.*"))
    pairs = cut(candidate_sets(sets, key, least))
    full = pairs.join(sets.select(F.col(key).alias("a"), F.col("_t").alias("_x")), "a").join(sets.select(F.col(key).alias("b"), F.col("_t").alias("_y")), "b")
    return full.withColumn("similarity", jaccard(F.col("_x"), F.col("_y"))).filter(F.col("similarity") >= least).select("a", "b", "similarity")


#: Ratios from which a title found in a source is the one looked for (fixed values).
TITLE_RULES = (("best of a search", 0.86), ("strict", 0.965), ("proceedings index", 0.992), ("venue index", 0.997))


#: Titles of a block, at least and at most, and blocks at least while there are titles for them.
TITLE_BLOCK, TITLE_BLOCKS = (256, 8192), 16


def _title_blocks(counts: list[tuple[int, int]], far: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Blocks (least length, greatest, parts) of near-equal size over lengths and their counts,
    and the pairs of (block, part), numbered through, that can hold similar titles."""
    target = min(max(sum(n for _, n in counts) // TITLE_BLOCKS, TITLE_BLOCK[0]), TITLE_BLOCK[1])
    ranges: list[list[int]] = []
    for length, n in sorted(counts):
        if ranges and ranges[-1][2] + n <= target:
            ranges[-1][1:] = [length, ranges[-1][2] + n]
        else:
            ranges.append([length, length, n])
    blocks = [(low, high, -(-n // target)) for low, high, n in ranges]
    flat = [(low, high) for low, high, parts in blocks for _ in range(parts)]
    return blocks, [(i, j) for i in range(len(flat)) for j in range(i, len(flat)) if flat[i][1] >= math.floor(far * flat[j][0])]


def similar_titles(rows: DataFrame, key: str, title: str, least: float, gram: int = 2) -> DataFrame:
    """(a, b, ratio) of different titles whose sequence ratio is at least ``least``.

    Exact; equal titles are one class, named by the least key.  Titles are dealt into blocks by
    length, and every two blocks whose lengths allow the ratio meet in one task: the grams
    that a pair shares, one matrix product for a tile of pairs, then its longest common
    subsequence leave few pairs to be compared in full.
    """
    one = rows.filter(F.length(title) > 0).groupBy(F.col(title).alias("_k")).agg(F.min(key).alias("_id"))
    one = cut(one.select("_id", "_k", F.length("_k").alias("_l")))
    blocks, pairs = _title_blocks([(r["_l"], r["n"]) for r in one.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()], least / (2 - least))
    spark = rows.sparkSession
    kind = one.schema["_id"].dataType
    first = [sum(parts for *_, parts in blocks[:k]) for k in range(len(blocks))]
    ranges = spark.createDataFrame([(x, k, parts) for (low, high, parts), k in zip(blocks, first, strict=True) for x in range(low, high + 1)], "_l int, _f int, _parts int")
    meets = spark.createDataFrame([(b, n, side) for n, pair in enumerate(pairs) for side, b in enumerate(pair) if not side or pair[0] != pair[1]], "_b int, _pair int, _side int")
    dealt = one.join(F.broadcast(ranges), "_l").withColumn("_b", (F.col("_f") + F.pmod(F.xxhash64("_k"), F.col("_parts"))).cast("int"))
    tasks = max(1, min(len(pairs), 8 * spark.sparkContext.defaultParallelism))
    met = dealt.join(F.broadcast(meets), "_b").select("_pair", "_side", "_id", "_k").repartition(tasks, "_pair").sortWithinPartitions("_pair", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        sides: tuple[tuple[list, list], tuple[list, list]] = ([], []), ([], [])

        def made() -> pa.RecordBatch:
            x = titles.Block(*sides[0], gram)
            y = titles.Block(*sides[1], gram) if sides[1][0] else x
            same = pairs[now][0] == pairs[now][1]
            found = list(titles.similar(x, y, same, least, gram)) if same or y is not x else []
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], ids), pa.array(cols[1], ids), pa.array(cols[2], pa.float64())], ["a", "b", "ratio"])

        for b in batches:
            ids = b.schema.field("_id").type
            for pair, side, i, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pair != now:
                    if now is not None:
                        yield made()
                    now, sides = pair, (([], []), ([], []))
                sides[side][0].append(i)
                sides[side][1].append(k)
        if now is not None:
            yield made()

    return met.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, ratio double")


def similar_pairs(pairs: DataFrame, titles: DataFrame, least: float, gram: int = 2) -> DataFrame:
    """(a, b, ratio) of those pairs that can have the ratio, compared in full.

    ``titles``: _id, _k.  Of two titles with lengths l and m, at most (1 - least) * (l + m)
    characters are matched by none of the other; each spoils at most ``gram`` grams, so at
    least the others of either title are shared, counted with repeats.
    """
    side = lambda name, k: titles.select(F.col("_id").alias(name), F.col("_k").alias(k))
    full = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    return full.select("a", "b", ratio_if_possible("_x", "_y", F.lit(least), F.lit(gram)).alias("ratio")).filter("ratio is not null")


def count_by(rows: DataFrame, column: Column, into: str) -> DataFrame:
    return rows.groupBy(column.alias(into)).agg(F.count(F.lit(1)).alias("n"))


def fixed_domain_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts with zero for absent members of the domain."""
    members = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(members).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def count_diff(actual: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """(key, diff): actual less official counts over all keys."""
    return actual.select(key, F.col("n").alias("_a")).join(official.select(key, F.col("n").alias("_o")), key, "full").select(
        key, (F.coalesce("_a", F.lit(0)) - F.coalesce("_o", F.lit(0))).alias("diff"))


def alignment(actual: Column, official: Column) -> Column:
    """True, false, or null where no official count is known."""
    return F.when(official.isNull(), F.lit(None).cast("boolean")).otherwise(actual == official)


def patch(rows: DataFrame, fills: DataFrame, key: str) -> DataFrame:
    """Blank abstracts filled by key, their flag removed, complete placeholders resolved."""
    f = fills.groupBy(key).agg(F.max("abstract").alias("_fill"))
    x = rows.join(f, key, "left").withColumn("patched", (F.trim("abstract") == "") & F.col("_fill").isNotNull())
    return x.select(
        *[c for c in rows.columns if c not in ("abstract", "quality_flags", "record_status")],
        F.when(F.col("patched"), F.col("_fill")).otherwise(F.col("abstract")).alias("abstract"),
        F.when(F.col("patched"), F.array_remove("quality_flags", "missing_abstract")).otherwise(F.col("quality_flags")).alias("quality_flags"),
        F.when(F.col("patched") & (F.col("record_status") == "placeholder") & (F.size("authors") > 0), "resolved").otherwise(F.col("record_status")).alias("record_status"),
        "patched",
    )
