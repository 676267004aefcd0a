"""Deduplication with survivor merge, and identity reconciliation of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.functions.python_functions import author_similarity, sequence_ratio
from paperlake.operators.storage import cut


def survivor_score(big: list[Column], small: list[Column], repaired: Column) -> Column:
    """+6 for each populated main field, +2 for each further one, +1 if repaired."""
    total = F.lit(0)
    for c in big:
        total = total + F.when(c, 6).otherwise(0)
    for c in small:
        total = total + F.when(c, 2).otherwise(0)
    return total + F.when(repaired, 1).otherwise(0)


def merge_groups(rows: DataFrame, key: str, score: Column, order: str, scalars: list[str], lists: list[str] = (), maps: list[str] = (), all_true: list[str] = ()) -> DataFrame:
    """One row per key: the best row filled from the others.

    Rows are ranked by score, equal scores by ``order``.  Scalars take the first non-blank
    value, lists (of strings) their ordered distinct union, maps (of strings) keep earlier
    entries, and flags hold only if they hold in every row.  Adds ``duplicates_removed``.

    Every field is an aggregate that tasks combine before the shuffle, so a key of any number
    of rows is no list of rows anywhere; what is held for a key are its distinct list elements
    and map keys.
    """
    x = rows.withColumn("_rank", F.struct((-score).alias("s"), F.col(order).alias("o")))
    none = F.array().cast(f"array<{_ENTRY}>")
    parts = [_entries(name, F.col(name), False) for name in lists] + [_entries(name, F.map_entries(name), True) for name in maps]
    # one entry stands for the row itself, with its scalars and flags
    entries = F.concat(F.array(F.lit(None).cast(_ENTRY)), *[F.coalesce(p, none) for p in parts])
    x = x.select(key, "_rank", *scalars, *all_true, F.explode(entries).alias("_e"))
    row, place = F.col("_e").isNull(), F.struct("_rank", "_e.i")

    def first(name: str) -> Column:
        there = row & F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "")
        return F.min_by(name, F.when(there, F.col("_rank"))).alias(name)  # a null rank takes no part

    flags = [F.bool_and(F.when(row, F.coalesce(F.col(a), F.lit(False)))).alias(a) for a in all_true]
    one = x.groupBy(key, F.col("_e.f").alias("_f"), F.col("_e.k").alias("_n")).agg(F.min(place).alias("_p"), F.min_by("_e.v", place).alias("_v"), *[first(s) for s in scalars], *flags, F.count_if(row).alias("_rows"))
    held = F.array_sort(F.collect_list(F.when(F.col("_rows") == 0, F.struct("_p", "_f", "_n", "_v"))))
    merged = one.groupBy(key).agg(*[F.first(s, ignorenulls=True).alias(s) for s in scalars], *[F.bool_and(a).alias(a) for a in all_true], (F.sum("_rows") - 1).alias("duplicates_removed"), held.alias("_all"))

    def of(name: str) -> Column:
        return F.filter("_all", lambda s: s["_f"] == name)

    lists_of = [F.transform(of(name), lambda s: s["_n"]).cast("array<string>").alias(name) for name in lists]
    maps_of = [F.map_from_entries(F.transform(of(m), lambda s: F.struct(s["_n"], s["_v"]))).alias(m) for m in maps]
    return merged.select(key, *scalars, *lists_of, *maps_of, *all_true, "duplicates_removed")


_ENTRY = "struct<f:string,k:string,v:string,i:int>"


def _entries(name: str, values: Column, keyed: bool) -> Column:
    """A list's elements or a map's entries with the field's name and their places."""
    null = F.lit(None).cast("string")

    def entry(v: Column, i: Column) -> Column:
        return F.struct(F.lit(name).alias("f"), (v["key"] if keyed else v).alias("k"), (v["value"] if keyed else null).alias("v"), i.alias("i"))

    return F.transform(values, entry)


def greedy(edges: DataFrame) -> DataFrame:
    """(old, new, ambiguous): each new row in turn takes the one old row it can still have.

    ``edges``: distinct (old, new).  Equal to a loop over the new rows in order: a row's turn
    has come when no earlier undecided row wants any of its old rows.  All rows whose turn has
    come are settled at once and their old rows leave; this repeats until no edge is left, so
    there are as many rounds as the longest chain of rows that wait for each other, mostly
    one.  A row that meets several free old rows at its turn is ambiguous and takes the least.
    """
    left, parts = edges, []
    while True:
        first = left.groupBy("old").agg(F.min("new").alias("_first"))
        own = Window.partitionBy("new")  # a record has few identifiers
        turn = F.min(F.col("new") == F.col("_first")).over(own)
        marked = cut(left.join(first, "old").select("old", "new", turn.alias("_turn"), F.min("old").over(own).alias("_least"), (F.count(F.lit(1)).over(own) > 1).alias("ambiguous")))
        taken = marked.filter(F.col("_turn") & (F.col("old") == F.col("_least"))).select("old", "new", "ambiguous")
        parts.append(taken)
        waiting = marked.filter(~F.col("_turn")).select("old", "new")
        if waiting.isEmpty():
            break
        left = waiting.join(taken, "old", "left_anti")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def unique_matches(old_ids: DataFrame, new_ids: DataFrame, method: str, done: DataFrame | None = None) -> DataFrame:
    """(old, new, method, ambiguous) over identifiers that are unique in the old snapshot.

    ``old_ids``: old, id; ``new_ids``: new, id.  Rows matched in ``done`` take no part, but an
    identifier that one of them shares is not unique.
    """
    hashed = F.sha2(F.col("id"), 256)  # identifiers may be long
    o, n = old_ids.select("old", hashed.alias("id")), new_ids.select("new", hashed.alias("id"))
    once = o.groupBy("id").agg(F.min("old").alias("old"), F.max("old").alias("_last")).filter("old = _last").drop("_last")
    if done is not None:
        once, n = once.join(done, "old", "left_anti"), n.join(done, "new", "left_anti")
    return greedy(n.join(once, "id").select("old", "new").distinct()).select("old", "new", F.lit(method).alias("method"), "ambiguous")


def reconcile(old: DataFrame, new: DataFrame, passes: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(old, new, method, ambiguous): matches by priority, each row of a side used once.

    ``passes``: (method, old ids, new ids); later passes match only rows left over.
    Rows without a partner come out as ``added`` or ``removed``.
    """
    done: DataFrame | None = None
    for method, o, n in passes:
        m = unique_matches(o, n, method, done)
        done = m if done is None else done.unionByName(m)
    none = F.lit(None).cast("long")
    added = new.join(done, "new", "left_anti").select(none.alias("old"), "new", F.lit("added").alias("method"), F.lit(False).alias("ambiguous"))
    removed = old.join(done, "old", "left_anti").select("old", none.alias("new"), F.lit("removed").alias("method"), F.lit(False).alias("ambiguous"))
    return done.unionByName(added).unionByName(removed)


def settled(matches: DataFrame) -> DataFrame:
    """The matches; one whose identifiers name several old rows stops the run."""
    stop = F.raise_error(F.concat(F.lit("ambiguous identifiers of new row "), F.col("new").cast("string"))).cast("string")
    return matches.withColumn("method", F.when(F.col("ambiguous"), stop).otherwise(F.col("method"))).drop("ambiguous")


def retitle_ids(old: DataFrame, new: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of a pass over approved retitles.

    ``policy``: old, old_title, new_title; a row holds if the old record still has that title.
    """
    held = old.join(policy.withColumnRenamed("old_title", "title"), ["old", "title"]).select("old", F.col("new_title").alias("id"))
    return held, new.select("new", F.col("title").alias("id"))


def blocked_removals(matches: DataFrame, allowed: DataFrame) -> DataFrame:
    """Old rows that vanish without permission: a publisher must stop if there are any."""
    return matches.filter("method = 'removed'").select("old").join(allowed.select("old"), "old", "left_anti")


#: How much the titles and the authors count in the similarity of two records (fixed values).
TITLE_SHARE, AUTHORS_SHARE = 0.42, 0.58


def fuzzy_score(title: tuple[str, str], authors: tuple[str, str]) -> Column:
    """How alike two records are, from the columns of both sides' titles and author lists."""
    return TITLE_SHARE * sequence_ratio(*title) + AUTHORS_SHARE * author_similarity(*authors)


def completeness_merge(old: Column, new: Column) -> Column:
    """The new text, or the old one where the new one is blank."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def overriding_maps(old: Column, new: Column) -> Column:
    """Old entries with new ones put over them."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def cascade(rows: DataFrame, column: str, lookups: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Blank values filled by the first lookup (name, frame) that has one, with its name."""
    x, values, names = rows, [F.nullif(F.trim(column), F.lit(""))], []
    for i, (name, frame) in enumerate(lookups):
        x = x.join(frame.groupBy(key).agg(F.max(column).alias(f"_f{i}")), key, "left")
        names.append(F.when(F.col(f"_f{i}").isNotNull(), F.lit(name)))
        values.append(F.col(f"_f{i}"))
    source = F.when(values[0].isNull(), F.coalesce(*names))
    return x.withColumn("hit_source", source).withColumn(column, F.coalesce(*values)).drop(*[f"_f{i}" for i in range(len(lookups))])
