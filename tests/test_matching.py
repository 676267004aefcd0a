"""Similar titles and token sets, author lists and reconciliation against plain versions."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.functions import ids as I
from paperlake.functions import text as X
from paperlake.functions.python_functions import author_similarity
from paperlake.operators import dedupe as D
from paperlake.operators import relational as R
from paperlake.operators import search as S
from paperlake.operators import titles


def test_similar_titles_lose_nothing(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 40))) for _ in range(25)]
    titles = list(base)
    for t in base:  # edits of any kind and place, also of the start and of the length
        x = list(t)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "ab"])
        titles += ["".join(x), t]
    rows = list(enumerate(titles))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "id long, title string")
    least = {}
    for i, t in rows:
        if t:
            least.setdefault(t, i)
    for ratio in (0.86, 0.965):
        want = {(a, b) for t, a in least.items() for u, b in least.items() if a < b and SequenceMatcher(None, t, u).ratio() >= ratio}
        assert {(r.a, r.b) for r in R.similar_titles(df, "id", "title", ratio).collect()} == want
        assert want or ratio > 0.9


def test_many_titles_are_found_by_bounds(spark, monkeypatch):
    """Blocks of all kinds against all pairs; of random titles hardly any is compared in full."""
    rng = random.Random(21)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "é"]
    base = ["".join(rng.choices(parts, k=rng.choice([1, 2, 12, 20, 22, 24, 31]))) for _ in range(450)]
    names = list(dict.fromkeys(base + [t[: len(t) // 2] + "x" + t[len(t) // 2 + rng.randint(0, 3) :] for t in base[::3]]))
    full = []
    monkeypatch.setattr(titles, "SequenceMatcher", lambda _, x, y: full.append(1) or SequenceMatcher(None, x, y))
    quick = lambda x, y: min(len(x), len(y)) >= 0.43 * (len(x) + len(y)) - 1e-9 and (s := SequenceMatcher(None, x, y)).quick_ratio() >= 0.86 and s.ratio() >= 0.86
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if quick(names[i], names[j])}
    block = titles.Block(list(range(len(names))), names, 2)
    assert {(a, b) for a, b, _ in titles.similar(block, block, True, 0.86, 2)} == want and len(want) > 100
    assert len(full) < 3 * len(want)
    monkeypatch.setattr(R, "TITLE_BLOCK", (64, 64))
    df = spark.createDataFrame(list(enumerate(names)), "id long, title string")
    assert {(r.a, r.b) for r in R.similar_titles(df, "id", "title", 0.86).collect()} == want
    assert R.similar_titles(df.filter("id < 0"), "id", "title", 0.86).collect() == []


def test_longest_common_subsequences_by_bits():
    rng = random.Random(23)
    names = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 5, 30, 63, 64]))) for _ in range(40)]
    block = titles.Block(list(range(40)), names, 2)
    pairs = np.array([(i, j) for i in range(40) for j in range(40)])
    got = titles.common(block.places()[pairs[:, 0]], block.chars[pairs[:, 1]], block.lengths[pairs[:, 0]])
    for (i, j), n in zip(pairs.tolist(), got.tolist()):
        row = [0] * (len(block.texts[j]) + 1)
        for c in block.texts[i]:
            last = 0
            for k, d in enumerate(block.texts[j], 1):
                last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
        assert n == row[-1]


def test_few_titles_are_compared_in_full(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    titles = [" ".join(rng.choices(words, k=rng.randint(5, 9))) for _ in range(150)]
    titles += [t.replace(" ", "  ", 1)[:-1] for t in titles[:40]]
    one = spark.createDataFrame(list(enumerate(titles)), "_id long, _k string")
    pairs = one.selectExpr("_id as a").crossJoin(one.selectExpr("_id as b")).filter("a < b")
    near = pairs.count()
    compared = R.similar_pairs(pairs, one, 0.86)
    found = {(r.a, r.b) for r in compared.filter("ratio >= 0.86").collect()}
    assert found == {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.86} and len(found) >= 40
    assert compared.count() < 0.05 * near


def test_fuzzy_score(spark):
    row = spark.createDataFrame([("deep nets", "deep net", ["ann lee", "bo"], ["ann lee"])], "x string, y string, a array<string>, b array<string>")
    want = 0.42 * SequenceMatcher(None, "deep nets", "deep net").ratio() + 0.58 * 0.5
    assert row.select(D.fuzzy_score(("x", "y"), ("a", "b"))).first()[0] == pytest.approx(want)


def test_similar_sets_lose_nothing(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(30):
        s = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40))]
        sets += [s, s[:-1] + ["other"], s + s]
    df = spark.createDataFrame([*enumerate(sets), (900, []), (901, None)], "id long, t array<string>")
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(frozenset(s), i)
    for bound in (0.9, 0.5):
        want = {(a, b) for x, a in least.items() for y, b in least.items() if a < b and len(x & y) / len(x | y) >= bound}
        assert want and {(r.a, r.b) for r in R.similar_sets(df, "id", "t", bound).collect()} == want


def test_few_sets_are_compared_in_full(spark):
    """Sets of frequent tokens: candidates are hardly more than the similar pairs, and all of them."""
    rng = random.Random(31)
    sets = []
    for _ in range(200):
        s = rng.sample(range(300), 150)
        sets += [sorted(s), sorted(s[:-5] + rng.sample(range(300, 320), 5))]
    df = spark.createDataFrame([(i, [(v * 0x9E3779B97F4A7C15 + (v << 32) * 77) % (1 << 63) for v in s]) for i, s in enumerate(sets)], "id long, _t array<bigint>")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.9}
    got = {(r.a, r.b) for r in R.candidate_sets(df, "id", 0.9).collect()}
    assert want <= got and 200 <= len(want) and len(got) < 1.5 * len(want)


def test_author_lists(spark):
    cases = [(["ann lee", "bo"], ["ann lee", "bo"], 1.0), (["ann lee", "ann lee"], ["ann lee"], 0.5), (["ann"], ["xyz"], 0.0), ([], ["x"], 0.0), (None, None, 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.s for r in df.select("i", author_similarity("a", "b").alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for *_, c in cases]


def test_retitles_need_the_old_title_and_ambiguity_stops(spark):
    o = spark.createDataFrame([(1, "A"), (2, "B")], "old long, title string")
    n = spark.createDataFrame([(11, "A2"), (12, "B2")], "new long, title string")
    policy = spark.createDataFrame([(1, "A", "A2"), (2, "not B", "B2")], "old long, old_title string, new_title string")
    m = D.settled(D.reconcile(o.select("old"), n.select("new"), [("approved_retitle", *D.retitle_ids(o, n, policy))]))
    assert {(r.old, r.new, r.method) for r in m.collect()} == {(1, 11, "approved_retitle"), (2, None, "removed"), (None, 12, "added")}
    ids = spark.createDataFrame([(1, "x"), (2, "y")], "old long, id string"), spark.createDataFrame([(11, "x"), (11, "y")], "new long, id string")
    with pytest.raises(Exception, match="ambiguous"):
        D.settled(D.reconcile(o.select("old"), n.select("new"), [("stable_id", *ids)])).collect()


def sequential(old_ids, new_ids):
    """One new row after the other; ambiguous rows take the least old row."""
    owners = {}
    for old, i in old_ids:
        owners.setdefault(i, set()).add(old)
    unique = {i: next(iter(o)) for i, o in owners.items() if len(o) == 1}
    used, out = set(), {}
    for new in sorted({n for n, _ in new_ids}):
        free = {unique[i] for n, i in new_ids if n == new and i in unique} - used
        if free:
            out[new] = (min(free), len(free) > 1)
            used.add(min(free))
    return out


def test_each_old_row_is_taken_once_in_the_order_of_the_new_rows(spark):
    old = [(1, "x"), (2, "y")]
    new = [(11, "x"), (12, "x"), (12, "y")]
    ids = spark.createDataFrame(old, "old long, id string"), spark.createDataFrame(new, "new long, id string")
    m = D.settled(D.reconcile(ids[0].select("old"), ids[1].select("new").distinct(), [("stable_id", *ids)]))
    assert {(r.old, r.new, r.method) for r in m.collect()} == {(1, 11, "stable_id"), (2, 12, "stable_id")}


def test_greedy_rounds_equal_a_loop(spark):
    chain = [(i, f"c{i}") for i in range(12)], [x for i in range(12) for x in ((100 + i, f"c{i}"), (101 + i, f"c{i}"))]
    hub = [(1, "h"), (2, "g")], [(n, "h") for n in range(50)] + [(49, "g")]
    cases = [chain, hub]
    for seed in range(4):
        rng = random.Random(seed)
        cases.append(([(rng.randrange(40), f"i{rng.randrange(50)}") for _ in range(60)], [(rng.randrange(60), f"i{rng.randrange(50)}") for _ in range(90)]))
    for old, new in cases:
        got = D.unique_matches(spark.createDataFrame(old, "old long, id string"), spark.createDataFrame(new, "new long, id string"), "m").collect()
        assert {r.new: (r.old, r.ambiguous) for r in got} == sequential(old, new)


def test_a_title_that_a_matched_old_row_shares_is_not_unique(spark):
    old = spark.createDataFrame([(1, "k1", "T"), (2, "k2", "T")], "old long, k string, t string")
    new = spark.createDataFrame([(11, "k1", "U"), (12, "k9", "T")], "new long, k string, t string")
    ids = lambda x, s, c: x.select(s, F.col(c).alias("id"))
    m = D.reconcile(old.select("old"), new.select("new"), [(c, ids(old, "old", c), ids(new, "new", c)) for c in ("k", "t")])
    assert {(r.old, r.new, r.method) for r in m.collect()} == {(1, 11, "k"), (2, None, "removed"), (None, 12, "added")}


def test_array_functions(spark):
    one = lambda x: spark.range(1).select(x.alias("v")).first().v
    assert one(X.distinct_folded(F.array(*[F.lit(v) for v in (" b", "A", "a", "", "B ", "c")]))) == ["b", "A", "c"]
    assert one(X.distinct_folded(F.array().cast("array<string>"))) == []
    spots = F.array(*[F.struct(F.lit(t).alias("token"), F.array(*[F.lit(p) for p in ps]).alias("positions")) for t, ps in (("b", [1, 3]), ("a", [0]), ("c", [3]))])
    assert one(I.text_of_positions(spots)) == "a b c"  # the later token wins a place


def merged_by_rows(rows):
    """One row after the other, best first."""
    out = {}
    for k, score, o, a, b, lst, m, ok in sorted(rows, key=lambda r: (-r[1], r[2])):
        x = out.setdefault(k, {"a": None, "b": None, "l": [], "m": {}, "ok": True, "n": -1})
        x["a"] = x["a"] if x["a"] is not None else a if a is not None and a.strip() else None
        x["b"] = x["b"] if x["b"] is not None else b
        x["l"] += [v for v in dict.fromkeys(lst or []) if v not in x["l"]]
        x["m"] = (m or {}) | x["m"]
        x["ok"] &= bool(ok)
        x["n"] += 1
    return out


def test_survivor_merge_equals_a_loop(spark):
    rng = random.Random(3)
    some = lambda *v: rng.choice([None, *v])
    rows = [
        (some("k1", "k2", "k3"), rng.randint(0, 3), o, some("", " ", f"a{o}"), some(o), some([], [f"x{rng.randint(0, 5)}" for _ in range(4)]), some({}, {f"m{rng.randint(0, 4)}": f"v{o}" for _ in range(3)}), some(True, True, False))
        for o in range(60)
    ] + [("solo", 1, 100, None, None, None, None, None), ("all", 1, 101, "x", 5, ["q", "q"], {"z": None}, True)]
    df = spark.createDataFrame(rows, "k string, s int, o int, a string, b int, l array<string>, m map<string,string>, ok boolean").repartition(5)
    got = D.merge_groups(df, "k", F.col("s"), "o", ["a", "b"], ["l"], ["m"], ["ok"])
    want = merged_by_rows(rows)
    assert {r.k: (r.a, r.b, r.l, r.m, r.ok, r.duplicates_removed) for r in got.collect()} == {k: (x["a"], x["b"], x["l"], x["m"], x["ok"], x["n"]) for k, x in want.items()}
    plan = got._jdf.queryExecution().toString()
    assert "partial_min_by" in plan


def test_a_key_of_many_rows_is_combined_in_the_tasks(spark):
    n = 1_000_000
    x = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") % 7).cast("int").alias("s"), F.col("id").cast("int").alias("o"), F.col("id").cast("string").alias("a"), F.array((F.col("id") % 10).cast("string")).alias("l"))
    got = D.merge_groups(x, "k", F.col("s"), "o", ["a"], ["l"]).collect()
    assert len(got) == 1 and got[0].a == "6" and got[0].duplicates_removed == n - 1 and sorted(got[0].l) == [str(i) for i in range(10)]


def test_few_pairs_of_titles_reach_the_longest_common_subsequence(monkeypatch):
    """The characters that titles share, then their grams, turn down nearly all others."""
    rng = random.Random(31)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "to", "it", "is", "ou", "ly"]
    names = ["".join(rng.choices(parts, k=25)) for _ in range(1200)]
    names += [t[:9] + "x" + t[12:30] + t[33:] for t in names[:40]] + ["é" * 70 + "n" * 9, "é" * 72 + "n" * 9, "ab" * 400, "ab" * 390, "a", "b"]
    reached, common = [0], titles.common
    monkeypatch.setattr(titles, "common", lambda places, *a: reached.__setitem__(0, reached[0] + len(places)) or common(places, *a))
    block = titles.Block(list(range(len(names))), names, 2)
    found = {(a, b) for a, b, _ in titles.similar(block, block, True, 0.86, 2)}
    assert found >= {(i, 1200 + i) for i in range(40) if SequenceMatcher(None, names[i], names[1200 + i]).ratio() >= 0.86}
    assert found >= {(1240, 1241), (1242, 1243)} and (1244, 1245) not in found
    assert reached[0] < len(names) ** 2 / 2 / 40  # 1.6 %; 17 % by grams alone


def test_pages_are_read_once_for_titles_and_names(spark):
    from __spark_entry__ import queries

    plan = queries()["REC06_author_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "html" not in plan
