import random
import re

from paperlake.llm import mixing as M


def test_budgets_are_met_exactly_when_sizes_allow():
    rng = random.Random(4)
    for _ in range(60):
        hist = sorted({rng.randint(0, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}.items())
        total = sum(s * n for s, n in hist)
        budget = rng.randint(0, total + 5)
        take = M.fit_budget(hist, budget)
        assert all(0 < n <= dict(hist)[s] for s, n in take.items())
        got = sum(s * n for s, n in take.items())
        assert got <= max(0, budget)
        reach = {0}
        for s, n in hist:
            reach = {r + s * k for r in reach for k in range(n + 1) if r + s * k <= budget}
        left = {s: n - take.get(s, 0) for s, n in hist}
        assert got == max(reach) or not any(s and left[s] and got + s <= budget for s in left)


def test_targets():
    want = M.targets([("a", 100), (None, 10), ("b", 10), ("c", 80)])
    assert abs(sum(want.values()) - 200) < 1e-6
    assert want["b"] <= 30 and want[None] <= 30 and want["a"] > want["c"]
    assert M.targets([("x", 0)]) == {"x": 0.0}


def test_mix(spark):
    rng = random.Random(6)
    data = [(i, " ".join(["w"] * rng.randint(0, 40)) + rng.choice(["", " \t", "\n"]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(400)]
    data += [(500, None, "s2"), (501, "", "s2"), (7, "a b c", "s1"), (7, "a b c", "s1")] + [(600 + i, "same words here", "s1") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, size int")
    got = M.mixing_query(df).collect()
    assert len(got) == len(data)
    again = M.mixing_query(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = M.targets(list(sizes.items()))
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for s, n in sizes.items():
        assert abs(sum(by_target[(n, want[s])]) - want[s]) <= 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixing_query(df).collect() == []


def test_a_text_of_millions_of_words_needs_little_memory():
    import tracemalloc

    hist = [(s, 3) for s in range(1, 3001)] + [(20_000_000, 1)]
    total = sum(s * n for s, n in hist)
    tracemalloc.start()
    take = M.fit_budget(hist, total - 20_000_000 + 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert abs(sum(s * n for s, n in take.items()) - (total - 20_000_000 + 7)) <= 7
    small = M.fit_budget([(3, 4), (5, 2), (7, 1)], 17)
    assert sum(s * n for s, n in small.items()) == 17
