import random

import numpy as np
import xxhash

from paperlake.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    bits = 0
    for k in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in sh) > len(sh):
            bits |= 1 << k
    return bits if sh else 0


def brute_components(fps, tau=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts(n=150):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = ["", None, " \t\n", "One", "one", "a b c", "word " * 3000]
    while len(out) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            out.append(" ".join(w))
    return out[:n]


def test_matches_brute_force(spark):
    data = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(data)], "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: r for r in simhash.simhash_query(df).collect()}
    fps = [brute_fingerprint(t) for t in data]
    comps = brute_components(fps)
    assert len(got) == len(data)
    for i, (f, c) in enumerate(zip(fps, comps)):
        assert got[i]["fingerprint"] == f"{f:016x}"
        assert got[i]["component_id"] == c


def test_links_of_random_balls(spark):
    """Chains and clusters of fingerprints a few bits apart, against all pairs."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8)])
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")
    for tau in (3,):
        root = {r["fp"]: r["root"] for r in simhash.link(nodes, tau).collect()}
        want = brute_components(fps, tau)
        assert len({root[s] for s in signed}) == len(set(want))
        assert all((root[signed[i]] == root[signed[j]]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(0, i, 7))


def test_allocation_is_optimal_and_sums_up():
    costs = [[0.0, 5.0, 9.0, 50.0], [0.0, 1.0, 30.0, 90.0], [0.0, 2.0, 3.0, 80.0]]
    total, chosen = simhash.allocate(costs, 3)
    assert sum(t + 1 for t in chosen) == 4
    assert (total, chosen) == (9.0, (0, 0, 1)) or total <= 9.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_query(df).collect() == []


def test_probe_keys_are_the_balls_of_the_parts(spark):
    plan = simhash.Plan(((0, 5, 63), (1, 2)), (1, 0))
    fp = -(1 << 63) + 0b100111
    nodes = spark.createDataFrame([(fp,)], "fp long")
    data = {(r["part"], r["key"] & (1 << 64) - 1) for r in simhash._keys(nodes, plan, False).collect()}
    own = (1 << 63) | 0b100001
    assert data == {(0, own), (1, 0b110)}
    probes = {(r["part"], r["key"] & (1 << 64) - 1) for r in simhash._keys(nodes, plan, True).collect()}
    assert probes == {(0, own), (0, own ^ 1), (0, own ^ 32), (0, own ^ 1 << 63), (1, 0b110)}


def test_near_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):  # hub and spokes: similar to the base, less so to each other
        w = list(base)
        for _ in range(4):
            w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "one"), (204, "One"), (205, " ".join(base[:150] + [word() for _ in range(150)]))]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, mark int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(got[i] == 0 for i in range(30)) and got[200] == 0
    assert all(got[100 + i] == 100 + i for i in range(20)) and got[205] == 205
    assert got[201] == got[202] == 201 and got[203] == got[204] == 203


def test_near_copies_are_decided_on_the_shingles(spark):
    """Pairs just above and just below 0.8, against brute force."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rows = []
    for i in range(80):  # 100 shingles; m other words at the end: (100 - m) / (100 + m)
        base, m = [word() for _ in range(104)], (11, 12)[i % 2]
        rows += [base, base[:-m] + [word() for _ in range(m)]]
    sets = [{tuple(w[k : k + 5]) for k in range(100)} for w in rows]
    fps = [brute_fingerprint(" ".join(w)) for w in rows]
    want = list(range(len(rows)))
    for i in range(0, len(rows), 2):
        if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 or (fps[i] ^ fps[i + 1]).bit_count() <= 4:
            want[i + 1] = i
    assert 40 <= sum(i != c for i, c in enumerate(want)) < 50
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_only_texts_of_candidates_are_sent(spark):
    docs = spark.range(20_000).selectExpr("id * 7919 - 50000000 as uid", "'text' as _text")
    wanted = spark.range(300).selectExpr("id * 66 * 7919 - 50000000 as uid")
    got = {r["uid"] for r in simhash._among(docs, "uid", wanted).collect()}
    want = {r["uid"] for r in wanted.collect()}
    assert want <= got and len(got) < 1.1 * len(want)
    plan = simhash._among(docs, "uid", wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
