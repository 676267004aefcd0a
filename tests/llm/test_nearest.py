import math
import random
from functools import reduce

from paperlake.llm import nearest as N


def test_matches_brute_force(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 10.0 ** rng.randint(-3, 3)) for _ in range(7)], 1.5) for i in range(230)]
    hot = [1.0, 2.0, -1.0, 0.5, 0.0, 3.0, 1.0]
    data += [(300 + i, hot, 0.0) for i in range(120)]
    data += [(500, None, 0.0), (520, [0.0] * 7, 0.0), (540, [1.0, None] + [2.0] * 5, 0.0), (560, [math.nan] * 7, 0.0), (580, [math.inf] + [1.0] * 6, 0.0), (600, [], 0.0), (620, [1.0, 2.0], 0.0), (640, [2.0, 1.0], 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double")
    got = {}
    for r in N.search(df, N.F.col("vec_id") % 20 == 0, 20, query_block=6, candidate_block=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: v for i, v, _ in data if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q in (i for i in fine if i % 20 == 0):
        score = lambda v: reduce(lambda s, ab: s + ab[0] * ab[1], zip(fine[q], v), 0.0)
        want = sorted(((-score(v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) == {i for i in fine if i % 20 == 0}


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(300, 64)) * rng.uniform(0.01, 100, (300, 1))
    q8, qs, qn, qe = N.quantise(q)
    c8, cs, _, ce = N.quantise(c)
    near = (q8 @ c8.T) * qs[:, None] * cs
    bound = qn[:, None] * ce + qe[:, None] * np.sqrt((c**2).sum(1))
    assert (np.abs(q @ c.T - near) <= bound + 1e-9).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest_query(df).collect() == []
