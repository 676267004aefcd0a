import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import katz as K


def texts():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcéx") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = [None, "", " \t", "One one ONE one", "zzz unseen-word"]
    for _ in range(120):
        w = [vocab[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.2:
            w.append(f"rare{rng.randint(0, 10**6)}")
        out.append(" ".join(w))
    return out


def brute(rows, is_held):
    """The same model with dictionaries; probabilities as a function (h, w)."""
    toks = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c1, c2 = Counter(), Counter()
    for i, t in toks.items():
        if not is_held(i):
            c1.update(t)
            c2.update(zip(["<s>", *t[:-1]], t))
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    d = K.discounts(np.array([sum(1 for c in c2.values() if c == r) for r in range(K.DISCOUNTED + 2)], float))
    after = {}
    for (h, w), c in c2.items():
        after.setdefault(h, {})[w] = c

    def p(h, w):
        if h not in after:
            return p1(w)
        f = after[h]
        kept = {x: (d[c] * c if c < len(d) else c) for x, c in f.items()}
        total = sum(f.values())
        below = total + 1 if total - sum(kept.values()) < 1e-9 * total else total
        if w in f:
            return kept[w] / below
        return (1 - sum(kept.values()) / below) / (1 - sum(map(p1, f))) * p1(w)

    return toks, c1, n, v, p1, p, after


@pytest.mark.parametrize(("known", "chunk", "piece"), [(40, 10**6, 10**6), (0, 50, 10)])
def test_matches_brute_force_and_sums_to_one(spark, known, chunk, piece):
    """Also with pieces and messages smaller than a text, and without known words."""
    rows = list(enumerate(texts()))
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks, c1, n, v, p1, p, after = brute(rows, is_held)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(5)
    tables = K.fit(df, K.held_out(), partition_bytes=400, known=known, chunk=chunk, piece=piece)
    assert known < 10 or len(tables.model.hot) > 0
    got = {r["doc_id"]: r for r in K.score(df, tables, K.held_out()).collect()}
    assert len(got) == len(rows)
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(i), len(t), sum(c1[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p1(w)) for w in t), rel=1e-12)
        assert r["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t)), rel=1e-9)
    for h in after:
        assert sum(p(h, w) for w in c1) + p(h, "never seen") == pytest.approx(1)


def test_no_training_documents_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = K.score(df, K.fit(df, F.lit(True)), F.lit(True)).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in got)
    assert K.katz_query(df.limit(0)).collect() == []


def test_discounts():
    d = K.discounts(np.array([0, 100, 40, 20, 12, 8, 6], float))
    assert d[0] == 1 and all(0 < x < 1 for x in d[1:])
    assert list(K.discounts(np.zeros(7))) == [1] * 6


def test_stored_tables_and_split_histories(spark):
    """One word is half of all tokens: its bigrams are dealt over partitions, the tables hold
    every training bigram once, and no partition has over twice the mean."""
    rng = random.Random(3)
    rows = [(i, " ".join(x for _ in range(40) for x in ("the", f"w{rng.randint(0, 400)}"))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = K.fit(df, F.lit(False), partition_bytes=3000)
    m, parts = tables.model, []
    assert int(K.hashed([b"the"])[0]) in m.hot.tolist()
    want = Counter()
    for _, t in rows:
        w = [*t.split(), None]
        want.update(zip(["<s>", *w[:-1]], w))
    name = {int(K.hashed([w.encode()])[0]): w for p in want for w in p if w and w != "<s>"} | {int(K.START): "<s>", int(K.END): None}
    found = Counter()
    for r in tables.bigrams.collect():
        p = K.Part(r["payload"], m)
        for h, w, c in zip(p.h[p.key >> 32], p.w[p.at], p.count):
            assert (name[int(h)], name[int(w)]) not in found
            found[name[int(h)], name[int(w)]] = c
        parts.append(p.count.sum())
    assert found == want
    assert max(parts) <= 2 * sum(parts) / m.parts
    total = sum(c for (h, _), c in want.items() if h == "the")
    mass = sum(K.kept(np.array([c]), m.discount)[0] for (h, _), c in want.items() if h == "the")
    at = m.hot.tolist().index(int(K.hashed([b"the"])[0]))
    assert m.hot_below[at] == total and 0 < mass < total


def test_long_texts_cut_into_pieces():
    text = b"one  two\tthree " * 50
    for size in (1, 7, 64, 10**6):
        got = list(K.pieces(text, size))
        assert all(got) and [w for p in got for w in p] == [*text.split(), b""]
    assert list(K.pieces(None)) == [[b""]]
