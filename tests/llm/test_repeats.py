import hashlib
import random
from collections import Counter

from pyspark import cloudpickle

from paperlake.llm import repeats as R


def brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    out = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 900, "ab" * 300, "ab" * 300]
    for _ in range(60):
        parts = [prose(rng.randint(5, 80)) for _ in range(3)]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, 80)
            parts.insert(rng.randint(0, 3), s[a : a + rng.randint(150, 400)])
        out.append(" ".join(parts))
    base = prose(300)
    for _ in range(40):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [out[20], out[20] + "!", base]
    return out


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r["doc_id"]: r for r in R.repeats_query(df).collect()}
    for i, want in enumerate(brute(texts, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


def test_spans_and_kept_bytes(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in R.strip_repeats(df).collect():
        data, spans = (texts[r["doc_id"]] or "").encode(), [tuple(s) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        gone = {i for a, b in spans for i in range(a, b)}
        assert bytes(r["kept"]) == bytes(c for i, c in enumerate(data) if i not in gone)


def test_other_lengths_and_repeated_rows(spark):
    texts = corpus()[8:40]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[0]), *((100 + i, t) for i, t in enumerate(texts[1:]))], "doc_id long, text string")
    got = R.remove_repeats(df, length=50, gram=8).collect()
    want = Counter(brute([texts[0], texts[0], *texts[1:]], 50))
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_frequent_grams_are_counted_by_string(spark):
    line = "one very common line of a good fifty bytes, as it is."
    texts = corpus()
    texts += [f"{t[:150]} {line} {t[-150:]}" for t in texts[8:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (0, 10):  # all grams, and the frequent ones alone
        got = {r["doc_id"]: tuple(r)[1:] for r in R.remove_repeats(df, group_rows=least).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_pieces_of_long_texts(monkeypatch):
    data = " ".join(corpus()[8:60]).encode()
    whole = R.anchors(data)
    monkeypatch.setattr(R, "_PIECE", 1000)
    parts = R.anchors(data)
    cover = lambda x: {i: a for a, s, e in zip(*(v.tolist() for v in x[1:])) for i in range(s, e + 1)}
    assert cover(whole) == cover(parts) and len(cover(whole)) == len(data) - 199


def test_cuts_between_pieces_remove_nothing(spark, monkeypatch):
    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (5000, 7321, 3000)]
    texts += [texts[0][700:2300] + texts[1][:1500], texts[2]]
    monkeypatch.setattr(R, "_PIECE", 1000)
    cloudpickle.register_pickle_by_value(R)  # the workers see the small pieces too
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: tuple(r)[1:] for r in R.remove_repeats(df).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(R)
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_interval_tree():
    nodes = set(R.prefix_intervals([0, 2, 5, 5, 1]))
    assert {(5, 1, 3), (2, 0, 3), (1, 0, 4)} <= nodes


def test_empty(spark):
    assert R.repeats_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
