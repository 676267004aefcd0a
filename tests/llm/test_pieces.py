import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import pieces as P

needs_model = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")
TEXTS = ["", None, " ", "Hello  world\nfoo 123 x ", "naïve café 😀😀 \t tab", "a" * 300, "   lead", "▁x y", "日本語のテキスト", "Thntblere of then, edtioner", "x", "------------------------------", "é́‍", "the " * 500]


@needs_model
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeinortstéß .,-01\n\t 日😀"), max_size=60))
def test_fold_is_the_library(text):
    import sentencepiece

    lib = _cache.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=P.MODEL))
    p = _cache.setdefault("p", P.Pieces.load())
    assert [i for u in P.units(text, p) for i in p.fold(u)] == lib.encode(text)
    assert [i for u in P.units(text, p) for x in p.split(u) for i in p.fold(x)] == lib.encode(text)
    assert all(p._merged(u) == p._merged_short(u) for u in P.units(text, p))


_cache: dict = {}


@needs_model
def test_query(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in P.pieces_query(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == (None if t is None else lib.encode(t))
        assert got[i]["round_trip"] is True
    p = P.Pieces.load()
    back = P.decode(P.encode(df.select("doc_id", "text"), p, known={}), p).collect()
    assert all(r["decoded"] == (r["text"] and r["text"].replace(P.SPACE, " ")) for r in back)


def brute_path(unit, table, lowest):
    best = {0: (0.0, [])}
    for j in range(1, len(unit) + 1):
        options = []
        for i in range(j):
            s = table.get(unit[i:j], (0, None))[1]
            if s is None and i == j - 1:
                s = lowest
            if s is not None:
                options.append((best[i][0] + s, [*best[i][1], unit[i:j]]))
        best[j] = max(options, key=lambda x: x[0])
    return best[len(unit)][0]


def test_relational_folds(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} - {"c"}
    scores = [-float(i + 1) for i in range(len(words))]
    rng.shuffle(scores)
    rows = [("<unk>", 0.0, 2), *((w, s, 1) for w, s in zip(sorted(words), scores))]
    units = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in set(units)], "unit string")
    for kind in (P._UNIGRAM, P._BPE):
        p = P.Pieces(rows, kind)
        got = {r["unit"]: r["segments"] for r in P.fold_units(df, p).collect()}
        for u in set(units):
            assert "".join(got[u]) == u
            if kind == P._BPE:
                assert got[u] == p._merged(u)
            else:
                lowest = min(scores) - 10
                total = sum(p.table.get(s, (0, lowest))[1] for s in got[u])
                assert total == pytest.approx(brute_path(u, p.table, lowest)) and got[u] == p._best_path(u)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    p = P.Pieces([("<unk>", 0.0, 2), ("a", -1.0, 1)], P._BPE)
    assert P.encode(df, p).collect() == []


def test_clashing_columns_and_empty_table(spark):
    m = P.Pieces.load(P.MODEL)
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, ids int")
    try:
        P.encode(df, m)
    except ValueError as e:
        assert "ids" in str(e)
    else:
        raise AssertionError("a clash must be an error")
    assert P.pieces_query(df.limit(0)).collect() == []
