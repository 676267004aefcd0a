import os
import re

import pytest

import corpus_pipeline as C
from paperlake.llm import mixing, pieces


def rows():
    base = "The quick brown fox jumps over the lazy dog while many other animals of the forest look on and wonder what this is about today"
    out = [(i, f"{base} number {i} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(40)), "en", "a" if i % 3 else "b", 10) for i in range(30)]
    out += [(100 + i, out[3][1], "en", "a", 10) for i in range(5)] + [(7, out[7][1], "en", "a", 10)]
    return [*out, (200, None, "en", "a", 0), (201, "12345 !!", "en", None, 3), (202, "write to jo@example.com or call +1 (743) 555-3824 about the dog", "en", "b", 5)]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
def test_stages(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "source_mixing", "sentence_pieces"]
    seen = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, "").cache()
        seen.append([r.asDict() for r in docs.collect()])
        if name != "sentence_pieces":
            assert tuple(docs.columns) == C.COLUMNS
    langs, unique, clean, mixed, encoded = seen
    assert {r["doc_id"] for r in langs} == {r[0] for r in rows()} - {200, 201}
    ids = [r["doc_id"] for r in unique]
    assert len(ids) == len(set(ids)) and not {100, 101, 102, 103, 104} & set(ids) and {3, 7, 202} <= set(ids)
    assert len(clean) == len(unique) and [r["text"] for r in clean if r["doc_id"] == 202] == ["write to <EMAIL> or call <PHONE> about the dog"]
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sources = {}
    for r in clean:
        sources[r["source"]] = sources.get(r["source"], 0) + size(r["text"])
    want = mixing.targets(list(sources.items()))
    for s, w in want.items():
        taken = sum(size(r["text"]) for r in mixed if r["source"] == s)
        assert w - max(size(r["text"]) for r in clean) <= taken <= w + 1
    assert len(encoded) == len(mixed) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in encoded)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
