import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": kind == "card" and 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


piece = st.sampled_from(["a", "Z", "@", ".", "-", " ", "+", "1", "25", "255", "256", "(", ")", "é", "x@y.z", "1.2.3.4", "4465758382889437", "+1 (743) 555-3824", "😀", "%", "\n", "007"])


@settings(max_examples=600, deadline=None)
@given(st.lists(piece, max_size=40).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_text(text) == brute(text)


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.candidates(t)


def test_query(spark):
    rows = [
        (1, "mail me: jo.b@mail5.example.com or call +1 (743) 555-3824 now"),
        (2, "card 4465758382889437, server 10.1.2.3 version 1.2.3.999"),
        (3, None), (4, ""), (5, "nothing here 12 34"), (5, "nothing here 12 34"),
        (6, "é😀 a@b.c"), (7, "call 555-123-4567 or jo [at] mail [dot] com"),
    ] + [(100 + i, f"tel +1 (743) 555-38{i:02d} ip 1.2.3.{i + 240} card 446575838288{i + 1000}") for i in range(40)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = pii.pii_query(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(k + ":") for k in pii.KINDS]
    assert {r["spans"] for r in got if r["doc_id"] in (3, 4, 5)} == {""}


def test_labelers_that_agree_are_trusted():
    good, bad = ("phone", "base", 1, 1, 1, 0, 0, 1, 2), ("phone", "base", 1, -1, -1, 0, -1, -1, 2)
    model = pii.fit([(good, 90), (bad, 60), (("phone", "national", 0, 1, 1, 1, 0, 1, 2), 5)])
    assert model.reliability["phone"]["check"] > 0.9 and model.probability(good) > 0.9 and model.probability(bad) < 0.5


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a@b.c and 1.2.3.4", "x"), (2, None, "y")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.train(df)).collect()}
    assert got == {1: "<EMAIL> and <IP>", 2: None}
