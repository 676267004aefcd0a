import random
import re
from collections import Counter, defaultdict

import pytest

from paperlake.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top):
    """One term and one pair at a time, from the contract, in Python's whole numbers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    order = lambda x: sorted(x, key=lambda r: (-r[1], r[0].encode()))
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        mass = {s: sum(count[lang, s][t] for t in kept) + 5 * v for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // mass[s] for t in kept} for s in sources}
        whole = sum(m - 5 * v for m in mass.values()) + 5 * v
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // whole for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            found = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", item, value, k) for k, (item, value) in enumerate(order(pairs), 1)]
            out += [(lang, s, "term", item, value, k) for k, (item, value) in enumerate(order(found)[:top], 1)]
    return sorted(out)


def sample(n, seed=3):
    rng = random.Random(seed)
    common = ["The", "of", "ünd", "Ça", "x", "été"]
    out = []
    for i in range(n):
        source = rng.choice([None, "", *(f"s{k}" for k in range(9)), "ß"])
        own = [f"w{chr(97 + k)}" for k in range(rng.randint(0, 20))] + [f"only{source}", "pair" + str(source)[:1]]
        words = rng.choices(common + own, k=rng.choice([0, 1, 30]))
        out.append((i, rng.choice([" ", ", ", "1"]).join(words), rng.choice(["en", "en", "en", "de", None]), source))
    return [*out, (900, None, "en", "s1"), (901, "1 2 3", "xx", "a"), (902, "few words", "xx", "b"), (903, "The The", "en", "last"), (903, "The The", "en", "last"), (904, "long " * 30_000, "de", "s1")]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in D.divergence(df, **kw).collect())


@pytest.mark.parametrize("heavy, tile, block", [(6, 512, 256), (0, 4, 3), (3, 5, 4), (100, 8, 5), (2, 2, 100)])
def test_equals_brute_force_however_terms_are_split(spark, heavy, tile, block):
    rows = sample(400)
    assert run(spark, rows, min_docs=4, top=5, heavy=heavy, tile=tile, block=block) == brute(rows, 4, 5)


def test_partial_counts_may_be_passed_on_at_any_size(spark):
    rows = sample(60)
    df = spark.createDataFrame(rows, SCHEMA)
    all_at_once, often = (sorted(map(tuple, D.term_counts(df, held=h).collect()), key=repr) for h in (10**6, 3))
    assert all_at_once == often


def test_no_kept_terms_one_source_and_no_rows(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, "d", "de", "x")]
    assert run(spark, rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert D.divergence_query(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_a_long_product(spark):
    df = spark.createDataFrame([(3 * 10**12, 7 * 10**12)], "n long, m long")
    assert df.select(D._share("n", "m")).first()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**12)


def test_further_columns(spark):
    df = spark.createDataFrame([(1, "a", "en", "x", "t", 5, 6)], SCHEMA + ", term string, n long, value long")
    assert D.divergence_query(df).collect() == []
