import hashlib
import random
import zlib

import pytest

from paperlake.llm import manifest as M


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def framed(*fields):
    return "".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields)


def tree(nodes):
    """Levels of hexadecimal digests."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 8 : at - at % 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    """One row at a time, from the contract."""
    leaves = sorted(((lang, i, h(framed(i, s, lang, n, t)), (i, s, lang, n, t)) for i, s, lang, n, t in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    langs = list(dict.fromkeys(r[0] for r in leaves))
    own = {g: [r for r in leaves if r[0] == g] for g in langs}
    trees = {g: tree([r[2] for r in own[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, (_, i, leaf, (_, s, lang, n, t)) in enumerate(own[g]):
            steps = siblings(trees[g], at) + siblings(top, k)
            now = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None:
                now = h(framed(i, s, lang, n, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((i, leaf, trees[g][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), now, now == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], SCHEMA).repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in M.manifest_query(df, **kw).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def sample(n, langs, seed=1):
    rng = random.Random(seed)
    texts = ["Ab Cd", "", None, "é ÀZ", "lower only", "X" * 5000]
    return [(i * 3 - 50, rng.choice(["a", None, "ü", ""]), rng.choice(langs), rng.choice([None, 0, 7]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("block, top", [(8, 1), (8, 40), (64, 10), (4096, 1 << 15)])
def test_equals_the_tree_built_row_by_row(spark, block, top):
    rows = sample(700, ["en"] * 12 + ["de", "fr", None, "", "zz", "é"])
    rows += [(9999, "s", "one", 1, "alone")]
    got = check(spark, rows, block=block, top=top)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_more_groups_than_the_driver_takes(spark):
    rows = sample(400, [f"l{i}" for i in range(90)] + [None] + ["en"] * 60, 2)
    check(spark, rows, block=8, top=4)


def test_one_row_repeated_rows_and_null_ids(spark):
    assert check(spark, [(5, "s", "en", 2, "hi")])[0][1] == h(framed(5, "s", "en", 2, "hi"))
    check(spark, [(7, "s", "en", 2, "Hi")] * 100 + [(None, "s", "en", 2, "Hi")] * 9 + [(7, "s", None, 2, "Other")] * 9, block=8, top=3)


def test_no_rows_and_further_columns(spark):
    assert M.manifest_query(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "A", "en", "s", 1, "x", b"y")], SCHEMA + ", grp string, digest binary")
    assert [r["doc_id"] for r in M.manifest_query(df).collect()] == [1]


def test_a_block_is_a_power_of_the_fan(spark):
    with pytest.raises(ValueError):
        M.manifest(spark.createDataFrame([(1, "A", "en", "s", 1)], SCHEMA), block=100).collect()
