import random
import zlib

from pyspark.sql import functions as F

from paperlake.llm import language as L

SYL = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro kru", "cc": "ñá ñé ñí ñó ñú"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def rows():
    rng = random.Random(2)
    out = [(i, text(rng, lang, rng.choice([3, 60, 300])), lang if rng.random() < 0.9 else None) for i, lang in enumerate(rng.choice(sorted(SYL)) for _ in range(240))]
    return [*out, (900, None, "aa"), (901, "", None), (902, "123 !! 456", "bb"), (903, "Ba.", "aa"), (None, text(rng, "cc", 50), "cc"), (903, "Ba.", "aa")]


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "score") for r in data], "doc_id long, text string, lang string, score string")
    got = L.language_query(df).collect()
    assert len(got) == len(data)
    truth = {r[0]: r[2] for r in data}
    hits = [(r["lang_pred"] == truth[r["doc_id"]]) for r in got if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(hits) > 30 and sum(hits) / len(hits) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0
        else:
            assert r["lang_pred"] in SYL and not r["rejected"]


def test_strangers_are_rejected(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = L.train(df, ~L.held_out())
    assert model.predict(["жш щю эй " * 100])[2][0]


def test_languages_of_short_texts_are_learnt(spark):
    rng = random.Random(7)
    draw = lambda syl, n: " ".join("".join(rng.choice(syl.split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    only, mixed = "wu wo wy wiq", "tsa tse tsi tso"
    data = [(i, text(rng, rng.choice(sorted(SYL)), 80), "aa") for i in range(120)]
    data = [(i, t, next(k for k in SYL if t.lower()[:2] in {x[:2] for x in SYL[k].split()})) for i, t, _ in data]
    data += [(1000 + i, draw(only, rng.randint(6, 12)), "short") for i in range(80)]  # never 200 characters
    data += [(2000 + i, draw(mixed, 90 if i == 0 else rng.randint(6, 12)), "mixed") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = L.train(df, ~L.held_out(), max_train=30)  # six rows of each language
    assert model.labels == ["aa", "bb", "cc", "mixed", "short"]
    got = {r["doc_id"]: r for r in L.language_query(df).collect()}
    for lang, first in (("short", 1000), ("mixed", 2000)):
        own = [got[i] for i, _, name in data if name == lang and got[i]["held_out"] and i >= first]
        assert len(own) > 10 and all(r["lang_pred"] == lang and not r["rejected"] for r in own)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in L.language_query(df).collect()] == ["und"]
    assert L.language_query(df.limit(0)).collect() == []


def test_one_id_for_all_rows(spark):
    """Null and repeated ids have one hash of the id: the sample stays bounded and even."""
    rng = random.Random(3)
    for one in (None, 7):
        data = [(one, text(rng, lang, 80), lang) for lang in sorted(SYL) for _ in range(150)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        model = L.train(df, F.lit(True), max_train=30)
        assert model.labels == sorted(SYL)
        right = [model.predict([t])[0][0] == lang for _, t, lang in data]
        assert sum(right) > 0.95 * len(right)


def test_very_long_texts(spark):
    rng = random.Random(5)
    data = [(i, text(rng, lang, 60_000 if i == 0 else 80), lang) for i, lang in enumerate(sorted(SYL) * 20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_query(df).collect()}
    assert got == {i: lang for i, _, lang in data}


def test_labels_of_repeated_rows_are_learnt(spark):
    rng = random.Random(5)
    one = {lang: text(rng, lang, 90) for lang in ("aa", "bb")}
    data = [(None, t, lang) for lang, t in one.items() for _ in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for _ in range(3):
        one["aa"] += " " + text(rng, "aa", 1)
        again = df.withColumn("text", F.when(F.col("lang") == "aa", one["aa"]).otherwise(F.col("text")))
        assert L.train(again, ~L.held_out()).labels == ["aa", "bb"]


def test_an_empty_table(spark):
    assert L.language_query(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
