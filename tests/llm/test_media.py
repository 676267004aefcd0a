import hashlib
import zlib

import numpy as np

from paperlake.llm import media as M

TEXTS = [None, "", "a", "x" * 576, "y" * 577, "é😀" * 500, "Thntblere of then, edtioner in inea that esly " * 60, "same", "same"]


def test_round_trip_and_checks(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in M.media_query(df).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), n)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        media = M.to_wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[7]["feature"] == got[8]["feature"] and got[6]["feature"] and got[0]["feature"] == ""


def test_a_tone_peaks_at_its_bin():
    t = np.arange(M.BLOCK * 4)
    samples = (128 + 100 * np.sin(2 * np.pi * 40 * t / M.BLOCK)).astype(np.uint8).tobytes()
    times, codes = M.fingerprint(samples, peaks=1)
    assert set((codes >> 9) & 511) == {40} and set(codes & 511) == {40} and (np.diff(times) >= 0).all()


def test_empty(spark):
    assert M.media_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_are_transformed_in_blocks():
    import random

    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(M.BLOCK * 40))
    whole = M.strongest(data)
    assert len(whole) == 79
    for at_once in (1, 7, 78, 79, 500):
        assert (M.strongest(data, at_once=at_once) == whole).all()
    assert M.strongest(b"x").shape == (0, M.PEAKS)
