"""Media columns: lossless WAV storage, short-time Fourier transform, peak-pair fingerprints.

A payload of bytes is stored as the samples of an 8-bit mono WAV, read back with the
``wave`` module, cut into overlapping Hann frames, transformed, and reduced to pairs of
spectral peaks: ``(t, code)`` with the frame number and the packed (bin, bin, lag).

Defined results: a null or empty text is the empty payload and is stored as one block of
padding; equal payloads give equal values on any partitioning because every row is
transformed on its own; constant (silent) stretches give no peaks; other input columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import sliced

BLOCK, HOP, RATE = 576, 288, 8000
PEAKS, ZONE = 2, 2
#: Frames that are transformed at a time.
FRAMES = 4096
MIN_MAGNITUDE = 16.0
_WINDOW = np.hanning(BLOCK).astype(np.float32)


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``block``."""
    return payload + b"\xff" * (max(1, -(-len(payload) // block)) * block - len(payload))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV holding exactly these samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1:
            raise ValueError("8-bit samples expected")
        return w.readframes(w.getnframes())


def spectrum(samples: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Magnitudes, frames x bins, of Hann frames of BLOCK samples every HOP; of ``count``
    frames from ``first`` on, or of all."""
    part = samples[first * HOP :] if count is None else samples[first * HOP : (first + count - 1) * HOP + BLOCK]
    x = np.frombuffer(part, np.uint8).astype(np.float32) - 128.0
    if len(x) < BLOCK:
        return np.zeros((0, BLOCK // 2 + 1), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::HOP]
    frames = (frames - frames.mean(axis=1, keepdims=True)) * _WINDOW
    return np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)


def strongest(samples: bytes, peaks: int = PEAKS, at_once: int = FRAMES) -> np.ndarray:
    """The bins, frames x peaks, of each frame's strongest peaks, -1 where there is none.

    Frames are transformed ``at_once`` at a time, so a long text holds one block's spectrum.
    """
    n = max(0, (len(samples) - BLOCK) // HOP + 1)
    bins = np.full((n, peaks), -1, np.int32)
    for i in range(0, n, at_once):
        m = np.rint(spectrum(samples, i, min(at_once, n - i)))
        core = np.where((m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] >= m[:, 2:]) & (m[:, 1:-1] >= MIN_MAGNITUDE), m[:, 1:-1], -1)
        rows = np.arange(len(core))
        for k in range(peaks):
            best = core.argmax(axis=1)
            bins[i : i + len(core), k] = np.where(core[rows, best] > 0, best + 1, -1)
            core[rows, best] = -1
    return bins


def fingerprint(samples: bytes, peaks: int = PEAKS, zone: int = ZONE) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of all peak pairs, in time order.

    A peak is a bin above both neighbours; the ``peaks`` strongest of a frame are paired
    with each other and with those of the next ``zone`` frames.  Magnitudes are rounded first, ties go to the
    lower bin.  code = lag << 18 | first bin << 9 | second bin.
    """
    bins, none = strongest(samples, peaks), np.zeros(0, np.int32)
    n = len(bins)
    if not n:
        return none, none
    times, codes = [], []
    for lag in range(zone + 1):
        first, second = bins[: max(0, n - lag)], bins[lag:]
        both = (first[:, :, None] >= 0) & (second[:, None, :] >= 0)
        if not lag:  # inside a frame each pair once, the stronger peak first
            both &= np.triu(np.ones((peaks, peaks), bool), 1)
        t, i, j = np.nonzero(both)
        times.append(t)
        codes.append(lag << 18 | first[t, i] << 9 | second[t, j] if len(t) else none)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, payload_len, media): every whole text stored as a WAV in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            payloads = [x or b"" for x in b.column(len(keep)).to_pylist()]
            media = pa.array([to_wav(pad(x)) for x in payloads], pa.binary())
            sizes = pa.array([len(x) for x in payloads], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), sizes, media], [*keep, "payload_len", "media"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_payload"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, payload_len long, media binary")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames int, fingerprint array<struct<t:int,code:int>>"
)


def features(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "payload_len"), media: str = "media") -> DataFrame:
    """Reads the stored bytes back and adds checksums and the time-coded fingerprint."""
    pair = pa.struct([("t", pa.int32()), ("code", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list] = [[] for _ in range(6)]
            ts, cs, ends = [], [], [0]
            for m in b.column(len(keep)).to_pylist():
                s = from_wav(m)
                t, c = fingerprint(s)
                ts.append(t)
                cs.append(c)
                ends.append(ends[-1] + len(t))
                row = (len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-32:]), len(m), hashlib.sha256(m).hexdigest(), max(0, (len(s) - BLOCK) // HOP + 1))
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32()) for x in (ts, cs)], fields=list(pair))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            prints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            names = [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "fingerprint"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols, prints], names)

    rows = stored.select(*keep, media)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, {FEATURES}")


def media_query(docs: DataFrame) -> DataFrame:
    """Per document the stored form's checks and its fingerprint as ``t:code`` text."""
    x = features(store(docs))
    feature = F.array_join(F.transform("fingerprint", lambda p: F.concat_ws(":", p["t"].cast("string"), p["code"].cast("string"))), ",")
    return x.select(
        "doc_id", F.col("payload_len").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32",
        "media_bytes", "media_sha256", feature.alias("feature"), "n_frames",
    )
