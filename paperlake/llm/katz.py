"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Bigrams back off to the unigram base, (c + 1) / (N + V + 1), whose unseen share belongs to
one unknown word.  Counts up to five are discounted by Good-Turing; a history without any
discounted mass reserves one count.  A history's backoff weight is its free mass over the
base probability of all words not seen after it, so every history sums to one.

``fit`` stores the model as tables in the shared folder, one row for each partition: ``words``
(counts of the words, by their hash), ``bigrams`` (counts by history, with the base counts
of the second words) and ``backoff`` (each history's weight and what its counts are divided
by).  ``score`` sends each document's bigrams to the partition of their history, which looks
them up: seen, or backed off to the word's base; a word whose base count is not there goes
on to its own partition of ``words``.  Partial sums return to the documents.

Scale: the number of partitions follows the input's bytes.  A history with more tokens than
half a partition's share is split by its second words, so no partition gets more than about
twice the mean; its sums are added up over its slices.  Texts are cut into pieces of bounded
size, so neither a task nor a message grows with a document.  Words are 64-bit hashes; the
``KNOWN`` most frequent travel as small numbers (a broadcast of bounded size), all others as
they are.  Rows find their sums by a digest of the rows that were read together: were they
read in another order after a lost executor, the run fails rather than mix up documents.

Defined results: a null or empty text is its end token; the end is a word, the start only a
history; unknown words score as the unknown word; without training documents every word is
unknown; repeated rows count each time; an empty table gives no rows; further columns of the
input are dropped, whatever their names; a null id is kept.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import cut_table, sliced

#: Counts above this are taken as they are.
DISCOUNTED = 5
#: Tokens that a task packs at a time, bytes of text for each partition of histories,
#: partitions of histories for each task and for each partition of words.
CHUNK, PARTITION_BYTES, PER_TASK, PER_WORDS = 1_000_000, 16_000_000, 1, 4
#: Most words that travel as numbers, bytes of a long text that are split into words at a
#: time, and documents whose sums a task gathers before it sends them on.
KNOWN, PIECE, GATHERED = 1 << 18, 1 << 22, 1_000_000
START, END = np.uint64(0x5A17D3C1B2E49F61), np.uint64(0xE3D9C5A7F1B08642)
_SPACE = re.compile(rb"[ \x09-\x0D]")


def put(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: planes of bytes, ascending numbers as differences."""
    out, z = [], zstandard.ZstdCompressor(level=1)
    for x in arrays:
        rising = x.dtype.kind == "u" and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.concatenate([x[:1], np.diff(x)]) if rising else np.ascontiguousarray(x)
        out.append((x.dtype.str, rising, z.compress(y.view(np.uint8).reshape(len(y), x.dtype.itemsize).T.tobytes())))
    return pickle.dumps(out, protocol=5)


def get(data: bytes) -> list[np.ndarray]:
    """The arrays that ``put`` made a value of."""
    out, z = [], zstandard.ZstdDecompressor()
    for kind, rising, raw in pickle.loads(data):
        dtype = np.dtype(kind)
        x = np.ascontiguousarray(np.frombuffer(z.decompress(raw), np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
        out.append(np.cumsum(x, dtype=dtype) if rising else x)
    return out


@dataclass
class Model:
    """What tasks need to know of the model beside its tables."""

    parts: int
    word_parts: int
    tasks: int
    chunk: int = CHUNK
    piece: int = PIECE
    #: Hashes and counts of the frequent words, by hash.
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    known_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Split histories, by hash, and the number of partitions of each.
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    slices: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Weight and divisor of each split history.
    hot_alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_below: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tokens: int = 0
    distinct: int = 0
    discount: np.ndarray = field(default_factory=lambda: np.ones(DISCOUNTED + 1))

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.distinct + 1)

    def place(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Partition of each bigram: by its history, and by its word if that is split."""
        part = part_of(h, self.parts)
        if len(self.hot):
            at, hit = find(self.hot, h)
            part = np.where(hit, (part + (w >> np.uint64(17)) % self.slices[at]) % np.uint64(self.parts), part)
        return part.astype(np.int64)

    def pack(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes as numbers of known words and the other hashes."""
        at, hit = find(self.known, w)
        return at[hit].astype(np.uint32), w[~hit]

    def unpack(self, ids: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([self.known[ids], rest]))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the upper bits: ascending hashes are in order of partition."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def find(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the ascending array, and whether it is there."""
    if not len(among):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return at, among[at] == x


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; b'' is the end."""
    out = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[[i for i, w in enumerate(words) if not w]] = END
    return out


def pieces(data: bytes | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text with its end, in pieces of bounded size; none is empty."""
    data, at = data or b"", 0
    while len(data) - at > size and (gap := _SPACE.search(data, at + size)):
        if words := data[at : gap.start()].lower().split():
            yield words
        at = gap.start()
    yield [*(data[at:] if at else data).lower().split(), b""]


class _Ids(dict):
    """Local numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Token numbers of some texts or pieces of texts, and their packed bigrams.

    ``docs`` has a row (key, id, held out, tokens) for each; pieces of a text share the key.
    """

    def __init__(self) -> None:
        self.ids = _Ids()
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.before: list[bytes | None] = []
        self.size = 0

    def add(self, key: int, row_id: object, held_out: bool, words: list[bytes], before: bytes | None) -> None:
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.docs.append((key, row_id, held_out, len(words)))
        self.before.append(before)
        self.size += len(words)

    def messages(self, model: Model, spots: bool) -> Iterator[tuple[int, bytes]]:
        """(partition, packed bigrams): histories with the number of their words, words, each
        bigram's word, how often it is there and, on demand, in which documents."""
        lengths = np.array([len(t) for t in self.tokens])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        w = np.concatenate(self.tokens)
        self.tokens.clear()
        first = np.array([-1 if b is None else self.ids[b] for b in self.before], np.int32)
        every = np.append(hashed(list(self.ids)), START)
        by_hash = np.argsort(every)
        rank = np.empty(len(every), np.int64)
        rank[by_hash] = np.arange(len(every))
        every = every[by_hash]
        h = np.empty(len(w), np.int32)
        h[1:] = w[:-1]
        h[starts] = first  # -1 is the start's place
        key = rank[h] << 32 | rank[w]
        del h, w
        if spots:
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)[order]
            doc = doc.astype(np.uint16) if len(lengths) < 1 << 16 else doc
            del order
        else:
            key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(at, len(key))).astype(np.uint32)
        hr, wr = key[at] >> 32, key[at] & 0xFFFFFFFF
        del key
        part = model.place(every[hr], every[wr])
        order = np.argsort(part, kind="stable")
        hr, wr, times, at = hr[order], wr[order], times[order], at[order]
        ends = np.cumsum(times, dtype=np.int64)
        if spots:
            doc = doc[np.repeat(at - (ends - times), times) + np.arange(len(doc))]
        cuts = np.searchsorted(part[order], np.arange(model.parts + 1))
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            a, b = cuts[p], cuts[p + 1]
            hk, hn = np.unique(hr[a:b], return_counts=True)
            wk, wi = np.unique(wr[a:b], return_inverse=True)
            more = [doc[ends[a] - times[a] : ends[b - 1]]] if spots else []
            yield int(p), put(*model.pack(every[hk]), hn.astype(np.uint32), *model.pack(every[wk]), wi.astype(np.uint32), times[a:b], *more)


def opened(data: bytes, model: Model) -> tuple[np.ndarray, ...]:
    """Histories, number of each one's words, words, each bigram's word, times, documents."""
    hi, hx, hn, wi, wx, *more = get(data)
    return model.unpack(hi, hx), hn, model.unpack(wi, wx), *more


def _texts(docs: DataFrame, held: Column, row_id: str, text: str) -> DataFrame:
    return docs.select(F.col(row_id).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).cast("binary").alias("data"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in sliced(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)], schema)


_MESSAGE = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
_STATS = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64()))])
_ASK = pa.schema([("part", pa.int32()), ("asker", pa.int32()), ("payload", pa.binary())])
_SUMS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), ("payload", pa.binary())])


def count_words(docs: DataFrame, held: Column, model: Model, row_id: str, text: str) -> DataFrame:
    """The table ``words``: (part, payload, stats) with ascending hashes and their counts;
    stats are tokens, distinct words, training documents, then words of 2^i to 2^(i+1) - 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            h = hashed(list(seen))
            order = np.argsort(h)
            h, c = h[order], np.fromiter(seen.values(), np.uint64, len(seen))[order]
            cuts = np.searchsorted(part_of(h, model.word_parts), np.arange(model.word_parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
                s = slice(cuts[p], cuts[p + 1])
                yield _batch([(int(p), put(h[s], c[s]))], _MESSAGE)
            seen.clear()

        for _, is_held, data in _rows(batches):
            for words in pieces(data, model.piece) if not is_held else ():
                seen.update(words)
                if len(seen) > model.chunk // 3:
                    yield from out()
        if seen:
            yield from out()

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        got = [get(x) for x in rows["payload"].to_pylist()]
        h, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x[1] for x in got])).astype(np.int64)
        ends = int(c[find(h, np.array([END]))[0][0]]) if find(h, np.array([END]))[1][0] else 0
        return _table([(int(key[0].as_py()), put(h, c), [int(c.sum()), len(h), ends, *np.bincount(np.log2(c).astype(int), minlength=64).tolist()])], _STATS)

    packed = _texts(docs, held, row_id, text).mapInArrow(scan, "part int, payload binary").repartition(max(1, model.word_parts), "part")
    return cut_table(packed.groupBy("part").applyInArrow(add, "part int, payload binary, stats array<long>"), "words")


def frequent(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words counted at least so often."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (data,) in _rows(batches):
            h, c = get(data)
            yield _batch([(0, put(h[c >= least], c[c >= least]))], _MESSAGE)

    got = [get(r[0]) for r in words.select("payload").mapInArrow(pick, "part int, payload binary").select("payload").collect()]
    h, c = (np.concatenate([np.zeros(0, k), *(g[i] for g in got)]) for i, k in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(h)
    return h[order], c[order]


def discounts(n: np.ndarray, k: int = DISCOUNTED) -> np.ndarray:
    """Share of a count r that stays, for r = 0..k, from the numbers n[r] of bigrams seen r
    times; absolute discounting where Good-Turing's terms do not lie between 0 and 1."""
    d = np.ones(k + 1)
    if n[1] > 0:
        a = (k + 1) * n[k + 1] / n[1]
        terms = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < t <= 1 for t in terms):
            d[1:] = terms
        else:
            cut = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2])))
            d[1:] = [(r - cut) / r for r in range(1, k + 1)]
    return d


def kept(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What the discounts leave of each count."""
    return np.where(count < len(d), d[np.minimum(count, len(d) - 1)] * count, count)


def weights(total: np.ndarray, mass: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and divisor of histories, from their counts, what the discounts leave of
    them, and the base probability of the words seen after them."""
    below = np.where(total - mass < 1e-9 * total, total + 1, total)  # reserves one count
    return (1 - mass / below) / np.maximum(1 - seen, 1e-300), below


def count_bigrams(docs: DataFrame, held: Column, model: Model, words: DataFrame, row_id: str, text: str) -> DataFrame:
    """The table ``bigrams``: (part, payload, stats); stats are the numbers of bigrams seen
    0, 1, ... times, up to one more than are discounted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for _, is_held, data in _rows(batches):
            before = None
            for words_ in pieces(data, model.piece) if not is_held else ():
                chunk.add(0, None, False, words_, before)
                before = words_[-1]
                if chunk.size >= model.chunk:
                    yield from (_batch([m], _MESSAGE) for m in chunk.messages(model, spots=False))
                    chunk = Chunk()
        if chunk.docs:
            yield from (_batch([m], _MESSAGE) for m in chunk.messages(model, spots=False))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        """The partition's words that are not known, for their partitions."""
        w = np.unique(np.concatenate([get(x)[4] for x in rows["payload"].to_pylist()]))
        cuts = np.searchsorted(part_of(w, model.word_parts), np.arange(model.word_parts + 1, dtype=np.uint64))
        return _table([(int(q), int(key[0].as_py()), put(w[cuts[q] : cuts[q + 1]])) for q in np.flatnonzero(cuts[1:] > cuts[:-1])], _ASK)

    def answer(own: pa.Table, asks: pa.Table) -> pa.Table:
        """Their counts."""
        if not own.num_rows:
            return _table([], _MESSAGE)
        h, c = get(own["payload"][0].as_py())
        return _table([(who, put(w := get(x)[0], c[find(h, w)[0]].astype(np.uint64))) for who, x in zip(asks["asker"].to_pylist(), asks["payload"].to_pylist(), strict=True)], _MESSAGE)

    def merge(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        """All of the partition's bigrams with their counts."""
        rows = [opened(x, model) for x in own["payload"].to_pylist()]
        hs, ws = np.unique(np.concatenate([r[0] for r in rows])), np.unique(np.concatenate([r[2] for r in rows]))
        keys = np.concatenate([np.repeat(np.searchsorted(hs, r[0]), r[1]) << 32 | np.searchsorted(ws, r[2])[r[3]] for r in rows])
        times = np.concatenate([r[4] for r in rows])
        del rows
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.add.reduceat(times[order], at, dtype=np.uint64)
        keys = keys[at]
        answers = [get(x) for x in told["payload"].to_pylist()]
        rest, c = (np.concatenate([np.zeros(0, np.uint64), *(a[i] for a in answers)]) for i in (0, 1))
        c = c[np.argsort(rest)]
        payload = put(*model.pack(hs), np.bincount(keys >> 32, minlength=len(hs)).astype(np.uint32), *model.pack(ws), (keys & 0xFFFFFFFF).astype(np.uint32), count, c)
        return _table([(int(key[0].as_py()), payload, np.bincount(np.minimum(count, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tolist())], _STATS)

    # used twice as it is, so that the plan has one scan and one exchange of it
    packed = _texts(docs, held, row_id, text).mapInArrow(scan, "part int, payload binary").repartition(model.tasks, "part")
    asked = packed.groupBy("part").applyInArrow(ask, "part int, asker int, payload binary")
    told = words.select("part", "payload").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "part int, payload binary")
    merged = packed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(merge, "part int, payload binary, stats array<long>")
    return cut_table(merged, "bigrams")


class Part:
    """A partition's bigrams: ``h`` and ``w`` are ascending hashes, ``key`` joins their places."""

    def __init__(self, data: bytes, model: Model) -> None:
        hi, hx, self.number, wi, wx, at, count, base = get(data)
        self.h, self.w = model.unpack(hi, hx), model.unpack(wi, wx)
        self.key = np.repeat(np.arange(len(self.h)), self.number) << 32 | at
        self.count, self.at = count.astype(np.int64), at
        self.base = np.empty(len(self.w), np.int64)
        known = find(model.known, self.w)
        self.base[known[1]] = model.known_counts[known[0][known[1]]]
        self.base[~known[1]] = base


def find_backoff(bigrams: DataFrame, model: Model) -> DataFrame:
    """The table ``backoff``: (part, payload, slices), weight and divisor of each history in
    the order of ``bigrams``; slices are what a split history's sums are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _rows(batches):
            p = Part(data, model)
            g = np.repeat(np.arange(len(p.h)), p.number)
            sums = [np.bincount(g, x) for x in (p.count, kept(p.count, model.discount), model.base(p.base)[p.at])]
            hot = find(model.hot, p.h)
            slices = [{"hot": int(at), "total": t, "mass": m, "seen": s} for at, hit, t, m, s in zip(*hot, *sums, strict=True) if hit]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([put(*weights(*sums))], pa.binary()), pa.array([slices], pa.list_(pa.struct([("hot", pa.int64()), ("total", pa.float64()), ("mass", pa.float64()), ("seen", pa.float64())])))], ["part", "payload", "slices"])

    kind = "part int, payload binary, slices array<struct<hot:long,total:double,mass:double,seen:double>>"
    return cut_table(bigrams.select("part", "payload").mapInArrow(run, kind), "backoff")


@dataclass
class Tables:
    """A stored model."""

    model: Model
    words: DataFrame
    bigrams: DataFrame
    backoff: DataFrame


def fit(docs: DataFrame, held: Column, row_id: str = "doc_id", text: str = "text", partition_bytes: int = PARTITION_BYTES, known: int = KNOWN, chunk: int = CHUNK, piece: int = PIECE) -> Tables:
    """Learns from the documents for which ``held`` does not hold."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(4, math.ceil(size / partition_bytes))
    model = Model(parts, max(2, parts // PER_WORDS), max(4, parts // PER_TASK), chunk, piece)
    words = count_words(docs, held, model, row_id, text)
    sums = [F.coalesce(F.sum(F.element_at("stats", i + 1)), F.lit(0)).cast("long") for i in range(67)]
    model.tokens, model.distinct, texts, *powers = words.agg(F.array(*sums).alias("s")).first()["s"]
    # the lowest power of two that as many words reach as may be known
    reach = next(i for i in range(64) if sum(powers[i:]) <= known)
    model.known, model.known_counts = frequent(words, 1 << reach)
    share = max(1.0, model.tokens / parts)
    h, c = frequent(words, math.ceil(share / 2))
    stays = h != END  # no history
    hot = dict(zip(h[stays].tolist(), c[stays].tolist(), strict=True)) | ({int(START): texts} if texts >= share / 2 else {})
    model.hot = np.array(sorted(hot), np.uint64)
    model.slices = np.array([min(parts, math.ceil(2 * hot[x] / share)) for x in sorted(hot)], np.uint64)
    bigrams = count_bigrams(docs, held, model, words, row_id, text)
    n = bigrams.agg(F.array(*sums[: DISCOUNTED + 2]).alias("s")).first()["s"]
    model.discount = discounts(np.array(n, float))
    backoff = find_backoff(bigrams, model)
    # as many rows as split histories, at most two for each partition
    added = backoff.select(F.explode("slices").alias("s")).groupBy("s.hot").agg(*(F.sum(f"s.{x}").alias(x) for x in ("total", "mass", "seen")))
    model.hot_alpha, model.hot_below = np.ones(len(model.hot)), np.ones(len(model.hot))
    for r in added.collect():
        a, b = weights(*(np.array([r[x]]) for x in ("total", "mass", "seen")))
        model.hot_alpha[r["hot"]], model.hot_below[r["hot"]] = a[0], b[0]
    return Tables(model, words, bigrams, backoff)


def look_up(own: Part | None, weight: list[np.ndarray], model: Model, data: bytes) -> tuple[np.ndarray, ...]:
    """Of a message's bigrams: log10 probability (of those backed off without the base), words,
    each bigram's word, words' base counts (-1: not here), which are backed off, times, documents."""
    hs, hn, ws, wi, times, spots = opened(data, model)
    counts = np.full(len(ws), -1)
    at, hit = find(model.known, ws)
    counts[hit] = model.known_counts[at[hit]]
    g = np.repeat(np.arange(len(hs)), hn)
    alpha, below, c = np.ones(len(hs)), np.ones(len(hs)), np.zeros(len(wi), np.int64)
    if own is not None:
        at, hit = find(own.w, ws)
        counts[hit] = own.base[at[hit]]
        place, there = find(own.h, hs)
        alpha[there], below[there] = weight[0][place[there]], weight[1][place[there]]
        where, seen = find(own.key, place[g] << 32 | at[wi])
        c[seen] = own.count[where[seen]]
        c[~(there[g] & hit[wi])] = 0
    at, hit = find(model.hot, hs)
    alpha[hit], below[hit] = model.hot_alpha[at[hit]], model.hot_below[at[hit]]
    seen = c > 0
    value = np.log10(np.where(seen, kept(c, model.discount) / below[g], alpha[g]))
    return value, ws, wi, counts, ~seen, times, spots


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums for each block of all that a task has made of it."""
    held: dict[tuple, np.ndarray] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (part, block), sums in held.items():
            at = np.flatnonzero(sums.any(axis=0))
            yield _batch([(part, block, "s", put(at.astype(np.uint32), sums[0, at], sums[1, at], sums[2, at].astype(np.uint32)))], _SUMS)
        held.clear()

    for row in _rows(batches):
        part, block, kind, payload = row
        if kind != "s":
            yield _batch([row], _SUMS)
            continue
        at, *sums = get(payload)
        have = held.get((-1, block))
        if have is None or have.shape[1] <= int(at[-1]):
            more = np.zeros((3, int(at[-1]) + 1))
            if have is not None:
                more[:, : have.shape[1]] = have
                size -= have.shape[1]
            have = held[-1, block] = more
            size += more.shape[1]
        for i in range(3):
            have[i, at] += sums[i]
        if size > GATHERED:
            yield from flush()
            size = 0
    yield from flush()


def _sums(block: int, spots: np.ndarray, *values: np.ndarray) -> tuple:
    docs, at = np.unique(spots, return_inverse=True)
    return -1, block, "s", put(docs.astype(np.uint32), *(np.bincount(at, x) for x in values[:2]), np.bincount(at, values[2]).astype(np.uint32))


def score(docs: DataFrame, tables: Tables, held: Column, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    model, train_tokens = tables.model, tables.model.tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, number, n = TaskContext.get().partitionId(), Chunk(), 0, 0

        def out(c: Chunk, k: int) -> Iterator[pa.RecordBatch]:
            rows = pickle.dumps(c.docs, protocol=5)
            block = xxhash.xxh64_intdigest(rows, seed=task << 20 | k) >> 1
            yield _batch([(block % model.parts, block, "d", rows)], _SUMS)
            for p, data in c.messages(model, spots=True):
                yield _batch([(p, block, "b", data)], _SUMS)

        for row_id_, is_held, data in _rows(batches):
            before, n = None, n + 1
            for words in pieces(data, model.piece):
                chunk.add(task << 40 | n, row_id_, is_held, words, before)
                before = words[-1]
                if chunk.size >= model.chunk:
                    yield from out(chunk, number)
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield from out(chunk, number)

    def evaluate(own: pa.Table, stored: pa.Table) -> pa.Table:
        """Sums of the partition's bigrams, and the backed-off words whose base is elsewhere."""
        have = dict(zip(stored["kind"].to_pylist(), stored["payload"].to_pylist(), strict=True))
        part, weight = (Part(have["b"], model), get(have["a"])) if have else (None, [])
        out = []
        for block, kind, data in zip(*(own[c].to_pylist() for c in ("block", "kind", "payload")), strict=True):
            if kind == "d":
                out.append((-1, block, kind, data))
                continue
            value, ws, wi, counts, off, times, spots = look_up(part, weight, model, data)
            count = counts[wi]
            here, base = count >= 0, np.log10(model.base(np.maximum(count, 0)))
            each = np.repeat(np.arange(len(wi)), times)
            out.append(_sums(block, spots, (value + np.where(off & here, base, 0))[each], np.where(here, base, 0)[each], (count > 0)[each]))
            if not here.all():  # only words never seen after any of the partition's histories
                todo = np.flatnonzero(~here)
                todo = todo[np.argsort(wi[todo], kind="stable")]
                first = np.cumsum(times, dtype=np.int64) - times
                t = times[todo]
                picked = spots[np.repeat(first[todo] - (np.cumsum(t, dtype=np.int64) - t), t) + np.arange(int(t.sum()))]
                h = ws[wi[todo]]
                ends = np.cumsum(t, dtype=np.int64)
                cuts = np.searchsorted(part_of(h, model.word_parts), np.arange(model.word_parts + 1, dtype=np.uint64))
                for q in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    a, b = cuts[q], cuts[q + 1]
                    out.append((int(q), block, "w", put(h[a:b], t[a:b], picked[ends[a] - t[a] : ends[b - 1]])))
        return _table(out, _SUMS)

    def recur(own: pa.Table, asks: pa.Table) -> pa.Table:
        """Sums of backed-off words from their base counts."""
        h, c = get(own["payload"][0].as_py()) if own.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out = []
        for block, data in zip(asks["block"].to_pylist(), asks["payload"].to_pylist(), strict=True):
            w, times, spots = get(data)
            at, hit = find(h, w)
            count = np.where(hit, c[at], 0) if len(c) else np.zeros(len(w), np.int64)
            base = np.repeat(np.log10(model.base(count)), times)
            out.append(_sums(block, spots, base, base, np.repeat(count > 0, times)))
        return _table(out, _SUMS)

    kind = "part int, block long, kind string, payload binary"
    packed = _texts(docs, held, row_id, text).mapInArrow(scan, kind).repartition(model.tasks, "part")
    stored = tables.bigrams.select("part", F.lit("b").alias("kind"), "payload").unionByName(tables.backoff.select("part", F.lit("a").alias("kind"), "payload"))
    found = cut_table(packed.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(evaluate, kind).mapInArrow(_gather, kind), "sums")
    base = tables.words.select("part", "payload").groupBy("part").cogroup(found.filter("kind = 'w'").groupBy("part")).applyInArrow(recur, kind).mapInArrow(_gather, kind)
    partial = found.filter("kind != 'w'").unionByName(base).select("block", "kind", "payload")

    id_kind = docs.schema[row_id].dataType
    done = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("id", _arrow(id_kind))])

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        """The documents of a block with their sums."""
        named = [x for k, x in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True) if k == "d"]
        if len(named) != 1:
            raise ValueError("the documents came in another order when they were read again; give them as a written table")
        docs_ = pickle.loads(named[0])
        out = np.zeros((3, len(docs_)))
        for k, data in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
            if k == "s":
                at, *sums_ = get(data)
                for i in range(3):
                    out[i, at] += sums_[i]
        columns = [[d[0] for d in docs_], list(range(len(docs_))), [d[2] for d in docs_], [d[3] for d in docs_], out[2].astype(np.int64), out[1], out[0], [d[1] for d in docs_]]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, done, strict=True)], schema=done)

    blocks = partial.groupBy("block").applyInArrow(finish, f"key long, at long, held_out boolean, n_tokens long, n_known long, base_score double, score double, id {id_kind.simpleString()}")
    # the pieces of a long text lie in several blocks
    whole = blocks.groupBy("key").agg(F.first("id").alias(row_id), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known")), *(F.sum(c).alias(c) for c in ("base_score", "score")))
    return whole.select(row_id, "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _arrow(kind: object) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(row_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def katz_query(docs: DataFrame) -> DataFrame:
    """Every document's log10 probability, learnt from those not held out."""
    return score(docs, fit(docs, held_out()), held_out())
