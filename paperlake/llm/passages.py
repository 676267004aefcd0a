"""Near-duplicate passages by compact windows over token min-hashes.

For one hash function, the Cartesian tree of a document's shingle hashes groups its
subsequences: all that lie in a node's span and hold the node share its minimum, so one
compact window (left, centre, right) stands for them.  Nodes of span at least ``least`` are
exactly the minima of some stretch of ``least`` shingles, which finds them without building
the rest of the tree.

Windows of all documents are grouped by their minimum.  Equal contexts in a group are equal
passages and need no pairs: each is tied to the first of its class, and the documents so
tied form provisional classes.  Where different contexts meet, every one is a candidate, also
in one provisional class, for its documents may have a near passage besides the equal one:
one shared minimum is enough.  Candidates are verified on their shingles: similarity is
Jaccard over a stretch of ``least`` shingles.  Small groups are compared pair by pair.  In a
larger one a context meets those that hold one of the rarest places of its stretches, enough
of them that no similar context can lack them all, so lines that thousands of documents
share pair nothing; it stops when each of its stretches has a similar one and no other class
is left, so near copies are not all compared with each other.

Two stretches of similarity s have no minimum in common, and are lost, with probability
(1 - s) ** functions: 0.15 % at 0.8 with four functions and 0.01 % at 0.9.

Defined results: a null text is empty; documents with fewer than ``least`` shingles have no
passage; a passage repeated only inside one document is not counted; repeated rows are one
document; documents without a shared passage are their own class; an empty table gives no
rows.  Each distinct context goes to one task per group once, copies do not.  Spans are those
of equal contexts and of all stretches that are similar to one of another document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import components, cut, cut_table, sliced

SHINGLE, LEAST, SIMILARITY = 5, 46, 0.8
FUNCTIONS = 4
_REMEMBERED = 150_000
_SEEDS = np.random.default_rng(57).integers(0, 1 << 63, 16, dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
#: Shingles whose windows are found at a time, centres that look around at a time, and bytes
#: of a long text that are split into words at a time.
_SHINGLES, _AT_ONCE, _PIECE = 500_000, 16_384, 1 << 22
#: Contexts of a group whose pairs are all compared, pairs compared at a time, and in a larger
#: group neighbours on a side, rows and others of a row compared at a time, and bytes of a table
#: of what rows hold.
_SMALL, _PAIRS, _NEAR, _ROWS, _TABLE = 100, 4096, 8, 256, 1 << 24
_SPACE = re.compile(rb"[ \x09-\x0D]")


class _Words(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the lower-cased words; a long text is split into words piece by piece."""
    out, at = [], 0
    while at < len(data):
        gap = _SPACE.search(data, at + _PIECE) if len(data) - at > _PIECE else None
        end = gap.start() if gap else len(data)
        words = (data[at:end] if at or gap else data).lower().split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if len(out) != 1 else out[0] if out else np.zeros(0, np.uint64)


def shingle_hashes(data: bytes, known: dict[bytes, int], n: int = SHINGLE) -> np.ndarray:
    """Hash of every n-word shingle of lower-cased words."""
    w = word_hashes(data, known) if data else np.zeros(0, np.uint64)
    if len(w) < n:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        x = x * _BASE + w[i : len(w) - n + 1 + i]
    return _mix(x)


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0, 1, ... n modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def contexts_of(s: np.ndarray, left: np.ndarray, right: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Hash of the shingles left..right, inclusive, and of the centre's place among them.

    The sum of each shingle's hash times a power of an odd base, from sums of all before.
    """
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * _powers(len(s), _ODD)[:-1], dtype=np.uint64)])
    x = (sums[right + 1] - sums[left]) * _powers(len(s), pow(_ODD, -1, 1 << 64))[left]
    return _mix(x ^ _mix(((right - left).astype(np.uint64) << np.uint64(32)) | (centre - left).astype(np.uint64)))


def compact_windows(v: np.ndarray, least: int, lengths: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(centre, left, right) of the Cartesian trees' nodes of span at least ``least``.

    ``v`` has the values of several sequences, one after the other, of the given lengths;
    each has its own tree.  ``left`` and ``right``, inclusive, bound the node's span as far
    as stretches of ``least`` around the centre reach; of equal values the first is the
    smaller one, and values are told apart by their upper 40 bits.
    """
    lengths = np.array([len(v)]) if lengths is None else lengths
    none = np.zeros(0, np.int64)
    if len(v) < least:
        return none, none, none
    stop = np.repeat(np.cumsum(lengths), lengths)
    start = stop - np.repeat(lengths, lengths)
    # the place in the low bits makes values distinct: of equal ones the first is smaller
    top = v & ~_PLACE
    code = top | np.arange(len(v), dtype=np.uint64) if len(v) <= int(_PLACE) else np.argsort(np.argsort(top, kind="stable"), kind="stable").astype(np.uint64)
    low, have = code, 1
    while have * 2 <= least:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if rest := least - have:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    low = low[np.arange(len(low)) + least <= stop[: len(low)]]
    if not len(low):
        return none, none, none
    lows = low[np.concatenate([[True], low[1:] != low[:-1]])]
    centre = (lows & _PLACE).astype(np.int64) if len(v) <= int(_PLACE) else np.argsort(top, kind="stable")[lows.astype(np.int64)]
    reach = np.arange(1, least)
    left, right = np.empty(len(centre), np.int64), np.empty(len(centre), np.int64)
    for i in range(0, len(centre), _AT_ONCE):
        c, own = centre[i : i + _AT_ONCE, None], lows[i : i + _AT_ONCE, None]
        for side, out in ((-1, left), (1, right)):
            at = c + side * reach
            smaller = (at < start[c]) | (at >= stop[c])
            np.clip(at, 0, len(v) - 1, out=at)
            smaller |= code[at] < own
            out[i : i + _AT_ONCE] = c[:, 0] + side * np.where(smaller.any(axis=1), smaller.argmax(axis=1), least - 1)
    return centre, left, right


def window_table(docs: DataFrame, uid: str = "uid", text: str = "text", n: int = SHINGLE, least: int = LEAST, functions: int = FUNCTIONS) -> DataFrame:
    """(low, context, uid, fn, left, right, most, more): every document's compact windows.

    Windows of equal minimum and context that a task reads together are one row, that of the
    least document; ``most`` is the greatest, and ``more`` has the others' (uid, left, right).
    """
    span = pa.struct([("uid", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])

    def windows(texts: list[tuple[int, int, int, int, np.ndarray]]) -> pa.RecordBatch | None:
        """Of pieces of texts (uid, place of the piece, own part's start and stop, hashes)."""
        lengths = np.array([len(t[4]) for t in texts])
        s = np.concatenate([t[4] for t in texts])
        begin = np.cumsum(lengths) - lengths
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for f in range(functions):
            v = _mix(s ^ _SEEDS[f])
            c, lo, hi = compact_windows(v, least, lengths)
            piece = np.searchsorted(begin, c, side="right") - 1
            uids, places, starts, stops = (np.array([t[i] for t in texts], np.int64)[piece] for i in range(4))
            off = places - begin[piece]
            own = (c + off >= starts) & (c + off < stops)
            c, lo, hi, off, uids = c[own], lo[own], hi[own], off[own], uids[own]
            new = (v[c].view(np.int64), contexts_of(s, lo, hi, c).view(np.int64), uids, np.full(len(c), f, np.int32), (lo + off).astype(np.int32), (hi + off).astype(np.int32))
            for col, x in zip(cols, new, strict=True):
                col.append(x)
        rows = [np.concatenate(c) for c in cols]
        if not len(rows[0]):
            return None
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = [r[order] for r in rows]
        head = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, len(head)))
        rest = pa.StructArray.from_arrays([pa.array(rows[i][~head]) for i in (2, 4, 5)], fields=list(span))
        more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]), pa.int32()), rest, mask=pa.array(size == 1))
        return pa.RecordBatch.from_arrays([*(pa.array(r[head]) for r in rows), pa.array(rows[2][starts + size - 1]), more], ["low", "context", "uid", "fn", "left", "right", "most", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts, size = _Words(), [], 0
        for b in sliced(batches, 256):
            for u, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_hashes(data or b"", known, n)
                # a piece's neighbours reach as far as its windows do
                for a in range(0, len(s) if len(s) >= least else 0, _SHINGLES):
                    first = max(0, a - least + 1)
                    texts.append((u, first, a, a + _SHINGLES, s[first : a + _SHINGLES + least - 1]))
                    size += len(texts[-1][4])
                    if size >= _SHINGLES:
                        if (out := windows(texts)) is not None:
                            yield out
                        texts, size = [], 0
        if texts and (out := windows(texts)) is not None:
            yield out

    rows = docs.select(uid, F.col(text).cast("binary").alias("_data"))
    return rows.mapInArrow(run, "low long, context long, uid long, fn int, left int, right int, most long, more array<struct<uid:bigint,left:int,right:int>>")


def shared_windows(table: DataFrame) -> DataFrame:
    """Windows whose minimum other documents have too: with ``first``, the least document of
    the same context, ``twin`` if that context is in several, ``several`` if the group has
    different contexts, and ``ask`` on one window of each context, and on every window of
    a context that only one document has."""
    group = Window.partitionBy("low")
    whole = group.orderBy("context", "uid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cls = Window.partitionBy("low", "context").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = table.select(
        "*", F.first("uid").over(cls).alias("first"), F.max("most").over(cls).alias("last"), F.row_number().over(Window.partitionBy("low", "context").orderBy("uid")).alias("row"),
        F.min("uid").over(whole).alias("u0"), F.max("most").over(whole).alias("u1"), (F.first("context").over(whole) != F.last("context").over(whole)).alias("several"))
    x = x.filter("u0 != u1")
    once = F.col("several") & (F.col("first") == F.col("last"))
    own = F.array(F.struct("uid", "left", "right", (once | (F.col("several") & (F.col("row") == 1))).alias("ask")))
    others = F.transform("more", lambda m: F.struct(m["uid"].alias("uid"), m["left"].alias("left"), m["right"].alias("right"), once.alias("ask")))
    each = F.explode(F.concat(own, F.coalesce(others, F.array().cast("array<struct<uid:bigint,left:int,right:int,ask:boolean>>"))))
    x = x.select("low", "context", "fn", "first", (F.col("first") != F.col("last")).alias("twin"), "several", each.alias("w"))
    return x.select("low", "context", "w.uid", "fn", "w.left", "w.right", "first", "twin", "several", "w.ask")


def _contexts(docs: DataFrame, shared: DataFrame, roots: DataFrame, uid: str, text: str, n: int) -> DataFrame:
    """(low, uid, root, left, twin, shingles) of the windows to verify."""
    asked = shared.filter("ask").groupBy("uid").agg(F.collect_list(F.struct("low", "left", "right", "twin")).alias("windows")).join(roots, "uid")
    rows = docs.select(F.col(uid).alias("uid"), F.col(text).cast("binary").alias("data")).join(asked, "uid").select("uid", "root", "data", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in sliced(batches, 128):
            out: list[list] = [[] for _ in range(6)]
            for u, root, data, windows in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s = (shingle_hashes(data, known, n) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for w in windows:
                    for col, v in zip(out, (w["low"], u, root, w["left"], w["twin"], s[w["left"] : w["right"] + 1].tobytes()), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["low", "uid", "root", "left", "twin", "shingles"])

    return rows.mapInArrow(run, "low long, uid long, root long, left int, twin boolean, shingles binary")


def best_stretch(x: list[int], other: set[int], least: int) -> tuple[int, int, int]:
    """(shared shingles, first, last start) of the best stretches of ``least`` in x."""
    total = [0, *accumulate(s in other for s in x)]
    counts = [total[i + least] - total[i] for i in range(len(x) - least + 1)]
    best = max(counts, default=0)
    return best, counts.index(best) if counts else 0, len(counts) - 1 - counts[::-1].index(best) if counts else 0


def _needed(least: int, similarity: float) -> float:
    """Shared shingles of two stretches that make their Jaccard similarity."""
    return 2 * least * similarity / (1 + similarity)


def _padded(rows: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat rows as a matrix, and which of its places are theirs."""
    own = np.arange(width) < lengths[:, None]
    out = np.zeros(own.shape, np.int64)
    out[own] = rows
    return out, own


def _stretches(hit: np.ndarray, lengths: np.ndarray, least: int, need: int) -> np.ndarray:
    """Which stretches of ``least`` places, by start, have ``need`` hits inside the row."""
    total = np.zeros((len(hit), hit.shape[1] + 1), np.int8 if hit.shape[1] < 1 << 7 else np.int64)
    np.cumsum(hit, axis=1, dtype=total.dtype, out=total[:, 1:])
    good = total[:, least:] - total[:, :-least] >= need
    return good & (np.arange(good.shape[1]) <= lengths[:, None] - least)


def _ends(good: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of the first and last place of the last stretch of each row."""
    return good.argmax(axis=1), good.shape[1] - 2 - good[:, ::-1].argmax(axis=1) + least


def _hopeful(ids: np.ndarray, n: int, lengths: np.ndarray, uid: np.ndarray, twin: np.ndarray, least: int, need: int) -> np.ndarray:
    """Which rows have a stretch of whose places ``need`` are in rows of other documents."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    one, several, equal = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    one[ids] = row  # some row that has the shingle
    several[ids[one[ids] != row]] = True
    equal[ids[twin[row]]] = True
    owner = uid[one]
    other = equal
    other[ids[owner[ids] != uid[row]]] = True
    hit, _ = _padded((other & several)[ids], lengths, max(int(lengths.max()), least))
    return _stretches(hit, lengths, least, need).any(axis=1)


def _small(which: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, own: np.ndarray, lengths: np.ndarray, distinct: np.ndarray, apart: Callable, least: int, need: int) -> Iterator[tuple]:
    """Similar pairs (i, j, their ends) of the small groups, all pairs of many groups at once."""
    group = np.repeat(which, size[which])
    rows = np.repeat(start[which] - np.cumsum(size[which]) + size[which], size[which]) + np.arange(len(group))
    at = np.zeros(len(lengths), np.int64)  # where the row's table of the group's shingles begins
    at[rows] = np.cumsum(distinct[group]) - distinct[group]
    table = np.zeros(int(distinct[group].sum()) if len(group) else 0, bool)
    r, c = np.nonzero(own[rows])
    table[at[rows[r]] + ids[rows[r], c]] = True
    later = start[group] + size[group] - 1 - rows
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    keep = apart(i, j)
    i, j = i[keep], j[keep]
    look = lambda x, y: _stretches(table[at[y][:, None] + ids[x]] & own[x], lengths[x], least, need)
    for k in range(0, len(i), _PAIRS):
        a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
        good = look(a, b)
        some = good.any(axis=1)
        a, b, good = a[some], b[some], good[some]
        back = look(b, a)
        some = back.any(axis=1)
        if some.any():
            yield a[some], b[some], *_ends(good[some], least), *_ends(back[some], least)


def _held(ids: np.ndarray, lengths: np.ndarray, distinct: int, x: np.ndarray, y: np.ndarray, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have a stretch of row ``x`` of whose places ``need`` are in row ``y``, and those stretches.

    ``ids`` has ``distinct`` where a row has no place.
    """
    order = np.argsort(y, kind="stable")
    rows, at = np.unique(y[order], return_inverse=True)
    which, goods = [order[:0]], [np.zeros((0, ids.shape[1] - least + 1), bool)]
    step = max(1, _TABLE // (distinct + 1))
    for t in range(0, len(rows), step):
        some = rows[t : t + step]
        table = np.zeros((len(some), distinct + 1), bool)
        table[np.arange(len(some))[:, None], ids[some]] = True
        table[:, distinct] = False
        table = table.ravel()
        begin, end = np.searchsorted(at, (t, t + step))
        for k in range(begin, end, _PAIRS):
            pair = order[k : min(k + _PAIRS, end)]
            hit = table[((at[k : k + len(pair)] - t) * (distinct + 1))[:, None] + ids[x[pair]]]
            good = _stretches(hit, lengths[x[pair]], least, need)
            has = good.any(axis=1)
            which.append(pair[has])
            goods.append(good[has])
    return np.concatenate(which), np.concatenate(goods)


def _large(first: int, n: int, ids: np.ndarray, own: np.ndarray, lengths: np.ndarray, distinct: int, root: np.ndarray, twin: np.ndarray, apart: Callable, least: int, need: int) -> Iterator[tuple]:
    """Similar pairs (i, j, their ends) of one large group, as many as give every link between
    classes and every similar stretch of a row.

    Rows are compared with their neighbours, and then with the rows that hold one of the
    ``least - need + 1`` rarest places of a stretch that no similar row has covered yet: a
    similar row cannot lack all of those.  At last the rows of all classes but the largest
    are compared with the rows of other classes that hold one of those of any stretch.
    """
    lengths = lengths[first : first + n]
    width = int(lengths.max())
    own = own[first : first + n, :width]
    ids = np.where(own, ids[first : first + n, :width], distinct)
    r, c = np.nonzero(own)
    pairs = np.unique(ids[r, c] * n + r)  # (shingle, row)
    bounds = np.searchsorted(pairs, np.arange(distinct + 1) * n)
    often, holders = np.diff(bounds), pairs % n
    label = np.unique(root[first : first + n], return_inverse=True)[1]
    covered = np.arange(width - least + 1) > lengths[:, None] - least  # stretches beyond the row's end count as covered
    covered[twin[first : first + n]] = True  # equal contexts have their span already
    missing = least - need + 1
    found: list[tuple] = []

    def look(i: int, of: np.ndarray) -> np.ndarray:
        """Rows that can be similar to one of these stretches of row i."""
        views = np.lib.stride_tricks.sliding_window_view(ids[i, : lengths[i]], least)[of[: lengths[i] - least + 1]]
        rare = np.take_along_axis(views, np.argpartition(often[views], missing - 1, axis=1)[:, :missing], axis=1)
        out = np.zeros(n, bool)
        for v in np.unique(rare).tolist():
            out[holders[bounds[v] : bounds[v + 1]]] = True
        out[i] = False
        out = np.flatnonzero(out)
        return out[apart(first + i, first + out)]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Keeps the similar ones of the pairs, the stretches they cover and the classes they join."""
        which, back = _held(ids, lengths, distinct, j, i, least, need)
        i, j = i[which], j[which]
        which, good = _held(ids, lengths, distinct, i, j, least, need)
        i, j, back = i[which], j[which], back[which]
        if not len(i):
            return
        found.append((first + i, first + j, *_ends(good, least), *_ends(back, least)))
        for row, stretches in ((i, good), (j, back)):
            order = np.argsort(row, kind="stable")
            rows, at = np.unique(row[order], return_index=True)
            covered[rows] |= np.logical_or.reduceat(stretches[order], at, axis=0)
        for k in np.unique(label[i] * n + label[j], return_index=True)[1].tolist():
            if label[i[k]] != label[j[k]]:
                label[label == label[j[k]]] = label[i[k]]

    def by_turns(rows: list[int], others: list[np.ndarray], left: Callable) -> None:
        """Compares rows with others, a growing number at a time, until nothing is left to find."""
        at, size = 0, _NEAR
        while rows:
            part = [left(i, o[at : at + size]) for i, o in zip(rows, others, strict=True)]
            compare(np.repeat(rows, [len(p) for p in part]), np.concatenate(part))
            at, size = at + size, min(2 * size, _ROWS)
            on = [k for k, o in enumerate(others) if len(o) > at]
            rows, others = [rows[k] for k in on], [others[k] for k in on]

    for d in range(1, _NEAR + 1):
        open_ = ~covered.all(axis=1)
        i = np.flatnonzero((open_[:-d] | open_[d:] | (label[:-d] != label[d:])) & apart(first + np.arange(n - d), first + np.arange(d, n)))
        compare(i, i + d)
    rows = np.flatnonzero(~covered.all(axis=1))
    for k in range(0, len(rows), _ROWS):
        some = [i for i in rows[k : k + _ROWS].tolist() if not covered[i].all()]
        by_turns(some, [look(i, ~covered[i]) for i in some], lambda i, o: o[:0] if covered[i].all() else o)
    large = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    rows, done = np.flatnonzero(label != label[large]), np.zeros(n, bool)
    for k in range(0, len(rows), _ROWS):
        # pairs within the largest class are tied, and those of a row that is done were compared in its turn
        some = [i for i in rows[k : k + _ROWS].tolist() if label[i] != label[large]]
        every = np.ones(covered.shape[1], bool)
        others = [look(i, every) for i in some]
        by_turns(some, [o[(label[o] != label[i]) & ~done[o]] for i, o in zip(some, others, strict=True)], lambda i, o: o[:0] if label[i] == label[large] else o[label[o] != label[i]])
        done[some] = True
    yield from found


def similar_contexts(group: np.ndarray, uid: np.ndarray, root: np.ndarray, twin: np.ndarray, left: np.ndarray, shingles: list[bytes], least: int, similarity: float) -> list[np.ndarray]:
    """uid, other uid, first, last shingle of what is similar in the groups (0, 1, ... ascending).

    Every context that is similar to one of another document has a row with all its similar
    stretches, which overlap, as one span; two classes (roots) that have a similar pair have
    a row as well.  ``twin``: contexts that several documents have.
    """
    need = math.ceil(_needed(least, similarity) - 1e-9)
    lengths = np.array([len(x) // 4 for x in shingles], np.int64)
    flat = np.frombuffer(b"".join(shingles), np.uint32)
    keys = (np.repeat(group, lengths).astype(np.uint64) << np.uint64(32)) | flat
    while len(group):  # without those of which no stretch can be similar to any other context
        values, ids = np.unique(keys, return_inverse=True)
        hope = _hopeful(ids, len(values), lengths, uid, twin, least, need)
        if hope.all():
            break
        keys = keys[np.repeat(hope, lengths)]
        group, uid, root, twin, left, lengths = (x[hope] for x in (group, uid, root, twin, left, lengths))
    if not len(group):
        return [np.zeros(0, np.int64)] * 4
    n_groups = int(group[-1]) + 1
    distinct = np.bincount((values >> np.uint64(32)).astype(np.int64), minlength=n_groups)
    ids = ids - np.repeat((np.cumsum(distinct) - distinct)[group], lengths)
    ids, own = _padded(ids, lengths, max(int(lengths.max()), least))
    size = np.bincount(group, minlength=n_groups)
    start = np.cumsum(size) - size
    apart = lambda i, j: (uid[i] != uid[j]) | twin[i] | twin[j]
    found = list(_small(np.flatnonzero((size > 1) & (size <= _SMALL)), start, size, ids, own, lengths, distinct, apart, least, need))
    for g in np.flatnonzero(size > _SMALL).tolist():
        found += _large(int(start[g]), int(size[g]), ids, own, lengths, int(distinct[g]), root, twin, apart, least, need)
    if not found:
        return [np.zeros(0, np.int64)] * 4
    i, j, a, b, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
    i, j, a, b = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([a, c]), np.concatenate([b, d])
    low, high, other = np.full(len(uid), 1 << 60), np.full(len(uid), -1), np.full(len(uid), (1 << 63) - 1)
    np.minimum.at(low, i, a)
    np.maximum.at(high, i, b)
    np.minimum.at(other, i, uid[j])
    rows = np.flatnonzero(high >= 0)
    across = np.flatnonzero(root[i] < root[j])
    across = across[np.unique(np.stack([group[i[across]], root[i[across]], root[j[across]]]), axis=1, return_index=True)[1]] if len(across) else across
    i, j = np.concatenate([rows, i[across]]), np.concatenate([other[rows], uid[j[across]]])
    return [uid[i], j, left[i] + low[i], left[i] + high[i]]


def group_links(members: list[tuple], least: int, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """(uid, other uid, first, last shingle) verified in one group of distinct contexts.

    ``members``: (uid, root, left, shingles).
    """
    uid, root, left = (np.array([m[k] for m in members], np.int64) for k in range(3))
    zero = np.zeros(len(members), np.int64)
    found = similar_contexts(zero, uid, root, zero.astype(bool), left, [m[3] for m in members], least, similarity) if len(members) > 1 else [zero[:0]] * 4
    yield from zip(*(x.tolist() for x in found), strict=True)


def verified(contexts: DataFrame, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, other, first, last) of the similar contexts of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            low, uid, root, left = (rows.column(k).to_numpy().astype(np.int64) for k in ("low", "uid", "root", "left"))
            group = np.cumsum(np.concatenate([[False], low[1:] != low[:-1]]))
            found = similar_contexts(group, uid, root, np.array(rows.column("twin").to_pylist(), bool), left, rows.column("shingles").to_pylist(), least, similarity)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["uid", "other", "first", "last"])

        # whole groups, many at a time
        for b in sliced(batches, 4096):
            low = b.column(0).to_numpy()
            held.append(b)
            if sum(map(len, held)) >= 4096 and low[-1] != held[0].column(0)[0].as_py():
                rows = pa.Table.from_batches(held)
                last = int(np.searchsorted(rows.column("low").to_numpy(), low[-1]))
                if last:
                    yield made(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held and sum(map(len, held)):
            yield made(pa.Table.from_batches(held))

    return contexts.repartition("low").sortWithinPartitions("low").mapInArrow(run, "uid long, other long, first long, last long")


def near_passages(docs: DataFrame, uid: str = "uid", text: str = "text", n: int = SHINGLE, least: int = LEAST, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """(uid, other, first, last): documents tied by a passage, with its shingles in ``uid``.

    Equal passages are tied to the first document that has them; ``other`` may be the
    document itself on that first one's own row.
    """
    shared = cut_table(shared_windows(window_table(docs, uid, text, n, least, functions)), "windows")
    twins = shared.filter("twin").select("uid", F.col("first").alias("other"), F.col("left").cast("long").alias("first"), F.col("right").cast("long").alias("last"))
    tied = twins.select(F.col("uid").alias("a"), F.col("other").alias("b")).filter("a != b")
    roots = cut(components(shared.select(F.col("uid").alias("node")).distinct(), tied).withColumnRenamed("node", "uid"))
    return twins.unionByName(verified(_contexts(docs, shared, roots, uid, text, n), least, similarity))


def passage_classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """(row_id, class_id, n_passages, n_words, passages) of every document.

    ``class_id`` is the smallest id reachable over shared passages; passages are runs of
    words ``start:end``, end exclusive, joined where they touch.
    """
    n = int(options.get("n", SHINGLE))
    marked = docs.select(F.col(row_id).alias("row_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(row_id, text).alias("uid"))
    found = cut_table(near_passages(marked, "uid", "text", **options), "passages")
    rows = marked.select("row_id", "uid")
    links = found.select(F.col("uid").alias("a"), F.col("other").alias("b")).filter("a != b")
    roots = components(rows.select(F.col("uid").alias("node")).distinct(), links).withColumnRenamed("node", "uid")
    # one span after the other, sorted, touching ones made one
    spans = found.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("last") + n).alias("b")))).alias("spans"))
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(s))))
    spans = spans.select("uid", joined.alias("spans"))
    named = rows.join(roots, "uid")
    least_id = named.groupBy("root").agg(F.min("row_id").alias("class_id"))
    runs = F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return named.join(least_id, "root").join(spans, "uid", "left").select(
        F.col("row_id").alias(row_id), "class_id", F.size(runs).cast("long").alias("n_passages"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"]).alias("n_words"),
        F.array_join(F.transform(runs, lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("passages"))


def passages_query(docs: DataFrame) -> DataFrame:
    """Every document's class by near-duplicate passages of at least fifty words."""
    return passage_classes(docs)
