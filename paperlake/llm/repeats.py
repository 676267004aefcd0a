"""Removal of repeated byte strings, by sparse suffix arrays over shared anchors.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else.  Any
two equal strings hold the same anchor, the k-gram of least hash (its minimizer), so only
suffixes that start at anchors are compared, bucket by bucket:

1. every document yields its anchors, each with the range of string starts that it stands
   for and a hash of its context, all bytes that those strings can reach;
2. anchors are grouped by k-gram; equal contexts repeat as a whole, without comparing;
   groups with several contexts send one of each for comparison;
3. in such a group the right contexts, sorted, are an enhanced suffix array: its common
   prefixes are scanned with a stack into the interval tree.  Each interval is a group of
   occurrences with a common right part; where their left extensions differ, the repeat is
   maximal, and sorting the left parts gives how far each occurrence shares its left with
   any other one, not just with neighbours in the array;
   a gram of more than ``GROUP_ROWS`` anchors is not held by one task: the strings of its
   distinct contexts are hashed one by one and counted by a combining aggregate, with the
   same result;
4. covered ranges meet the documents again, and what is left is hashed.

Matches never cross documents, overlaps count, and strings are judged on the input.

Defined results: a null text is empty; texts shorter than the length keep all bytes;
repeated rows are occurrences of their own, so their bytes go if long enough; an empty
table gives no rows.  Contexts, and the strings of grams beyond ``GROUP_ROWS``, count as
equal if both their k-gram's and their own 64-bit hash agree; all other comparisons are of
bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import cut_table, sliced

LENGTH, GRAM = 200, 32
#: Anchors of one gram whose contexts (some 600 bytes each) one task holds at most.
GROUP_ROWS = 65_536
_POSITION_BITS = 24
_PIECE = 1 << 22
_RANDOM = np.random.default_rng(20_240_229)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every gram (a power of two) of a uint8 array, by doubling."""
    h, step = _BYTES[data], 1
    for factor in _FACTORS[: gram.bit_length() - 1]:
        h = h[:-step] * factor + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor position, first start, last start) of each anchor in order.

    Long texts go piece by piece; the choice in a window depends on its bytes alone.  An
    anchor of strings on both sides of a cut is one anchor.
    """
    found: list[tuple[np.ndarray, ...]] = []
    keep = ~np.uint64((1 << _POSITION_BITS) - 1)
    for base in range(0, max(1, len(data) - length + 1), _PIECE):
        x = np.frombuffer(data[base : base + _PIECE + length - 1], np.uint8)
        if len(x) < length:
            continue
        h = gram_hashes(x, gram)
        best = _sliding_min((h & keep) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (best & ~keep).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        found.append((h[at[first]].view(np.int64), at[first] + base, first + base, last + base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[head], at[head], first[head], last[np.append(head[1:] - 1, len(at) - 1)]


def _context(data: bytes, a: int, length: int, gram: int) -> tuple[int, int]:
    """Reach of the strings that hold the gram at a."""
    return max(0, a - (length - gram)), min(len(data), a + length)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def prefix_intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the interval tree's nodes, inner ones first, by a stack scan.

    ``prefixes[i]`` is what suffixes i-1 and i of the sorted array have in common.
    """
    stack = [(0, 0)]
    for i in range(1, len(prefixes) + 1):
        now, first = (prefixes[i] if i < len(prefixes) else -1), i - 1
        while stack and now < stack[-1][0]:
            value, first = stack.pop()
            yield value, first, i - 1
        if not stack or now > stack[-1][0]:
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Repeat groups of one k-gram's occurrences: (left, right, members, shared lefts).

    ``rights`` are sorted, ``lefts`` reversed.  A group's occurrences share ``right`` bytes
    from the anchor on and ``left`` before it; it is given only if their left extensions
    then differ, and if some pair shares ``least`` bytes in all.  The last list holds how
    far each member shares its left with any other member.
    """
    prefixes = [0, *(common_prefix(rights[i - 1], rights[i]) for i in range(1, len(rights)))]
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = [0] * len(lefts)
    for r, i in enumerate(by_left):
        rank[i] = r
    for right, first, last in prefix_intervals(prefixes):
        if first == last or not right:
            continue
        members = sorted(range(first, last + 1), key=rank.__getitem__) if last - first + 1 < len(lefts) else by_left
        shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        reach = [max(x, y) for x, y in zip([0, *shared], [*shared, 0])]
        if max(reach) + right >= least:
            yield min(shared), right, members, reach


def anchor_table(docs: DataFrame, uid: str = "uid", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(gram, context, uid, at, first, last, more): every anchor of every whole text.

    Anchors of equal gram and context that a task reads together are one row, with the
    others' (uid, first, last) in ``more``: copies, common passages and periodic stretches
    are gathered before the shuffle.
    """
    span = pa.struct([("uid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            texts: dict[bytes, list[int]] = {}
            for u, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None and len(data) >= length:
                    texts.setdefault(data, []).append(u)
            for data, uids in texts.items():
                h, a, s, e = anchors(data, length, gram)
                reach = [(x, *_context(data, x, length, gram)) for x in a.tolist()]
                ctx = np.array([xxhash.xxh64_intdigest(data[lo:hi], x - lo) for x, lo, hi in reach], np.uint64).view(np.int64)
                for u in uids:
                    for col, v in zip(cols, (h, ctx, np.full(len(a), u, np.int64), a, s, e), strict=True):
                        col.append(v)
            if not cols[0]:
                continue
            rows = [np.concatenate(c) for c in cols]
            order = np.lexsort((rows[1], rows[0]))
            rows = [r[order] for r in rows]
            head = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            size = np.diff(np.append(np.flatnonzero(head), len(head)))
            rest = pa.StructArray.from_arrays([pa.array(rows[i][~head]) for i in (2, 4, 5)], fields=list(span))
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]), pa.int32()), rest, mask=pa.array(size == 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(r[head]) for r in rows), more], ["gram", "context", "uid", "at", "first", "last", "more"])

    rows = docs.select(uid, F.col(text).cast("binary").alias("_data"))
    return rows.mapInArrow(run, "gram long, context long, uid long, at long, first long, last long, more array<struct<uid:bigint,first:bigint,last:bigint>>")


def _contexts(docs: DataFrame, asked: DataFrame, uid: str, text: str, length: int, gram: int) -> DataFrame:
    """(gram, right, left, uid, at, first, last) of the asked anchors, lefts reversed."""
    wanted = asked.groupBy("uid").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("asks"))
    rows = docs.select(F.col(uid).alias("uid"), F.col(text).cast("binary").alias("data")).join(wanted, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            out: list[list] = [[] for _ in range(7)]
            for u, data, asks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for x in asks:
                    lo, hi = _context(data, x["at"], length, gram)
                    for col, v in zip(out, (x["gram"], data[x["at"] : hi], data[lo : x["at"]][::-1], u, x["at"], x["first"], x["last"]), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gram", "right", "left", "uid", "at", "first", "last"])

    return rows.mapInArrow(run, "gram long, right binary, left binary, uid long, at long, first long, last long")


def _group_ranges(group: list[tuple], length: int) -> Iterator[tuple[int, int, int]]:
    """(uid, first, last) string starts that repeat, of one k-gram's distinct contexts."""
    rights, lefts = [g[1] for g in group], [g[2] for g in group]
    for _, right, members, reach in maximal_repeats(lefts, rights, length):
        for i, left in zip(members, reach, strict=True):
            if left + right >= length:
                _, _, _, uid, at, first, last = group[i]
                lo, hi = max(first, at - left), min(last, at + right - length)
                if lo <= hi:
                    yield uid, lo, hi


def compared(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, first, last): repeated string starts inside groups of several contexts.

    Each task reads its suffixes in sorted order and holds one k-gram's group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["uid", "first", "last"])

        for b in sliced(batches, 4096):
            rows: list[tuple] = []
            for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if group and group[0][0] != r[0]:
                    rows += _group_ranges(group, length)
                    group = []
                group.append(r)
            yield made(rows)
        yield made(list(_group_ranges(group, length)) if group else [])

    return contexts.repartition("gram").sortWithinPartitions("gram", "right", "left").mapInArrow(run, "uid long, first long, last long")


def counted(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, first, last) as from ``compared``, for contexts of grams too frequent for a task.

    Every string that a context stands for is a row by its hash, at most length - gram + 1
    of them; those counted twice or more repeat.  No task holds a gram's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            cols: list[list[int]] = [[] for _ in range(4)]
            for gram, right, left, uid, at, first, last in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                data, base = left[::-1] + right, at - len(left)
                for start in range(first, last + 1):
                    mark = xxhash.xxh64_intdigest(data[start - base : start - base + length]) - (1 << 63)
                    for col, v in zip(cols, (gram, mark, uid, start), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gram", "mark", "uid", "start"])

    strings = cut_table(contexts.mapInArrow(run, "gram long, mark long, uid long, start long"), "strings")
    often = strings.groupBy("gram", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "mark")
    return strings.join(often, ["gram", "mark"]).select("uid", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_starts(docs: DataFrame, uid: str = "uid", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(uid, first, last): ranges of starts of strings that start elsewhere too."""
    table = anchor_table(docs, uid, text, length, gram)
    same = Window.partitionBy("gram").orderBy("context")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag("context").over(same), F.lead("context").over(same)
    x = table.select("*", before.alias("before"), after.alias("after"), (F.first("context").over(whole) != F.last("context").over(whole)).alias("several"),
                     (F.count(F.lit(1)).over(whole) > group_rows).alias("hot"))
    twin = F.col("more").isNotNull() | F.col("before").eqNullSafe(F.col("context")) | F.col("after").eqNullSafe(F.col("context"))
    x = x.filter("before is not null or after is not null or more is not null").select(
        "gram", "uid", "more", "at", "first", "last", twin.alias("twin"), (F.col("several") & ~F.col("before").eqNullSafe(F.col("context"))).alias("ask"), "hot")
    x = cut_table(x, "anchors")
    none = F.array().cast("array<struct<uid:bigint,first:bigint,last:bigint>>")
    twins = x.filter("twin").select(F.explode(F.concat(F.array(F.struct("uid", "first", "last")), F.coalesce("more", none))).alias("s")).select("s.*")
    found = twins.select("uid", "first", "last").unionByName(compared(_contexts(docs, x.filter("ask and not hot"), uid, text, length, gram), length))
    hot = x.filter("ask and hot")
    return found if hot.isEmpty() else found.unionByName(counted(_contexts(docs, hot, uid, text, length, gram), length))


def _runs(ranges: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the bytes that ranges of starts cover."""
    runs: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges):
        end = last + length
        if not runs or first > runs[-1][1]:
            runs.append((first, end))
        elif end > runs[-1][1]:
            runs[-1] = runs[-1][0], end
    return runs


def strip_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row_id, n_bytes, spans, kept): each document's removed runs of bytes, as an array of
    (start, end), end exclusive, and the bytes that are left."""
    marked = docs.select(F.col(row_id).alias("row_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(row_id, text).alias("uid"))
    found = repeated_starts(marked, "uid", "text", length, gram, group_rows)
    ranges = found.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    rows = marked.select("row_id", F.col("text").cast("binary").alias("data"), "uid").join(ranges, "uid", "left").select("row_id", "data", "ranges")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, spans, kept = [], [], []
            for data, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = _runs(found or [], length)
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(b"".join(data[i:j] for i, j in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True)))
            cols = [pa.array(sizes, pa.int64()), pa.array(spans, run_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [row_id, "n_bytes", "spans", "kept"])

    kind = docs.schema[row_id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{row_id}` {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def remove_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    x = strip_repeats(docs, row_id, text, length, gram, group_rows)
    return x.select(row_id, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def repeats_query(docs: DataFrame) -> DataFrame:
    """What 200-byte repeat removal leaves of every document."""
    return remove_repeats(docs)
