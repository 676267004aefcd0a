"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint takes the majority of each bit over the XXH64 of its word shingles.
Fingerprints within ``tau`` differing bits are linked; a component is what links reach.

Search: the 64 bits are grouped into m parts, correlated bits together.  If thresholds
t_1..t_m with sum(t_i + 1) = tau + 1 are given to the parts (-1: part unused), any two
fingerprints within tau agree on some part i up to t_i bits.  Number of parts and unequal
thresholds come from a dynamic programme on estimated probe and candidate counts; the
estimate (from a bounded sample of fingerprints) steers cost only, never the result.

Linking stays clear of all pairs inside a group: equal fingerprints are one node; members
of a part's bucket are first tied to the bucket's leader; then only pairs from different
components so far are compared, a bucket's largest component never with itself.

Defined results: a null text has no words; a text without words has fingerprint zero and
is linked like any other; repeated rows share a component; null ids are ignored when the
smallest id of a component is taken; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import components, cut, cut_table, sliced

SHINGLE, TAU, SEED = 4, 4, 42
#: Fingerprints in the sample that bit groups and thresholds are planned on.
PLAN_SAMPLE = 2048
#: Keys that a part may be probed with for each fingerprint.
MOST_PROBES = 4096


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes with A-Z lower-cased (bytes.split cuts at space, \\x09-\\x0D)."""
    return data.lower().split()


def shingles(data: bytes, n: int) -> list[bytes]:
    """Every n-word shingle, space-joined; the whole sequence if shorter."""
    w = words(data)
    if len(w) <= n:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return [joined[a:b] for a, b in zip(starts[: len(w) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(data: bytes, n: int = SHINGLE) -> bytes:
    """Eight bytes, most significant bit first."""
    hashes = [xxhash.xxh64_digest(s, SEED) for s in shingles(data, n)]
    if not hashes:
        return bytes(8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.frombuffer(b"".join(hashes[i : i + (1 << 16)]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, n: int = SHINGLE, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = b"".join(fingerprint(x or b"", n) for x in b.column(len(keep)).to_pylist())
            fp = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), fp], [*keep, "fp"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit positions (0: least significant) and threshold of each part in use."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def allocate(costs: list[list[float]], tau: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least total cost with sum(t + 1) = tau + 1; costs[i][t + 1], t from -1."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for k in range(min(tau + 1 - used, len(row) - 1) + 1):
                option = (total + row[k], (*chosen, k - 1))
                if used + k not in after or option < after[used + k]:
                    after[used + k] = option
        best = after
    return best.get(tau + 1, (math.inf, ()))


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each grows by the bit most correlated with it."""
    width = bits.shape[1]
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(width)), []
    for i in range(m):
        size = width * (i + 1) // m - width * i // m
        left = sorted(free)
        part = [left[int(corr[np.ix_(left, left)].max(axis=1).argmax())]]
        free.remove(part[0])
        while len(part) < size:
            left = sorted(free)
            part.append(left[int(corr[np.ix_(left, part)].mean(axis=1).argmax())])
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def make_plan(sample: np.ndarray, n: int, tau: int = TAU, most_parts: int = 8) -> Plan:
    """The cheapest parts and thresholds for n fingerprints like the sampled ones."""
    bits = ((sample.astype(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    if len(bits) < 2:
        bits = np.vstack([bits, np.zeros((2 - len(bits), 64), np.float32)])
    best: tuple[float, Plan] | None = None
    n = max(n, 1000)
    for m in range(1, min(most_parts, tau + 1) + 1):
        parts, costs = group_bits(bits, m), []
        for part in parts:
            b = bits[:, part]
            apart = b @ (1 - b).T
            apart = (apart + apart.T)[np.triu_indices(len(b), 1)]
            row = [0.0]
            for t in range(tau + 1):
                ball = sum(math.comb(len(part), k) for k in range(min(t, len(part)) + 1))
                share = max((apart <= t).mean(), ball / 2.0 ** len(part))
                row.append(20.0 * n * ball + n * n / 2 * share if ball <= MOST_PROBES else math.inf)
            costs.append(row)
        cost, chosen = allocate(costs, tau)
        if best is None or cost < best[0]:
            best = (cost, Plan(tuple(map(tuple, parts)), chosen))
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(nodes: DataFrame, plan: Plan, probes: bool) -> DataFrame:
    """(part, key, fp, ...): a part's own bits, or with probes all within its threshold."""

    def entry(i: int, part: tuple[int, ...], t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))
        flips = [sum(1 << b for b in c) for k in range((t if probes else 0) + 1) for c in itertools.combinations(part, k)]
        near = F.array(*[F.lit(_signed(x)).cast("long") for x in flips])
        return F.transform(near, lambda x: F.struct(F.lit(i).cast("int").alias("part"), own.bitwiseXOR(x).alias("key")))

    entries = [entry(i, part, t) for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)) if t >= 0]
    return nodes.withColumn("e", F.explode(F.concat(*entries))).select("e.part", "e.key", *nodes.columns)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, root): components of distinct fingerprints ``nodes(fp, n)`` within tau bits."""
    n = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    plan = make_plan(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), n, tau)
    roots = nodes.select("fp", F.col("fp").alias("root"))
    # leaders: the bucket's most frequent fingerprint, and one drawn by a hash
    own = _keys(nodes, plan, probes=False)
    lead = own.groupBy("part", "key").agg(F.max(F.struct("n", "fp"))["fp"].alias("x"), F.min(F.struct(F.xxhash64("fp", F.lit(1)), "fp"))["fp"].alias("y"))
    star = own.join(lead, ["part", "key"]).select("fp", F.explode(F.array("x", "y")).alias("lead"))
    star = star.filter((F.col("fp") != F.col("lead")) & (_apart("fp", "lead") <= tau))
    roots = _merge(roots, star.toDF("a", "b"))
    data = _keys(nodes.select("fp").join(roots, "fp"), plan, probes=False)
    probe = _keys(nodes.select("fp").join(roots, "fp"), plan, probes=True).toDF("part", "key", "fp2", "root2")
    # a bucket's largest component so far is not compared with itself
    big = data.groupBy("part", "key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("part", "key").agg(F.max(F.struct("n", "root"))["root"].alias("big"))
    marked = data.join(big, ["part", "key"])
    probes = probe.join(big, ["part", "key"])
    apart = (_apart("fp", "fp2") <= tau) & (F.col("root") != F.col("root2"))
    others = marked.filter("root != big").drop("big").join(probe, ["part", "key"]).filter(apart)
    largest = marked.filter("root = big").drop("big").join(probes.filter("root2 != big").drop("big"), ["part", "key"]).filter(apart)
    pairs = others.select("root", "root2").union(largest.select("root", "root2")).distinct()
    return _merge(roots, pairs.toDF("a", "b"))


def _merge(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots after joining the components named by the edges."""
    new = components(roots.select(F.col("root").alias("node")).distinct(), edges)
    return cut(roots.join(new.toDF("root", "new"), "root").select("fp", F.col("new").alias("root")))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, tau: int = TAU, text: str = "text", row_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, fp, root, component_id): root is the component's least fingerprint
    and component_id its smallest row id."""
    prints = cut_table(fingerprints(docs, n, text, (row_id, *keep)), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("least")))
    roots = link(nodes.select("fp", "n"), tau)
    least = nodes.select("fp", "least").join(roots, "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots.join(names, "root"), "fp").select(row_id, *keep, "fp", "root", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint and component."""
    x = near_duplicates(docs)
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For near copies: words of a shingle, least similarity, least share of equal places in the
#: sketches of candidates, min-hashes of a sketch, and rows and number of the bands that
#: bring candidates together.
COPY_SHINGLE, COPY_SIMILARITY, CANDIDATE, SKETCH, BAND_ROWS, BANDS = 5, 0.8, 0.65, 128, 4, 16
_MULTIPLIERS = np.random.default_rng(41).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(43).integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SKETCH linear functions over shingle hashes."""
    low = np.full(SKETCH, ~np.uint64(0), np.uint64)
    for i in range(0, len(hashes), 1024):
        part = hashes[i : i + 1024]
        low = np.minimum(low, (_MULTIPLIERS[:, None] * part[None, :] + _OFFSETS[:, None]).min(axis=1))
    return low


def sketches(docs: DataFrame, uid: str, text: str = "text", n: int = COPY_SHINGLE) -> DataFrame:
    """(uid, bands, sketch) of every text with words: band keys and 16 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, keys, kept = [], [], []
            for u, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _hashes(data or b"", n)
                if not len(found):
                    continue
                low = sketch(found)
                ids.append(u)
                raw = low.tobytes()
                size = 8 * BAND_ROWS
                keys.append([xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) - (1 << 63) for i in range(BANDS)])
                kept.append((low >> np.uint64(40)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["uid", "bands", "sketch"])

    return docs.select(uid, F.col(text).cast("binary").alias("_text")).mapInArrow(run, "uid long, bands array<bigint>, sketch binary")


def _hashes(data: bytes, n: int = COPY_SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(data, n))), ">u8").astype(np.uint64)


def _alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of distinct hashes have at least this Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) >= similarity


def _similar(group: list[tuple], need: int, similarity: float | None = None) -> Iterator[tuple[int, int]]:
    """Links that join all members of a group whose sketches agree in ``need`` places and,
    if a similarity is given, whose sets of hashes (third of a member) have it."""
    ids = [m[0] for m in group]
    x = np.frombuffer(b"".join(m[1] for m in group), np.uint16).reshape(len(group), -1)
    top = list(range(len(ids)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(0, len(ids), 128):
        for j in range(0, i + 128, 512):
            same = (x[i : i + 128, None, :] == x[None, j : j + 512, :]).sum(axis=2)
            for a, b in zip(*(v.tolist() for v in np.nonzero(same >= need)), strict=True):
                m, o = a + i, b + j
                a, b = find(m), find(o)
                if a != b and (similarity is None or (o < m and _alike(group[m][2], group[o][2], similarity))):
                    top[max(a, b)] = min(a, b)
                    yield ids[a], ids[b]


def _grouped_links(rows: DataFrame, need: int, similarity: float | None = None) -> DataFrame:
    """(a, b) linked in the groups of rows (key, uid, sketch, ...); pairs inside a group are
    compared in tiles, not given out."""
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        links: list[tuple[int, int]] = []
        for b in sliced(batches, 4096):
            for key, *member in zip(*(b.column(i).to_pylist() for i in range(width)), strict=True):
                if key != last:
                    links += _similar(group, need, similarity) if len(group) > 1 else ()
                    last, group = key, []
                group.append(tuple(member))
            cols = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])
            links = []
        links = list(_similar(group, need, similarity)) if len(group) > 1 else []
        cols = list(zip(*links, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "uid").mapInArrow(run, "a long, b long").distinct()


def sketch_links(table: DataFrame, share: float = CANDIDATE) -> DataFrame:
    """(a, b) that join distinct texts whose sketches agree in this share of places and in a
    band: candidates, to be decided by ``copy_links``."""
    keys = table.select("uid", F.explode("bands").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = keys.join(several, "key").join(table.select("uid", "sketch"), "uid").select("key", "uid", "sketch")
    return _grouped_links(rows, math.ceil(SKETCH * share))


#: Bits of the set that tells which texts can be among the candidates.
CANDIDATE_BITS = 1 << 24


def _among(rows: DataFrame, uid: str, wanted: DataFrame) -> DataFrame:
    """The rows whose uid is wanted, and few others, without moving the rows: a set of
    CANDIDATE_BITS hashed uids, in words of 32 bits, is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(CANDIDATE_BITS))
    bit = lambda c: F.pmod(place(c), F.lit(32)).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))
    words = wanted.groupBy(F.floor(place("uid") / 32).cast("int").alias("_word")).agg(F.bit_or(one("uid")).alias("_bits"))
    near = rows.withColumn("_word", F.floor(place(uid) / 32).cast("int")).join(F.broadcast(words), "_word")
    return near.filter(F.col("_bits").bitwiseAND(one(uid)) != 0).drop("_word", "_bits")


def copy_links(docs: DataFrame, table: DataFrame, uid: str, text: str = "text", similarity: float = COPY_SIMILARITY, share: float = CANDIDATE) -> DataFrame:
    """(a, b) that join distinct texts whose sets of shingles have this Jaccard similarity.

    Texts that candidates connect meet in one group with their sets, once each; there pairs
    of agreeing sketches are decided on the sets.
    """
    found = cut(sketch_links(table, share))
    nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    groups = components(nodes, found).toDF("uid", "key").join(table.select("uid", "sketch"), "uid")
    # only texts that candidates connect are sent, once each
    texts = _among(docs.select(F.col(uid).alias("uid"), F.col(text).alias("_text")), "uid", nodes.withColumnRenamed("node", "uid")).dropDuplicates(["uid"])
    rows = texts.join(groups, "uid").select("key", "uid", "sketch", F.col("_text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [np.unique(_hashes(x)).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(sets, pa.binary())], ["key", "uid", "sketch", "hashes"])

    return _grouped_links(rows.mapInArrow(run, "key long, uid long, sketch binary, hashes binary"), math.ceil(SKETCH * share), similarity)


def near_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, mark, root, component_id): groups of near-duplicate documents.

    Fingerprints within TAU bits are linked as in ``near_duplicates``.  At a similarity of
    0.8 over five-word shingles fingerprints differ in about ten of 64 bits, too many for
    any split into parts to be selective, so links between texts of that similarity are
    added: sketches bring candidates together, the sets of shingles decide.  ``mark`` is the
    text's hash, the same for equal texts.
    """
    marked = docs.withColumn("mark", F.xxhash64(text)).select(row_id, text, "mark")
    found = cut(near_duplicates(marked, text=text, row_id=row_id, keep=("mark",)).select(row_id, "mark", "root"))
    table = cut_table(sketches(marked, "mark", text), "sketches").dropDuplicates(["uid"])
    owner = found.groupBy("mark").agg(F.min("root").alias("root"))
    links = copy_links(marked, table, "mark", text)
    links = links.join(owner.toDF("a", "ra"), "a").join(owner.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(found.select(F.col("root").alias("node")).distinct(), links).toDF("root", "new")
    named = found.join(merged, "root").select(row_id, "mark", F.col("new").alias("root"))
    return named.join(named.groupBy("root").agg(F.min(row_id).alias("component_id")), "root").select(row_id, "mark", "root", "component_id")
