"""A Merkle manifest of a table: one root for all rows, a proof and a check for each row.

Every row is a leaf, the SHA-256 of its framed fields.  The leaves of a group, in order, form
a tree in which each run of FAN consecutive nodes becomes one node until one is left; the
groups' roots, in order, form the tree above.

The tree is built from below in large blocks.  Leaves are sorted and numbered by group on the
executors; each block of ``block`` consecutive leaves (a power of FAN) is reduced to one node
in one task, and its leaves are stored as one row.  While more than ``top`` nodes are left
they are reduced in blocks again; the small rest of the tree is built on the driver and
broadcast, level by level, so that the path above a node is a slice of each level.  Then the
stored blocks are read once more: a task completes each leaf's path by the block's own levels
and the broadcast ones (or, between two reductions, the joined ones), hashes it as the proof
and folds the row's digest, as it now is, up to the root.

Groups need no balance: a group with most rows is many blocks.  Sorting is by ranges of
(group, order, digest), so a repeated order value is no hot key either.  The driver and every
task see at most ``top`` nodes or ``block`` leaves.

Defined results: a null field is ``-`` and differs from an empty one; the null group comes
first and then groups by their UTF-8 bytes; a null order value comes first; rows of equal
order are taken by digest, so equal rows are interchangeable; a row of null id is never
tampered with; a proof without siblings is the digest of nothing; an empty table has no rows.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlake.llm.common import cut, cut_table, sliced

FAN = 8
#: Leaves of one block, and the most nodes that the driver makes the top of the tree from.
BLOCK, TOP = FAN**4, 1 << 15
SIZE = 32

Path = list[tuple[bytes, bytes]]


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def framed(*fields: str) -> Column:
    """The fields one after the other, each as bytes, colon and value, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in fields]
    return F.concat(*parts)


def leaf(*fields: str) -> Column:
    return F.unhex(F.sha2(framed(*fields).cast("binary"), 256))


# A level is the concatenated digests of its nodes.


def up(level: bytes) -> bytes:
    """The level above: the digest of each run's hexadecimal digests."""
    step = FAN * SIZE
    return b"".join(digest(level[i : i + step].hex().encode()) for i in range(0, len(level), step))


def levels(nodes: bytes, height: int | None = None) -> list[bytes]:
    """The levels from the nodes on: ``height`` steps, or until one node is left."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > SIZE:
        out.append(up(out[-1]))
    return out


def path(tree: Sequence[bytes], at: int) -> Path:
    """The hexadecimal siblings to the left and right of a node, for each step upwards."""
    out = []
    for level in tree[:-1]:
        first = at - at % FAN
        out.append((level[first * SIZE : at * SIZE].hex().encode(), level[(at + 1) * SIZE : (first + FAN) * SIZE].hex().encode()))
        at //= FAN
    return out


def fold(node: bytes, steps: Path) -> bytes:
    """The node that a node and its siblings lead to."""
    for left, right in steps:
        node = digest(left + node.hex().encode() + right)
    return node


def _height(block: int) -> int:
    height = 0
    while FAN**height < block:
        height += 1
    if FAN**height != block or not height:
        raise ValueError(f"a block must be a power of {FAN}")
    return height


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Stored ``rows`` with ``at``, the position (from 0) by ``order`` in the group ``grp``.

    ``rows`` must hold ``grp`` and ``digest``.  Rows equal in group, order and digest may lie
    in several ranges.
    """
    keys = ["grp", *order, "digest", "_salt"]
    # stored first: finding the ranges reads the rows once more
    x = cut_table(rows.withColumn("_salt", F.spark_partition_id()), f"{name}-unsorted").repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    x = cut_table(x.withColumn("_id", F.monotonically_increasing_id()), name)
    x = x.withColumn("_part", F.shiftrightunsigned("_id", 33))
    parts = x.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("grp")
    # few rows: one for each group and range
    parts = parts.select(F.col("grp").alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(total).alias("n"))
    joined = x.join(parts, x["grp"].eqNullSafe(parts["_g"]) & (x["_part"] == parts["_p"]))
    return joined.withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_g", "_p", "_shift")


@dataclass
class _Step:
    """One reduction: the stored blocks of nodes and the node that each became."""

    blocks: DataFrame
    nodes: DataFrame


def _reduced(nodes: DataFrame, block: int, carried: Sequence[str], name: str) -> _Step:
    """Blocks of ``nodes`` (grp, at, n, digest, *carried), one row each, and the reduced nodes."""
    height = _height(block)
    rows = F.array_sort(F.collect_list(F.struct("at", "digest", *carried)))
    grouped = nodes.groupBy("grp", F.floor(F.col("at") / block).alias("block")).agg(F.first("n").alias("n"), rows.alias("rows"))
    blocks = cut_table(grouped, name)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            lists = b.column(3)
            digests = [b"".join(lists[i].values.field(1).to_pylist()) for i in range(b.num_rows)]
            sizes = b.column(2).to_pylist()
            found = [levels(d, height if n > block else None)[-1] for d, n in zip(digests, sizes, strict=True)]
            after = pa.array([-(-n // block) for n in sizes], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), after, pa.array(found, pa.binary())], ["grp", "at", "n", "digest"])

    made = blocks.select("grp", "block", "n", "rows").mapInArrow(reduce, "grp string, at long, n long, digest binary")
    return _Step(blocks, cut(made))


def _paths(b: pa.RecordBatch, block: int, height: int, top: dict | None) -> Iterator[tuple[int, int, Path, bytes, bytes]]:
    """Of each node of blocks (grp, block, n, rows[, steps, subroot, root]): its row of the
    batch, place in the block, whole path, subroot and root."""
    groups, numbers, sizes = (b.column(i).to_pylist() for i in range(3))
    for i, (group, at, n) in enumerate(zip(groups, numbers, sizes, strict=True)):
        digests = b"".join(b.column(3)[i].values.field(1).to_pylist())
        own = levels(digests, height if n > block else None)
        if top is None:
            above = [(s["left"], s["right"]) for s in b.column(4)[i].as_py()]
            subroot, root = b.column(5)[i].as_py(), b.column(6)[i].as_py()
        else:
            tree, subroot, over, root = top[group]
            above = path(tree, at) + over
        for k in range(len(digests) // SIZE):
            yield i, k, path(own, k) + above, subroot, root


class _Top:
    """The rest of the tree, built from few nodes: by group its levels, its root, the path of
    that root among the groups' roots, and the root of all."""

    def __init__(self, nodes: list) -> None:
        by_group: dict[str | None, list] = {}
        for r in nodes:
            by_group.setdefault(r["grp"], []).append((r["at"], bytes(r["digest"])))
        trees = {g: levels(b"".join(d for _, d in sorted(x))) for g, x in by_group.items()}
        order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
        roots = levels(b"".join(trees[g][-1] for g in order)) if order else []
        self.by_group = {g: (trees[g], trees[g][-1], path(roots, k), roots[-1]) for k, g in enumerate(order)}


_STEPS = "steps array<struct<left: binary, right: binary>>, subroot binary, root binary"


def _suffixes(step: _Step, block: int, source: dict | DataFrame) -> DataFrame:
    """(grp, block, steps, subroot, root): the path above each node that the step took in."""
    height = _height(block)
    spark = step.blocks.sparkSession
    shared = None if isinstance(source, DataFrame) else spark.sparkContext.broadcast(source)
    steps = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            found = list(_paths(b, block, height, shared and shared.value))
            first = b.column(1)[0].as_py() * block if b.num_rows else 0
            cols = [
                pa.array([b.column(0)[0].as_py()] * len(found), pa.string()), pa.array([first + k for _, k, *_ in found], pa.int64()),
                pa.array([[{"left": x, "right": y} for x, y in p] for _, _, p, _, _ in found], steps), pa.array([s for *_, s, _ in found], pa.binary()), pa.array([r for *_, r in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["grp", "block", "steps", "subroot", "root"])

    return _with_suffix(step, source).mapInArrow(run, f"grp string, block long, {_STEPS}")


def _with_suffix(step: _Step, source: dict | DataFrame) -> DataFrame:
    x = step.blocks.select("grp", "block", "n", "rows")
    if not isinstance(source, DataFrame):
        return x
    s = source.withColumnsRenamed({"grp": "_g", "block": "_b"})
    return x.join(s, x["grp"].eqNullSafe(s["_g"]) & (x["block"] == s["_b"])).select("grp", "block", "n", "rows", "steps", "subroot", "root")


def _climb(nodes: DataFrame, block: int, top: int, carried: Sequence[str], name: str) -> tuple[list[_Step], list | None]:
    """Reductions until at most ``top`` nodes or one of each group are left; the nodes if few."""
    steps = [_reduced(nodes, block, carried, f"{name}-0")]
    while True:
        left, most = steps[-1].nodes.agg(F.count(F.lit(1)), F.max("n")).first()
        if left <= top:
            return steps, steps[-1].nodes.collect()
        if most == 1:
            return steps, None
        steps.append(_reduced(steps[-1].nodes, block, (), f"{name}-{len(steps)}"))


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id",
    now: Column | None = None, block: int = BLOCK, top: int = TOP,
) -> DataFrame:
    """(order, leaf, subroot, root, proof, folded): all digests in binary.

    The path of every row is folded from ``now``, the digest of the row as it is at present, or
    from the leaf where that is null (default); it equals ``root`` only if the row is unchanged.
    """
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("key"), leaf(*fields).alias("digest"), (F.lit(None).cast("binary") if now is None else now).alias("now"))
    steps, few = _climb(numbered(rows, ["key"], "manifest-leaves"), block, top, ("key", "now"), "manifest")
    source = _over(steps[-1].nodes, block, top) if few is None else _Top(few).by_group
    for step in reversed(steps[1:]):
        source = _suffixes(step, block, source)
    return _finished(steps[0], block, source, docs.schema[order].dataType.simpleString())


def _over(roots: DataFrame, block: int, top: int) -> DataFrame:
    """(grp, block, steps, subroot, root) of each group's root, for more groups than the driver
    takes: their roots are sorted and reduced as the leaves of one group."""
    rows = roots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "digest")
    steps, few = _climb(numbered(rows, ["name"], "manifest-groups"), block, top, ("name",), "manifest-over")
    source: dict | DataFrame = _Top(few).by_group
    for step in reversed(steps):
        source = _suffixes(step, block, source)
    named = steps[0].blocks.select(F.explode("rows").alias("row")).select(F.col("row.at").alias("block"), F.col("row.name").alias("grp"), F.col("row.digest").alias("subroot"))
    return cut_table(named.join(source.select("block", "steps", "root"), "block").select("grp", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root"), "manifest-over-paths")


def _finished(step: _Step, block: int, source: dict | DataFrame, key: str) -> DataFrame:
    """Proof and fold of every leaf of the stored blocks."""
    height = _height(block)
    shared = None if isinstance(source, DataFrame) else step.blocks.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            if not b.num_rows:
                continue
            rows = b.column(3)[0].values
            leaves, now = rows.field(1).to_pylist(), rows.field(3).to_pylist()
            subroots, roots, proofs, folded = [], [], [], []
            for _, k, steps, subroot, root in _paths(b, block, height, shared and shared.value):
                subroots.append(subroot)
                roots.append(root)
                proofs.append(digest(b"".join(x + y for x, y in steps)))
                folded.append(fold(now[k] or leaves[k], steps))
            yield pa.RecordBatch.from_arrays([rows.field(2), rows.field(1), *(pa.array(c, pa.binary()) for c in (subroots, roots, proofs, folded))], ["key", "leaf", "subroot", "root", "proof", "folded"])

    return _with_suffix(step, source).mapInArrow(run, f"key {key}, leaf binary, subroot binary, root binary, proof binary, folded binary")


def manifest_query(docs: DataFrame, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """Every document's proof, and whether it still leads to the root.

    Documents whose id's checksum is divisible by three are tampered with: A to Z lower-cased.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = docs.select(*fields)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    marked = docs.withColumn("_changed", F.when(tampered, F.translate("text", upper, lower)))
    now = F.when(tampered, leaf(*fields[:-1], "_changed"))
    x = manifest(marked, fields, now=now, block=block, top=top)
    text = lambda c: F.lower(F.hex(c))
    return x.select(
        F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
