"""SentencePiece encoding and decoding on a relational lattice.

Text is normalised as the model asks (spaces become U+2581, one is put in front) and cut
into units that no piece can cross.  The units of the whole corpus are counted; for the
frequent ones all substrings up to the longest piece are exploded, equi-joined to the piece
table, grouped by unit as lattice edges, and folded by Spark's ``aggregate``: best path
(Viterbi) for unigram models, best merge first for BPE models, whose exact result is not
the path of the largest score sum.  The folded units, at most ``DICTIONARY`` of them, are
broadcast; documents are encoded by looking units up, and units outside the dictionary
(rare or very long ones) take the same fold inside the task.

Defined results: a null text has null ids and decodes to null; an empty text has no ids;
characters without a piece become byte pieces, or the unknown id in a model without them;
the encoding is that of the sentencepiece library for normal and user-defined pieces;
decoding restores the text except that U+2581 itself becomes a space.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import cut_table, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units whose folded ids are broadcast, and the longest of them in characters.
DICTIONARY, LONGEST_UNIT = 1 << 17, 48
#: Units that a task remembers before it starts anew.
REMEMBERED = 300_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


@dataclass
class Pieces:
    """A piece table: (piece, score, type) by id, and how the model folds."""

    rows: list[tuple[str, float, int]]
    model_type: int
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with leading spaces is supported")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, spec.add_dummy_prefix)

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        found = {p: (i, s) for i, (p, s, t) in enumerate(self.rows) if t in (_NORMAL, _USER)}
        if any(SPACE in p.lstrip(SPACE) for p in found):
            raise ValueError("pieces with inner spaces are not supported")
        return found

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def unknown(self) -> int:
        return next((i for i, x in enumerate(self.rows) if x[2] == _UNKNOWN), 0)

    @cached_property
    def bytes_(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.rows) if t == _BYTE}

    def normalise(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.dummy_prefix else text

    def spelled(self, segment: str) -> list[int]:
        """Ids of a segment: its piece, or bytes, or the unknown id."""
        hit = self.table.get(segment)
        if hit:
            return [hit[0]]
        return [self.bytes_[b] for b in segment.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    @cached_property
    def pairs(self) -> set[str]:
        """All two adjacent characters inside pieces."""
        return {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}

    def split(self, unit: str) -> list[str]:
        """The unit cut wherever no piece can reach across."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(unit[start:i])
                start = i
        out.append(unit[start:])
        return out

    @cached_property
    def costs(self) -> dict[str, float]:
        return {p: -s for p, (_, s) in self.table.items()}

    def fold(self, unit: str) -> list[int]:
        if self.model_type != _BPE:
            segments = self._best_path(unit)
        else:
            segments = self._merged_short(unit) if len(unit) <= LONGEST_UNIT else self._merged(unit)
        return [i for s in segments for i in self.spelled(s)]

    def _merged_short(self, unit: str) -> list[str]:
        """As _merged, on plain lists: quicker for few characters."""
        cost, none = self.costs.get, float("inf")
        seg = list(unit)
        pair = [cost(a + b, none) for a, b in zip(seg, seg[1:])]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            both = seg[i] + seg[i + 1]
            seg[i : i + 2] = [both]
            del pair[i]
            if i:
                pair[i - 1] = cost(seg[i - 1] + both, none)
            if i < len(pair):
                pair[i] = cost(both + seg[i + 1], none)
        return seg

    def _merged(self, unit: str) -> list[str]:
        """Best-scored adjacent pair first, leftmost on ties, on a linked list and a heap."""
        n, table = len(unit), self.table
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b < n and (hit := table.get(unit[a : end[b]])):
                heapq.heappush(heap, (-hit[1], a, end[b]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = after[a] if end[a] else n
            if b >= n or end[b] != stop or end[a] != b:
                continue
            end[a], after[a], end[b] = stop, after[b], 0
            if after[a] < n:
                before[after[a]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [unit[i : end[i]] for i in range(n) if end[i]]

    def _best_path(self, unit: str) -> list[str]:
        """Largest score sum; of equals the one whose last piece is longest."""
        lowest = min((s for _, s in self.table.values()), default=0.0) - 10.0
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(unit) + 1):
            options = []
            for i in range(max(0, j - self.longest), j):
                hit = self.table.get(unit[i:j])
                if hit or i == j - 1:
                    options.append((best[i][0] + (hit[1] if hit else lowest), -i))
            score, start = max(options)
            best.append((score, -start))
        out, j = [], len(unit)
        while j:
            out.append(unit[best[j][1] : j])
            j = best[j][1]
        return out[::-1]


def units(text: str, pieces: Pieces) -> list[str]:
    """Runs of spaces with the characters up to the next space."""
    return _UNIT.findall(pieces.normalise(text))


def count_units(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """(unit, n) over all documents, counted inside the tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces([], pieces.model_type, pieces.dummy_prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])
            seen.clear()
            return rows

        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(units(t, shared.value))
                    if len(seen) > REMEMBERED:
                        yield flush()
        yield flush()

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The units above the smallest count class (eighths of powers of two) that fits ``most``."""
    level = F.floor(F.log2("n") * 8).cast("int")
    short = counted.filter(F.length("unit") <= LONGEST_UNIT)
    sizes = sorted(((r["level"], r["units"]) for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("units")).collect()), reverse=True)
    total, least = 0, None
    for at, size in sizes:
        if total + size > most:
            break
        total, least = total + size, at
    return short.filter(level >= least if least is not None else F.lit(False)).select("unit")


def lattice(unit_rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edges): for each distinct unit all (start, len, score, id) matched by a piece."""
    spark = unit_rows.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    n = F.length("unit")
    spots = unit_rows.withColumn("start", F.explode(F.sequence(F.lit(1), n))).withColumn(
        "len", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start") + 1)))
    )
    parts = spots.withColumn("piece", F.expr("substring(unit, start, len)"))
    edges = parts.join(F.broadcast(table), "piece")
    grouped = edges.groupBy("unit").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "len", "score", "id")).alias("edges"))
    empty = F.array().cast("array<struct<start:int,len:int,score:double,id:int>>")
    return unit_rows.join(grouped, "unit", "left").select("unit", F.coalesce("edges", empty).alias("edges"))


def _merge_fold(n: Column, by_span: Column) -> Column:
    """Boundaries left after merging: each step drops the one inside the best pair."""

    def step(bounds: Column, _: Column) -> Column:
        inner = F.transform(
            F.slice(bounds, F.lit(2), F.greatest(F.size(bounds) - 2, F.lit(0))),
            lambda b, i: F.struct(by_span[F.get(bounds, i) * 1000 + F.get(bounds, i + 2)].alias("score"), (-i).alias("i"), b.alias("b")),
        )
        best = F.array_max(F.filter(inner, lambda x: x["score"].isNotNull()))
        return F.when(best.isNull(), bounds).otherwise(F.array_remove(bounds, F.coalesce(best["b"], F.lit(-1))))

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def _path_fold(n: Column, edges: Column, lowest: float) -> Column:
    """Boundaries of the best path, by Viterbi over end positions and a walk back."""

    def reach(best: Column, end: Column) -> Column:
        hits = F.transform(
            F.filter(edges, lambda e: e["start"] + e["len"] == end),
            lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("at")),
        )
        lone = F.array(F.struct((F.get(best, end - 1)["score"] + F.lit(lowest)).alias("score"), (-(end - 1)).alias("at")))
        unmatched = ~F.exists(edges, lambda e: (e["start"] == end - 1) & (e["len"] == 1))
        options = F.concat(hits, F.when(unmatched, lone).otherwise(F.slice(lone, 1, 0)))
        return F.concat(best, F.array(F.array_max(options)))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("at")))
    best = F.aggregate(F.sequence(F.lit(1), n), first, reach)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(n),
        lambda walk, _: F.when(F.get(walk, F.lit(0)) == 0, walk).otherwise(F.concat(F.array(-F.get(best, F.get(walk, F.lit(0)))["at"]), walk)),
    )


def fold_units(unit_rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, segments): each distinct unit cut into pieces by the lattice fold."""
    x = lattice(unit_rows, pieces).withColumn("n", F.length("unit"))
    if pieces.model_type == _BPE:
        x = x.withColumn("spans", F.map_from_entries(F.transform("edges", lambda e: F.struct((e["start"] * 1000 + e["start"] + e["len"]), e["score"]))))
        bounds = _merge_fold(F.col("n"), F.col("spans"))
    else:
        lowest = min((s for _, s in pieces.table.values()), default=0.0) - 10.0
        bounds = _path_fold(F.col("n"), F.col("edges"), lowest)
    x = x.withColumn("bounds", bounds)
    cuts = F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda b, i: F.substring("unit", b + 1, F.get("bounds", i + 1) - b))
    return x.select("unit", cuts.alias("segments"))


class _Memory(dict):
    """Packed ids by unit; a unit not held is folded here."""

    def __init__(self, known: dict[str, bytes], pieces: Pieces):
        super().__init__(known)
        self.known, self.pieces = known, pieces

    def __missing__(self, unit: str) -> bytes:
        parts = self.pieces.split(unit)
        if len(parts) > 1:  # only its parts are remembered
            return b"".join([self[x] for x in parts])
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.known)
        packed = self[unit] = np.array(self.pieces.fold(unit), np.int32).tobytes()
        return packed



def dictionary(docs: DataFrame, pieces: Pieces, text: str = "text", most: int = DICTIONARY) -> dict[str, bytes]:
    """Packed ids of the corpus's frequent units, from the relational lattice."""
    counted = cut_table(count_units(docs, pieces, text), "units")
    rows = fold_units(frequent(counted, most), pieces).toLocalIterator()
    return {r["unit"]: np.array([i for s in r["segments"] for i in pieces.spelled(s)], np.int32).tobytes() for r in rows}


class Speller:
    """Texts of id arrays."""

    def __init__(self, pieces: Pieces):
        self.drop_first = pieces.dummy_prefix
        self.spelled = [self._bytes(x, t) for x, _, t in pieces.rows]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == _UNKNOWN:
            return b" \xe2\x81\x87 "
        return piece.replace(SPACE, " ").encode() if kind in (_NORMAL, _USER) else b""

    def text(self, ids: np.ndarray) -> str:
        s = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (s[1:] if self.drop_first and s[:1] == b" " else s).decode("utf-8", "replace")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, pieces: Pieces, known: dict[str, bytes] | None = None, text: str = "text", into: str = "ids", check: str | None = None) -> DataFrame:
    """The documents with an array<int> column of piece ids.

    With ``check`` each array is decoded again in the task, and that boolean column says
    whether the text came back (null for a null text).  Other columns stay; one that is
    named like a new one is an error.  An empty table stays empty.
    """
    if clash := {into, check} & set(docs.columns):
        raise ValueError(f"the documents have these columns already: {sorted(clash)}")
    known = dictionary(docs, pieces, text) if known is None else known
    shared = docs.sparkSession.sparkContext.broadcast((pieces, known))
    at, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = shared.value
        memory, speller = _Memory(held, p), Speller(p)
        for b in sliced(batches):
            texts = b.column(at).to_pylist()
            packed = [b"".join(map(memory.__getitem__, units(t, p))) if t is not None else None for t in texts]
            ends = np.cumsum([0] + [len(x or b"") // 4 for x in packed], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32))
            new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([x is None for x in packed]))]
            if check:
                same = [None if t is None else speller.text(np.frombuffer(x, np.int32)) == t.replace(SPACE, " ") for t, x in zip(texts, packed, strict=True)]
                new.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), *new], [*b.schema.names[:width], into, *[check] * bool(check)])

    return docs.mapInArrow(run, f"{_schema(docs)}, `{into}` array<int>" + (f", `{check}` boolean" if check else ""))


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that the ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    at, width = encoded.columns.index(ids), len(encoded.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for b in sliced(batches):
            out = [None if x is None else speller.text(np.array(x, np.int32)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(out, pa.string())], [*b.schema.names[:width], into])

    return encoded.mapInArrow(run, f"{_schema(encoded)}, `{into}` string")


def pieces_query(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Every document's ids, and whether decoding gives its text back."""
    pieces = Pieces.load(path)
    x = encode(docs.select("doc_id", "text"), pieces, check="same")
    return x.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.coalesce("same", F.lit(True)).alias("round_trip"))
