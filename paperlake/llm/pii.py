"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidate spans come from the base patterns and from looser ones (obfuscated addresses,
national telephone numbers, shorter card numbers, long-form IP addresses, and base matches
that fail their check).  Labelers of three sorts - patterns and checks, gazetteers, context -
vote for, against or abstain.  The vote patterns of all documents are counted, and
expectation-maximisation over the counts estimates each labeler's reliability per kind.
The posteriors, as soft labels, train a logistic span classifier on votes and shape, which
decides on each candidate that passes its kind's check; base matches that fail theirs are
examples to learn from and never spans.  Base spans always stay; others are added if
accepted and clear of every base span.

Collected to the driver are counts by discrete feature tuple, a bounded set.  Scanning is
linear in the text, however long its runs of digits or letters.

Defined results: a null or empty text has no span; offsets are code points, ends exclusive;
repeated rows get equal spans; an empty table trains nothing and gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,6}", re.I)
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

#: Gazetteers and context words.
_TOP_LEVEL = frozenset("com org net edu gov io info biz de fr es uk eu it nl ch at be se no dk fi pl pt ru jp cn in br ca au us mx".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "2", "35")
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|adresse|kontakt|reach", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login|from|client|connect", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|ruf|appel|llama|contact", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|issn|section|order|invoice|page|part no|serial|figure|doi", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


@dataclass(frozen=True)
class Candidate:
    """A span with its pattern and whether the pattern's own check holds."""

    kind: str
    start: int
    end: int
    pattern: str
    valid: bool

    @property
    def base(self) -> bool:
        return self.pattern == "base" and self.valid


def candidates(text: str) -> list[Candidate]:
    """All candidates by kind and start; matches of looser patterns avoid base spans."""
    out: list[Candidate] = []
    if "@" in text:
        out += [Candidate("email", a, b, "base", True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            out.append(Candidate("ip", *m.span(), "base", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19:
                    out.append(Candidate("card", *m.span(), "base", luhn(digits)))
                elif 13 <= len(digits) <= 15:
                    out.append(Candidate("card", *m.span(), "short", luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                out.append(Candidate("phone", *m.span(), "base", 8 <= sum(map(str.isdecimal, m[0])) <= 15))
        out += [Candidate("phone", *m.span(), "national", True) for m in _NATIONAL.finditer(text)]
        if ":" in text:
            out += [Candidate("ip", *m.span(), "long", True) for m in _IP6.finditer(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        out += [Candidate("email", *m.span(), "masked", True) for m in _MASKED.finditer(text)]
    taken = sorted((c.start, c.end) for c in out if c.base)
    if len(taken) < len(out):
        starts = [a for a, _ in taken]
        ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

        def clear(c: Candidate) -> bool:
            i = int(np.searchsorted(starts, c.end)) if starts else 0
            return i == 0 or ends[i - 1] <= c.start

        out = [c for c in out if c.base or clear(c)]
    return sorted(out, key=lambda c: (KINDS.index(c.kind), c.start, c.end))


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """+1, -1 or 0 of: pattern, check, gazetteer, context for, context against, border."""
    s, before = text[c.start : c.end], text[max(0, c.start - 32) : c.start]
    digits = "".join(x for x in s if x in "0123456789")
    if c.kind == "email":
        known = s.rpartition(".")[2].lower() in _TOP_LEVEL if c.pattern == "base" else re.split(r"[\])] ?", s)[-1].lower() in _TOP_LEVEL
    elif c.kind == "phone":
        known = (digits.startswith(_CALLING) if c.pattern == "base" else digits[0] in "23456789")
    elif c.kind == "card":
        known = digits.startswith(_ISSUERS)
    else:
        known = not s.startswith(("0.", "255.")) if c.pattern == "base" else True
    odd = (c.start > 0 and text[c.start - 1].isalnum()) or (c.end < len(text) and text[c.end].isalnum())
    return (
        1 if c.pattern == "base" else 0,
        1 if c.valid else -1,
        1 if known else -1,
        1 if _FOR[c.kind].search(before) else 0,
        -1 if _AGAINST.search(before) else 0,
        -1 if odd else 1,
    )


def described(text: str, c: Candidate) -> tuple:
    """The discrete features of a candidate: kind, pattern, votes, length class."""
    return (c.kind, c.pattern, *votes(text, c), min(c.end - c.start, 40) // 8)


LABELERS = ("pattern", "check", "gazetteer", "for", "against", "border")


@dataclass
class Model:
    """Labeler reliabilities by kind and the classifier's weights by feature."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: dict[tuple, float] = field(default_factory=dict)
    bias: float = 0.0

    def probability(self, d: tuple) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in _features(d))
        return 1.0 / (1.0 + float(np.exp(-z)))


def _features(d: tuple) -> list[tuple]:
    kind, pattern, *rest = d
    return [("kind", kind), ("pattern", kind, pattern), *((name, kind, v) for name, v in zip(LABELERS, rest, strict=False)), ("length", kind, d[-1])]


def estimate(counted: list[tuple[tuple, int]], rounds: int = 50) -> tuple[Model, np.ndarray]:
    """EM with one confusion table per labeler and kind; the posterior of each tuple."""
    model, posterior = Model(), np.zeros(len(counted))
    for kind in KINDS:
        at = [i for i, (d, _) in enumerate(counted) if d[0] == kind]
        if not at:
            continue
        v = np.array([counted[i][0][2:8] for i in at])
        n = np.array([counted[i][1] for i in at], float)
        p = np.clip(0.5 + v.sum(axis=1) / 10.0, 0.05, 0.95)
        for _ in range(rounds):
            weight = np.stack([(1 - p) * n, p * n])  # class x tuple
            prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
            like = np.log(prior)[:, None] + np.zeros((2, len(at)))
            for j in range(v.shape[1]):
                for cls in (0, 1):
                    table = {x: 0.5 + (weight[cls] * (v[:, j] == x)).sum() for x in (-1, 0, 1)}
                    # a labeler keeps its sense: the prior leans the right way
                    table[1 if cls else -1] += 0.5
                    total = sum(table.values())
                    like[cls] += np.log(np.array([table[x] / total for x in v[:, j]]))
            p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        posterior[at] = p
        model.prior[kind] = float((p * n).sum() / n.sum())
        model.reliability[kind] = {}
        for j, name in enumerate(LABELERS):
            cast = v[:, j] != 0
            right = np.where(v[:, j] > 0, p, 1 - p)
            model.reliability[kind][name] = float((right * n * cast).sum() / max((n * cast).sum(), 1e-9))
    return model, posterior


def fit(counted: list[tuple[tuple, int]], rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Reliabilities by EM, then the classifier on the posteriors as soft labels."""
    counted = sorted(counted, key=lambda x: tuple(map(str, x[0])))
    model, target = estimate(counted)
    names = sorted({f for d, _ in counted for f in _features(d)}, key=lambda f: tuple(map(str, f)))
    if not names:
        return model
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counted), len(names) + 1))
    x[:, -1] = 1
    for r, (d, _) in enumerate(counted):
        x[r, [index[f] for f in _features(d)]] = 1
    n = np.sqrt(np.array([c for _, c in counted], float))  # frequent tuples weigh more, not alone
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (target - p)) - ridge * w)
        w += 0.5 * step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = {f: float(w[i]) for f, i in index.items()}
    model.bias = float(w[-1])
    return model


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the feature tuples of every document's candidates and fits the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(described(t, c) for c in candidates(t))
        rows = list(seen.items())
        names = ["kind", "pattern", *(f"v{i}" for i in range(6)), "length", "n"]
        cols = [pa.array([r[0][i] for r in rows], pa.string() if i < 2 else pa.int32()) for i in range(9)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.int64())], names)

    votes_ = ", ".join(f"v{i} int" for i in range(6))
    counted = docs.select(F.col(text).alias("_text")).mapInArrow(run, f"kind string, pattern string, {votes_}, length int, n long")
    keys = [c for c in counted.columns if c != "n"]
    rows = counted.groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return fit([(tuple(r[k] for k in keys), r["n"]) for r in rows])


def spans(text: str | None, model: Model, known: dict[tuple, bool] | None = None) -> list[Candidate]:
    """Base spans and the accepted others of one text, by kind and start."""
    known = {} if known is None else known
    out: list[Candidate] = []
    for c in candidates(text) if text else []:
        keep = c.base
        if not keep and c.valid:
            d = described(text, c)
            keep = known.get(d)
            if keep is None:
                keep = known[d] = model.probability(d) >= ACCEPT
            keep = keep and not (out and out[-1].kind == c.kind and out[-1].end > c.start)
        if keep:
            out.append(c)
    return out


def find(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, spans): array of (kind, start, end, base) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}
        for b in sliced(batches):
            found = [[{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base} for c in spans(t, shared.value, known)] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.list_(span))], [*keep, "spans"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with every found span of ``text`` replaced by ``<KIND>``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def clean(t: str | None, known: dict) -> str | None:
        if not t:
            return t
        out, done = [], 0
        for c in sorted(spans(t, shared.value, known), key=lambda c: (c.start, -c.end)):
            if c.end > done:
                if c.start >= done:
                    out += [t[done : c.start], f"<{c.kind.upper()}>"]
                done = c.end
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}
        for b in sliced(batches):
            cols = [pa.array([clean(t, known) for t in c.to_pylist()], c.type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_query(docs: DataFrame) -> DataFrame:
    """Per document the base counts and digest, and all spans."""
    x = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def base_text(text: str) -> str:
    """The base spans of a text as hashed by the query."""
    return ",".join(f"{c.kind}:{c.start}:{c.end}" for c in candidates(text) if c.base)
