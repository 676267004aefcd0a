"""The few functions without a built-in: Unicode normal forms and sequence similarity.

They run on Arrow batches and belong behind a blocking join or a small result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def compatibility_key(x: pd.Series) -> pd.Series:
    """NFKD letters and digits, case folded."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if c.isalnum()))


@F.pandas_udf(StringType())
def composed_key(x: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


@F.pandas_udf(DoubleType())
def author_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How well two lists of names agree: greedy one-to-one matches of ratio 0.72 or more, in
    the order of the first list, over the larger size; ties go to the later name; without
    names 0."""

    def greedy(left: list[str], right: list[str]) -> float:
        free, total = dict(enumerate(right)), 0.0
        for name in left:
            ratio, at = max(((SequenceMatcher(None, name, other).ratio(), i) for i, other in free.items()), default=(0.0, -1))
            if ratio >= 0.72:
                total += ratio
                del free[at]
        return total / max(len(left), len(right)) if left and right else 0.0

    return pd.Series([greedy([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(1 << 16)
def _grams(text: str, size: int) -> frozenset:
    """The grams of a text, repeated ones numbered."""
    seen: Counter = Counter()
    out = []
    for i in range(max(len(text) - size + 1, 0)):
        g = text[i : i + size]
        out.append((g, seen[g]))
        seen[g] += 1
    return frozenset(out)


@F.pandas_udf(DoubleType())
def ratio_if_possible(a: pd.Series, b: pd.Series, least: pd.Series, gram: pd.Series) -> pd.Series:
    """The similarity of two texts, or null if the grams they share show it to be below
    ``least``, without comparing them in full."""

    def one(x: str, y: str, ratio: float, size: int) -> float | None:
        spoilt = int(round((1 - ratio) * (len(x) + len(y)), 9)) * size
        if len(_grams(x, size) & _grams(y, size)) < max(len(x), len(y)) - (size - 1) - spoilt:
            return None
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(*v) for v in zip(a, b, least, gram, strict=True)], dtype="float64")
