"""Similarity of two names: a registry of features, JVM expressions where Spark has them, else Arrow-batched pandas UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def indel(a: str, b: str) -> float:
    """2 x longest common subsequence / both lengths; 1 for two empty texts.  Bit-parallel over a."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best indel ratio of the shorter text with a part of the longer of at most its length, cut at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n, best, chars = len(a), 0.0, set(a)
    for i in range(1 - n, len(b)):
        part = b[max(0, i) : i + n]
        if part and (part[-1] in chars if i <= len(b) - n else part[0] in chars):
            best = max(best, indel(a, part))
            if best == 1.0:
                break
    return best


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common words, and the common words with either text's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(r))])) for r in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 1.0
    return max(indel(left, right), *((indel(both, left), indel(both, right)) if both else (0.0,)))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    m = len(mine)
    swaps = sum(p != q for p, q in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, boost_over: float = 0.7) -> float:
    j = jaro(a, b)
    same = 0
    for p, q in zip(a[:4], b[:4], strict=False):
        if p != q:
            break
        same += 1
    return j + same * weight * (1 - j) if j > boost_over else j


def _udf(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A null on either side gives 0."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([f(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def first_letter_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def combined_length(a: Column, b: Column) -> Column:
    return F.ln(F.length(a) + F.length(b))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longest)


#: Feature name -> Column of two names.  Add to it, or pass another, to plug in features of one's own.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "ratio": _udf(indel),
    "partialratio": _udf(partial),
    "tokensort": _udf(token_sort),
    "tokenset": _udf(token_set),
    "levenstein": levenshtein_ratio,
    "jaro_winkler": _udf(jaro_winkler),
    "first_letter_jaccard": first_letter_jaccard,
    "combined_len": combined_length,
    "len_ratio": length_ratio,
}


def featurize(pairs: DataFrame, features: dict[str, Callable[[Column, Column], Column]] | None = None, left: str = "left_norm", right: str = "right_norm") -> DataFrame:
    """pairs with a double column for each feature, 0 where a feature has no value."""
    return pairs.withColumns({name: F.coalesce(f(F.col(left), F.col(right)).cast("double"), F.lit(0.0)) for name, f in (features or FEATURES).items()})
