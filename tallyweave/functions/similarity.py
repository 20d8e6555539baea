"""Similarities of pairs."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lev_sim(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either side is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a machine word (a Python integer here) at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _indel(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best of the shared words against either whole, and of the wholes; 100 if one's words contain the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = _indel(one, two)
    return max(best, _indel(both, one), _indel(both, two)) if both else best


@cache
def _token_set_udf():
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) / 100 if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, DoubleType())


def token_set_sim(a: Column, b: Column) -> Column:
    """token_set_ratio as a share; 0 where a side is null."""
    return _token_set_udf()(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
