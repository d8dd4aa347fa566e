"""Fuzzy similarity: ratio and token-sort ratio (indel similarity, 0 to 100), with bounds that need no Python.

ratio = 100 * 2 * LCS / (len a + len b). The longest common subsequence is found bit-parallel, one Python integer
operation a character, in an Arrow-batched pandas UDF; candidates are cut first by bounds on JVM columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (Hyyro's bit-vector recurrence)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    """White-space tokens in order, joined by one space: token_sort_ratio is the ratio of these."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


def can_reach(n: Column, m: Column, score: float) -> Column:
    """Whether texts of n and m characters can have a ratio of score or more."""
    return F.least(n, m) * 200 >= (n + m) * score


def character_bag(text: Column) -> Column:
    """map<character, count>."""
    chars = F.array_sort(F.split(text, ""))
    return F.map_from_arrays(
        F.array_distinct(chars), F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
