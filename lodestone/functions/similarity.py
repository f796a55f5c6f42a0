"""Similarity of short strings: edit ratios over Arrow batches and trigrams as Column expressions.

A longest common subsequence has no built-in function, and as nested
aggregates over arrays it took some 300 microseconds a pair where the
bit-parallel form below takes a few, so the edit ratios are pandas functions.
Callers block first, drop pairs whose upper bound, a Column expression of
lengths and of letters in common, is below their threshold, and score only the
distinct pairs left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: bits of one number stand for a's places, a step for each letter of b."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    both = len(a) + len(b)
    return 200.0 * lcs(a, b) / both if both else 100.0


def set_ratio(a: str, b: str) -> float:
    """The best ratio of shared words, and of shared words with each side's others; 100 if one side has no others, 0 if one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    s, n, m = len(shared), len(only_x), len(only_y)
    if s and not (n and m):
        return 100.0
    gap = 1 if s else 0
    apart = 100.0 - 100.0 * (n + m - 2 * lcs(only_x, only_y)) / (s + gap + n + s + gap + m)
    if not s:
        return apart
    return max(apart, 100.0 - 100.0 * (gap + n) / (s + s + gap + n), 100.0 - 100.0 * (gap + m) / (s + s + gap + m))


def _over(function):
    @F.pandas_udf("double")
    def of_batches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of_batches


def indel_ratio(a: Column, b: Column) -> Column:
    """200 times the common subsequence over both lengths; 100 for two empty strings, null with a null."""
    return _over(ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _over(set_ratio)(a, b)


def _numbered(x: Column) -> Column:
    """Each letter with how often it has come up, so that sets of these meet in as many as the letters do."""

    def at(i: Column) -> Column:
        begun, letter = F.substring(x, F.lit(1), i), F.substring(x, i, F.lit(1))
        return F.concat(letter, (F.length(begun) - F.length(F.replace(begun, letter, F.lit("")))).cast("string"))

    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), at)).otherwise(F.array().cast("array<string>"))


def letters(x: Column) -> Column:
    """What bounds are told by: size, distinct words and numbered letters of the text and of those words."""
    words = F.array_distinct(F.filter(F.split(x, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return F.struct(F.length(x).alias("size"), _numbered(x).alias("all"), words.alias("words"), _numbered(F.array_join(words, "")).alias("of_words"))


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than `indel_ratio` of the texts that these are the `letters` of: a common subsequence has letters of both."""
    both = a["size"] + b["size"]
    return F.when(both == 0, F.lit(100.0)).otherwise(200.0 * F.size(F.array_intersect(a["all"], b["all"])) / both)


def set_ratio_bound(a: Column, b: Column) -> Column:
    """No less than `token_set_ratio` of the texts that these are the `letters` of: the same ratios, with letters in common for the common subsequence."""
    x, y = a["words"], b["words"]
    shared, only_x, only_y = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    s, n, m = (F.length(F.array_join(w, " ")) for w in (shared, only_x, only_y))
    spaces = F.greatest(F.least(F.size(only_x), F.size(only_y)) - 1, F.lit(0))
    # shared words have all their letters in common
    common = F.size(F.array_intersect(a["of_words"], b["of_words"])) - F.length(F.array_join(shared, "")) + spaces
    gap = F.when(s > 0, 1).otherwise(0)
    share = lambda apart, whole: 100.0 - 100.0 * apart / F.greatest(whole, F.lit(1))
    apart = share(n + m - 2 * common, s + gap + n + s + gap + m)
    with_shared = F.when((n == 0) | (m == 0), F.lit(100.0)).otherwise(F.greatest(apart, share(gap + n, s + s + gap + n), share(gap + m, s + s + gap + m)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(s > 0, with_shared).otherwise(apart)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of letters and digits, each with two spaces before and one after."""
    found = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(padded))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 where neither side has any."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / every)
