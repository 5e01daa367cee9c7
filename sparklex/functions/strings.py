"""String distances, similarities and fuzzy scorers as Column functions.

Levenshtein and Hamming are native expressions; the others are Arrow-batched kernels, which remember pairs within a task,
so pairs that come often are best dealt out by both texts. The unit of comparison is the code point; ``unit="utf16"``
counts UTF-16 code units instead. Array columns compare element by element. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

from sparklex.functions import kernels as K

#: So many pairs are remembered at most, of at most so many symbols together.
REMEMBERED, SHORT = 50_000, 512


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kernel_udf(kernel, kind: DataType, unit: str = "codepoint"):
    """A two-column function from a pure-Python kernel."""
    if unit not in ("codepoint", "utf16"):
        raise ValueError("unit must be codepoint or utf16")
    prepare = K.utf16 if unit == "utf16" else (lambda x: x if isinstance(x, str) else tuple(x))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen: dict = {}
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                if x is None or y is None:
                    out.append(None)
                    continue
                x, y = prepare(x), prepare(y)
                value = seen.get((x, y))
                if value is None:
                    value = kernel(x, y)
                    if len(x) + len(y) <= SHORT:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[x, y] = value
                out.append(value)
            yield pd.Series(out, dtype="object")

    run.__name__ = getattr(kernel, "__name__", "kernel")
    udf = F.pandas_udf(run, kind)
    return lambda a, b: udf(_col(a), _col(b))


def _longest(a, b) -> Column:
    return F.greatest(F.length(_col(a)), F.length(_col(b)))


def _share(d: Column, n: Column, empty: float) -> Column:
    return F.when(n == 0, empty).otherwise(d / n).cast("double")


def levenshtein(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b))


def levenshtein_normalized_distance(a, b) -> Column:
    return _share(levenshtein(a, b), _longest(a, b), 0.0)


def levenshtein_normalized_similarity(a, b) -> Column:
    return 1 - levenshtein_normalized_distance(a, b)


def hamming(a, b) -> Column:
    """Differing positions and the gap in length."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.abs(F.length(a) - F.length(b)) + F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def hamming_normalized_similarity(a, b) -> Column:
    return 1 - _share(hamming(a, b), _longest(a, b), 0.0)


def osa(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.osa, IntegerType(), unit)(a, b)


def damerau_levenshtein(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.damerau, IntegerType(), unit)(a, b)


def indel(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.indel, IntegerType(), unit)(a, b)


def lcs_subsequence(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.lcs_length, IntegerType(), unit)(a, b)


def lcs_substring(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.common_substring, IntegerType(), unit)(a, b)


def levenshtein_tokens(a, b) -> Column:
    """Levenshtein distance of two array columns."""
    return kernel_udf(K.levenshtein, IntegerType())(a, b)


def normalized_distance(distance: Column, a, b, total: bool = False) -> Column:
    """A distance over the longer length, or over both lengths with ``total`` (Indel); two empties give 0."""
    n = F.length(_col(a)) + F.length(_col(b)) if total else _longest(a, b)
    return _share(distance, n, 0.0)


def normalized_similarity(distance: Column, a, b, total: bool = False) -> Column:
    return 1 - normalized_distance(distance, a, b, total)


def jaro(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.jaro, DoubleType(), unit)(a, b)


def jaro_distance(a, b, unit: str = "codepoint") -> Column:
    return 1 - jaro(a, b, unit)


def jaro_winkler(a, b, weight: float = 0.1, unit: str = "codepoint") -> Column:
    return kernel_udf(lambda x, y: K.jaro_winkler(x, y, weight), DoubleType(), unit)(a, b)


def jaro_winkler_distance(a, b, weight: float = 0.1, unit: str = "codepoint") -> Column:
    return 1 - jaro_winkler(a, b, weight, unit)


def ratcliff_obershelp(a, b, unit: str = "codepoint") -> Column:
    return kernel_udf(K.ratcliff, DoubleType(), unit)(a, b)


def fuzz(scorer: str, a, b) -> Column:
    """A fuzzy scorer by name, 0 to 100: see ``kernels.SCORERS``."""
    return kernel_udf(K.SCORERS[scorer], DoubleType())(a, b)
