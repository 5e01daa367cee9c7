"""Set similarity over multisets of character q-grams, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qgrams(s, q: int) -> Column:
    """The q-grams of a string in order; none where it is shorter."""
    if q < 1:
        raise ValueError("q must be at least 1")
    return F.regexp_extract_all(_col(s), F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))


def _bag(a, b, q: int, formula) -> Column:
    """``formula`` of the bags' sizes and the size of their intersection, each q-gram array built once."""
    pair = F.array(F.struct(qgrams(a, q).alias("x"), qgrams(b, q).alias("y")))

    def one(p):
        count = lambda bag, g: F.size(F.filter(bag, lambda v: v == g))
        both = F.aggregate(F.array_intersect(p["x"], p["y"]), F.lit(0), lambda acc, g: acc + F.least(count(p["x"], g), count(p["y"], g)))
        return formula(both.cast("double"), F.size(p["x"]).cast("double"), F.size(p["y"]).cast("double"))

    null = _col(a).isNull() | _col(b).isNull()
    return F.when(~null, F.element_at(F.transform(pair, one), 1))


def jaccard(a, b, q: int = 2) -> Column:
    return _bag(a, b, q, lambda i, x, y: F.when(x + y == 0, 1.0).otherwise(i / (x + y - i)))


def sorensen_dice(a, b, q: int = 2) -> Column:
    return _bag(a, b, q, lambda i, x, y: F.when(x + y == 0, 1.0).otherwise(2 * i / (x + y)))


def overlap(a, b, q: int = 2) -> Column:
    return _bag(a, b, q, lambda i, x, y: F.when(x + y == 0, 1.0).when((x == 0) | (y == 0), 0.0).otherwise(i / F.least(x, y)))


def cosine(a, b, q: int = 2) -> Column:
    return _bag(a, b, q, lambda i, x, y: F.when(x + y == 0, 1.0).when((x == 0) | (y == 0), 0.0).otherwise(i / F.sqrt(x * y)))


def tversky(a, b, q: int = 2, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """A zero denominator gives 1."""
    den = lambda i, x, y: i + alpha * (x - i) + beta * (y - i)
    return _bag(a, b, q, lambda i, x, y: F.when(den(i, x, y) == 0, 1.0).otherwise(i / den(i, x, y)))
