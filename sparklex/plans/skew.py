"""Joins that keep a hot key from becoming one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it has over one of so many rows; there are fewer hot keys than that, so they are broadcast.
SHARE = 1_000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``big`` joined with ``small``, which holds every key once, with the number of ``big``'s rows of that key in ``n``.

    Rows of hot keys stay where they are and meet a broadcast of fewer than ``SHARE`` rows; the others are shuffled.
    ``total`` is the number of ``big``'s rows.
    """
    hot = small.where(F.col(n) * SHARE > total)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(n) * SHARE <= total), on)
    return big.join(F.broadcast(hot), on).unionByName(rest)
