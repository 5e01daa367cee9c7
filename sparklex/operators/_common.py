"""Small helpers shared by the metric operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ZERO_DIVISION = ("zero", "one", "nan", "throw")


def undefined(policy: str) -> Column:
    """What an undefined ratio becomes: 0, 1, NaN or an error at run time."""
    if policy not in ZERO_DIVISION:
        raise ValueError(f"zero_division must be one of {ZERO_DIVISION}")
    if policy == "throw":
        return F.raise_error(F.lit("undefined metric: the denominator is zero")).cast("double")
    return F.lit({"zero": 0.0, "one": 1.0, "nan": float("nan")}[policy])


def ratio(num: Column, den: Column, policy: str = "zero") -> Column:
    return F.when(den != 0, num / den).otherwise(undefined(policy)).cast("double")


def weight_of(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))


def grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def finite(c: Column, what: str) -> Column:
    """``c``, or an error at run time where it is null, NaN or infinite."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} must be finite")).cast("double")).otherwise(c)
