"""Regression metrics: weighted kernel means in one aggregation, with grouping columns.

``outputs`` metrics take one pair of columns; for several outputs call them with each pair, or with array columns
through ``per_output``. Inputs must be finite. Two-pass metrics (R2, explained variance) join the means of the first
pass back by group, so that centred sums are not lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklex.operators._common import finite, grouped, undefined, weight_of
from sparklex.plans.ranks import percentiles, running_weights

EPS = 2.0**-52


def _rows(df: DataFrame, t: str, p: str, weight: str | None, by: Sequence[str]) -> DataFrame:
    return df.select(*by, finite(F.col(t), t).alias("t"), finite(F.col(p), p).alias("p"), weight_of(weight).alias("w"))


def _mean(df: DataFrame, t: str, p: str, kernel, weight: str | None, by: Sequence[str], root: bool = False) -> DataFrame:
    rows = _rows(df, t, p, weight, by)
    m = F.sum(F.col("w") * kernel(F.col("t"), F.col("p"))) / F.sum("w")
    return grouped(rows, by).agg((F.sqrt(m) if root else m).alias("value"))


def per_output(df: DataFrame, t: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Array columns of targets and predictions as rows ``(by, output, t, p, w)``; use ``by=[..., "output"]`` on it."""
    z = F.posexplode(F.arrays_zip(F.col(t).alias("t"), F.col(p).alias("p"))).alias("output", "z")
    return df.select(*by, weight_of(weight).alias("w"), z).select(*by, "output", F.col("z.t").alias("t"), F.col("z.p").alias("p"), "w")


def mse(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: (a - b) * (a - b), weight, by)


def rmse(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: (a - b) * (a - b), weight, by, True)


def mae(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: F.abs(a - b), weight, by)


def mape(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.lit(EPS)), weight, by)


def _log1p(x: Column) -> Column:
    return F.when(x <= -1, F.raise_error(F.lit("logarithmic errors need values above -1")).cast("double")).otherwise(F.log1p(x))


def msle(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: (_log1p(a) - _log1p(b)) * (_log1p(a) - _log1p(b)), weight, by)


def rmsle(df, t, p, weight=None, by=()):
    return _mean(df, t, p, lambda a, b: (_log1p(a) - _log1p(b)) * (_log1p(a) - _log1p(b)), weight, by, True)


def pinball(df, t, p, alpha: float = 0.5, weight=None, by=()):
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    return _mean(df, t, p, lambda a, b: F.greatest(alpha * (a - b), (alpha - 1) * (a - b)), weight, by)


def max_error(df, t, p, by=()):
    return grouped(_rows(df, t, p, None, by), by).agg(F.max(F.abs(F.col("t") - F.col("p"))).alias("value"))


def _deviance(power: float):
    bad = lambda ok, x: F.when(ok, x).otherwise(F.raise_error(F.lit(f"a value is outside the domain of power {power}")).cast("double"))
    zero = F.lit(0.0)

    def kernel(t, p):
        if power < 0:
            return bad(p > 0, 2 * (F.pow(F.greatest(t, zero), 2 - power) / ((1 - power) * (2 - power)) - t * F.pow(p, 1 - power) / (1 - power) + F.pow(p, 2 - power) / (2 - power)))
        if power == 0:
            return (t - p) * (t - p)
        if power == 1:
            return bad((t >= 0) & (p > 0), 2 * (F.when(t > 0, t * F.log(t / p)).otherwise(zero) - t + p))
        if power == 2:
            return bad((t > 0) & (p > 0), 2 * (F.log(p / t) + t / p - 1))
        return bad(((t >= 0) if power < 2 else (t > 0)) & (p > 0), 2 * (F.pow(t, 2 - power) / ((1 - power) * (2 - power)) - t * F.pow(p, 1 - power) / (1 - power) + F.pow(p, 2 - power) / (2 - power)))

    return kernel


def tweedie(df, t, p, power: float = 0.0, weight=None, by=()):
    if 0 < power < 1:
        raise ValueError("there is no Tweedie distribution of a power between 0 and 1")
    return _mean(df, t, p, _deviance(power), weight, by)


def poisson(df, t, p, weight=None, by=()):
    return tweedie(df, t, p, 1.0, weight, by)


def gamma(df, t, p, weight=None, by=()):
    return tweedie(df, t, p, 2.0, weight, by)


def _attach(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group statistics beside the rows; without groups they are one row."""
    return rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))


def _explained(df, t, p, weight, by, centred: bool, force_finite: bool, zero_division: str, few: bool) -> DataFrame:
    rows = _rows(df, t, p, weight, by)
    w = F.col("w")
    stats = grouped(rows, by).agg((F.sum(w * F.col("t")) / F.sum("w")).alias("mt"), (F.sum(w * (F.col("t") - F.col("p"))) / F.sum("w")).alias("mr"), F.count("*").alias("n"))
    r = F.col("t") - F.col("p") - (F.col("mr") if centred else F.lit(0.0))
    d = F.col("t") - F.col("mt")
    s = grouped(_attach(rows, stats, by), by).agg(F.sum(w * r * r).alias("num"), F.sum(w * d * d).alias("den"), F.first("n").alias("n"))
    num, den = F.col("num"), F.col("den")
    flat = (F.when(num == 0, 1.0).otherwise(0.0)) if force_finite else F.when(num == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    value = F.when(den == 0, flat).otherwise(1 - num / den)
    if few:
        value = F.when(F.col("n") < 2, undefined(zero_division)).otherwise(value)
    return s.select(*by, value.alias("value"), den.alias("variance"))


def r2(df, t, p, weight=None, by=(), force_finite: bool = True, zero_division: str = "nan") -> DataFrame:
    """``value`` and ``variance``, the weighted squared deviation that ``variance_weighted`` uses."""
    return _explained(df, t, p, weight, by, False, force_finite, zero_division, True)


def explained_variance(df, t, p, weight=None, by=(), force_finite: bool = True) -> DataFrame:
    return _explained(df, t, p, weight, by, True, force_finite, "nan", False)


def variance_weighted(scores: DataFrame) -> DataFrame:
    """The mean of ``value`` over outputs weighted by ``variance``; a plain mean where all variances are 0."""
    s = scores.agg(F.sum(F.col("value") * F.col("variance")).alias("a"), F.sum("variance").alias("b"), F.avg("value").alias("m"))
    return s.select(F.when(F.col("b") == 0, F.col("m")).otherwise(F.col("a") / F.col("b")).alias("value"))


def quantile(rows: DataFrame, value: str, q: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``q``-quantile by group. Unweighted: the linear percentile, exact. Weighted: the mean of the lower value (first
    whose running weight reaches ``q``) and the upper one (first whose running weight passes ``q`` by over 2^-52).

    Equal values are summed before the running sum, so a window holds distinct values only; without groups the distinct
    values are spread over ranges.
    """
    if weight is None:
        return grouped(rows, by).agg(F.percentile(value, F.lit(q)).alias("value")) if by else percentiles(rows, F.col(value), [q]).select(F.col("q")[0].alias("value"))
    g = rows.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight_of(weight)).alias("w")).where("w > 0")
    if by:
        g = g.withColumn("c", F.sum("w").over(Window.partitionBy(*by).orderBy("v")) / F.sum("w").over(Window.partitionBy(*by)))
    else:
        g = running_weights(g).withColumn("c", F.col("c") / F.col("t"))
    out = grouped(g, by).agg(F.min(F.when(F.col("c") >= q - EPS, F.col("v"))).alias("lo"), F.min(F.when(F.col("c") - q > EPS, F.col("v"))).alias("hi"), F.max("v").alias("top"))
    return out.select(*by, ((F.coalesce("lo", "top") + F.coalesce("hi", "top")) / 2).alias("value"))


def median_ae(df, t, p, weight=None, by=()):
    rows = _rows(df, t, p, weight, by).withColumn("e", F.abs(F.col("t") - F.col("p")))
    return quantile(rows, "e", 0.5, "w" if weight else None, by)


def d2_tweedie(df, t, p, power: float = 0.0, weight=None, by=(), zero_division: str = "nan"):
    """1 less the deviance over that of the mean; a constant truth is refused."""
    rows = _rows(df, t, p, weight, by)
    w, kernel = F.col("w"), _deviance(power)
    stats = grouped(rows, by).agg((F.sum(w * F.col("t")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    s = grouped(_attach(rows, stats, by), by).agg(F.sum(w * kernel(F.col("t"), F.col("p"))).alias("a"), F.sum(w * kernel(F.col("t"), F.col("m"))).alias("b"), F.first("n").alias("n"))
    flat = F.raise_error(F.lit("the deviance of the mean is zero")).cast("double")
    return s.select(*by, F.when(F.col("n") < 2, undefined(zero_division)).when(F.col("b") == 0, flat).otherwise(1 - F.col("a") / F.col("b")).alias("value"))


def d2_pinball(df, t, p, alpha: float = 0.5, weight=None, by=(), zero_division: str = "nan"):
    """1 less the pinball loss over that of the quantile; 0 where that one is 0."""
    rows = _rows(df, t, p, weight, by)
    loss = lambda a, b: F.greatest(alpha * (a - b), (alpha - 1) * (a - b))
    stats = quantile(rows, "t", alpha, "w" if weight else None, by).withColumnRenamed("value", "q")
    s = grouped(_attach(rows, stats, by), by).agg(F.sum(F.col("w") * loss(F.col("t"), F.col("p"))).alias("a"), F.sum(F.col("w") * loss(F.col("t"), F.col("q"))).alias("b"), F.count("*").alias("n"))
    return s.select(*by, F.when(F.col("n") < 2, undefined(zero_division)).when(F.col("b") == 0, 0.0).otherwise(1 - F.col("a") / F.col("b")).alias("value"))


def d2_absolute(df, t, p, weight=None, by=(), zero_division: str = "nan"):
    return d2_pinball(df, t, p, 0.5, weight, by, zero_division)
