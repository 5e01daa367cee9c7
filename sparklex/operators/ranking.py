"""Ranking metrics over rows of (query, item, relevance, score), all in windows and groups of a query.

The position of an item in its query breaks score ties: the later one ranks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklex.operators._common import weight_of


def _discount(rank: Column, k: int | None, log_base: float) -> Column:
    d = F.log(F.lit(log_base)) / F.log(rank + 1)
    return d if k is None else F.when(rank <= k, d).otherwise(0.0)


def dcg(df: DataFrame, query: str, item: str, relevance: str, score: str, k: int | None = None, log_base: float = 2.0, ignore_ties: bool = False) -> DataFrame:
    """``query``, ``value``. Tied items share the mean of their gains unless ``ignore_ties``."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item).desc())
    rows = df.select(query, item, F.col(relevance).cast("double").alias("g"), score).withColumn("d", _discount(F.row_number().over(order), k, log_base))
    if not ignore_ties:
        rows = rows.groupBy(query, score).agg(F.avg("g").alias("g"), F.sum("d").alias("d"))
    return rows.groupBy(query).agg(F.sum(F.col("g") * F.col("d")).alias("value"))


def ndcg(df: DataFrame, query: str, item: str, relevance: str, score: str, k: int | None = None, ignore_ties: bool = False) -> DataFrame:
    """DCG over that of the ideal order, whose ties are never shared; 0 where the ideal is 0. Negative relevance is
    refused, as is a query of one item."""
    rel = F.col(relevance).cast("double")
    ok = F.when(rel < 0, F.raise_error(F.lit("relevance must not be negative")).cast("double")).otherwise(rel)
    rows = df.withColumn("_rel", ok)
    got = dcg(rows, query, item, "_rel", score, k, 2.0, ignore_ties)
    best = dcg(rows, query, item, "_rel", "_rel", k, 2.0, True).withColumnRenamed("value", "best")
    n = rows.groupBy(query).agg(F.count("*").alias("n"))
    few = F.raise_error(F.lit("NDCG needs two items a query")).cast("double")
    out = got.join(best, query).join(n, query)
    return out.select(query, F.when(F.col("n") < 2, few).when(F.col("best") <= 0, 0.0).otherwise(F.col("value") / F.col("best")).alias("value"))


def reciprocal_rank(df: DataFrame, query: str, item: str, relevance: str, score: str) -> DataFrame:
    """One over the rank of the first relevant item, 0 without one."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item).desc())
    rows = df.select(query, F.col(relevance).alias("g"), F.row_number().over(order).alias("r"))
    return rows.groupBy(query).agg(F.coalesce(1 / F.min(F.when(F.col("g") != 0, F.col("r"))), F.lit(0.0)).alias("value"))


def mean_over(values: DataFrame, weight: str | None = None) -> DataFrame:
    """The weighted mean of ``value``; weights that sum to 0 are refused."""
    s = values.agg(F.sum(F.col("value") * weight_of(weight)).alias("a"), F.sum(weight_of(weight)).alias("b"))
    bad = F.raise_error(F.lit("the weights sum to zero")).cast("double")
    return s.select(F.when(F.col("b") == 0, bad).otherwise(F.col("a") / F.col("b")).alias("value"))


def _label_ranks(df: DataFrame, sample: str, relevant: str, score: str) -> DataFrame:
    """Per row the number of labels scored at least as high (``r``), of relevant ones among them (``rr``), and the
    sample's counts."""
    own = Window.partitionBy(sample)
    up = own.orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, 0)
    hit = F.col(relevant).cast("int")
    return df.select(sample, hit.alias("hit"), F.col(score).alias("s"), F.count("*").over(up).alias("r"), F.sum(hit).over(up).alias("rr"), F.sum(hit).over(own).alias("p"), F.count("*").over(own).alias("l"))


def coverage_error(df: DataFrame, sample: str, relevant: str, score: str) -> DataFrame:
    """``sample``, ``value``: how far down the ranking the last relevant label is; 0 without one."""
    rows = _label_ranks(df, sample, relevant, score)
    return rows.groupBy(sample).agg(F.coalesce(F.max(F.when(F.col("hit") == 1, F.col("r"))), F.lit(0)).cast("double").alias("value"))


def label_ranking_average_precision(df: DataFrame, sample: str, relevant: str, score: str) -> DataFrame:
    """``sample``, ``value``; 1 where all labels or none are relevant."""
    rows = _label_ranks(df, sample, relevant, score)
    v = F.avg(F.when(F.col("hit") == 1, F.col("rr") / F.col("r")))
    return rows.groupBy(sample).agg(F.when((F.max("p") == 0) | (F.max("p") == F.max("l")), 1.0).otherwise(v).alias("value"))


def label_ranking_loss(df: DataFrame, sample: str, relevant: str, score: str) -> DataFrame:
    """``sample``, ``value``: the share of (relevant, irrelevant) pairs in the wrong order, ties included."""
    rows = _label_ranks(df, sample, relevant, score)
    wrong = F.sum(F.when(F.col("hit") == 1, F.col("r") - F.col("rr")).otherwise(0))
    n = F.max("p") * (F.max("l") - F.max("p"))
    return rows.groupBy(sample).agg(F.when(n == 0, 0.0).otherwise(wrong / n).alias("value"))
