"""Running weights over the distinct values of a whole table, and values at given ranks, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklex.plans.scratch import Scratch


def running_weights(values: DataFrame) -> DataFrame:
    """``v``, ``w``, ``c``, ``t`` of ``values`` (v, w) whose ``v`` are distinct: the weight of all values up to this one and
    of all. Values are partitioned by ranges; a row a partition carries the weight before it."""
    parts = Scratch(values.sparkSession, "ranks").save(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranged")
    sums = parts.groupBy("part").agg(F.sum("w").alias("s"))
    w = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a partition
    before = sums.select("part", F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("b"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("t"))
    local = F.sum("w").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "part").select("v", "w", (local + F.col("b")).alias("c"), "t")


def percentiles(rows: DataFrame, value: Column, shares: Sequence[float]) -> DataFrame:
    """One row with ``q``, the linear percentiles of all values that are not null; nulls without a value."""
    counted = rows.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("w"))
    r = running_weights(counted)
    at = lambda rank: F.min(F.when(F.col("c") > rank, F.col("v")))
    place = lambda q: (F.col("t") - 1) * F.lit(float(q))
    found = r.agg(F.max("t").alias("t"), *[f(at(g(place(q)))) for i, q in enumerate(shares) for f, g in ((lambda x, i=i: x.alias(f"lo{i}"), F.floor), (lambda x, i=i: x.alias(f"hi{i}"), F.ceil))])
    part = lambda q: place(q) - F.floor(place(q))
    return found.select(F.array(*[F.when(part(q) == 0, F.col(f"lo{i}")).otherwise((1 - part(q)) * F.col(f"lo{i}") + part(q) * F.col(f"hi{i}")) for i, q in enumerate(shares)]).alias("q"))
