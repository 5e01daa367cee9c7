"""Fuzzy matching: top-k extraction from a list of choices, and blocked deduplication into clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklex.functions import strings as T
from sparklex.plans.components import connected_components
from sparklex.plans.scratch import Scratch

#: Choices that are broadcast at most; more are joined by a nested loop that Spark plans itself.
MAX_BROADCAST_CHOICES = 100_000


def extract(queries: DataFrame, choices: DataFrame, query_key: str, query: str, choice_key: str, choice: str, scorer: str | Callable[[Column, Column], Column] = "weighted_ratio", limit: int | None = 5, cutoff: float = 0.0) -> DataFrame:
    """``query_key``, ``choice_key``, ``choice``, ``score``, ``rank``: for each query the best choices.

    Every pair is scored once, by a scorer name or a function of two columns. Scores of at least ``cutoff`` stay, by
    score downwards, then ``choice_key``; ``limit`` None keeps all. For plain ``ratio`` pairs whose lengths alone rule
    the cutoff out are left before scoring.
    """
    score = scorer if callable(scorer) else (lambda a, b: T.fuzz(scorer, a, b))
    c = choices.select(F.col(choice_key).alias("_ck"), F.col(choice).alias("_c"))
    few = c.limit(MAX_BROADCAST_CHOICES + 1).count() <= MAX_BROADCAST_CHOICES
    q = queries.select(F.col(query_key).alias("_qk"), F.col(query).alias("_q"))
    pairs = q.crossJoin(F.broadcast(c) if few else c)  # the operator compares every query with every choice
    if scorer == "ratio" and cutoff > 0:
        a, b = F.length("_q"), F.length("_c")
        pairs = pairs.where((a + b == 0) | (200.0 * F.least(a, b) >= cutoff * (a + b)))
    rows = pairs.withColumn("score", score(F.col("_q"), F.col("_c"))).where(F.col("score") >= cutoff)
    order = Window.partitionBy("_qk").orderBy(F.col("score").desc(), "_ck")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    rows = rows if limit is None else rows.where(F.col("rank") <= limit)
    return rows.select(F.col("_qk").alias(query_key), F.col("_ck").alias(choice_key), F.col("_c").alias("choice"), "score", "rank")


def extract_one(queries: DataFrame, choices: DataFrame, query_key: str, query: str, choice_key: str, choice: str, scorer="weighted_ratio", cutoff: float = 0.0) -> DataFrame:
    """The best choice of each query; nulls where none reaches the cutoff."""
    best = extract(queries, choices, query_key, query, choice_key, choice, scorer, 1, cutoff).drop("rank")
    return queries.select(query_key).distinct().join(best, query_key, "left")


def find_clusters(df: DataFrame, key: str, block: Column, similarity: Callable[[str, str], Column], columns: list[str], threshold: float) -> DataFrame:
    """``key``, ``cluster``: the smallest key reachable over pairs of one block that are similar enough.

    ``similarity`` gets the names of a left and a right prefix, and builds a column from ``left + column`` and
    ``right + column``. Rows of a block whose ``columns`` are equal are compared once, as one; singletons are clusters.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    rows = scratch.save(df.select(F.col(key).alias("_k"), block.alias("_b"), *columns), "rows")
    reps = scratch.save(rows.groupBy("_b", *columns).agg(F.min("_k").alias("_r"), F.lit(1).alias("_one")), "distinct")
    a = reps.select("_b", F.col("_r").alias("a"), *[F.col(c).alias(f"l_{c}") for c in columns])
    b = reps.select("_b", F.col("_r").alias("b"), *[F.col(c).alias(f"r_{c}") for c in columns])
    pairs = a.join(b, "_b").where("a < b").where(similarity("l_", "r_") >= threshold).select("a", "b")
    roots = connected_components(pairs).select(F.col("node").alias("_r"), "root")
    heads = reps.select("_b", *columns, "_r").join(roots, "_r", "left").withColumn("root", F.coalesce("root", "_r"))
    least = heads.groupBy("root").agg(F.min("_r").alias("cluster"))
    heads = heads.join(least, "root")
    on = [rows["_b"].eqNullSafe(heads["_b"]), *[rows[c].eqNullSafe(heads[c]) for c in columns]]
    return rows.join(heads, on).select(rows["_k"].alias(key), "cluster")
