"""Connected components by repeated contraction, DataFrame only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparklex.plans.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list; nodes of one component share a root.

    Each round points every node at its smallest neighbour, shortens those pointers twice, renames both ends of every
    edge to what they point at and drops the loops that arise. At least half of the unfinished nodes vanish a round, so
    the number of rounds is logarithmic in the longest chain. Nothing is collected: the driver sees row counts only.
    Null ends and loops in the input are ignored; an empty input gives an empty table.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    live = scratch.save(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        step = live.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        step = scratch.save(step, "step")
        for _ in range(2):
            up = step.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            nxt = scratch.save(step.join(up, "p").select("a", F.col("pp").alias("p")), "jump")
            scratch.drop(step)
            step = nxt
        if labels is None:
            new = scratch.save(step.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels")
        else:
            to = step.select(F.col("a").alias("root"), F.col("p").alias("top"))
            new = labels.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            new = scratch.save(new, "labels")
            scratch.drop(labels)
        labels = new
        pa = step.select("a", F.col("p").alias("pa"))
        pb = step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        nxt = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        nxt = scratch.save(nxt.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        scratch.drop(live)
        scratch.drop(step)
        live = nxt
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
