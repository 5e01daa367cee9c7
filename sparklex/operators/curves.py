"""Score curves and areas: ROC, precision-recall, detection error trade-off, average precision.

Rows are first summed by distinct score (map-side combined), which is also how ties are defined; running sums then go
over distinct scores. Within a group (``by``, a class) a window does that. Without a group, ``running`` uses a prefix
sum in two levels: scores are range-partitioned, each partition is summed, the few partition totals give offsets and
the rest is local, so no task ever holds all scores. NaN scores are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparklex.operators._common import grouped, weight_of
from sparklex.plans.scratch import Scratch


def by_score(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``s``, ``pos``, ``neg``: the weights at every distinct score."""
    s = F.col(score).cast("double")
    s = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("scores must be numbers")).cast("double")).otherwise(s)
    hit, w = F.col(y_true) == pos_label, weight_of(weight)
    rows = df.select(*by, s.alias("s"), F.when(hit, w).otherwise(0.0).alias("pos"), F.when(hit, 0.0).otherwise(w).alias("neg"), w.alias("w")).where("w <> 0")
    return rows.groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def running(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``tp`` and ``fp``, sums over all scores at least as high, and ``next_pos`` and ``next_neg``, the
    weights at the next lower score (null at the last)."""
    if by:
        o = Window.partitionBy(*by).orderBy(F.col("s").desc())
        w = o.rowsBetween(Window.unboundedPreceding, 0)
        return points.select("*", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.lead("pos").over(o).alias("next_pos"), F.lead("neg").over(o).alias("next_neg"))
    scratch = Scratch(points.sparkSession, "curve")
    parts = scratch.save(points.repartitionByRange(F.col("s").desc()).withColumn("part", F.spark_partition_id()), "ranged")
    totals = parts.groupBy("part").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"), F.max_by(F.struct("pos", "neg"), "s").alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("a").over(before), F.lit(0.0)).alias("a"), F.coalesce(F.sum("b").over(before), F.lit(0.0)).alias("b"), F.lead("first").over(order).alias("follows"),
    )  # one row a partition
    o = Window.partitionBy("part").orderBy(F.col("s").desc())
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "part")
    follows = lambda c: F.coalesce(F.lead(c).over(o), F.col(f"follows.{c}")).alias(f"next_{c}")
    return out.select("s", "pos", "neg", (F.sum("pos").over(w) + F.col("a")).alias("tp"), (F.sum("neg").over(w) + F.col("b")).alias("fp"), follows("pos"), follows("neg"))


def _totals(points: DataFrame, by: Sequence[str]) -> DataFrame:
    t = grouped(points, by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return points.join(t, list(by)) if by else points.crossJoin(F.broadcast(t))  # one row


def roc_auc(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Tie-grouped trapezoid over P·N; a single class is refused."""
    p = running(by_score(df, y_true, score, pos_label, weight, by), by)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    s = grouped(p, by).agg(area.alias("_area"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    one = F.raise_error(F.lit("ROC-AUC needs both classes")).cast("double")
    return s.select(*by, F.when((F.col("_pos") == 0) | (F.col("_neg") == 0), one).otherwise(F.col("_area") / (F.col("_pos") * F.col("_neg"))).alias("value"))


def average_precision(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall gains times precision; 0 without positives."""
    p = running(by_score(df, y_true, score, pos_label, weight, by), by)
    s = grouped(p, by).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_area"), F.sum("pos").alias("_pos"))
    return s.select(*by, F.when(F.col("_pos") == 0, 0.0).otherwise(F.col("_area") / F.col("_pos")).alias("value"))


def _kept(points: DataFrame, rule: str) -> DataFrame:
    """Points that bend the curve; ``rule`` is ``roc`` (one step differs from the next) or ``tp`` (true positives change).
    The steps are weights at a score and the next, so that no task needs to hold a curve."""
    ends = F.col("next_pos").isNull() | ((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")) if rule == "roc" else (F.col("pos") != 0) | (F.col("next_pos") != 0)
    return points.where(ends | bends)


def roc_curve(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, drop_intermediate: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``threshold``, ``fpr``, ``tpr`` from the infinite threshold on; the rate of an absent class is NaN."""
    p = running(by_score(df, y_true, score, pos_label, weight, by), by)
    if drop_intermediate:
        p = _kept(p, "roc")
    p = p.select(*by, "s", "tp", "fp")
    top = (p.select(*by).distinct() if by else p.sparkSession.range(1).select()).select(*by, F.lit(float("inf")).alias("s"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"))
    t = grouped(p, by).agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    p = p.unionByName(top)
    p = p.join(t, list(by)) if by else p.crossJoin(F.broadcast(t))  # one row
    rate = lambda a, b: F.when(F.col(b) == 0, float("nan")).otherwise(F.col(a) / F.col(b))
    return p.select(*by, F.col("s").alias("threshold"), rate("fp", "N").alias("fpr"), rate("tp", "P").alias("tpr"))


def precision_recall_curve(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, drop_intermediate: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``threshold``, ``precision``, ``recall``; the closing point (1, 0) has no threshold. Recall is 1 without positives."""
    p = running(by_score(df, y_true, score, pos_label, weight, by), by)
    if drop_intermediate:
        p = _kept(p, "tp")
    t = grouped(p, by).agg(F.max("tp").alias("P"))
    q = p.join(t, list(by)) if by else p.crossJoin(F.broadcast(t))  # one row
    q = q.select(*by, F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("P") == 0, 1.0).otherwise(F.col("tp") / F.col("P")).alias("recall"))
    end = (p.select(*by).distinct() if by else p.sparkSession.range(1).select()).select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return q.unionByName(end)


def det_curve(df: DataFrame, y_true: str, score: str, pos_label=1, weight: str | None = None, drop_intermediate: bool = False) -> DataFrame:
    """``threshold``, ``fpr``, ``fnr`` without the run of no false positives at the strict end (its last point stays)
    and what follows the first point of all true positives."""
    p = running(by_score(df, y_true, score, pos_label, weight))
    if drop_intermediate:
        p = _kept(p, "tp")
    p = p.select("s", "tp", "fp").unionByName(p.sparkSession.range(1).select(F.lit(float("inf")).alias("s"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp")))
    t = p.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    q = p.crossJoin(F.broadcast(t))  # one row
    e = q.agg(F.min(F.when(F.col("fp") == 0, F.col("s"))).alias("first"), F.max(F.when(F.col("tp") == F.col("P"), F.col("s"))).alias("last"))
    q = q.crossJoin(F.broadcast(e)).where("s <= first and s >= last")
    return q.select(F.col("s").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), ((F.col("P") - F.col("tp")) / F.col("P")).alias("fnr"))


def auc_trapezoid(df: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """The area under points in the order of ``order``; x must be monotone. Points are partitioned by ranges of it, and
    the first of each range takes the last of the range before from a row a partition."""
    points = df.select(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    points = Scratch(df.sparkSession, "area").save(points, "ranged")
    last = points.groupBy("part").agg(F.max_by(F.struct("x", "y"), "o").alias("end"))
    last = last.select("part", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("end"))  # one row a partition
    w = Window.partitionBy("part").orderBy("o")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(f"end.{c}"))
    d = points.join(F.broadcast(last), "part").select((F.col("x") - before("x")).alias("dx"), ((F.col("y") + before("y")) / 2).alias("m"))
    s = d.agg(F.sum(F.col("dx") * F.col("m")).alias("a"), F.min("dx").alias("lo"), F.max("dx").alias("hi"), F.count("*").alias("n"))
    bad = F.raise_error(F.lit("the area needs two points and a monotone x")).cast("double")
    return s.select(F.when((F.col("n") < 2) | ((F.col("lo") < 0) & (F.col("hi") > 0)), bad).when(F.col("hi") <= 0, -F.col("a")).otherwise(F.col("a")).alias("value"))


def _exploded(df: DataFrame, y_true: str, scores: str, weight: str | None) -> DataFrame:
    return df.select(F.col(y_true).alias("y"), weight_of(weight).alias("w"), F.posexplode(scores).alias("c", "s"))


def positions(df: DataFrame, y_true: str, labels: Sequence) -> DataFrame:
    """``df`` with ``y_true`` as its place in ``labels``, the order of the score columns; another label is refused."""
    if len(set(labels)) != len(labels) or len(labels) < 2:
        raise ValueError("labels must be distinct, and at least two")
    at = F.array_position(F.array(*[F.lit(x).cast(df.schema[y_true].dataType) for x in labels]), F.col(y_true))
    bad = F.raise_error(F.lit("a label is not among those given")).cast("int")
    return df.withColumn(y_true, F.when(F.coalesce(at, F.lit(0)) > 0, at.cast("int") - 1).otherwise(bad))


def roc_auc_ovr(df: DataFrame, y_true: str, scores: str, average: str = "macro", weight: str | None = None, labels: Sequence | None = None) -> DataFrame:
    """One class against the rest, ``scores`` an array of probabilities; ``macro`` or ``weighted`` by prevalence.

    ``y_true`` is the class's place in the array, or one of ``labels`` in that order.
    """
    df = df if labels is None else positions(df, y_true, labels)
    rows = _exploded(_sums_to_one(df, scores), y_true, scores, weight).withColumn("hit", (F.col("y") == F.col("c")).cast("int"))
    each = roc_auc(rows, "hit", "s", 1, "w", ["c"])
    if average == "macro":
        return each.agg(F.avg("value").alias("value"))
    share = rows.where("hit = 1").groupBy("c").agg(F.sum("w").alias("p"))
    return each.join(share, "c").agg((F.sum(F.col("value") * F.col("p")) / F.sum("p")).alias("value"))


def roc_auc_ovo(df: DataFrame, y_true: str, scores: str, average: str = "macro", labels: Sequence | None = None) -> DataFrame:
    """Every pair of classes in both directions, on the samples of those two; ``weighted`` by the pair's prevalence.
    ``labels`` as above."""
    df = df if labels is None else positions(df, y_true, labels)
    base = _sums_to_one(df, scores).select(F.col(y_true).alias("y"), F.col(scores).alias("q"))
    k = F.size("q")
    others = F.filter(F.sequence(F.lit(0), k - 1), lambda i: i != F.col("y"))
    rows = base.select("y", "q", F.explode(others).alias("o"))
    rows = rows.select(F.least("y", "o").alias("a"), F.greatest("y", "o").alias("b"), "y", "q")
    two = F.explode(F.array(F.struct(F.lit(0).alias("d"), (F.col("y") == F.col("a")).cast("int").alias("hit"), F.get("q", F.col("a")).alias("s")), F.struct(F.lit(1).alias("d"), (F.col("y") == F.col("b")).cast("int").alias("hit"), F.get("q", F.col("b")).alias("s"))))
    rows = rows.select("a", "b", two.alias("z")).select("a", "b", "z.d", "z.hit", "z.s")
    each = roc_auc(rows, "hit", "s", 1, None, ["a", "b", "d"]).groupBy("a", "b").agg(F.avg("value").alias("value"))
    if average == "macro":
        return each.agg(F.avg("value").alias("value"))
    share = rows.where("d = 0").groupBy("a", "b").agg(F.count("*").alias("p"))
    return each.join(share, ["a", "b"]).agg((F.sum(F.col("value") * F.col("p")) / F.sum("p")).alias("value"))


def _sums_to_one(df: DataFrame, scores: str) -> DataFrame:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    bad = F.raise_error(F.lit("class probabilities must sum to 1")).cast(df.schema[scores].dataType)
    return df.withColumn(scores, F.when(F.abs(total - 1) <= 1e-8 + 1e-5, F.col(scores)).otherwise(bad))


def average_precision_multilabel(df: DataFrame, flags: str, scores: str, average: str = "macro", weight: str | None = None) -> DataFrame:
    """``flags`` and ``scores`` are arrays by label; ``none`` gives one value a label."""
    z = F.posexplode(F.arrays_zip(F.col(flags).alias("f"), F.col(scores).alias("s"))).alias("label", "z")
    rows = df.select(weight_of(weight).alias("w"), z).select("w", "label", F.col("z.f").cast("int").alias("f"), F.col("z.s").alias("s"))
    if average == "micro":
        return average_precision(rows, "f", "s", 1, "w")
    each = average_precision(rows, "f", "s", 1, "w", ["label"])
    if average == "none":
        return each
    if average == "macro":
        return each.agg(F.avg("value").alias("value"))
    share = rows.where("f = 1").groupBy("label").agg(F.sum("w").alias("p"))
    s = each.join(share, "label", "left").agg(F.sum(F.col("value") * F.col("p")).alias("a"), F.sum("p").alias("b"))
    return s.select(F.when(F.coalesce("b", F.lit(0.0)) == 0, 0.0).otherwise(F.col("a") / F.col("b")).alias("value"))
