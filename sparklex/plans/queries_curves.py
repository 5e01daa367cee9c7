"""Queries of the curves and ranking metrics with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklex.operators import curves as C, ranking as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines against a score with ties."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = (F.col("l_orderkey") * 7919 % 1000) / 1000.0 + F.when(F.col("l_returnflag") == "R", 0.15).otherwise(0.0)
    return t.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.round(s, 3).alias("s"), F.col("l_quantity").alias("w"), "l_linestatus", F.col("l_linenumber").alias("n"))


_S = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round((l_orderkey * 7919 % 1000) / 1000.0::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0.15::DOUBLE ELSE 0.0 END, 3) AS s, l_quantity AS w, l_linestatus, l_linenumber AS n FROM lineitem"
_one = lambda v: v.select(F.round("value", 6).alias("value"))


def _run(w: str = "1.0::DOUBLE", by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH g AS (SELECT {k}s, sum(y * {w})::DOUBLE AS pos, sum((1 - y) * {w})::DOUBLE AS neg FROM ({_S}) GROUP BY {k}s),
p AS (SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(neg) OVER ({part}ORDER BY s DESC) AS fp FROM g)"""


_AUC, _AP = "sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))", "sum(pos * tp / (tp + fp)) / sum(pos)"
_add("roc_auc", lambda s, d: _one(C.roc_auc(scored(s, d), "y", "s")), f"{_run()} SELECT round({_AUC}, 6) AS value FROM p")
_add("roc_auc_weighted_by", lambda s, d: C.roc_auc(scored(s, d), "y", "s", 1, "w", ["l_linestatus"]).withColumn("value", F.round("value", 6)), f"{_run('w', 'l_linestatus')} SELECT l_linestatus, round({_AUC}, 6) AS value FROM p GROUP BY 1")
_add("average_precision", lambda s, d: _one(C.average_precision(scored(s, d), "y", "s")), f"{_run()} SELECT round({_AP}, 6) AS value FROM p")
_add("average_precision_by", lambda s, d: C.average_precision(scored(s, d), "y", "s", 1, None, ["n"]).withColumn("value", F.round("value", 6)), f"{_run(by='n')} SELECT n, round({_AP}, 6) AS value FROM p GROUP BY n")
_r = lambda df, *cols: df.select(*[F.round(c, 6).alias(c) for c in cols])
_ROC = "UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0"
_add("roc_curve", lambda s, d: _r(C.roc_curve(scored(s, d), "y", "s", drop_intermediate=False), "threshold", "fpr", "tpr"), f"{_run()} SELECT s AS threshold, round(fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(tp / (SELECT sum(pos) FROM g), 6) AS tpr FROM p {_ROC}")
_DROP = "d AS (SELECT *, lag(tp) OVER w AS t0, lead(tp) OVER w AS t1, lag(fp) OVER w AS f0, lead(fp) OVER w AS f1 FROM p WINDOW w AS (ORDER BY s DESC))"
_add("roc_curve_dropped", lambda s, d: _r(C.roc_curve(scored(s, d), "y", "s"), "threshold", "fpr", "tpr"), f"{_run()}, {_DROP} SELECT s AS threshold, round(fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(tp / (SELECT sum(pos) FROM g), 6) AS tpr FROM d WHERE t0 IS NULL OR t1 IS NULL OR t0 + t1 <> 2 * tp OR f0 + f1 <> 2 * fp {_ROC}")
_PR = "SELECT s AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / (SELECT sum(pos) FROM g), 6) AS recall FROM"
_add("pr_curve", lambda s, d: _r(C.precision_recall_curve(scored(s, d), "y", "s"), "threshold", "precision", "recall"), f"{_run()} {_PR} p UNION ALL SELECT NULL, 1.0, 0.0")
_add("pr_curve_dropped", lambda s, d: _r(C.precision_recall_curve(scored(s, d), "y", "s", drop_intermediate=True), "threshold", "precision", "recall"), f"{_run()}, {_DROP} {_PR} d WHERE t0 IS NULL OR t1 IS NULL OR t0 <> tp OR t1 <> tp UNION ALL SELECT NULL, 1.0, 0.0")
_add("det_curve", lambda s, d: _r(C.det_curve(scored(s, d), "y", "s"), "threshold", "fpr", "fnr"), f"""{_run()}, q AS (SELECT s, tp, fp FROM p UNION ALL SELECT 'inf'::DOUBLE, 0, 0), e AS (SELECT max(tp) AS pp, max(fp) AS nn FROM q),
c AS (SELECT min(s) FILTER (fp = 0) AS a, max(s) FILTER (tp = pp) AS b FROM q, e) SELECT s AS threshold, round(fp / nn, 6) AS fpr, round((pp - tp) / pp, 6) AS fnr FROM q, e, c WHERE s <= a AND s >= b""")
_add("auc_trapezoid", lambda s, d: _one(C.auc_trapezoid(C.roc_curve(scored(s, d), "y", "s").withColumn("o", -F.col("threshold")), "fpr", "tpr", "o")), f"{_run()} SELECT round({_AUC}, 6) AS value FROM p")
_multi = lambda s, d: scored(s, d).select((F.col("n") - 1).alias("y"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(i == F.col("n"), 0.1 + F.col("s") / 8).otherwise((0.9 - F.col("s") / 8) / 6)).alias("q"))
_Q = f"SELECT n - 1 AS y, [CASE WHEN i = n THEN 0.1::DOUBLE + s / 8 ELSE (0.9::DOUBLE - s / 8) / 6 END FOR i IN range(1, 8)] AS q FROM ({_S})"
_OVR = f"""WITH e AS (SELECT y, unnest(q) AS s, unnest(range(0, 7)) AS c FROM ({_Q})), g AS (SELECT c, s, sum(CASE WHEN y = c THEN 1.0 ELSE 0.0 END)::DOUBLE AS pos, sum(CASE WHEN y = c THEN 0.0 ELSE 1.0 END)::DOUBLE AS neg FROM e GROUP BY c, s),
p AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY s DESC) AS tp FROM g), a AS (SELECT c, {_AUC} AS v, sum(pos) AS w FROM p GROUP BY c)"""
_add("roc_auc_ovr", lambda s, d: _one(C.roc_auc_ovr(_multi(s, d), "y", "q")), f"{_OVR} SELECT round(avg(v), 6) AS value FROM a")
_add("roc_auc_ovr_weighted", lambda s, d: _one(C.roc_auc_ovr(_multi(s, d), "y", "q", "weighted")), f"{_OVR} SELECT round(sum(v * w) / sum(w), 6) AS value FROM a")
_OVO = f"""WITH x AS ({_Q}), e AS (SELECT a, b, d, CASE WHEN y = (CASE WHEN d = 0 THEN a ELSE b END) THEN 1 ELSE 0 END AS hit, q[(CASE WHEN d = 0 THEN a ELSE b END) + 1] AS s
  FROM x, range(0, 7) AS r1(a), range(0, 7) AS r2(b), (VALUES (0), (1)) AS v(d) WHERE a < b AND (y = a OR y = b)),
g AS (SELECT a, b, d, s, sum(hit)::DOUBLE AS pos, sum(1 - hit)::DOUBLE AS neg FROM e GROUP BY a, b, d, s), p AS (SELECT *, sum(pos) OVER (PARTITION BY a, b, d ORDER BY s DESC) AS tp FROM g),
z AS (SELECT a, b, d, {_AUC} AS v, sum(pos + neg) AS w FROM p GROUP BY a, b, d), m AS (SELECT a, b, avg(v) AS v, avg(w) AS w FROM z GROUP BY a, b)"""
_add("roc_auc_ovo", lambda s, d: _one(C.roc_auc_ovo(_multi(s, d), "y", "q")), f"{_OVO} SELECT round(avg(v), 6) AS value FROM m")
_add("roc_auc_ovo_weighted", lambda s, d: _one(C.roc_auc_ovo(_multi(s, d), "y", "q", "weighted")), f"{_OVO} SELECT round(sum(v * w) / sum(w), 6) AS value FROM m")
_flags = lambda s, d: scored(s, d).select(F.array(F.col("y") == 1, F.col("n") < 3).alias("f"), F.array("s", 1 - F.col("s") / 2).alias("q"))
_FL = f"SELECT 0 AS label, y AS f, s FROM ({_S}) UNION ALL SELECT 1, CASE WHEN n < 3 THEN 1 ELSE 0 END, 1 - s / 2 FROM ({_S})"
_ML = "WITH g AS (SELECT {k}s, sum(f)::DOUBLE AS pos, sum(1 - f)::DOUBLE AS neg FROM (" + _FL + ") GROUP BY {k}s), p AS (SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(neg) OVER ({part}ORDER BY s DESC) AS fp FROM g)"
_EACH = _ML.format(k="label, ", part="PARTITION BY label ") + f", a AS (SELECT label, {_AP} AS v, sum(pos) AS w FROM p GROUP BY label)"
_add("average_precision_multilabel_micro", lambda s, d: _one(C.average_precision_multilabel(_flags(s, d), "f", "q", "micro")), _ML.format(k="", part="") + f" SELECT round({_AP}, 6) AS value FROM p")
_add("average_precision_multilabel_macro", lambda s, d: _one(C.average_precision_multilabel(_flags(s, d), "f", "q")), f"{_EACH} SELECT round(avg(v), 6) AS value FROM a")
_add("average_precision_multilabel_weighted", lambda s, d: _one(C.average_precision_multilabel(_flags(s, d), "f", "q", "weighted")), f"{_EACH} SELECT round(sum(v * w) / sum(w), 6) AS value FROM a")
_add("average_precision_per_label", lambda s, d: C.average_precision_multilabel(_flags(s, d), "f", "q", "none").withColumn("value", F.round("value", 6)), f"{_EACH} SELECT label, round(v, 6) AS value FROM a")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as queries, their lines as items, with tied scores."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select(F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_partkey", F.col("l_discount").alias("s"), (F.floor(F.col("l_quantity") / 10)).alias("g")).groupBy("q", "i").agg(F.max("s").alias("s"), F.max("g").alias("g"))


_R = "SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS i, max(l_discount) AS s, max(floor(l_quantity / 10)) AS g FROM lineitem GROUP BY 1, 2"
_RK = f"WITH x AS ({_R}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, i DESC) AS r, row_number() OVER (PARTITION BY q ORDER BY g DESC, i DESC) AS b FROM x)"
_per = lambda v: v.withColumn("value", F.round("value", 6))
_add("dcg", lambda s, d: _per(R.dcg(ranked(s, d), "q", "i", "g", "s")), f"{_RK} SELECT q, round(sum(g * d), 6) AS value FROM (SELECT q, s, avg(g) AS g, sum(1 / log2(r + 1)) AS d FROM r GROUP BY q, s) GROUP BY q")
_add("dcg_at_10_ignore_ties", lambda s, d: _per(R.dcg(ranked(s, d), "q", "i", "g", "s", 10, 2.0, True)), f"{_RK} SELECT q, round(sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0 END), 6) AS value FROM r GROUP BY q")
_add("ndcg", lambda s, d: _per(R.ndcg(ranked(s, d), "q", "i", "g", "s")), f"{_RK}, t AS (SELECT q, sum(g * d) AS v FROM (SELECT q, s, avg(g) AS g, sum(1 / log2(r + 1)) AS d FROM r GROUP BY q, s) GROUP BY q), b AS (SELECT q, sum(g / log2(b + 1)) AS v FROM r GROUP BY q) SELECT q, round(CASE WHEN b.v <= 0 THEN 0 ELSE t.v / b.v END, 6) AS value FROM t JOIN b USING (q)")
_add("mean_ndcg_at_5", lambda s, d: _one(R.mean_over(R.ndcg(ranked(s, d), "q", "i", "g", "s", 5))), f"{_RK}, t AS (SELECT q, sum(g * d) AS v FROM (SELECT q, s, avg(g) AS g, sum(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS d FROM r GROUP BY q, s) GROUP BY q), b AS (SELECT q, sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS v FROM r GROUP BY q) SELECT round(avg(CASE WHEN b.v <= 0 THEN 0 ELSE t.v / b.v END), 6) AS value FROM t JOIN b USING (q)")
_add("reciprocal_rank", lambda s, d: _per(R.reciprocal_rank(ranked(s, d).withColumn("hit", (F.col("g") == 4).cast("int")), "q", "i", "hit", "s")), f"{_RK} SELECT q, round(coalesce(1.0::DOUBLE / min(r) FILTER (g = 4), 0), 6) AS value FROM r GROUP BY q")
_lab = lambda s, d: ranked(s, d).withColumn("hit", F.col("g") >= 3)
_LB = f"WITH x AS (SELECT q, s, g >= 3 AS hit FROM ({_R})), r AS (SELECT *, count(*) OVER w AS r, count(*) FILTER (hit) OVER w AS rr, count(*) FILTER (hit) OVER (PARTITION BY q) AS p, count(*) OVER (PARTITION BY q) AS l FROM x WINDOW w AS (PARTITION BY q ORDER BY s DESC RANGE UNBOUNDED PRECEDING))"
_add("coverage_error", lambda s, d: _per(R.coverage_error(_lab(s, d), "q", "hit", "s")), f"{_LB} SELECT q, coalesce(max(r) FILTER (hit), 0)::DOUBLE AS value FROM r GROUP BY q")
_add("label_ranking_average_precision", lambda s, d: _per(R.label_ranking_average_precision(_lab(s, d), "q", "hit", "s")), f"{_LB} SELECT q, round(CASE WHEN max(p) = 0 OR max(p) = max(l) THEN 1.0 ELSE avg(rr / r) FILTER (hit) END, 6) AS value FROM r GROUP BY q")
_add("label_ranking_loss", lambda s, d: _per(R.label_ranking_loss(_lab(s, d), "q", "hit", "s")), f"{_LB} SELECT q, round(CASE WHEN max(p * (l - p)) = 0 THEN 0.0 ELSE sum(CASE WHEN hit THEN r - rr ELSE 0 END) / max(p * (l - p)) END, 6) AS value FROM r GROUP BY q")
