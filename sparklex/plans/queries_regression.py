"""Queries of the regression and clustering metrics with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparklex.operators import clustering as K, regression as R


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices in thousands against their customer's mean."""
    t = spark.read.parquet(f"{sf}/orders.parquet")
    price = F.col("o_totalprice") / 1000
    return t.select(price.alias("t"), (F.avg(price).over(Window.partitionBy("o_custkey")) * 0.9 + 10).alias("p"), (1.0 + F.col("o_orderkey") % 3).alias("w"), "o_orderpriority", "o_orderkey")


_O = "SELECT o_totalprice / 1000 AS t, avg(o_totalprice / 1000) OVER (PARTITION BY o_custkey) * 0.9 + 10 AS p, 1.0::DOUBLE + o_orderkey % 3 AS w, o_orderpriority, o_orderkey FROM orders"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _one(v: DataFrame) -> DataFrame:
    return v.select(F.round("value", 6).alias("value"))


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _mean(name: str, f, kernel: str, wrap: str = "{}") -> None:
    _add(name, lambda s, d: _one(f(orders(s, d), "t", "p", "w")), f"SELECT round({wrap.format(f'sum(w * ({kernel})) / sum(w)')}, 6) AS value FROM ({_O})")


_mean("mse", lambda x, t, p, w: R.mse(x, t, p, w), "(t - p) ** 2")
_mean("rmse", lambda x, t, p, w: R.rmse(x, t, p, w), "(t - p) ** 2", "sqrt({})")
_mean("mae", lambda x, t, p, w: R.mae(x, t, p, w), "abs(t - p)")
_mean("mape", lambda x, t, p, w: R.mape(x, t, p, w), "abs(t - p) / greatest(abs(t), 2.220446049250313e-16)")
_mean("msle", lambda x, t, p, w: R.msle(x, t, p, w), "(ln(1 + t) - ln(1 + p)) ** 2")
_mean("rmsle", lambda x, t, p, w: R.rmsle(x, t, p, w), "(ln(1 + t) - ln(1 + p)) ** 2", "sqrt({})")
_mean("pinball_loss", lambda x, t, p, w: R.pinball(x, t, p, 0.2, w), "greatest(0.2 * (t - p), -0.8 * (t - p))")
_mean("poisson_deviance", lambda x, t, p, w: R.poisson(x, t, p, w), "2 * (t * ln(t / p) - t + p)")
_mean("gamma_deviance", lambda x, t, p, w: R.gamma(x, t, p, w), "2 * (ln(p / t) + t / p - 1)")
_T15 = "2 * (t ** 0.5 / (-0.5 * 0.5) - t * p ** -0.5 / -0.5 + p ** 0.5 / 0.5)"
_mean("tweedie_deviance_p15", lambda x, t, p, w: R.tweedie(x, t, p, 1.5, w), _T15)
_mean("tweedie_deviance_p3", lambda x, t, p, w: R.tweedie(x, t, p, 3.0, w), "2 * (1 / t / 2 - t * p ** -2 / -2 + p ** -1 / -1)")
_mean("tweedie_deviance_neg", lambda x, t, p, w: R.tweedie(x, t, p, -1.0, w), "2 * (greatest(t, 0) ** 3 / 6 - t * p ** 2 / 2 + p ** 3 / 3)")
_mean("tweedie_deviance_p0", lambda x, t, p, w: R.tweedie(x, t, p, 0.0, w), "(t - p) ** 2")
_add("mae_by", lambda s, d: R.mae(orders(s, d), "t", "p", None, ["o_orderpriority"]).withColumn("value", F.round("value", 6)), f"SELECT o_orderpriority, round(avg(abs(t - p)), 6) AS value FROM ({_O}) GROUP BY 1")
_add("max_error", lambda s, d: _one(R.max_error(orders(s, d), "t", "p")), f"SELECT round(max(abs(t - p)), 6) AS value FROM ({_O})")
_add("median_ae", lambda s, d: _one(R.median_ae(orders(s, d), "t", "p")), f"SELECT round(quantile_cont(abs(t - p), 0.5), 6) AS value FROM ({_O})")
_WQ = """g AS (SELECT v, sum(w) AS w FROM ({rows}) GROUP BY v), r AS (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS c FROM g),
q AS (SELECT (coalesce(min(v) FILTER (c >= {q} - 2.220446049250313e-16), max(v)) + coalesce(min(v) FILTER (c - {q} > 2.220446049250313e-16), max(v))) / 2 AS q FROM r)"""
_add("median_ae_weighted", lambda s, d: _one(R.median_ae(orders(s, d), "t", "p", "w")), f"WITH {_WQ.format(rows=f'SELECT abs(t - p) AS v, w FROM ({_O})', q=0.5)} SELECT round(q, 6) AS value FROM q")
_CENT = f"WITH x AS ({_O}), m AS (SELECT sum(w * t) / sum(w) AS mt, sum(w * (t - p)) / sum(w) AS mr FROM x)"
_add("r2", lambda s, d: _one(R.r2(orders(s, d), "t", "p", "w")), f"{_CENT} SELECT round(1 - sum(w * (t - p) ** 2) / sum(w * (t - mt) ** 2), 6) AS value FROM x, m")
_add("explained_variance", lambda s, d: _one(R.explained_variance(orders(s, d), "t", "p", "w")), f"{_CENT} SELECT round(1 - sum(w * (t - p - mr) ** 2) / sum(w * (t - mt) ** 2), 6) AS value FROM x, m")
_two = lambda s, d: R.per_output(orders(s, d).select(F.array("t", F.sqrt("t")).alias("a"), F.array("p", F.sqrt("p") + 1).alias("b"), "w"), "a", "b", "w")
_TWO = f"SELECT 0 AS output, t, p, w FROM ({_O}) UNION ALL SELECT 1, sqrt(t), sqrt(p) + 1, w FROM ({_O})"
_add("mse_per_output", lambda s, d: R.mse(_two(s, d), "t", "p", "w", ["output"]).withColumn("value", F.round("value", 6)), f"SELECT output, round(sum(w * (t - p) ** 2) / sum(w), 6) AS value FROM ({_TWO}) GROUP BY output")
_R2O = f"WITH x AS ({_TWO}), m AS (SELECT output, sum(w * t) / sum(w) AS mt FROM x GROUP BY output), s AS (SELECT output, 1 - sum(w * (t - p) ** 2) / sum(w * (t - mt) ** 2) AS v, sum(w * (t - mt) ** 2) AS d FROM x JOIN m USING (output) GROUP BY output)"
_add("r2_per_output", lambda s, d: R.r2(_two(s, d), "t", "p", "w", ["output"]).select("output", F.round("value", 6).alias("value")), f"{_R2O} SELECT output, round(v, 6) AS value FROM s")
_add("r2_variance_weighted", lambda s, d: _one(R.variance_weighted(R.r2(_two(s, d), "t", "p", "w", ["output"]))), f"{_R2O} SELECT round(sum(v * d) / sum(d), 6) AS value FROM s")
_add("d2_tweedie", lambda s, d: _one(R.d2_tweedie(orders(s, d), "t", "p", 1.5, "w")), f"{_CENT} SELECT round(1 - sum(w * ({_T15})) / sum(w * ({_T15.replace('p **', 'mt **')})), 6) AS value FROM x, m")
_PIN = "greatest({a} * (t - {p}), ({a} - 1) * (t - {p}))"
for _n, _a in (("d2_pinball", 0.2), ("d2_absolute", 0.5)):
    _add(_n, lambda s, d, a=_a: _one(R.d2_pinball(orders(s, d), "t", "p", a, "w")), f"WITH {_WQ.format(rows=f'SELECT t AS v, w FROM ({_O})', q=_a)} SELECT round(1 - sum(w * {_PIN.format(a=_a, p='p')}) / sum(w * {_PIN.format(a=_a, p='q')}), 6) AS value FROM ({_O}), q")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return K.contingency(t.select("l_linenumber", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey") % 5).otherwise(F.col("l_linenumber") % 5).alias("b")), "l_linenumber", "b")


_C = """WITH c AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT l_linenumber AS a, CASE WHEN l_orderkey % 4 = 0 THEN l_partkey % 5 ELSE l_linenumber % 5 END AS b FROM lineitem) GROUP BY a, b),
e AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
s AS (SELECT max(t) AS t, sum(n * n) AS sq, sum(n * na) AS sqa, sum(n * nb) AS sqb, sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM e),
p AS (SELECT *, sq - t AS c11, sqb - sq AS c01, sqa - sq AS c10, t * t - sqa - sqb + sq AS c00 FROM s)"""
_add("pair_confusion", lambda s, d: K.pair_confusion(K.summary(_cells(s, d))), f"{_C} SELECT c00::BIGINT AS c00, c01::BIGINT AS c01, c10::BIGINT AS c10, c11::BIGINT AS c11 FROM p")
for _n, _f, _e in (
    ("rand_index", K.rand, "(c00 + c11) / (c00 + c01 + c10 + c11)"), ("adjusted_rand", K.adjusted_rand, "2 * (c11 * c00 - c10 * c01) / ((c11 + c10) * (c10 + c00) + (c11 + c01) * (c01 + c00))"),
    ("mutual_information", K.mutual_information, "mi"), ("normalized_mutual_information", K.normalized_mutual_information, "mi / ((ha + hb) / 2)"),
    ("fowlkes_mallows", K.fowlkes_mallows, "sqrt(c11 / (sqb - t)) * sqrt(c11 / (sqa - t))"), ("homogeneity", K.homogeneity, "mi / ha"), ("completeness", K.completeness, "mi / hb"), ("v_measure", K.v_measure, "2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)"),
):
    _add(_n, lambda s, d, f=_f: _one(f(K.summary(_cells(s, d)))), f"{_C} SELECT round({_e}, 6) AS value FROM p")


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


_add("adjusted_mutual_information", lambda s, d: _one(K.adjusted_mutual_information(K.contingency(_embedded(s, d).select("label", (F.col("vec_id") % 10).alias("b")), "label", "b"))), """
WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
s AS (SELECT max(t) AS t, sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM e),
x AS (SELECT a.a, a.na AS x, b.nb AS y, t, unnest(range(greatest(1, (a.na + b.nb - t)::BIGINT), least(a.na, b.nb)::BIGINT + 1)) AS k FROM (SELECT DISTINCT a, na FROM e) a, (SELECT DISTINCT b, nb FROM e) b, (SELECT max(t) AS t FROM e)),
m AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi FROM x)
SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS value FROM s, m""")
_E = "WITH v AS (SELECT vec_id, label AS c, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT c, i, avg(x) AS m, count(*) AS n FROM v GROUP BY c, i)"
_add("calinski_harabasz", lambda s, d: _one(K.calinski_harabasz(_embedded(s, d), "embedding", "label")), f"""{_E}, g AS (SELECT i, avg(x) AS g FROM v GROUP BY i), w AS (SELECT sum((x - m) ** 2) AS w FROM v JOIN m USING (c, i)), b AS (SELECT sum(n * (m - g) ** 2) AS b, count(DISTINCT c) AS k FROM m JOIN g USING (i)), n AS (SELECT count(*) AS n FROM embeddings)
SELECT round(b * (n - k) / (w * (k - 1)), 6) AS value FROM w, b, n""")
_add("davies_bouldin", lambda s, d: _one(K.davies_bouldin(_embedded(s, d), "embedding", "label")), f"""{_E}, s AS (SELECT c, avg(d) AS s FROM (SELECT c, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM v JOIN m USING (c, i) GROUP BY c, vec_id) GROUP BY c),
p AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b ON a.i = b.i AND a.c <> b.c GROUP BY a.c, b.c)
SELECT round(avg(r), 6) AS value FROM (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.c = a JOIN s y ON y.c = b GROUP BY a)""")
_SIL = """WITH d AS (SELECT a.vec_id AS k, a.label AS ca, b.label AS cb, avg(sqrt(list_sum([(x - y) ** 2 FOR x, y IN list_zip(a.embedding, b.embedding)]))) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY ALL)"""
_SIL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS k, a.label AS ca, b.label AS cb, avg(list_distance(a.v, b.v)) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT k, max(d) FILTER (ca = cb) AS a, min(d) FILTER (ca <> cb) AS b FROM d GROUP BY k), z AS (SELECT k, CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS v FROM s)"""
_add("silhouette", lambda s, d: _one(K.silhouette(_embedded(s, d), "vec_id", "embedding", "label")), f"{_SIL} SELECT round(avg(v), 6) AS value FROM z")
_add("silhouette_samples", lambda s, d: K.silhouette_samples(_embedded(s, d), "vec_id", "embedding", "label").select("vec_id", F.round("value", 6).alias("value")), f"{_SIL} SELECT k AS vec_id, round(v, 6) AS value FROM z")
