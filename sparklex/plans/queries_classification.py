"""Queries of the classification metrics with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklex.operators import classification as C


def multi(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as seven classes; every fifth order predicts the next class."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    wrong = F.col("l_orderkey") % 5 == 0
    return t.select(F.col("l_linenumber").alias("t"), F.when(wrong, F.col("l_linenumber") % 7 + 1).otherwise(F.col("l_linenumber")).alias("p"), F.col("l_quantity").alias("w"), "l_returnflag")


def binary(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels with derived predictions and scores."""
    t = spark.read.parquet(f"{sf}/labels.parquet")
    score = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return t.select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"), score.alias("s"), (1.0 + F.col("doc_id") % 3).alias("w"), "toxic", "doc_id")


_M = "SELECT l_linenumber AS t, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber % 7 + 1 ELSE l_linenumber END AS p, l_quantity AS w, l_returnflag FROM lineitem"
_B = "SELECT quality AS t, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS p, (doc_id * 7919 % 1000) / 1000.0 AS s, 1.0 + doc_id % 3 AS w, toxic, doc_id FROM labels"
_PC = "pc AS (SELECT label, sum(tp) AS tp, sum(pred) AS pred, sum(sup) AS sup FROM (SELECT t AS label, CASE WHEN t = p THEN w ELSE 0 END AS tp, 0 AS pred, w AS sup FROM b UNION ALL SELECT p, 0, w, 0 FROM b) GROUP BY label)"


def _with(base: str, body: str) -> str:
    return f"WITH b AS ({base}), {_PC} {body}"


def _one(v) -> DataFrame:
    return v.select(F.round("value", 6).alias("value"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_add("confusion_matrix", lambda s, d: C.confusion(multi(s, d), "t", "p"), f"SELECT t AS y_true, p AS y_pred, CAST(count(*) AS DOUBLE) AS w FROM ({_M}) GROUP BY t, p")
_add("confusion_matrix_weighted_by", lambda s, d: C.confusion(multi(s, d), "t", "p", "w", ["l_returnflag"]).withColumn("w", F.round("w", 3)), f"SELECT l_returnflag, t AS y_true, p AS y_pred, round(sum(w), 3) AS w FROM ({_M}) GROUP BY ALL")
for _over, _keys in (("true", "PARTITION BY t"), ("pred", "PARTITION BY p"), ("all", "")):
    _add(f"confusion_matrix_norm_{_over}", lambda s, d, o=_over: C.normalized(C.confusion(multi(s, d), "t", "p"), o).withColumn("w", F.round("w", 6)),
         f"SELECT t AS y_true, p AS y_pred, round(n / sum(n) OVER ({_keys}), 6) AS w FROM (SELECT t, p, CAST(count(*) AS DOUBLE) AS n FROM ({_M}) GROUP BY t, p)")
_add("accuracy", lambda s, d: _one(C.accuracy(C.confusion(multi(s, d), "t", "p"))), f"SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS value FROM ({_M})")
_add("accuracy_by", lambda s, d: C.accuracy(C.confusion(multi(s, d), "t", "p", "w", ["l_returnflag"]), ["l_returnflag"]).withColumn("value", F.round("value", 6)), f"SELECT l_returnflag, round(sum(CASE WHEN t = p THEN w ELSE 0.0 END) / sum(w), 6) AS value FROM ({_M}) GROUP BY 1")
_classes = lambda s, d, f=multi, w=None: C.per_class(C.confusion(f(s, d), "t", "p", w))
_add("balanced_accuracy", lambda s, d: _one(C.balanced_accuracy(_classes(s, d, w="w"))), _with(_M, "SELECT round(avg(tp / sup), 6) AS value FROM pc WHERE sup > 0"))
_add("balanced_accuracy_adjusted", lambda s, d: _one(C.balanced_accuracy(_classes(s, d, w="w"), True)), _with(_M, "SELECT round((avg(tp / sup) - 1.0 / count(*)) / (1 - 1.0 / count(*)), 6) AS value FROM pc WHERE sup > 0"))
_F = {"precision": "tp / nullif(pred, 0)", "recall": "tp / nullif(sup, 0)", "f1": "2 * tp / nullif(pred + sup, 0)", "fbeta": "1.25 * tp / nullif(pred + 0.25 * sup, 0)", "jaccard_score": "tp / nullif(pred + sup - tp, 0)"}
_K = {"precision": ("precision", 1.0), "recall": ("recall", 1.0), "f1": ("fbeta", 1.0), "fbeta": ("fbeta", 0.5), "jaccard_score": ("jaccard", 1.0)}
for _n, _e in _F.items():
    _k, _beta = _K[_n]
    _sums = "FROM (SELECT sum(tp) AS tp, sum(pred) AS pred, sum(sup) AS sup FROM pc)"
    for _avg, _sql in (("macro", f"SELECT round(avg(coalesce({_e}, 0)), 6) AS value FROM pc"), ("micro", f"SELECT round(coalesce({_e}, 0), 6) AS value {_sums}"), ("weighted", f"SELECT round(sum(coalesce({_e}, 0) * sup) / sum(sup), 6) AS value FROM pc")):
        _add(f"{_n}_{_avg}", lambda s, d, k=_k, b=_beta, a=_avg: _one(C.score(_classes(s, d, w="w"), k, a, b)), _with(_M, _sql))
    _add(f"{_n}_binary", lambda s, d, k=_k, b=_beta: _one(C.score(_classes(s, d, binary), k, "binary", b)), _with(f"SELECT t, p, 1.0 AS w FROM ({_B})", f"SELECT round(coalesce({_e}, 0), 6) AS value FROM pc WHERE label = 1"))
    _add(f"{_n}_per_class", lambda s, d, k=_k, b=_beta: C.score_per_class(_classes(s, d), k, b).select("label", F.round("value", 6).alias("value")), _with(f"SELECT t, p, 1.0 AS w FROM ({_M})", f"SELECT label, round(coalesce({_e}, 0), 6) AS value FROM pc"))
_add("matthews_corrcoef", lambda s, d: _one(C.matthews(_classes(s, d))), _with(f"SELECT t, p, 1.0::DOUBLE AS w FROM ({_M})", "SELECT round((sum(tp) * sum(sup) - sum(sup * pred)) / sqrt((sum(sup) * sum(sup) - sum(sup * sup)) * (sum(sup) * sum(sup) - sum(pred * pred))), 6) AS value FROM pc"))
for _w, _c in ((None, "CASE WHEN i = j THEN 0.0 ELSE 1.0 END"), ("linear", "abs(i - j)"), ("quadratic", "(i - j) * (i - j)")):
    def _kappa(s, d, w=_w):
        cm = C.confusion(multi(s, d), "t", "p")
        return _one(C.cohen_kappa(cm, C.per_class(cm), w))

    _add("cohen_kappa" + (f"_{_w}" if _w else ""), _kappa, _with(f"SELECT t, p, 1.0::DOUBLE AS w FROM ({_M})", f""", k AS (SELECT *, row_number() OVER (ORDER BY label) AS i FROM pc),
o AS (SELECT sum(w * ({_c})) AS o, sum(w) AS n FROM b JOIN (SELECT label, i FROM k) a ON t = a.label JOIN (SELECT label, i AS j FROM k) c ON p = c.label),
e AS (SELECT sum(a.sup * c.pred * ({_c})) AS e FROM k a, (SELECT pred, i AS j FROM k) c)
SELECT round(1 - o * n / e, 6) AS value FROM o, e"""))  # fmt: skip
_add("hamming_loss", lambda s, d: _one(C.hamming_loss(multi(s, d), "t", "p")), f"SELECT round(avg(CASE WHEN t <> p THEN 1.0 ELSE 0.0 END), 6) AS value FROM ({_M})")
_flags = lambda s, d: binary(s, d).select("doc_id", F.array(F.col("t") == 1, F.col("toxic") == 1, F.col("doc_id") % 2 == 0).alias("a"), F.array(F.col("p") == 1, F.col("s") > 0.5, F.col("doc_id") % 3 == 0).alias("b"))
_FLAGS = f"SELECT doc_id, [t = 1, toxic = 1, doc_id % 2 = 0] AS a, [p = 1, s > 0.5, doc_id % 3 = 0] AS b FROM ({_B})"
_add("hamming_loss_multilabel", lambda s, d: _one(C.hamming_loss(_flags(s, d), "a", "b")), f"SELECT round(avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END), 6) AS value FROM (SELECT unnest(a) AS x, unnest(b) AS y FROM ({_FLAGS}))")
_add("zero_one_loss", lambda s, d: _one(C.zero_one_loss(multi(s, d), "t", "p", False)), f"SELECT round(sum(CASE WHEN t <> p THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS value FROM ({_M})")
_add("zero_one_loss_multilabel", lambda s, d: _one(C.zero_one_loss(_flags(s, d), "a", "b")), f"SELECT round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS value FROM ({_FLAGS})")
_CELLS = "round(sum(CASE WHEN NOT x AND NOT y THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS tn, round(sum(CASE WHEN NOT x AND y THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS fp, round(sum(CASE WHEN x AND NOT y THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS fn, round(sum(CASE WHEN x AND y THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS tp"
_add("multilabel_confusion", lambda s, d: C.multilabel_confusion(C.confusion(multi(s, d), "t", "p")), _with(f"SELECT t, p, 1.0::DOUBLE AS w FROM ({_M})", "SELECT label, n - pred - sup + tp AS tn, pred - tp AS fp, sup - tp AS fn, tp FROM pc, (SELECT sum(sup) AS n FROM pc)"))
_add("multilabel_confusion_flags", lambda s, d: C.multilabel_confusion_flags(_flags(s, d), "a", "b"), f"SELECT CAST(i AS INT) AS label, {_CELLS} FROM (SELECT unnest(a) AS x, unnest(b) AS y, unnest([0, 1, 2]) AS i FROM ({_FLAGS})) GROUP BY i")
_add("multilabel_confusion_samplewise", lambda s, d: C.multilabel_confusion_flags(_flags(s, d), "a", "b", True, "doc_id"), f"SELECT doc_id, {_CELLS} FROM (SELECT doc_id, unnest(a) AS x, unnest(b) AS y FROM ({_FLAGS})) GROUP BY doc_id")
_add("likelihood_ratios", lambda s, d: C.likelihood_ratios(_classes(s, d, binary)).select(F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative")),
     f"WITH c AS (SELECT sum(t * p)::DOUBLE AS tp, sum(t)::DOUBLE AS pos, sum((1 - t) * p)::DOUBLE AS fp, sum(1 - t)::DOUBLE AS neg FROM ({_B})) SELECT round((tp / pos) / (fp / neg), 6) AS positive, round(((pos - tp) / pos) / ((neg - fp) / neg), 6) AS negative FROM c")
_add("classification_report", lambda s, d: C.report(C.confusion(multi(s, d), "t", "p")).select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "support")]), _with(f"SELECT t, p, 1.0::DOUBLE AS w FROM ({_M})", """, e AS (SELECT label::VARCHAR AS row, coalesce(tp / nullif(pred, 0), 0) AS a, coalesce(tp / nullif(sup, 0), 0) AS r, coalesce(2 * tp / nullif(pred + sup, 0), 0) AS f, sup, tp FROM pc)
SELECT row, round(a, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(sup, 6) AS support FROM e
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(sup), 6) FROM e
UNION ALL SELECT 'macro avg', round(avg(a), 6), round(avg(r), 6), round(avg(f), 6), round(sum(sup), 6) FROM e
UNION ALL SELECT 'weighted avg', round(sum(a * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6), round(sum(f * sup) / sum(sup), 6), round(sum(sup), 6) FROM e"""))  # fmt: skip
_add("brier_score", lambda s, d: _one(C.brier(binary(s, d), "t", "s", "w")), f"SELECT round(sum(w * (s - t) * (s - t)) / sum(w), 6) AS value FROM ({_B})")
_CLIP = "least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
_add("log_loss", lambda s, d: _one(C.log_loss(binary(s, d), "t", "s")), f"SELECT round(-avg(t * ln({_CLIP}) + (1 - t) * ln(1 - {_CLIP})), 6) AS value FROM (SELECT t, s::DOUBLE AS s FROM ({_B}))")
_add("hinge_loss", lambda s, d: _one(C.hinge_loss(binary(s, d).withColumn("m", F.col("s") * 4 - 2), "t", "m")), f"SELECT round(avg(greatest(0, 1 - CASE WHEN t > 0 THEN s * 4 - 2 ELSE 2 - s * 4 END)), 6) AS value FROM (SELECT t, s::DOUBLE AS s FROM ({_B}))")
_probs = lambda s, d: multi(s, d).select((F.col("t") - 1).alias("t"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(i == F.col("p"), 0.4).otherwise(0.1)).alias("q"), "w")
_PROBS = f"SELECT t - 1 AS t, [CASE WHEN i = p THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END FOR i IN range(1, 8)] AS q, w FROM ({_M})"
_add("brier_score_multiclass", lambda s, d: _one(C.brier_multiclass(_probs(s, d), "t", "q")), f"SELECT round(avg(v), 6) AS value FROM (SELECT list_sum([(q[i + 1] - CASE WHEN i = t THEN 1 ELSE 0 END) ** 2 FOR i IN range(0, 7)]) AS v FROM ({_PROBS}))")
_add("log_loss_multiclass", lambda s, d: _one(C.log_loss_multiclass(_probs(s, d), "t", "q")), f"SELECT round(-avg(ln(q[t + 1])), 6) AS value FROM ({_PROBS})")
_add("hinge_loss_multiclass", lambda s, d: _one(C.hinge_loss_multiclass(_probs(s, d), "t", "q")), f"SELECT round(avg(greatest(0, 1 - (q[t + 1] - list_max([q[i + 1] FOR i IN range(0, 7) IF i <> t])))), 6) AS value FROM ({_PROBS})")
_add("top_k_accuracy", lambda s, d: _one(C.top_k_accuracy(_probs(s, d), "t", "q", 3)), f"SELECT round(avg(CASE WHEN len([i FOR i IN range(0, 7) IF q[i + 1] > q[t + 1] OR (q[i + 1] = q[t + 1] AND i > t)]) < 3 THEN 1.0 ELSE 0.0 END), 6) AS value FROM ({_PROBS})")
_CAL = "round(avg(s), 6) AS mean_predicted, round(avg(t::DOUBLE), 6) AS fraction_positive, count(*) AS n"
_cal = lambda df: df.select("bin", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("fraction_positive", 6).alias("fraction_positive"), "n")
_add("calibration_curve", lambda s, d: _cal(C.calibration_curve(binary(s, d), "t", "s")), f"SELECT len([e FOR e IN [0.2::DOUBLE, 0.4, 0.6, 0.8] IF e < s]) AS bin, {_CAL} FROM (SELECT t, s::DOUBLE AS s FROM ({_B})) GROUP BY 1")
_add("calibration_curve_quantile", lambda s, d: _cal(C.calibration_curve(binary(s, d), "t", "s", 4, "quantile")), f"WITH x AS (SELECT t, s::DOUBLE AS s FROM ({_B})), q AS (SELECT quantile_cont(s, [0.25, 0.5, 0.75]) AS e FROM x) SELECT len([y FOR y IN e IF y < s]) AS bin, {_CAL} FROM x, q GROUP BY 1")
