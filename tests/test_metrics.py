"""Labels of the caller's, ranks over ranges, distances as input and saved artifacts, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklex.functions.stopwords import read_stop_words
from sparklex.operators import classification as C, clustering as K, curves, regression as R, vectorize as V, vectors as X
from sparklex.plans import ranks


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("b", "b"), ("b", "a"), ("a", "a"), ("c", "b"), ("c", "c"), ("a", "c"), ("b", "b")]
    return C.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p")


def test_matrix_follows_the_order_of_labels(pairs):
    got = {(r["row"], r["column"]): r["w"] for r in C.matrix(pairs, ["b", "a", "z"]).collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (0, 2): 0, (1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0, (2, 1): 0, (2, 2): 0}
    assert C.dropped(pairs, ["b", "a", "z"]).first()[0] == 3
    for bad in ([], ["a", "a"], [None]):
        with pytest.raises(ValueError):
            C.matrix(pairs, bad)


def test_report_of_some_labels_has_a_micro_average(pairs):
    rows = {r["row"]: r for r in C.report(pairs, labels=["c", "b"]).collect()}
    assert set(rows) == {"c", "b", "micro avg", "macro avg", "weighted avg"} and rows["c"]["pos"] == 0 and rows["micro avg"]["pos"] == 2
    # c: tp 1, predicted 2, support 2; b: tp 2, predicted 3, support 3
    assert (rows["micro avg"]["precision"], rows["micro avg"]["recall"], rows["micro avg"]["support"]) == (3 / 5, 3 / 5, 5)
    text = C.report_text(C.report(pairs, labels=["c", "b"]))
    assert text.index("  c ") < text.index("  b ") < text.index("micro avg")


def test_report_of_all_labels_keeps_accuracy(pairs):
    rows = {r["row"]: r for r in C.report(pairs, labels=["c", "b", "a", "z"]).collect()}
    assert "micro avg" not in rows and math.isclose(rows["accuracy"]["f1"], 4 / 7) and rows["z"]["support"] == 0


def test_kappa_of_ordered_labels(pairs):
    want = {}
    rows = [("b", "b"), ("b", "a"), ("a", "a"), ("c", "b"), ("c", "c"), ("a", "c"), ("b", "b")]
    for order in ("abc", "cab"):
        at = order.index
        o = sum(abs(at(t) - at(p)) for t, p in rows) / len(rows)
        e = sum(abs(at(t) - at(p)) for t, _ in rows for _, p in rows) / len(rows) ** 2
        want[order] = 1 - o / e
        cm = C.matrix(pairs, list(order))
        assert math.isclose(C.cohen_kappa(cm, C.per_class(cm, labels=list(order)), "linear").first()[0], want[order])
    assert want["abc"] != want["cab"]


def test_multiclass_areas_take_labels(spark):
    rows = [("x", [0.7, 0.2, 0.1]), ("y", [0.3, 0.3, 0.4]), ("z", [0.1, 0.2, 0.7]), ("y", [0.2, 0.6, 0.2]), ("x", [0.3, 0.4, 0.3])]
    named = spark.createDataFrame(rows, "t string, q array<double>")
    placed = spark.createDataFrame([("xyz".index(t), q) for t, q in rows], "t int, q array<double>")
    for f in (curves.roc_auc_ovr, curves.roc_auc_ovo):
        assert f(named, "t", "q", labels=list("xyz")).first()[0] == f(placed, "t", "q").first()[0]
    with pytest.raises(Exception, match="not among"):
        curves.roc_auc_ovr(named, "t", "q", labels=list("xyw")).collect()


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles(spark, n):
    values = [float(v) for v in np.random.default_rng(n).integers(-20, 20, n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = ranks.percentiles(df, F.col("v"), [0.0, 0.1, 0.5, 0.77, 1.0]).first()["q"]
    assert np.allclose(got, np.percentile(values, [0, 10, 50, 77, 100]))
    assert R.quantile(df, "v", 0.5).first()[0] == np.median(values)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ranks.percentiles(df, F.col("v"), [0.5]).first()["q"] == [None]
    assert R.quantile(df, "v", 0.5).first()[0] is None


def test_ranks_and_totals_need_no_single_task_over_values(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), F.lit(1.0).alias("w"))
    plan = ranks.running_weights(df.groupBy("v").agg(F.sum("w").alias("w")))._jdf.queryExecution().optimizedPlan().toString()
    over_values = [line for line in plan.split("\n") if "Window" in line and "sum(w#" in line]
    assert over_values and all("[part#" in line for line in over_values)  # the others run over one row a partition
    cells = K.contingency(spark.range(100).select((F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b")), "a", "b")
    assert "Window" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_contingency_keeps_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, 2)], "a int, b int")
    got = {(r["a"], r["b"]): (r["n"], r["na"], r["nb"], r["t"]) for r in K.contingency(df, "a", "b").collect()}
    assert got == {(None, 1): (2, 2, 2, 4), (1, None): (1, 2, 1, 4), (1, 2): (1, 2, 1, 4)}


def test_silhouette_from_distances(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(23, 3))
    labels = [0] + [int(i) for i in rng.integers(1, 4, 22)]
    rows = spark.createDataFrame([(i, v[i].tolist(), labels[i]) for i in range(23)], "k int, v array<double>, c int")
    d = spark.createDataFrame([(i, j, float(np.linalg.norm(v[i] - v[j]))) for i in range(23) for j in range(23)], "a int, b int, d double")
    want = K.silhouette(rows, "k", "v", "c").first()[0]
    assert math.isclose(K.silhouette_from_distances(d, rows, "a", "b", "d", "k", "c").first()[0], want)
    assert K.silhouette_from_distances(d, rows, "a", "b", "d", "k", "c", True).count() == 23
    with pytest.raises(ValueError):
        K.silhouette_from_distances(d, rows.withColumn("c", F.lit(1)), "a", "b", "d", "k", "c")


def test_index_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<float>")
    X.save_index(df, "i", "v", str(tmp_path / "x"), True)
    got, header = X.load_index(spark, str(tmp_path / "x"), 2)
    assert header["dimension"] == 2 and header["normalized"] and got.count() == 2 and got.columns == ["i", "v"]
    with pytest.raises(ValueError):
        X.load_index(spark, str(tmp_path / "x"), 3)
    with pytest.raises(ValueError):
        X.save_index(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0])], "i int, v array<float>"), "i", "v", str(tmp_path / "y"))


def test_options_of_saved_vectorizers(spark, tmp_path):
    options = {"n_features": 1 << 18, "norm": "l1", "alternate_sign": False}
    V.save_vectorizer(None, options, str(tmp_path / "h"), spark)
    assert V.load_vectorizer(spark, str(tmp_path / "h")) == (None, options)
    docs = spark.createDataFrame([(1, "red kite"), (2, "red barn red")], "i int, t string")
    counts = V.term_counts(docs, "i", "t")
    vocab = V.with_idf(V.vocabulary(counts, "i", 2), 2)
    V.save_vectorizer(vocab, {"norm": "l2", "n_docs": 2}, str(tmp_path / "t"))
    again, _ = V.load_vectorizer(spark, str(tmp_path / "t"))
    assert sorted(V.tfidf(counts, again, "i").collect()) == sorted(V.tfidf(counts, vocab, "i").collect())
    for bad in ({"colour": 1}, {"ngrams": [2, 1]}, {"norm": "l3"}, {"n_features": True}, {"stop_words": [1]}):
        with pytest.raises(ValueError):
            V.save_vectorizer(None, bad, str(tmp_path / "bad"), spark)


def test_stop_words_from_a_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("and  | a conjunction\n\n| only a comment\nor\nand\n")
    assert read_stop_words(spark, str(tmp_path / "w.txt")) == ("and", "or")
    with pytest.raises(ValueError):
        read_stop_words(spark, str(tmp_path / "w.txt"), "en")


def test_silhouette_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 4)) * 1e-2 + 1e5
    v[300:] = v[:300]  # copies, at a distance of 0
    keys, labels = np.arange(600), rng.integers(3, size=600)
    keys[7] = 8  # a repeated key under two labels is one row, as in the SQL
    labels[7], labels[8] = 0, 1
    rows = spark.createDataFrame([(int(k), x, int(c)) for k, x, c in zip(keys, v.tolist(), labels)], "k int, v array<double>, c int")
    saved = []
    save = K.Scratch.save
    monkeypatch.setattr(K.Scratch, "save", lambda self, df, name="t": saved.append(save(self, df, name)) or saved[-1])
    got = {r["k"]: r["value"] for r in K.silhouette_samples(rows, "k", "v", "c", 4).collect()}
    assert saved and saved[0].count() <= 2 * K.BLOCKS  # not a block for every four rows
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    assert len(got) == 599
    for key in (0, 8, 300, 599):
        a = keys == key
        means = lambda own: [d[np.ix_(a & (labels == x), ~a & (labels == y))].mean() for x in set(labels[a]) for y in range(3) if (x == y) == own]
        near, far = max(means(True)), min(means(False))
        assert math.isclose(got[key], (far - near) / max(far, near), abs_tol=1e-9)
