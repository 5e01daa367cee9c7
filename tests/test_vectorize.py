"""Vectorizers, their files, stop words, vectors and streams on small hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from sparklex.functions.stopwords import stop_words
from sparklex.operators import fuzzy, vectorize as V, vectors as X


@pytest.fixture
def docs(spark):
    texts = ["a river runs past the old mill", "the mill and a bridge", "children cross the bridge", "boats and rivers in summer", "water is cold"]
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def terms(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(V.Analyzer(**kw).terms(F.col("t"))).first()[0]


def test_analyzers(spark):
    assert terms(spark, "Café a naïve_1  x") == ["café", "naïve_1"]
    assert terms(spark, "a bb cc dd", ngrams=(1, 2)) == ["bb", "cc", "dd", "bb cc", "cc dd"]
    assert terms(spark, "ab  c", kind="char", ngrams=(2, 3)) == ["ab", "b ", " c", "ab ", "b c"]
    assert terms(spark, "ab  c", kind="char_wb", ngrams=(4, 5)) == [" ab ", " c "]
    assert terms(spark, "ab", kind="char_wb", ngrams=(2, 4)) == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert terms(spark, "Éa été", strip_accents=True) == ["ea", "ete"] and terms(spark, "the cat", stop_words=("the",)) == ["cat"]
    assert terms(spark, "") == [] and terms(spark, "x😀y", kind="char", ngrams=(2, 2)) == ["x😀", "😀y"]


def test_tfidf_by_hand(spark, docs):
    counts = V.term_counts(docs, "i", "t")
    vocab = V.with_idf(V.vocabulary(counts, "i", 5), 5)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert idf["the"] == pytest.approx(math.log(6 / 4) + 1) and idf["old"] == pytest.approx(math.log(6 / 2) + 1)
    assert [r["col"] for r in vocab.orderBy("term").collect()] == list(range(len(idf)))
    rows = V.tfidf(counts, vocab, "i")
    assert all(r["norm"] == pytest.approx(1) for r in V.norms(rows, "i").collect())
    assert V.packed(rows, "i", len(idf)).where("i = 0").first()["vector"]["indices"] == sorted(V.packed(rows, "i", 1).where("i = 0").first()["vector"]["indices"])
    assert {r["term"] for r in V.vocabulary(counts, "i", 5, 2, 0.5).collect()} == {"and", "mill", "bridge"}
    with pytest.raises(Exception, match="null"):
        V.term_counts(spark.createDataFrame([(1, None)], "i int, t string"), "i", "t").collect()


def test_hashing(spark, docs):
    rows = V.hashing_vectorize(V.term_counts(docs, "i", "t"), "i", 16).collect()
    assert all(0 <= r["col"] < 16 and r["value"] for r in rows)


def test_vectorizer_files(spark, docs, tmp_path):
    vocab = V.vocabulary(V.term_counts(docs, "i", "t"), "i", 5)
    V.save_vectorizer(vocab, {"ngrams": [1, 1]}, str(tmp_path / "v"))
    got, options = V.load_vectorizer(spark, str(tmp_path / "v"))
    assert sorted(got.collect()) == sorted(vocab.collect()) and options == {"ngrams": [1, 1]}
    spark.createDataFrame([('{"format": "other", "version": 1, "options": {}}',)], "value string").write.mode("overwrite").text(str(tmp_path / "v" / "options"))
    with pytest.raises(ValueError):
        V.load_vectorizer(spark, str(tmp_path / "v"))


def test_stop_words(spark):
    assert "the" in stop_words(spark, "en") and "und" in stop_words(spark, "de")
    with pytest.raises(ValueError):
        stop_words(spark, "xx")


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0]), (4, None)], "i int, v array<float>")
    assert [r[0] for r in df.where("i < 4").orderBy("i").select(X.l2_norm("v")).collect()] == [5.0, 0.0, 5.0]
    X.save_index(df.where("i < 4"), "i", "v", str(tmp_path / "x"), True)
    assert [round(x, 6) for x in spark.read.parquet(str(tmp_path / "x")).where("i = 1").first()["v"]] == [0.6, 0.8]
    got = X.nearest(df, df.where("i = 1"), 2, "i", "v").orderBy("rank").collect()
    assert [(r["i"], r["score"]) for r in got] == [(1, 25.0), (3, 24.0)]
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "i int, v array<float>")
    assert [r["i"] for r in X.nearest(ties, ties.where("i = 5"), 3, "i", "v").orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="length"):
        df.select(X.dot("v", F.array(F.lit(1.0)))).collect()
    with pytest.raises(ValueError):
        X.nearest(df, df, 0, "i", "v")


def test_extract_and_clusters(spark):
    q = spark.createDataFrame([(1, "new york jets"), (2, "zzz")], "q int, s string")
    c = spark.createDataFrame([(1, "new york giants"), (2, "new york jets"), (3, "dallas")], "c int, s string")
    got = fuzzy.extract(q, c, "q", "s", "c", "s", "ratio", 2, 50.0).orderBy("q", "rank").collect()
    assert [(r["q"], r["c"], r["rank"]) for r in got] == [(1, 2, 1), (1, 1, 2)] and got[0]["score"] == 100
    one = {r["q"]: r["c"] for r in fuzzy.extract_one(q, c, "q", "s", "c", "s", "ratio", 50.0).collect()}
    assert one == {1: 2, 2: None}
    from sparklex.functions import strings as T

    rows = spark.createDataFrame([(5, "a", "abcd"), (2, "a", "abce"), (3, "a", "xbce"), (4, "b", "abcd"), (9, "a", "abcd"), (7, None, "q")], "k int, g string, s string")
    got = {r["k"]: r["cluster"] for r in fuzzy.find_clusters(rows, "k", F.col("g"), lambda a, b: T.levenshtein_normalized_similarity(f"{a}s", f"{b}s"), ["s"], 0.75).collect()}
    assert got == {5: 2, 2: 2, 3: 2, 4: 4, 9: 2, 7: 7}


def test_precompiled_character_map():
    sp = pytest.importorskip("sentencepiece")
    from sparklex.functions.tokenize.models import CharsMap
    from sparklex.sources.artifacts import protobuf_fields

    model = sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    blob = next(b for n, v in protobuf_fields(model) if n == 3 for a, b in protobuf_fields(v) if a == 2)
    lib = sp.SentencePieceNormalizer(model_proto=model, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    mine = CharsMap(blob)
    for text in ["Ａｂｃ １２３", "ﬁne ½ ㎏", "ガｶﾞ", "café", "a b\tc​d", ""] + [f"{chr(c)}a{chr(c)}" for c in range(33, 0x3400, 29)]:
        assert mine.apply(text) == lib.normalize(text)


def test_streaming_distance(spark, tmp_path):
    from sparklex.functions import strings as T
    from sparklex.streaming.metrics import run_to_table

    spark.createDataFrame([("kitten", "sitting")], "a string, b string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    run_to_table(stream.select(T.osa("a", "b").alias("d")), "distances", str(tmp_path / "cp"), "append")
    assert [r["d"] for r in spark.table("distances").collect()] == [3]


def test_terms_are_counted_in_place(spark):
    unique = spark.createDataFrame([(1, "b a b"), (2, ""), (None, "a")], "i int, t string")
    counts = V.term_counts(unique, "i", "t", V.Analyzer(pattern=r"\w+"))
    assert sorted(counts.collect(), key=str) == sorted([(1, "a", 1.0), (1, "b", 2.0), (None, "a", 1.0)], key=str)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    twice = unique.unionByName(spark.createDataFrame([(1, "b c"), (None, "a")], "i int, t string"))
    want = [(1, "a", 1.0), (1, "b", 3.0), (1, "c", 1.0), (None, "a", 2.0)]
    assert sorted(V.term_counts(twice, "i", "t", V.Analyzer(pattern=r"\w+")).collect(), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind,n", [("char", 2), ("char", 3), ("char", 9), ("char_wb", 2), ("char_wb", 3), ("char_wb", 4), ("char_wb", 6)])
def test_totals_of_character_grams(spark, monkeypatch, kind, n):
    texts = ["", " ", "a", "  Ab  abc\t\nabcd ab", "x😀y x😀y", "a\x00b\x00 \x00", "é ß " * 30, "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "abcdefghij" * 20]
    monkeypatch.setattr(V, "GRAM_CHARS", 50)
    a = V.Analyzer(kind, (n, n))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    counts = df.select("i", F.explode(a.terms(F.col("t"))).alias("term"))
    want = {r["term"]: (r["n"], r["df"]) for r in counts.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("i").alias("df")).collect()}
    got = {r["term"]: (r["n"], r["df"]) for r in V.term_totals(df, "i", "t", a).collect()}
    assert got == want
    again = {r["term"]: (r["n"], r["df"]) for r in V.term_totals(df.unionByName(df), "i", "t", a).collect()}
    assert again == {t: (2 * x, d) for t, (x, d) in want.items()}


def test_rare_terms_are_joined_too(spark, docs, monkeypatch):
    counts = V.term_counts(docs, "i", "t")
    vocab = V.with_idf(V.vocabulary(counts, "i", 5), 5)
    plain = [sorted(V.count_vectorize(counts, vocab, "i").collect()), sorted(V.tfidf(counts, vocab, "i", None).collect())]
    normed = {(r["i"], r["term"]): r["value"] for r in V.tfidf(counts, vocab, "i").collect()}
    for bound in (0, 2, 4):  # none, and some, of the terms are frequent
        monkeypatch.setattr(V, "FREQUENT", bound)
        assert [sorted(V.count_vectorize(counts, vocab, "i").collect()), sorted(V.tfidf(counts, vocab, "i", None).collect())] == plain
        assert {(r["i"], r["term"]): pytest.approx(r["value"]) for r in V.tfidf(counts, vocab, "i").collect()} == normed


def test_best_rows_without_a_sort(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import IntegerType

    rng = np.random.default_rng(3)
    for low in (rng.integers(4, size=(30, 50)).astype(float), rng.normal(size=(5, 7)), np.zeros((2, 9)), np.where(rng.random((9, 20)) < 0.8, np.nan, 1.0)):
        for k in (1, 3, 7, 60):
            at = np.argsort(low, axis=1, kind="stable")[:, :k]
            row, got = X._best(low, k)
            assert got.tolist() == at.ravel().tolist() and row.tolist() == np.repeat(np.arange(len(low)), at.shape[1]).tolist()
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "i int, v array<float>").coalesce(1)
    monkeypatch.setattr(X, "ROW_BLOCK", 4)
    shared = type("B", (), {"value": ([0, 1], np.array([[1.0, 0.0], [0.0, 1.0]]))})()
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int32()), pa.array([[float(i % 3), 1.0] for i in range(9)], pa.list_(pa.float32()))], names=["k", "v"])
    out = list(X._search(shared, 2, False, (IntegerType(), IntegerType()))([batch]))
    assert [len(b) for b in out] == [4, 4, 2] and out[0].to_pylist()[0] == {"query": 0, "k": 2, "score": 2.0}
    assert [r["i"] for r in X.nearest(df, df.where("i = 2"), 3, "i", "v").orderBy("rank").collect()] == [2, 5, 8]
