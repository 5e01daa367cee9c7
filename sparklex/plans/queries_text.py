"""Queries of the string functions and vectorizers with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparklex.functions import phonetics as P, setsim as S, strings as T
from sparklex.operators import vectorize as V
from sparklex.plans import sql_text as Q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name beside that of the part with the next key."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("b"))
    return p.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a")).join(q, "p_partkey")


_N = "SELECT p.p_partkey, p.p_name || ' ' || lower(p.p_type) AS a, q.p_name || ' ' || q.p_brand AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1"


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out by both texts: all cores have some, however few files there are, and a repeated pair is computed once
    a task."""
    return pairs.repartition("a", "b")


def _pair(name: str, f, sql: str | None, digits: int | None = 6, native: bool = False) -> None:
    def query(s, d):
        v = f("a", "b")
        rows = names(s, d) if native else dealt(names(s, d))
        return rows.select("p_partkey", "a", "b", (v.cast("long") if digits is None else F.round(v, digits)).alias("value"))

    _add(name, query, sql and f"SELECT p_partkey, a, b, {f'CAST({sql} AS BIGINT)' if digits is None else f'round(({sql})::DOUBLE, {digits})'} AS value FROM ({_N})")


_MAX, _HAM = "greatest(length(a), length(b))", "abs(length(a) - length(b)) + len([i FOR i IN range(1, least(length(a), length(b)) + 1) IF a[i] <> b[i]])"
_pair("levenshtein", T.levenshtein, "levenshtein(a, b)", None, native=True)
_pair("levenshtein_normalized_distance", T.levenshtein_normalized_distance, f"levenshtein(a, b) / {_MAX}", native=True)
_pair("levenshtein_normalized_similarity", T.levenshtein_normalized_similarity, f"1 - levenshtein(a, b) / {_MAX}", native=True)
_pair("damerau_levenshtein", T.damerau_levenshtein, "damerau_levenshtein(a, b)", None)
_pair("damerau_normalized_similarity", lambda a, b: T.normalized_similarity(T.damerau_levenshtein(a, b), a, b), f"1 - damerau_levenshtein(a, b) / {_MAX}")
_pair("hamming", T.hamming, _HAM, None, native=True)
_pair("hamming_normalized_similarity", T.hamming_normalized_similarity, f"1 - ({_HAM}) / {_MAX}", native=True)
_pair("jaro", T.jaro, "jaro_similarity(a, b)")
_pair("jaro_distance", T.jaro_distance, "1 - jaro_similarity(a, b)")
_pair("jaro_winkler", T.jaro_winkler, "jaro_winkler_similarity(a, b)")


def _lcs(a: str, b: str) -> str:
    """SQL for the longest common subsequence: a fold over the rows of the table, each a fold over its cells."""
    cell = f"list_append(new, CASE WHEN ({b})[j[1]] = chr(x[1]) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], new[j[1]]) END)"
    inner = f"list_reduce([[j::INT] FOR j IN range(1, length({b}) + 1)], lambda new, j: {cell}, [0::INT])"
    return f"coalesce(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce([[ord(c)::INT] FOR c IN string_split({a}, '')], lambda row, x: {inner}, list_resize([0::INT], length({b}) + 1, 0::INT))[length({b}) + 1] END, 0)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"
_TOKENS = f"SELECT p_partkey, a, b, {_SORTED.format(x='a')} AS sa, {_SORTED.format(x='b')} AS sb, list_sort(list_distinct(string_split(a, ' '))) AS ta, list_sort(list_distinct(string_split(b, ' '))) AS tb FROM ({_N})"
_SETS3 = f"SELECT *, array_to_string(i, ' ') AS si, trim(array_to_string(list_concat(i, da), ' ')) AS ca, trim(array_to_string(list_concat(i, db), ' ')) AS cb FROM (SELECT *, [t FOR t IN ta IF list_contains(tb, t)] AS i, [t FOR t IN ta IF NOT list_contains(tb, t)] AS da, [t FOR t IN tb IF NOT list_contains(ta, t)] AS db FROM ({_TOKENS}))"
_FUZZ = {"ratio": _ratio("a", "b"), "token_sort_ratio": _ratio("sa", "sb"), "token_set_ratio": f"greatest({_ratio('si', 'ca')}, {_ratio('si', 'cb')}, {_ratio('ca', 'cb')})"}
#: The state of a fold is the last two rows of the table, one behind the other.
_CELL = "least(acc[m + 2 + j[1]] + 1, new[j[1]] + 1, acc[m + 1 + j[1]] + CASE WHEN ord(b[j[1]]) = x[1] THEN 0 ELSE 1 END, CASE WHEN x[3] > 1 AND j[1] > 1 AND ord(b[j[1] - 1]) = x[1] AND ord(b[j[1]]) = x[2] THEN acc[j[1] - 1] + 1 ELSE 1000000 END)"
_OSA = f"list_reduce([[ord(a[i])::INT, CASE WHEN i > 1 THEN ord(a[i - 1]) ELSE -1 END::INT, i::INT] FOR i IN range(1, length(a) + 1)], lambda acc, x: list_concat(acc[m + 2:], list_reduce([[j::INT] FOR j IN range(1, m + 1)], lambda new, j: list_append(new, ({_CELL})::INT), [x[3]])), list_concat([k::INT FOR k IN range(0, m + 1)], [k::INT FOR k IN range(0, m + 1)]))[2 * m + 2]"
_pair("osa", T.osa, None, None)
ORACLES["osa"] = f"SELECT p_partkey, a, b, ({_OSA})::BIGINT AS value FROM (SELECT *, length(b)::INT AS m FROM ({_N}))"
_pair("indel", T.indel, f"length(a) + length(b) - 2 * {_lcs('a', 'b')}", None)
_pair("indel_normalized_similarity", lambda a, b: T.normalized_similarity(T.indel(a, b), a, b, True), f"{_ratio('a', 'b')} / 100")
_pair("lcs_subsequence", T.lcs_subsequence, _lcs("a", "b"), None)
_pair("lcs_substring", T.lcs_substring, "list_max([len(s) FOR s IN list_distinct(flatten([[a[i:j] FOR j IN range(i, length(a) + 1)] FOR i IN range(1, length(a) + 1)])) IF contains(b, s)])", None)
_pair("ratcliff_obershelp", T.ratcliff_obershelp, None)
ORACLES["ratcliff_obershelp"] = f"SELECT p_partkey, a, b, round((2 * matched / (length(a) + length(b)))::DOUBLE, 6) AS value FROM ({_N}) JOIN ({Q.ratcliff(_N)}) USING (p_partkey)"
for _s in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "partial_token_sort_ratio", "partial_token_set_ratio", "weighted_ratio"):
    _pair(f"fuzz_{_s}", lambda a, b, s=_s: T.fuzz(s, a, b), None)
    if _s in _FUZZ:
        ORACLES[f"fuzz_{_s}"] = f"SELECT p_partkey, a, b, round(({_FUZZ[_s]})::DOUBLE, 6) AS value FROM ({_SETS3})"
_WHOLE, _SORT = f"SELECT p_partkey, 'w' AS k, a AS x, b AS y FROM ({_N})", f"SELECT p_partkey, 's' AS k, sa AS x, sb AS y FROM ({_TOKENS})"
_SET = " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS k, {x} AS x, {y} AS y FROM ({_SETS3})" for k, x, y in (("l", "si", "ca"), ("r", "si", "cb"), ("b", "ca", "cb")))
_BEST = "SELECT p_partkey, max(score) AS {n} FROM ({q}) GROUP BY p_partkey"
for _s, _q in (("partial_ratio", _WHOLE), ("partial_token_sort_ratio", _SORT), ("partial_token_set_ratio", _SET)):
    ORACLES[f"fuzz_{_s}"] = f"SELECT p_partkey, a, b, round(v, 6) AS value FROM ({_N}) JOIN ({_BEST.format(n='v', q=Q.partial_scores(_q))}) USING (p_partkey)"
_PARTS = " JOIN ".join(f"({_BEST.format(n=n, q=Q.partial_scores(q))}) {'USING (p_partkey)' if n != 'pw' else ''}" for n, q in (("pw", _WHOLE), ("ps", _SORT), ("pt", _SET)))
_LONG = "greatest(length(a), length(b)) / least(length(a), length(b))::DOUBLE"
ORACLES["fuzz_weighted_ratio"] = f"""SELECT p_partkey, a, b, round(CASE WHEN d < 1.5 THEN greatest(w, 0.95 * s, 0.95 * t) ELSE greatest(w, z * pw, 0.95 * z * ps, 0.95 * z * pt) END, 6) AS value
FROM (SELECT p_partkey, a, b, {_LONG} AS d, (CASE WHEN {_LONG} > 8 THEN 0.6 ELSE 0.9 END)::DOUBLE AS z, ({_FUZZ["ratio"]})::DOUBLE AS w, ({_FUZZ["token_sort_ratio"]})::DOUBLE AS s, ({_FUZZ["token_set_ratio"]})::DOUBLE AS t FROM ({_SETS3})) JOIN (SELECT * FROM {_PARTS}) USING (p_partkey)"""
_TOK_CELL = "least(row[j[1] + 1] + 1, new[j[1]] + 1, row[j[1]] + CASE WHEN tb[j[1]] = ta[x[1]] THEN 0 ELSE 1 END)::INT"
_add("levenshtein_tokens", lambda s, d: dealt(names(s, d)).select("p_partkey", T.levenshtein_tokens(F.split("a", " "), F.split("b", " ")).alias("value")),
     f"SELECT p_partkey, list_reduce([[i::INT] FOR i IN range(1, len(ta) + 1)], lambda row, x: list_reduce([[j::INT] FOR j IN range(1, len(tb) + 1)], lambda new, j: list_append(new, {_TOK_CELL}), [x[1]]), [k::INT FOR k IN range(0, len(tb) + 1)])[len(tb) + 1] AS value FROM (SELECT p_partkey, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM ({_N}))")
_GRAMS = "[{x}[i:i + 1] FOR i IN range(1, length({x}))]"
_SETS = f"SELECT *, len(x)::DOUBLE AS m, len(y)::DOUBLE AS n, coalesce(list_sum([least(len([v FOR v IN x IF v = g]), len([v FOR v IN y IF v = g])) FOR g IN list_distinct(x)]), 0)::DOUBLE AS i FROM (SELECT *, {_GRAMS.format(x='a')} AS x, {_GRAMS.format(x='b')} AS y FROM ({_N}))"
for _n, _f, _e in (("jaccard", S.jaccard, "i / (m + n - i)"), ("sorensen_dice", S.sorensen_dice, "2 * i / (m + n)"), ("overlap", S.overlap, "i / least(m, n)"), ("cosine", S.cosine, "i / sqrt(m * n)"), ("tversky", lambda a, b: S.tversky(a, b, 2, 0.3, 0.7), "i / (i + 0.3 * (m - i) + 0.7 * (n - i))")):
    _add(f"{_n}_bigrams", lambda s, d, f=_f: names(s, d).select("p_partkey", F.round(f("a", "b"), 6).alias("value")), f"SELECT p_partkey, round({_e}, 6) AS value FROM ({_SETS})")


def words(spark: SparkSession, sf: str, lang: str | None = None) -> DataFrame:
    """The distinct words of all documents (of a language), with their counts."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.where(F.col("lang") == lang) if lang else d
    return d.select(F.explode(V.Analyzer().terms(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_UP = "translate(regexp_replace(translate(word, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g'), '', '')"
_DIGITS = "translate(regexp_replace(u, '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUY', '111122222222334556000000')"
for _d in "123456":
    _DIGITS = f"regexp_replace({_DIGITS}, '{_d}+', '{_d}', 'g')"
_SOUND = f"SELECT word, CASE WHEN u = '' THEN '' ELSE left(u[1] || replace(CASE WHEN u[1] IN ('H', 'W') THEN d ELSE substr(d, 2) END, '0', '') || '000', 4) END AS code FROM (SELECT word, u, {_DIGITS} AS d FROM (SELECT word, {_UP} AS u FROM (SELECT DISTINCT term AS word FROM ({{tok}}))))"
_add("soundex", lambda s, d: words(s, d).select("word", P.soundex("word").alias("code")))
_add("metaphone", lambda s, d: words(s, d).select("word", P.metaphone("word").alias("code")))
_add("nysiis", lambda s, d: words(s, d).select("word", P.nysiis("word").alias("code")))

DOCS = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
_TOK = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents"
_WORDS = f"SELECT DISTINCT term AS word FROM ({_TOK})"
ORACLES |= {"soundex": _SOUND.format(tok=_TOK), "metaphone": Q.metaphone(_WORDS), "nysiis": Q.nysiis(_WORDS)}
_TF = f"tf AS (SELECT doc_id, any_value(lang) AS lang, term, count(*)::DOUBLE AS tf FROM ({_TOK}) GROUP BY doc_id, term), n AS (SELECT count(*) AS n FROM documents)"
_DF = "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"


def _counts(s, d, analyzer=V.Analyzer(), **kw) -> DataFrame:
    return V.term_counts(DOCS(s, d), "doc_id", "text", analyzer, **kw)


def _fitted(s, d, min_df=1, max_df=1.0, analyzer=V.Analyzer(), binary=False):
    counts = V.Scratch(s, "counts").save(_counts(s, d, analyzer, binary=binary))
    n = DOCS(s, d).count()
    return counts, V.vocabulary(counts, "doc_id", n, min_df, max_df), n


def _tfidf(s, d, norm="l2", sublinear=False, min_df=1, smooth=True) -> DataFrame:
    counts, vocab, n = _fitted(s, d, min_df)
    return V.tfidf(counts, V.with_idf(vocab, n, smooth), "doc_id", norm, sublinear)


def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The five terms of each language with the greatest sum of normalised tf-idf weights."""
    rows = _tfidf(spark, sf).join(DOCS(spark, sf).select("doc_id", "lang"), "doc_id")
    sums = rows.groupBy("lang", "term").agg(F.round(F.sum("value"), 6).alias("weight"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("weight").desc(), "term"))
    return sums.withColumn("rank", top.cast("long")).where("rank <= 5")


_IDF = "ln((1 + n) / (1 + df)) + 1"
_W = f"WITH {_TF}, {_DF}, w AS (SELECT doc_id, lang, term, tf * ({_IDF}) AS v FROM tf JOIN df USING (term), n), l AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM w GROUP BY doc_id)"
_add("tfidf_top_terms", tfidf_top_terms, f"{_W}, s AS (SELECT lang, term, round(sum(v / l), 6) AS weight FROM w JOIN l USING (doc_id) GROUP BY lang, term) SELECT lang, term, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 5")
_out = lambda rows: rows.select("doc_id", "term", F.round("value", 6).alias("value"))
_add("tfidf_vectorizer", lambda s, d: _out(_tfidf(s, d)), f"{_W} SELECT doc_id, term, round(v / l, 6) AS value FROM w JOIN l USING (doc_id)")
_add("tfidf_sublinear_l1", lambda s, d: _out(_tfidf(s, d, "l1", True, 3)), f"WITH {_TF}, {_DF}, w AS (SELECT doc_id, term, (1 + ln(tf)) * ({_IDF}) AS v FROM tf JOIN df USING (term), n WHERE df >= 3), l AS (SELECT doc_id, sum(abs(v)) AS l FROM w GROUP BY doc_id) SELECT doc_id, term, round(v / l, 6) AS value FROM w JOIN l USING (doc_id)")
_add("tfidf_no_norm_no_smooth", lambda s, d: _out(_tfidf(s, d, None, False, 2, False)), f"WITH {_TF}, {_DF} SELECT doc_id, term, round(tf * (ln(n / df) + 1), 6) AS value FROM tf JOIN df USING (term), n WHERE df >= 2")
_VOC = "v AS (SELECT term, df, (row_number() OVER (ORDER BY term COLLATE \"C\") - 1)::INT AS col FROM df, n WHERE {w})"
_add("count_vectorizer_vocabulary", lambda s, d: _fitted(s, d)[1].select("term", "df", "col"), f"WITH {_TF}, {_DF}, {_VOC.format(w='true')} SELECT term, df, col FROM v")
_add("count_vectorizer_df_pruned", lambda s, d: _fitted(s, d, 5, 0.4)[1].select("term", "df", "col"), f"WITH {_TF}, {_DF}, {_VOC.format(w='df >= 5 AND df <= 0.4 * n')} SELECT term, df, col FROM v")


def _vectors(s, d, **kw) -> DataFrame:
    counts, vocab, _ = _fitted(s, d, **kw)
    return V.count_vectorize(counts, vocab, "doc_id").select("doc_id", "term", "col", "value")


_add("count_vectorizer", lambda s, d: _vectors(s, d), f"WITH {_TF}, {_DF}, {_VOC.format(w='true')} SELECT doc_id, term, col, tf AS value FROM tf JOIN v USING (term)")
_add("count_vectorizer_binary", lambda s, d: _vectors(s, d, min_df=0.01, binary=True), f"WITH {_TF}, {_DF}, {_VOC.format(w='df >= 0.01 * n')} SELECT doc_id, term, col, 1.0::DOUBLE AS value FROM tf JOIN v USING (term)")
_LIST = f"SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents"
_total = lambda s, d, analyzer: V.term_totals(DOCS(s, d), "doc_id", "text", analyzer)
_SUM = "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({t}) GROUP BY term"
_add("word_ngrams_1_2", lambda s, d: _total(s, d, V.Analyzer(ngrams=(1, 2))), _SUM.format(t=f"SELECT doc_id, unnest(w) AS term FROM ({_LIST}) UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM ({_LIST})"))
_CH = "SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS t FROM documents"
_add("char_ngrams_3", lambda s, d: _total(s, d, V.Analyzer("char", (3, 3))), _SUM.format(t=f"SELECT doc_id, unnest([substr(t, i, 3) FOR i IN range(1, length(t) - 1)]) AS term FROM ({_CH})"))
_WB = "SELECT doc_id, ' ' || unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF x <> '']) || ' ' AS w FROM documents"
_add("char_wb_ngrams_4", lambda s, d: _total(s, d, V.Analyzer("char_wb", (4, 4))), _SUM.format(t=f"SELECT doc_id, unnest(CASE WHEN length(w) < 4 THEN [w] ELSE [substr(w, i, 4) FOR i IN range(1, length(w) - 2)] END) AS term FROM ({_WB})"))
_STOP = ("the", "and", "of", "to", "is", "der", "die", "und", "la", "le", "de", "el", "que")
_add("stop_word_filter", lambda s, d: _total(s, d, V.Analyzer(stop_words=_STOP)), _SUM.format(t=f"SELECT doc_id, term FROM ({_TOK}) WHERE term NOT IN {_STOP}"))
_add("strip_accents", lambda s, d: _total(s, d, V.Analyzer(strip_accents=True)), _SUM.format(t="SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents"))
_add("hashing_vectorizer", lambda s, d: V.hashing_vectorize(_counts(s, d), "doc_id", 1 << 18).withColumn("value", F.round("value", 6)),
     f"WITH {_TF}, h AS ({Q.murmur3('SELECT DISTINCT term FROM tf')}), c AS (SELECT doc_id, (abs(h) % 262144)::INT AS col, sum(CASE WHEN h < 0 THEN -tf ELSE tf END) AS v FROM tf JOIN h USING (term) GROUP BY 1, 2) SELECT doc_id, col, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM c WHERE v <> 0")
_add("row_norms", lambda s, d: V.norms(_counts(s, d).withColumnRenamed("tf", "value"), "doc_id").withColumn("norm", F.round("norm", 6)), f"WITH {_TF} SELECT doc_id, round(sqrt(sum(tf * tf)), 6) AS norm FROM tf GROUP BY doc_id")


def _stems(lang: str, where: str):
    from sparklex.functions.stemming import stem

    return lambda s, d: words(s, d, where).select("word", stem("word", lang).alias("stem"))


for _l, _where in (("porter", "en"), ("en", "en"), ("fr", "fr"), ("de", "de"), ("es", "es"), ("it", "es"), ("pt", "es")):
    _add(f"stem_{_l}", _stems(_l, _where))
