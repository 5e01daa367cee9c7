"""Queries of fuzzy matching, deduplication and vector search with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklex.functions import strings as T
from sparklex.operators import fuzzy as Z, vectors as X
from sparklex.plans.queries_text import _ratio

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each part type and brand as a query, each distinct part name as a choice."""
    p = s.read.parquet(f"{d}/part.parquet")
    q = p.groupBy(F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("query")).agg(F.min("p_partkey").alias("q"))
    return q, p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("c"))


_ND = "WITH q AS (SELECT lower(p_type) || ' ' || lower(p_brand) AS query, min(p_partkey) AS q FROM part GROUP BY 1), c AS (SELECT p_name AS name, min(p_partkey) AS c FROM part GROUP BY 1)"


def _extract(s, d, **kw) -> DataFrame:
    q, c = _names(s, d)
    return Z.extract(q, c, "q", "query", "c", "name", **kw).withColumn("score", F.round("score", 6))


_jw = lambda a, b: 100 * T.jaro_winkler(a, b)
_add("extract_top5", lambda s, d: _extract(s, d))
_add("extract_ratio_cutoff", lambda s, d: _extract(s, d, scorer="ratio", limit=None, cutoff=45.0), f"{_ND} SELECT q, c, name AS choice, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM (SELECT *, {_ratio('query', 'name')} AS s FROM q, c) WHERE s >= 45")
_add("extract_jaro_winkler_top5", lambda s, d: _extract(s, d, scorer=_jw), f"{_ND} SELECT q, c, name AS choice, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM (SELECT *, 100 * jaro_winkler_similarity(query, name) AS s FROM q, c) QUALIFY rank <= 5")


def _extract_one(s, d) -> DataFrame:
    q, c = _names(s, d)
    return Z.extract_one(q, c, "q", "query", "c", "name", lambda a, b: 100 * T.levenshtein_normalized_similarity(a, b), 25.0).withColumn("score", F.round("score", 6))


_add("extract_one_levenshtein", _extract_one, f"{_ND}, m AS (SELECT *, 100 * (1 - levenshtein(query, name) / greatest(length(query), length(name))::DOUBLE) AS s FROM q, c), b AS (SELECT q, c, name, s FROM m WHERE s >= 25 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) = 1) SELECT q.q, b.c, b.name AS choice, round(b.s, 6) AS score FROM q LEFT JOIN b ON q.q = b.q")


def _clusters(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet").withColumn("label", F.concat_ws(" ", "p_name", "p_type"))
    return Z.find_clusters(p, "p_partkey", F.col("p_brand"), lambda a, b: T.levenshtein_normalized_similarity(f"{a}label", f"{b}label"), ["label"], 0.75)


_add("dedup_clusters", _clusters, """WITH RECURSIVE r AS (SELECT p_brand AS b, p_name || ' ' || p_type AS t, min(p_partkey) AS k FROM part GROUP BY 1, 2),
e AS (SELECT x.k AS a, y.k AS z FROM r x JOIN r y ON x.b = y.b AND x.k <> y.k AND 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t))::DOUBLE >= 0.75),
w AS (SELECT k AS n, k AS m FROM r UNION SELECT e.z, w.m FROM w JOIN e ON e.a = w.n), c AS (SELECT n, min(m) AS cluster FROM w GROUP BY n)
SELECT p_partkey, cluster FROM part JOIN r ON r.b = p_brand AND r.t = p_name || ' ' || p_type JOIN c ON c.n = r.k""")


EMB = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
_V = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"


def _search(s, d, normalize: bool) -> DataFrame:
    e = EMB(s, d)
    return X.nearest(e, e.where("vec_id % 20 = 0"), 10, "vec_id", "embedding", normalize=normalize).withColumn("score", F.round("score", 4))


_KNN = "SELECT query, vec_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, {s} AS s FROM ({v}) q, ({v}) e WHERE q.vec_id % 20 = 0) QUALIFY rank <= 10"
_add("knn_top10", lambda s, d: _search(s, d, False), _KNN.format(s="list_dot_product(q.v, e.v)", v=_V))
_add("knn_top10_cosine", lambda s, d: _search(s, d, True), _KNN.format(s="list_cosine_similarity(q.v, e.v)", v=_V))
_add("dot_product", lambda s, d: EMB(s, d).select("vec_id", F.round(X.dot("embedding", F.reverse("embedding")), 5).alias("value")), f"SELECT vec_id, round(list_dot_product(v, list_reverse(v)), 5) AS value FROM ({_V})")
_add("l2_norm", lambda s, d: EMB(s, d).select("vec_id", F.round(X.l2_norm("embedding"), 6).alias("value")), f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS value FROM ({_V})")
_long = lambda df, v: df.select(*[c for c in df.columns if c != v], F.posexplode(v).alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))
_add("l2_normalize", lambda s, d: _long(EMB(s, d).select("vec_id", X.l2_normalize("embedding").alias("v")), "v"), f"SELECT vec_id, CAST(i - 1 AS INT) AS i, round((v[i] / n)::FLOAT::DOUBLE, 4) AS x FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(1, len(v) + 1)) AS i FROM ({_V}))")
_add("mean_pool", lambda s, d: _long(X.mean_pool(EMB(s, d).withColumn("m", (F.col("vec_id") % 3 != 0).cast("int")), "label", "embedding", "m"), "vector"), f"SELECT label, CAST(i - 1 AS INT) AS i, round((sum(v[i] * m) / greatest(sum(m), 1e-9))::FLOAT::DOUBLE, 4) AS x FROM (SELECT label, v, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, unnest(range(1, len(v) + 1)) AS i FROM ({_V})) GROUP BY label, i")
_add("mean_pool_normalize", lambda s, d: _long(X.mean_pool(EMB(s, d), "label", "embedding", None, True), "vector"), f"WITH p AS (SELECT label, i, avg(v[i])::FLOAT::DOUBLE AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM ({_V})) GROUP BY label, i) SELECT label, CAST(i - 1 AS INT) AS i, round((x / sqrt(sum(x * x) OVER (PARTITION BY label)))::FLOAT::DOUBLE, 4) AS x FROM p")
