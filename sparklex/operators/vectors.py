"""Dense vectors: dot products, norms, pooling and exact nearest neighbours.

Search is exhaustive. Queries come to the driver in order, a partition at a time, and are broadcast in blocks of
``QUERY_BLOCK``; every task multiplies its vectors with a block as one matrix product and keeps its best ``k`` of each query, so what is
shuffled is k rows a query and Arrow batch, never all pairs.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries broadcast at once.
QUERY_BLOCK = 4_096
#: Rows that a task holds as a matrix.
ROW_BLOCK = 4_096


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Sum of products in double precision; different lengths are refused."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(total)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """A zero vector stays."""
    v = _col(v)
    pair = F.array(F.struct(v.alias("v"), l2_norm(v).alias("n")))
    return F.element_at(F.transform(pair, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, (x / p["n"]).cast("float")).otherwise(x.cast("float")))), 1)


def mean_pool(df: DataFrame, key: str, vector: str, mask: str | None = None, normalize: bool = False) -> DataFrame:
    """``key``, ``vector``: the mean of the token vectors of each key whose mask is set, over max(count, 1e-9)."""
    rows = df.select(key, F.col(mask).cast("double").alias("m") if mask else F.lit(1.0).alias("m"), F.posexplode(vector).alias("i", "x"))
    sums = rows.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).cast("float").alias("x"))
    out = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("vector"))
    return out.withColumn("vector", l2_normalize("vector")) if normalize else out


def nearest(index: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str | None = None, query_vector: str | None = None, normalize: bool = False) -> DataFrame:
    """``query``, ``key``, ``score``, ``rank``: the ``k`` greatest dot products of each query, ties by key.

    With ``normalize`` both sides are brought to unit length, which makes the score a cosine. Scores are float32
    products summed in double precision.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    query_key, query_vector = query_key or key, query_vector or vector
    rows = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v")).where("v is not null").orderBy("q").toLocalIterator()
    key_type = index.schema[key].dataType
    query_type = queries.schema[query_key].dataType
    source = index.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    schema = f"query {query_type.simpleString()}, k {key_type.simpleString()}, score double"
    parts = []
    while block := list(islice(rows, QUERY_BLOCK)):
        shared = index.sparkSession.sparkContext.broadcast(([r["q"] for r in block], _matrix([r["v"] for r in block], normalize)))
        parts.append(source.mapInArrow(_search(shared, k, normalize, (query_type, key_type)), schema))
    if not parts:
        return index.sparkSession.createDataFrame([], f"query {query_type.simpleString()}, {key} {key_type.simpleString()}, score double, rank bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "k")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query", F.col("k").alias(key), "score", "rank")


def _matrix(vectors: list, normalize: bool) -> np.ndarray:
    m = np.array(vectors, dtype=np.float64)
    if normalize and len(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.where(n > 0, m / np.maximum(n, 1e-300), m).astype(np.float32).astype(np.float64)
    return m


def _rows(vectors: pa.Array, normalize: bool) -> np.ndarray:
    """A matrix of an Arrow column, without a Python object a number."""
    sizes = np.diff(vectors.offsets)
    flat = vectors.flatten()
    if len(set(sizes)) != 1 or flat.null_count:
        raise ValueError("vectors differ in length or hold nulls")
    return _matrix(flat.to_numpy(zero_copy_only=False).reshape(len(vectors), -1), normalize)


def _best(low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of its ``k`` least values, ties by place, without a sort of whole rows."""
    if low.shape[1] > k:
        most = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero((low <= most) | np.isnan(most))
        order = np.lexsort((at, low[row, at], row))
        row, at = row[order], at[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], at[rank < k]
    at = np.argsort(low, axis=1, kind="stable")
    return np.repeat(np.arange(len(low)), at.shape[1]), at.ravel()


def _search(shared, k: int, normalize: bool, types: tuple):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        query_type, key_type = map(to_arrow_type, types)
        names, q = shared.value
        for batch in (b.slice(at, ROW_BLOCK) for b in batches for at in range(0, len(b), ROW_BLOCK)):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            m = _rows(batch.column(1), normalize)[order]
            for lo in range(0, len(q), 256):
                low = -(q[lo : lo + 256] @ m.T)  # a row a query
                col, row = _best(low, k)
                out_q = [names[lo + j] for j in col.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, query_type), pa.array(keys[row]).cast(key_type), pa.array(-low[col, row])], names=["query", "k", "score"])

    return run


INDEX_FORMAT, INDEX_VERSION = "sparklex/index", 1


def save_index(index: DataFrame, key: str, vector: str, path: str, normalize: bool = False) -> None:
    """The index as Parquet, float32, normalised on the way if asked, beside a header with format, version, dimension,
    flag and column names. Null vectors and vectors of different lengths are refused."""
    import json

    v = l2_normalize(vector) if normalize else F.transform(vector, lambda x: x.cast("float"))
    sizes = index.agg(F.min(F.coalesce(F.size(vector), F.lit(-1))).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes["a"] is not None and (sizes["a"] != sizes["b"] or sizes["a"] < 1):
        raise ValueError("the vectors of an index have one length, at least 1")
    index.select(key, v.alias(vector)).write.parquet(path)
    header = {"format": INDEX_FORMAT, "version": INDEX_VERSION, "dimension": sizes["a"] or 0, "normalized": normalize, "key": key, "vector": vector}
    index.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_meta/header")


def load_index(spark, path: str, dimension: int | None = None) -> tuple[DataFrame, dict]:
    """What ``save_index`` wrote, and its header; another format or version, or a dimension other than ``dimension``, is refused."""
    import json

    header = json.loads(spark.read.text(f"{path}/_meta/header").first()[0])
    if header.get("format") != INDEX_FORMAT or header.get("version") != INDEX_VERSION:
        raise ValueError(f"{path} is no index of this version")
    if dimension is not None and header["dimension"] != dimension:
        raise ValueError(f"the index has {header['dimension']} dimensions, not {dimension}")
    return spark.read.parquet(path), header
