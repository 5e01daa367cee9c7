"""Agreement of two clusterings over one contingency table, and validity of a clustering from its vectors.

The contingency table is one shuffle of map-side combined counts; marginals and pair counts are sums over it. Empty
input gives no row from the table, which each metric turns into its documented value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparklex.plans.scratch import Scratch

EPS = 2.0**-52


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a``, ``b``, ``n`` with the marginals ``na``, ``nb`` and the total ``t``.

    The counted cells are written once; marginals are aggregated and joined back, so a class that meets most others is
    no single task's work. A null is a class of its own.
    """
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    cells = Scratch(df.sparkSession, "contingency").save(cells, "cells")
    na = cells.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("na"))
    nb = cells.groupBy(F.col("b").alias("_b")).agg(F.sum("n").alias("nb"))
    t = cells.agg(F.sum("n").alias("t"))  # one row
    out = cells.join(na, F.col("a").eqNullSafe(F.col("_a"))).join(nb, F.col("b").eqNullSafe(F.col("_b"))).crossJoin(F.broadcast(t))
    return out.select("a", "b", "n", "na", "nb", "t")


def summary(cells: DataFrame) -> DataFrame:
    """One row: pair sums, information and entropies of a contingency table."""
    c = F.col
    n, na, nb, t = c("n"), c("na"), c("nb"), c("t")
    mi = n / t * (F.log(n / t) - F.log(na / t) - F.log(nb / t))
    return cells.agg(
        F.coalesce(F.max("t"), F.lit(0.0)).alias("t"), F.coalesce(F.sum(n * n), F.lit(0.0)).alias("sq"), F.coalesce(F.sum(n * na), F.lit(0.0)).alias("sq_a"), F.coalesce(F.sum(n * nb), F.lit(0.0)).alias("sq_b"),
        F.coalesce(F.sum(F.when(F.abs(mi) < EPS, 0.0).otherwise(mi)), F.lit(0.0)).alias("mi"),
        F.coalesce(-F.sum(n / t * F.log(na / t)), F.lit(0.0)).alias("ha"), F.coalesce(-F.sum(n / t * F.log(nb / t)), F.lit(0.0)).alias("hb"),
        F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"),
    )


def _pairs() -> tuple[Column, Column, Column, Column]:
    c = F.col
    c11 = c("sq") - c("t")
    c01, c10 = c("sq_b") - c("sq"), c("sq_a") - c("sq")
    return c("t") * c("t") - c01 - c10 - c("sq"), c01, c10, c11


def pair_confusion(s: DataFrame) -> DataFrame:
    """``c00``, ``c01``, ``c10``, ``c11`` over ordered pairs of samples."""
    return s.select(*[x.cast("long").alias(n) for x, n in zip(_pairs(), ("c00", "c01", "c10", "c11"), strict=True)])


def _value(x: Column) -> Column:
    return x.cast("double").alias("value")


def rand(s: DataFrame) -> DataFrame:
    c00, c01, c10, c11 = _pairs()
    return s.select(_value(F.when((c01 == 0) & (c10 == 0), 1.0).otherwise((c00 + c11) / (c00 + c01 + c10 + c11))))


def adjusted_rand(s: DataFrame) -> DataFrame:
    c00, c01, c10, c11 = _pairs()
    return s.select(_value(F.when((c01 == 0) & (c10 == 0), 1.0).otherwise(2 * (c11 * c00 - c10 * c01) / ((c11 + c10) * (c10 + c00) + (c11 + c01) * (c01 + c00)))))


def mutual_information(s: DataFrame) -> DataFrame:
    return s.select(_value(F.greatest(F.col("mi"), F.lit(0.0))))


def _one_class() -> Column:
    return (F.col("ka") <= 1) & (F.col("kb") <= 1)


def normalized_mutual_information(s: DataFrame) -> DataFrame:
    return s.select(_value(F.when(_one_class(), 1.0).when(F.col("mi") <= 0, 0.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2))))


def fowlkes_mallows(s: DataFrame) -> DataFrame:
    tk, pk, qk = F.col("sq") - F.col("t"), F.col("sq_b") - F.col("t"), F.col("sq_a") - F.col("t")
    return s.select(_value(F.when(tk == 0, 0.0).otherwise(F.sqrt(tk / pk) * F.sqrt(tk / qk))))


def homogeneity(s: DataFrame) -> DataFrame:
    return s.select(_value(F.when(F.col("ha") == 0, 1.0).otherwise(F.col("mi") / F.col("ha"))))


def completeness(s: DataFrame) -> DataFrame:
    return s.select(_value(F.when(F.col("hb") == 0, 1.0).otherwise(F.col("mi") / F.col("hb"))))


def v_measure(s: DataFrame) -> DataFrame:
    h = F.when(F.col("ha") == 0, 1.0).otherwise(F.col("mi") / F.col("ha"))
    c = F.when(F.col("hb") == 0, 1.0).otherwise(F.col("mi") / F.col("hb"))
    return s.select(_value(F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c))))


def expected_mutual_information(a: list[int], b: list[int]) -> float:
    """Of two clusterings with these class sizes under the hypergeometric model."""
    n = sum(a)
    lg = math.lgamma
    out = 0.0
    sizes_b: dict[int, int] = {}
    for x in b:
        sizes_b[x] = sizes_b.get(x, 0) + 1
    sizes_a: dict[int, int] = {}
    for x in a:
        sizes_a[x] = sizes_a.get(x, 0) + 1
    for x, times_x in sizes_a.items():
        for y, times_y in sizes_b.items():
            fixed = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
            part = 0.0
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(fixed - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1))
                part += k / n * (math.log(n) + math.log(k) - math.log(x) - math.log(y)) * p
            out += times_x * times_y * part
    return out


def adjusted_mutual_information(cells: DataFrame) -> DataFrame:
    """From a contingency table; the marginals, one number for each class, are finished on the driver."""
    spark = cells.sparkSession
    s = summary(cells).first()
    if s["ka"] == s["kb"] and s["ka"] <= 1:
        value = 1.0
    else:
        a = [int(r[0]) for r in cells.groupBy("a").agg(F.max("na")).select("max(na)").collect()]
        b = [int(r[0]) for r in cells.groupBy("b").agg(F.max("nb")).select("max(nb)").collect()]
        emi = expected_mutual_information(a, b)
        den = (s["ha"] + s["hb"]) / 2 - emi
        den = min(den, -EPS) if den < 0 else max(den, EPS)
        value = (s["mi"] - emi) / den
    return spark.createDataFrame([(float(value),)], "value double")


def _elements(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.select(F.col(label).alias("c"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``c``, ``size``, ``mean``: one array of means for each cluster."""
    sums = _elements(df, vector, label).groupBy("c", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return sums.groupBy("c").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("mean"))


def _sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _dispersion(df: DataFrame, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the centroid of their cluster, which is small and joined by a checked broadcast or a shuffle."""
    mid = centroids(df, vector, label)
    rows = df.select(F.col(label).alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return rows.join(mid, "c"), mid


def calinski_harabasz(df: DataFrame, vector: str, label: str) -> DataFrame:
    rows, mid = _dispersion(df, vector, label)
    within = rows.agg(F.sum(_sq(F.col("v"), F.col("mean"))).alias("w"), F.count("*").alias("n"))
    all_ = mid.select(F.posexplode("mean").alias("i", "m"), "size").groupBy("i").agg((F.sum(F.col("m") * F.col("size")) / F.sum("size")).alias("g"))
    all_ = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "g"))), lambda z: z["g"]).alias("g"))
    between = mid.crossJoin(F.broadcast(all_)).agg(F.sum(F.col("size") * _sq(F.col("mean"), F.col("g"))).alias("b"), F.count("*").alias("k"))
    c = F.col
    return within.crossJoin(between).select(_value(F.when(c("w") == 0, 1.0).otherwise(c("b") * (c("n") - c("k")) / (c("w") * (c("k") - 1)))))


def davies_bouldin(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Clusters are compared pairwise, so their number, not that of rows, is squared."""
    rows, mid = _dispersion(df, vector, label)
    spread = rows.groupBy("c").agg(F.avg(F.sqrt(_sq(F.col("v"), F.col("mean")))).alias("s"), F.first("mean").alias("m"))
    a, b = spread.select(F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("m").alias("ma")), spread.select(F.col("c").alias("cb"), F.col("s").alias("sb"), F.col("m").alias("mb"))
    pairs = a.join(b, F.col("ca") != F.col("cb")).withColumn("d", F.sqrt(_sq(F.col("ma"), F.col("mb"))))
    r = F.when(F.col("d") == 0, 0.0).otherwise((F.col("sa") + F.col("sb")) / F.col("d"))
    return pairs.groupBy("ca").agg(F.max(r).alias("r")).agg(_value(F.avg("r")))


#: Rows are dealt into about so many blocks, and a block has so many numbers at most (32 MB in double precision).
BLOCKS, BLOCK_VALUES = 48, 1 << 22
#: Squared distances below this share of the squared norms are taken from differences, so that small ones stay exact.
NEAR = 1e-4


def silhouette_samples(df: DataFrame, key: str, vector: str, label: str, block: int = 1_024) -> DataFrame:
    """``key``, ``value`` with Euclidean distances; a singleton's value is 0. All pairs by definition.

    Rows are packed by ranges of the label in blocks of ``block`` at least; blocks grow with the table, up to
    ``BLOCK_VALUES``, so each row is shuffled about ``BLOCKS`` times however many there are. Every pair of blocks is
    one cell, whose distances serve both sides and are never all in memory; only sums by row and cluster come back.
    """
    wide = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    rows = max(block, min(-(-wide["n"] // BLOCKS), BLOCK_VALUES // max(1, wide["d"] or 1)))
    parts = max(1, -(-wide["n"] // rows))
    kt, ct, vt = (df.schema[c].dataType.simpleString() for c in (key, label, vector))
    number = "float" if vt == "array<float>" else "double"
    named = df.select(F.col(key).alias("k"), F.col(label).alias("c"), F.col(vector).cast(f"array<{number}>").alias("v")).where("k is not null")
    dealt = named.withColumn("h", F.xxhash64("k")).repartitionByRange(parts, "c", "h").drop("h")
    scratch = Scratch(df.sparkSession, "silhouette")
    packed = dealt.mapInArrow(_pack(rows, number), f"s int, k array<{kt}>, c array<{ct}>, v binary").withColumn("p", F.spark_partition_id())
    packed = scratch.save(packed, "blocks")
    ids = [(r["p"], r["s"], i) for i, r in enumerate(packed.select("p", "s").orderBy("p", "s").collect())]  # one a block
    blocks = packed.join(F.broadcast(df.sparkSession.createDataFrame(ids, "p int, s int, b int")), ["p", "s"])
    cells = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(ids) - 1))))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "k", "c", "v")
    sums = cells.groupBy("i", "j").applyInArrow(_cell(number), f"ka {kt}, ca {ct}, cb {ct}, s double, n double")
    return _silhouettes(sums.groupBy("ka", "ca", "cb").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0"), key)


def _pack(rows: int, number: str):
    """A partition as blocks of at most ``rows`` rows: keys, labels and the vectors' bytes, by label."""
    kind = np.float32 if number == "float" else np.float64

    def block(held: list[pa.RecordBatch], s: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, [("c", "ascending")])).combine_chunks()
        k, c, v = (t.column(i).chunk(0) for i in range(3))
        flat = v.flatten()
        if v.null_count or flat.null_count or len(set(np.diff(v.offsets))) > 1:
            raise ValueError("silhouettes need vectors of one length without nulls")
        whole = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), whole(k), whole(c), pa.array([flat.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())], names=["s", "k", "c", "v"])

    def run(batches):
        held, n, s = [], 0, 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, rows - n))
                batch = batch.slice(rows - n)
                n += len(held[-1])
                if n == rows:
                    yield block(held, s)
                    held, n, s = [], 0, s + 1
        if held:
            yield block(held, s)

    return run


def _sides(batches, kind) -> list[tuple]:
    """Keys, labels, vectors and, of each run of rows with one label, its begin, of a cell's blocks in their order."""
    found = []
    for batch in batches:
        for r in range(len(batch)):
            k, c = (batch.column(name).slice(r, 1).flatten() for name in ("k", "c"))
            v = np.frombuffer(batch.column("v")[r].as_buffer(), kind).reshape(len(k), -1).astype(np.float64)
            code = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            found.append((batch.column("b")[r].as_py(), k, c, v, np.flatnonzero(np.r_[True, code[1:] != code[:-1]])))
    return [f[1:] for f in sorted(found, key=lambda f: f[0])]


def _same(ka: pa.Array, kb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places with one key, by the first place."""
    at: dict = {}
    for j, k in enumerate(kb.to_pylist()):
        at.setdefault(k, []).append(j)
    pairs = [(i, j) for i, k in enumerate(ka.to_pylist()) for j in at.get(k, ())]
    return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)


def _distances(x: np.ndarray, y: np.ndarray, tile: int):
    """(begin, end, distances of these rows of ``x`` and all of ``y``): matrix products about a common centre, and
    differences where a product form would lose digits."""
    mid = x.mean(axis=0)
    xc, yc = x - mid, y - mid
    xx, yy = (xc * xc).sum(axis=1), (yc * yc).sum(axis=1)
    left = np.c_[-2 * xc, xx, np.ones(len(x))]
    right = np.ascontiguousarray(np.c_[yc, np.ones(len(y)), yy].T)
    most = NEAR * yy.max(initial=0.0)
    for lo in range(0, len(x), tile):
        hi = min(lo + tile, len(x))
        d = left[lo:hi] @ right
        at, to = np.nonzero(d <= (NEAR * xx[lo:hi] + most)[:, None])
        small = d[at, to] <= NEAR * (xx[lo:hi][at] + yy[to])
        at, to = at[small], to[small]
        for n in range(0, len(at), 1 << 14):
            i, j = at[n : n + (1 << 14)], to[n : n + (1 << 14)]
            d[i, j] = ((x[lo + i] - y[j]) ** 2).sum(axis=1)
        yield lo, hi, np.sqrt(d, out=d)


def _cell(number: str):
    kind = np.float32 if number == "float" else np.float64

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches, kind)
        (ka, ca, x, at_a), (kb, cb, y, at_b) = sides[0], sides[-1]
        i, j = _same(ka, kb)
        run_a, run_b = (np.searchsorted(at, z, "right") - 1 for at, z in ((at_a, i), (at_b, j)))

        def rows(keys, own, lo, hi, others, at, s, n):  # s, n: a row a key from lo to hi, a column a run
            place = pa.array(np.repeat(np.arange(lo, hi), len(at)))
            cb_ = others.take(pa.array(np.tile(at, hi - lo)))
            return pa.RecordBatch.from_arrays([keys.take(place), own.take(place), cb_, pa.array(s.ravel()), pa.array(n.ravel())], names=["ka", "ca", "cb", "s", "n"])

        size_a, size_b = (np.diff(np.r_[at, len(k)]).astype(float) for at, k in ((at_a, ka), (at_b, kb)))
        tile = max(16, (1 << 18) // max(1, len(y)))
        held: dict[int, np.ndarray] = {}  # distances of all of y to the runs of x that are not through
        for lo, hi, d in _distances(x, y, tile):
            here = slice(*np.searchsorted(i, [lo, hi]))
            d[i[here] - lo, j[here]] = 0.0  # i ascends
            n = np.tile(size_b, (hi - lo, 1))
            np.subtract.at(n, (i[here] - lo, run_b[here]), 1.0)
            yield rows(ka, ca, lo, hi, cb, at_b, np.add.reduceat(d, at_b, axis=1), n)
            if len(sides) == 1:
                continue
            first, last = np.searchsorted(at_a, [lo, hi - 1], "right") - 1
            part = np.add.reduceat(d, np.maximum(at_a[first : last + 1] - lo, 0), axis=0)
            for r in range(first, last + 1):
                held[r] = held[r] + part[r - first] if r in held else part[r - first]
            for r in [r for r in held if r < last or hi == len(x)]:
                n = np.full(len(y), size_a[r])
                np.subtract.at(n, j[run_a == r], 1.0)
                yield rows(kb, cb, 0, len(y), ca, at_a[r : r + 1], held.pop(r), n)

    return sums


def _silhouettes(sums: DataFrame, key: str) -> DataFrame:
    """``key``, ``value`` of the distances ``s`` of row ``ka`` in cluster ``ca`` to the ``n`` other rows of cluster ``cb``."""
    d = sums.withColumn("d", F.col("s") / F.col("n"))
    own, other = F.col("ca") == F.col("cb"), F.col("ca") != F.col("cb")
    s = d.groupBy("ka").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(other, F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    return s.select(F.col("ka").alias(key), F.when(F.col("a").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("value"))


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return silhouette_samples(df, key, vector, label).agg(_value(F.avg("value")))


def silhouette_from_distances(distances: DataFrame, clusters: DataFrame, a: str, b: str, distance: str, key: str, label: str, samples: bool = False) -> DataFrame:
    """The mean silhouette, or with ``samples`` ``key`` and ``value``, from a table of distances of every ordered pair of rows.

    ``clusters`` holds ``key`` and ``label`` once a row. Pairs of a row with itself are ignored; a negative, null or NaN
    distance and fewer than two clusters are refused.
    """
    d = F.col(distance).cast("double")
    d = F.when(d.isNull() | F.isnan(d) | (d < 0), F.raise_error(F.lit("distances must be numbers of at least 0")).cast("double")).otherwise(d)
    pairs = distances.select(F.col(a).alias("ka"), F.col(b).alias("kb"), d.alias("d")).where("ka <> kb")
    sums = pairs.join(clusters.select(F.col(key).alias("kb"), F.col(label).alias("cb")), "kb").groupBy("ka", "cb").agg(F.sum("d").alias("s"), F.count("*").cast("double").alias("n"))
    sums = sums.join(clusters.select(F.col(key).alias("ka"), F.col(label).alias("ca")), "ka")
    each = _silhouettes(sums, key)
    few = clusters.select(label).distinct().limit(2).count() < 2
    if few:
        raise ValueError("silhouettes need two clusters")
    return each if samples else each.agg(_value(F.avg("value")))
