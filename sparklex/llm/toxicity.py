"""Toxicity (operator 4): cumulative-link ordinal regression over sparse text features.

``P(grade <= k) = sigmoid(threshold_k - x.w)`` with one weight vector for all thresholds, which stay ordered because
each is the one before plus a positive gap. Features are words and word beginnings (five to eight characters) of the
lower-cased text; a chi-squared test over a bounded sample of labelled documents (``MAX_LABELLED``, those with the
smallest hashes of their id, outside the held-out fold) keeps ``MAX_FEATURES`` of them. A feature's value is
log(1 + count). Every whole text is scored; the output has the expected severity, the most likely grade and the
probability of any grade above 0.

``labels`` says only toxic or not. ``severity_grades`` makes grades of it: 0 for clean documents, and for toxic ones 1
to 3, by thirds, of a score that shares no feature and no row with the model's view of the document: the mean log-odds of
the text's letter trigrams (hashed), counted over the labelled documents of all other folds. ``fit`` takes any grades
from 0. The penalty, among ``PENALTIES``, and the probability from which a document is called toxic are those with the
greatest F1 in ``FOLDS``-fold cross-validation within the labelled sample; held-out documents play no part.

Defined cases: a null text counts as an empty one; without both clean and toxic labelled rows there is nothing to tell
them apart by and every severity is near 0; repeated rows and null keys are answered row by row; an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sparklex.llm._text import map_rows
from sparklex.plans.scratch import Scratch

#: Labelled documents that a fit reads at most, features that it keeps at most.
MAX_LABELLED, MAX_FEATURES = 20_000, 1_024
PREFIXES = (5, 6, 7, 8)
#: Folds within the labelled sample, penalties to choose from, buckets of hashed trigrams.
FOLDS, PENALTIES, BUCKETS = 3, (1e-5, 1e-4, 1e-3, 1e-2), 4_096
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of a-z and non-ASCII characters of the lower-cased text."""
    return (text or "").lower().encode().translate(_LETTERS).decode().split()


def features_of(word: str) -> list[str]:
    return [f"={word}", *[f"^{word[:n]}" for n in PREFIXES if len(word) >= n]]


@dataclass(frozen=True)
class OrdinalModel:
    names: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # the probability of being toxic from which a document is called so

    def probabilities(self, x: float) -> np.ndarray:
        """P(grade = k) for a linear score."""
        at_most = 1 / (1 + np.exp(-np.clip(self.thresholds - x, -40, 40)))
        return np.diff(np.concatenate([[0.0], at_most, [1.0]]))


def fit(names, rows: list[tuple[list[int], list[float]]], grades: np.ndarray, levels: int, penalty: float = 1e-4, steps: int = 600) -> OrdinalModel:
    """Maximum penalised likelihood by Adam; ``rows`` holds the feature numbers and values of each document."""
    n, m = len(rows), len(names)
    col = np.array([c for cs, _ in rows for c in cs], dtype=np.int64)
    val = np.array([v for _, vs in rows for v in vs], dtype=np.float64)
    row = np.repeat(np.arange(n), [len(cs) for cs, _ in rows]) if n else np.zeros(0, dtype=np.int64)
    counts = np.bincount(grades, minlength=levels) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(below / (1 - below))
    theta = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1) if n else ():
        w, cuts = theta[:m], theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
        x = np.bincount(row, weights=val * w[col], minlength=n)
        up = np.where(grades < levels - 1, sig(cuts[np.minimum(grades, levels - 2)] - x), 1.0)
        low = np.where(grades > 0, sig(cuts[np.maximum(grades - 1, 0)] - x), 0.0)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        dcut = np.bincount(np.minimum(grades, levels - 2), weights=-du * (grades < levels - 1), minlength=levels - 1) + np.bincount(np.maximum(grades - 1, 0), weights=dl * (grades > 0), minlength=levels - 1)
        gaps = np.exp(theta[m + 1 :])
        grad = np.concatenate([np.bincount(col, weights=val * (du - dl)[row], minlength=m) / n + penalty * w, [dcut.sum() / n], np.cumsum(dcut[::-1])[::-1][1:] * gaps / n])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    cuts = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
    return OrdinalModel(tuple(names), theta[:m], cuts)


def chi_squared(a, b, pos, neg):
    """Association of a feature (in ``a`` of ``pos`` toxic and ``b`` of ``neg`` clean documents) with the class."""
    n, c, d = pos + neg, pos - a, neg - b
    return F.when((a + b > 0) & (c + d > 0), n * (a * d - b * c) * (a * d - b * c) / (F.lit(pos) * neg * (a + b) * (c + d))).otherwise(F.lit(0.0))


def trigram_counts(text: str | None) -> np.ndarray:
    """How often the letter trigrams of a text, its words' ends included, fall into each bucket."""
    data = np.frombuffer(b"  " + b" ".join((text or "").lower().encode().translate(_LETTERS).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    codes = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
    return np.bincount(codes, minlength=BUCKETS)


def severity_grades(toxic: np.ndarray, severity: np.ndarray, levels: int = 4) -> np.ndarray:
    """0 where not toxic, else 1 to ``levels - 1`` by equal shares of the severity."""
    grades = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(severity[toxic], np.arange(1, levels - 1) / (levels - 1))
        grades[toxic] = 1 + np.searchsorted(cuts, severity[toxic], side="right")
    return grades


def fold_odds(read: DataFrame) -> np.ndarray:
    """For each fold the log-odds of every trigram bucket, toxic against clean, over the documents of the other folds."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros((FOLDS, 2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for y, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[fold, y] += trigram_counts(text)
        rows = [(f, y, total[f, y]) for f in range(FOLDS) for y in range(2) if total[f, y].any()]
        yield pa.RecordBatch.from_pydict({"fold": pa.array([r[0] for r in rows], pa.int32()), "y": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))})

    each = read.select("y", "fold", "text").mapInArrow(run, "fold int, y int, n array<bigint>").select("fold", "y", F.posexplode("n").alias("i", "n"))
    counts = np.zeros((FOLDS, 2, BUCKETS))
    for r in each.where("n > 0").groupBy("fold", "y", "i").agg(F.sum("n").alias("n")).collect():
        counts[r["fold"], r["y"], r["i"]] = r["n"]
    other = counts.sum(axis=0)[None] - counts + 1.0
    shares = other / other.sum(axis=2, keepdims=True)
    return np.log(shares[:, 1]) - np.log(shares[:, 0])


def choose_penalty(names, rows, grades: np.ndarray, folds: np.ndarray, levels: int) -> tuple[float, float]:
    """The penalty, and the probability of being toxic from which a document is called so, with the greatest F1 on the
    left-out folds; of equals the greatest."""
    best, toxic = (-1.0, PENALTIES[-1], 0.5), grades > 0
    for penalty in sorted(PENALTIES, reverse=True):
        p = np.zeros(len(rows))
        for fold in range(FOLDS):
            inside, outside = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(inside) and len(outside):
                model = fit(names, [rows[i] for i in inside], grades[inside], levels, penalty, steps=200)
                x = np.array([float(model.weights[rows[i][0]] @ np.array(rows[i][1])) if rows[i][0] else 0.0 for i in outside])
                p[outside] = 1 - 1 / (1 + np.exp(-np.clip(model.thresholds[0] - x, -40, 40)))
        cuts = np.unique(p)
        order = np.sort(p[toxic])
        hits = len(order) - np.searchsorted(order, cuts, side="left")
        called = len(p) - np.searchsorted(np.sort(p), cuts, side="left")
        f1 = 2 * hits / np.maximum(called + len(order), 1)
        if len(cuts) and f1.max() > best[0]:
            i = int(len(f1) - 1 - np.argmax(f1[::-1]))
            best = (float(f1[i]), penalty, float((cuts[i] + cuts[max(i - 1, 0)]) / 2))
    return best[1:]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", levels: int = 4, limit: int = MAX_LABELLED, most: int = MAX_FEATURES) -> OrdinalModel:
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % 3 != 1))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    read = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")
    read = read.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    read = Scratch(docs.sparkSession, "toxicity").save(read, "labelled")
    make = lambda: lambda t: (sorted({f for w in set(words_of(t)) for f in features_of(w)}),)
    each = map_rows(read, ["y"], ["text"], make, StructType([StructField("f", ArrayType(StringType()))]))
    shares = {r["y"]: r["n"] for r in read.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = shares.get(1, 0), shares.get(0, 0)
    if not pos or not neg:
        return OrdinalModel((), np.zeros(0), np.arange(4.0, 4.0 + levels - 1))
    counts = each.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    scored = counts.where("a + b >= 5").select("f", "a", "b", chi_squared(F.col("a"), F.col("b"), pos, neg).alias("x2"))
    kept = scored.orderBy(F.col("x2").desc(), "f").limit(most).collect()
    names = sorted(r["f"] for r in kept)
    at = {f: i for i, f in enumerate(names)}
    odds = fold_odds(read)

    def make_rows():
        def one(t, fold):
            got: Counter = Counter()
            for w, n in Counter(words_of(t)).items():
                for f in features_of(w):
                    if f in at:
                        got[at[f]] += n
            idx, grams = sorted(got), trigram_counts(t)
            return idx, [float(np.log1p(got[i])) for i in idx], float(grams @ odds[fold] / max(1, grams.sum()))

        return one

    fields = StructType([StructField("i", ArrayType(IntegerType())), StructField("v", ArrayType(DoubleType())), StructField("severity", DoubleType())])
    rows = map_rows(read, ["id", "y", "fold"], ["text", "fold"], make_rows, fields).orderBy(F.xxhash64("id"), "id", "severity").limit(limit).collect()
    toxic = np.array([r["y"] == 1 for r in rows])
    grades = severity_grades(toxic, np.array([r["severity"] for r in rows]), levels)
    found = [(list(r["i"]), list(r["v"])) for r in rows]
    penalty, cut = choose_penalty(names, found, grades, np.array([r["fold"] for r in rows]), levels)
    return replace(fit(names, found, grades, levels, penalty), cut=cut)


SEVERITY = StructType([StructField("expected_severity", DoubleType()), StructField("grade", IntegerType()), StructField("p_toxic", DoubleType()), StructField("n_hits", LongType()), StructField("predicted", IntegerType())])


def score_severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the fields of ``SEVERITY`` for every whole text."""
    def make():
        at = {f: i for i, f in enumerate(model.names)}
        cache: dict[str, tuple[int, ...]] = {}

        def one(t):
            got: Counter = Counter()
            for w in words_of(t):
                hit = cache.get(w)
                if hit is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    hit = cache[w] = tuple(at[f] for f in features_of(w) if f in at)
                if hit:
                    got.update(hit)
            x = sum(model.weights[i] * np.log1p(n) for i, n in sorted(got.items()))
            p = model.probabilities(x)
            return float(p @ np.arange(len(p))), int(np.argmax(p)), float(1 - p[0]), sum(got.values()), int(1 - p[0] >= model.cut)

        return one

    return map_rows(docs, [key], [text], make, SEVERITY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_severity(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "expected_severity", "grade", "p_toxic", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
