"""Quality classifier (operator 2): a sparse rule ensemble compiled into Spark column expressions.

Statistics of every text are computed once as column expressions. A bounded sample of labelled rows (``MAX_LABELLED``,
those with the smallest hashes of their id) goes to the driver as numbers only. Shallow trees on bootstrap samples and
random statistics are grown there; every path from a root is a conjunctive rule; lasso logistic regression (accelerated
proximal gradient) gives the rules weights, most of them zero; what is left becomes one column expression, so scoring
runs in the JVM without user functions. Language, source, id and labels are no inputs.

Defined cases: a null text counts as an empty one and is scored like any other; without labelled rows of both classes
every score is the smoothed share of label 1; a null id is labelled by nothing and held out by nothing; repeated rows
are answered row by row; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparklex.llm._text import fresh, let
from sparklex.llm.quality_rules import STOP_WORDS, without
from sparklex.plans.scratch import Scratch

#: Labelled rows that a fit reads at most.
MAX_LABELLED = 20_000
_SPACE = " \t\n\x0b\x0c\r"
FEATURES = (
    "n_words", "mean_word", "symbol_ratio", "symbol_tail_ratio", "exclaim_ratio", "upper_ratio", "digit_ratio", "pipe_ratio", "distinct_ratio", "adjacent_repeat_ratio",
    "dup_line_ratio", "stop_ratio", "words_per_line", "sentence_ratio",
)


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of ``FEATURES`` as doubles, a row for each row."""
    t, words, lines = F.col("_t"), F.col("_words"), F.col("_lines")
    gone = lambda chars: (F.length(t) - F.length(without(t, chars))).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    tail = lambda w: F.right(w, F.lit(1))
    count = lambda f: F.size(F.filter(words, f))
    n, chars = F.size(words), F.length(t)
    out = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    out = out.select(
        "_key", "_t", F.filter(F.split("_t", f"[{_SPACE}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("_lines"), F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).alias("_letters"),
    )
    again = let(words, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))))
    upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    values = {
        "n_words": n.cast("double"), "mean_word": ratio(F.length(F.array_join(words, "")), n), "symbol_ratio": ratio(gone("#*$%&|<>"), chars),
        "symbol_tail_ratio": ratio(count(lambda w: tail(w).isin(*"#*$%&|<>")), n), "exclaim_ratio": ratio(gone("!?"), n), "upper_ratio": ratio(upper, F.col("_letters")),
        "digit_ratio": ratio(gone("0123456789"), chars), "pipe_ratio": ratio(gone("|"), n), "distinct_ratio": ratio(F.size(F.array_distinct(words)), n),
        "adjacent_repeat_ratio": ratio(again, n), "dup_line_ratio": ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "stop_ratio": ratio(count(lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?*$%&#"))).isin(*sorted(set(STOP_WORDS)))), n), "words_per_line": ratio(n, F.size(lines)),
        "sentence_ratio": ratio(count(lambda w: tail(w).isin(".", "?", "!")), n),
    }
    return out.select(F.col("_key").alias(key), *[values[c].alias(c) for c in FEATURES])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at most?, bound) with its weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, below, bound in self.conditions:
            out &= (x[:, j] <= bound) if below else (x[:, j] > bound)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, below, bound in self.conditions:
            c = F.col(FEATURES[j])
            out = out & ((c <= float(bound)) if below else (c > float(bound)))
        return F.when(out, F.lit(float(self.weight))).otherwise(F.lit(0.0))


def _grow(codes, y, rows, cols, edges, depth, path, out) -> None:
    """Collect the paths of a tree over binned features, split by Gini gain."""
    if depth == 0 or len(rows) < 20:
        return
    ones, n, best = y[rows].sum(), len(rows), (1e-9, None, None)
    if ones in (0, n):
        return
    base = ones * (n - ones) / n
    for j in cols:
        size = len(edges[j]) + 1
        if size < 2:
            continue
        c = np.cumsum(np.bincount(codes[rows, j], minlength=size))[:-1]
        p = np.cumsum(np.bincount(codes[rows, j], weights=y[rows], minlength=size))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - np.where(c > 0, p * (c - p) / c, 0) - np.where(c < n, (ones - p) * (n - c - ones + p) / (n - c), 0)
        gain[(c < 5) | (c > n - 5)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    if best[1] is None:
        return
    _, j, k = best
    left = codes[rows, j] <= k
    for below, part in ((True, rows[left]), (False, rows[~left])):
        here = (*path, (j, below, float(edges[j][k])))
        out.add(here)
        _grow(codes, y, part, cols, edges, depth - 1, here, out)


def _simplify(path) -> tuple:
    """The tightest bounds of a path, in a fixed order."""
    tight: dict = {}
    for j, below, bound in path:
        old = tight.get((j, below))
        tight[j, below] = bound if old is None else min(old, bound) if below else max(old, bound)
    return tuple(sorted((j, b, v) for (j, b), v in tight.items()))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, m = x.shape
    z = np.hstack([x, np.ones((n, 1), dtype=x.dtype)])
    v = np.ones(m + 1, dtype=np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (z.T @ (z @ v))) * 0.99
    share = (y.sum() + 1) / (n + 2)
    w = np.zeros(m + 1, dtype=np.float64)
    w[-1] = np.log(share / (1 - share))
    look, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look, -40, 40)))
        new = look - rate * (z.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + r.column()
        return (1 / (1 + F.exp(-total))).cast("double")


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, bins: int = 32, penalty: float = 5e-4, seed: int = 2) -> RuleEnsemble:
    """The ensemble of a sample; without both classes only an intercept."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    rng, paths = np.random.default_rng(seed), set()
    for _ in range(trees):
        rows = np.sort(rng.integers(0, len(y), len(y)))
        cols = np.sort(rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False))
        _grow(codes, y, rows, cols, edges, depth, (), paths)
    rules, seen, cover = [], set(), []
    for conditions in sorted({_simplify(p) for p in paths}):
        hit = Rule(conditions).holds(x)
        mark = hit.tobytes()
        if 5 <= hit.sum() <= len(y) - 5 and mark not in seen:
            seen.add(mark)
            rules.append(conditions)
            cover.append(hit)
    if not rules:
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    weights, intercept = lasso_logistic(np.stack(cover, axis=1).astype(np.float32), y.astype(np.float32), penalty)
    kept = tuple(Rule(c, round(float(w), 6)) for c, w in zip(rules, weights) if abs(w) > 1e-4)
    return RuleEnsemble(kept, round(intercept, 6))


def fold(key: str = "doc_id") -> Column:
    """The remainder that names a row's fold."""
    return F.crc32(F.col(key).cast("string")) % 3


def known_labels(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """``_id`` and ``_y`` of at most ``limit`` labelled ids outside the held-out fold; of repeated ids the lesser label."""
    known = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_y"))
    known = known.where(F.col("_y").isin(0.0, 1.0) & (fold("_id") != 1)).groupBy("_id").agg(F.min("_y").alias("_y"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def train(table: DataFrame, known: DataFrame, limit: int = MAX_LABELLED) -> RuleEnsemble:
    """Fit on the rows of the statistics ``table`` (with its ids in ``_key``) that ``known`` labels, ``limit`` at most."""
    rows = table.join(F.broadcast(known), F.col("_key") == F.col("_id"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(limit).select(*FEATURES, "_y")
    got = np.array(rows.toPandas(), dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return fit(got[:, :-1], got[:, -1])


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted``, a row for each row."""
    table = features(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text")
    table = Scratch(docs.sparkSession, "quality").save(table, "features")
    model = train(table, known_labels(labels, key, label, limit), limit)
    out = table.select(F.col("_key").alias(key), F.coalesce(fold("_key") == 1, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns as they are; no text is shuffled."""
    known = Scratch(docs.sparkSession, "quality").save(known_labels(labels, key, label, limit), "known")
    name = fresh(docs, "_id")
    some = docs.join(F.broadcast(known.select(F.col("_id").alias(name))), F.col(f"`{key}`") == F.col(name), "left_semi")
    model = train(features(some.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text"), known, limit)
    rows = features(docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text")), "_row", "_text")
    # behind a generator the optimizer does not copy the statistics into every rule of the filter
    rows = rows.select("_row", F.explode(F.array(F.struct(*FEATURES))).alias("_f")).select("_row", "_f.*")
    return rows.where(model.score() >= 0.5).select("_row.*")


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_rule_ensemble": op2_rule_ensemble}
ORACLES: dict[str, str] = {}
