"""Classification metrics over one aggregated confusion table.

Every metric starts from ``confusion``: one shuffle of (label, prediction) sums that are combined on the map side, so
what moves is classes squared, not rows. ``by`` names grouping columns and gives the metric for each group at once.
Averages are ``binary`` (the class ``pos_label``), ``micro``, ``macro`` and ``weighted``; per-class tables come from
``per_class``. A null label or prediction is refused, as is an empty input (no row comes out).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklex.operators._common import grouped, ratio, undefined, weight_of
from sparklex.plans.ranks import percentiles

EPS = 2.0**-52


def confusion(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``y_true``, ``y_pred``, ``w``: the weight of every pair that occurs."""
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} must not be null")).cast(df.schema[c].dataType)).otherwise(F.col(c))
    rows = df.select(*by, known(y_true).alias("y_true"), known(y_pred).alias("y_pred"), weight_of(weight).alias("w"))
    return rows.groupBy(*by, "y_true", "y_pred").agg(F.sum("w").alias("w"))


def _listed(labels: Sequence) -> list:
    if not labels or len(set(labels)) != len(labels) or any(x is None for x in labels):
        raise ValueError("labels must be distinct, at least one, and not null")
    return list(labels)


def _label_table(cm: DataFrame, labels: Sequence, by: Sequence[str]) -> DataFrame:
    """``by``, ``label``, ``pos``: the given labels in their order, for every group."""
    kind = cm.schema["y_true"].dataType
    pairs = F.posexplode(F.array(*[F.lit(x).cast(kind) for x in _listed(labels)])).alias("pos", "label")
    groups = cm.select(*by).distinct() if by else cm.sparkSession.range(1).select()
    return groups.select(*by, pairs)


def matrix(cm: DataFrame, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``row``, ``column``, ``y_true``, ``y_pred``, ``w``: every cell of the given labels, in their order, 0 where no
    sample falls. Samples with another label on either side are left out; ``dropped`` weighs them."""
    table = _label_table(cm, labels, by)
    a = table.select(*by, F.col("pos").alias("row"), F.col("label").alias("y_true"))
    b = table.select(*by, F.col("pos").alias("column"), F.col("label").alias("y_pred"))
    cells = a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))  # labels squared
    return cells.join(cm, [*by, "y_true", "y_pred"], "left").select(*by, "row", "column", "y_true", "y_pred", F.coalesce("w", F.lit(0.0)).alias("w"))


def dropped(cm: DataFrame, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``value``: the weight of samples whose label or prediction is not among ``labels``."""
    names = _listed(labels)
    inside = F.col("y_true").isin(names) & F.col("y_pred").isin(names)
    return grouped(cm, by).agg(F.coalesce(F.sum(F.when(~inside, F.col("w"))), F.lit(0.0)).alias("value"))


def normalized(cm: DataFrame, over: str = "all", by: Sequence[str] = ()) -> DataFrame:
    """The confusion table with ``w`` divided by its row (``true``), column (``pred``) or whole sum; 0/0 is 0."""
    keys = {"true": [*by, "y_true"], "pred": [*by, "y_pred"], "all": list(by) or [F.lit(0)]}[over]
    return cm.withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy(*keys))))


def per_class(cm: DataFrame, by: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    """``by``, ``label``, ``tp``, ``predicted``, ``support`` for the union of labels, or for ``labels`` where given.

    With ``labels`` the sums still run over all rows, so predictions on samples of other labels count; a label that does
    not occur has zeros, and ``pos`` is its place in the list.
    """
    same = F.when(F.col("y_true") == F.col("y_pred"), F.col("w")).otherwise(0.0)
    one = cm.select(*by, F.col("y_true").alias("label"), same.alias("tp"), F.lit(0.0).alias("predicted"), F.col("w").alias("support"))
    two = cm.select(*by, F.col("y_pred").alias("label"), F.lit(0.0).alias("tp"), F.col("w").alias("predicted"), F.lit(0.0).alias("support"))
    out = one.unionByName(two).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    if labels is None:
        return out
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tp", "predicted", "support")]
    return _label_table(cm, labels, by).join(out, [*by, "label"], "left").select(*by, "label", *zero, "pos")


def _value(kind: str, beta: float, zero: str) -> Column:
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    if kind == "precision":
        return ratio(tp, predicted, zero)
    if kind == "recall":
        return ratio(tp, support, zero)
    if kind == "jaccard":
        return ratio(tp, predicted + support - tp, zero)
    b2 = beta * beta
    return ratio((1 + b2) * tp, predicted + b2 * support, zero)


def score_per_class(classes: DataFrame, kind: str, beta: float = 1.0, zero_division: str = "zero") -> DataFrame:
    """``classes`` with ``value``: precision, recall, fbeta or jaccard of each class."""
    return classes.withColumn("value", _value(kind, beta, zero_division))


def score(classes: DataFrame, kind: str, average: str = "binary", beta: float = 1.0, pos_label=1, zero_division: str = "zero", by: Sequence[str] = ()) -> DataFrame:
    """One ``value`` for each group: ``kind`` is precision, recall, fbeta or jaccard."""
    if not (beta >= 0 and beta != float("inf")):
        raise ValueError("beta must be finite and not negative")
    if average == "micro":
        sums = grouped(classes, by).agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
        return sums.select(*by, _value(kind, beta, zero_division).alias("value"))
    each = score_per_class(classes, kind, beta, zero_division)
    if average == "binary":
        out = grouped(each, by).agg(F.max(F.when(F.col("label") == pos_label, F.col("value"))).alias("v"), F.count("*").alias("n"))
        many = F.raise_error(F.lit("binary average needs at most two labels")).cast("double")
        return out.select(*by, F.when(F.col("n") > 2, many).otherwise(F.coalesce("v", F.lit(0.0))).alias("value"))
    if average == "macro":
        return grouped(each, by).agg(F.avg("value").alias("value"))
    if average == "weighted":
        out = grouped(each, by).agg(F.sum(F.when(F.col("support") != 0, F.col("value") * F.col("support")).otherwise(0.0)).alias("a"), F.sum("support").alias("b"))
        return out.select(*by, ratio(F.col("a"), F.col("b")).alias("value"))
    raise ValueError("average must be binary, micro, macro or weighted")


def accuracy(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("w")).otherwise(0.0))
    return grouped(cm, by).agg((hit / F.sum("w")).alias("value"))


def balanced_accuracy(classes: DataFrame, adjusted: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall of the classes with support; ``adjusted`` maps chance to 0."""
    out = grouped(classes.where("support > 0"), by).agg(F.avg(F.col("tp") / F.col("support")).alias("m"), F.count("*").alias("n"))
    chance = 1 / F.col("n")
    return out.select(*by, ((F.col("m") - chance) / (1 - chance) if adjusted else F.col("m")).alias("value"))


def matthews(classes: DataFrame, zero_division: str = "zero", by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    s = grouped(classes, by).agg(
        F.sum("tp").alias("d"), F.sum("support").alias("n"), F.sum(c("support") * c("predicted")).alias("rc"), F.sum(c("support") * c("support")).alias("rr"), F.sum(c("predicted") * c("predicted")).alias("cc"),
    )
    den = F.sqrt((c("n") * c("n") - c("rr")) * (c("n") * c("n") - c("cc")))
    return s.select(*by, ratio(c("d") * c("n") - c("rc"), den, zero_division).alias("value"))


def cohen_kappa(cm: DataFrame, classes: DataFrame, weights: str | None = None, zero_division: str = "nan", by: Sequence[str] = ()) -> DataFrame:
    """Agreement beyond chance; ``linear`` and ``quadratic`` weights use the labels' positions, not their values.

    For labels of the caller's give ``matrix(cm, labels)`` and ``per_class(..., labels)`` of it: their order counts.
    """
    pos = classes if "pos" in classes.columns else classes.withColumn("pos", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("label")))
    cost = lambda i, j: (F.when(i == j, 0.0).otherwise(1.0) if weights is None else F.abs(i - j) if weights == "linear" else (i - j) * (i - j)).cast("double")
    a = pos.select(*by, F.col("label").alias("y_true"), F.col("pos").alias("i"), F.col("support").alias("r"))
    b = pos.select(*by, F.col("label").alias("y_pred"), F.col("pos").alias("j"), F.col("predicted").alias("c"))
    seen = cm.join(a, [*by, "y_true"]).join(b, [*by, "y_pred"])
    seen = grouped(seen, by).agg(F.sum(F.col("w") * cost(F.col("i"), F.col("j"))).alias("o"), F.sum("w").alias("n"))
    chance = a.join(b, list(by)) if by else a.crossJoin(b)  # classes squared
    chance = grouped(chance, by).agg(F.sum(F.col("r") * F.col("c") * cost(F.col("i"), F.col("j"))).alias("e"))
    both = seen.join(chance, list(by)) if by else seen.crossJoin(chance)
    return both.select(*by, (1 - ratio(F.col("o") * F.col("n"), F.col("e"), zero_division)).alias("value"))


def hamming_loss(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of wrong labels; for array columns the share of wrong flags over all samples and labels."""
    w = weight_of(weight)
    if df.schema[y_true].dataType.typeName() == "array":
        wrong = F.aggregate(F.zip_with(y_true, y_pred, lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda x, y: x + y)
        return grouped(df, by).agg((F.sum(w * wrong) / F.sum(w * F.size(y_true))).alias("value"))
    return grouped(df, by).agg((F.sum(w * (F.col(y_true) != F.col(y_pred)).cast("double")) / F.sum(w)).alias("value"))


def zero_one_loss(df: DataFrame, y_true: str, y_pred: str, normalize: bool = True, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Samples with any wrong label, as a share or as a weight."""
    w = weight_of(weight)
    bad = F.sum(w * (F.col(y_true) != F.col(y_pred)).cast("double"))
    return grouped(df, by).agg((bad / F.sum(w) if normalize else bad).alias("value"))


def multilabel_confusion(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label``, ``tn``, ``fp``, ``fn``, ``tp`` one against the rest."""
    n = F.sum("support").over(Window.partitionBy(*(by or [F.lit(0)])))
    c = F.col
    out = per_class(cm, by).withColumn("n", n)
    return out.select(*by, "label", (c("n") - c("predicted") - c("support") + c("tp")).alias("tn"), (c("predicted") - c("tp")).alias("fp"), (c("support") - c("tp")).alias("fn"), "tp")


def multilabel_confusion_flags(df: DataFrame, y_true: str, y_pred: str, samplewise: bool = False, key: str | None = None, weight: str | None = None) -> DataFrame:
    """The same for arrays of flags: by label position, or by sample (``key``) with ``samplewise``."""
    pairs = F.posexplode(F.arrays_zip(F.col(y_true).alias("a"), F.col(y_pred).alias("b"))).alias("label", "f")
    rows = df.select(*([key] if key else []), weight_of(weight).alias("w"), pairs)
    a, b, w = F.col("f")["a"], F.col("f")["b"], F.col("w")
    cell = lambda x, y: F.sum(F.when((a == x) & (b == y), w).otherwise(0.0))
    return rows.groupBy(key if samplewise else "label").agg(cell(False, False).alias("tn"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(True, True).alias("tp"))


def likelihood_ratios(classes: DataFrame, pos_label=1, replace_positive: float = float("nan"), replace_negative: float = float("nan"), by: Sequence[str] = ()) -> DataFrame:
    """``positive`` = sensitivity/(1 - specificity) and ``negative`` = (1 - sensitivity)/specificity of two classes."""
    own = F.col("label") == pos_label
    s = grouped(classes, by).agg(F.sum(F.when(own, F.col("tp")).otherwise(0.0)).alias("tp"), F.sum(F.when(own, F.col("predicted")).otherwise(0.0)).alias("pp"), F.sum(F.when(own, F.col("support")).otherwise(0.0)).alias("p"), F.sum("support").alias("n"), F.count("*").alias("k"))
    c, nan = F.col, F.lit(float("nan"))
    neg, fp = c("n") - c("p"), c("pp") - c("tp")
    tn, fn = neg - fp, c("p") - c("tp")
    up = F.when(c("p") == 0, nan).when((fp == 0) | (neg == 0), F.lit(replace_positive)).otherwise((c("tp") / c("p")) / (fp / neg))
    down = F.when(c("p") == 0, nan).when((tn == 0) | (neg == 0), F.lit(replace_negative)).otherwise((fn / c("p")) / (tn / neg))
    many = F.raise_error(F.lit("likelihood ratios need two classes")).cast("double")
    return s.select(*by, F.when(c("k") > 2, many).otherwise(up).alias("positive"), down.alias("negative"))


def report(cm: DataFrame, by: Sequence[str] = (), zero_division: str = "zero", labels: Sequence | None = None) -> DataFrame:
    """Rows of a classification report: every class, ``accuracy``, ``macro avg`` and ``weighted avg``.

    With ``labels`` only those classes, in their order (column ``pos``); where a group has other labels too, ``micro avg``
    stands in the place of ``accuracy``.
    """
    c = F.col
    kinds = (("precision", "precision"), ("recall", "recall"), ("fbeta", "f1"))
    classes = per_class(cm, by, labels)
    each = classes.select(*by, c("label").cast("string").alias("row"), *[_value(k, 1.0, zero_division).alias(a) for k, a in kinds], "support", "tp", "predicted", *(["pos"] if labels else []))
    names = ("precision", "recall", "f1")
    macro = grouped(each, by).agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support")).withColumn("row", F.lit("macro avg"))
    mean = lambda x: ratio(F.sum(c(x) * c("support")), F.sum("support"))
    weighted = grouped(each, by).agg(*[mean(x).alias(x) for x in names], F.sum("support").alias("support")).withColumn("row", F.lit("weighted avg"))
    hit = grouped(each, by).agg(*[F.sum(x).alias(x) for x in ("tp", "predicted", "support")])
    cols = [*by, "row", *names, "support"]
    if labels is None:
        middle = hit.select(*by, F.lit("accuracy").alias("row"), *[(c("tp") / c("support")).alias(x) for x in names], "support")
    else:
        known = _listed(labels)
        more = grouped(cm, by).agg(F.max(~c("y_true").isin(known) | ~c("y_pred").isin(known)).alias("_more"), F.sum("w").alias("_all"))
        hit = hit.join(more, list(by)) if by else hit.crossJoin(F.broadcast(more))  # one row
        value = lambda k: F.when(c("_more"), _value(k, 1.0, zero_division)).otherwise(ratio(c("tp"), c("_all"), zero_division))
        middle = hit.select(*by, F.when(c("_more"), "micro avg").otherwise("accuracy").alias("row"), *[value(k).alias(a) for k, a in kinds], "support")
    out = each.select(cols).unionByName(middle.select(cols)).unionByName(macro.select(cols)).unionByName(weighted.select(cols))
    if labels is None:
        return out
    order = F.array(*[F.lit(str(x)) for x in [*known, "micro avg", "accuracy", "macro avg", "weighted avg"]])
    return out.withColumn("pos", F.array_position(order, c("row")).cast("int") - 1)


def report_text(rows: DataFrame, digits: int = 2) -> str:
    """A report without groups as text; classes in the order of their names, or of the labels given, then the summary."""
    got = {r["row"]: r for r in rows.collect()}
    middle = "micro avg" if "micro avg" in got else "accuracy"
    tail = [middle, "macro avg", "weighted avg"]
    place = (lambda k: got[k]["pos"]) if "pos" in rows.columns else (lambda k: (not k.lstrip("-").isdigit(), int(k) if k.lstrip("-").isdigit() else 0, k))
    names = sorted((k for k in got if k not in tail), key=place)
    width = max([len(n) for n in names] + [len("weighted avg"), digits])
    line = lambda n, p, r, f, s: f"{n:>{width}s} " + "".join(f" {x:>9}" for x in (p, r, f, s)) + "\n"
    num = lambda x: f"{x:.{digits}f}"
    count = lambda x: str(int(x)) if float(x).is_integer() else str(x)
    out = f"{'':>{width}s} " + "".join(f" {x:>9}" for x in ("precision", "recall", "f1-score", "support")) + "\n\n"
    for n in names:
        r = got[n]
        out += line(n, num(r["precision"]), num(r["recall"]), num(r["f1"]), count(r["support"]))
    out += "\n"
    if middle == "accuracy":
        out += line("accuracy", "", "", num(got["accuracy"]["f1"]), count(got["accuracy"]["support"]))
    for n in tail if middle == "micro avg" else tail[1:]:
        r = got[n]
        out += line(n, num(r["precision"]), num(r["recall"]), num(r["f1"]), count(r["support"]))
    return out


def _mean(df: DataFrame, value: Column, weight: str | None, by: Sequence[str], normalize: bool = True) -> DataFrame:
    w = weight_of(weight)
    return grouped(df, by).agg((F.sum(w * value) / F.sum(w) if normalize else F.sum(w * value)).alias("value"))


def brier(df: DataFrame, y_true: str, p: str, weight: str | None = None, scale_by_half: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of a probability of the positive class; without ``scale_by_half`` twice that."""
    d = F.col(p) - F.col(y_true).cast("double")
    return _mean(df, d * d * (1.0 if scale_by_half else 2.0), weight, by)


def brier_multiclass(df: DataFrame, y_true: str, p: str, weight: str | None = None, scale_by_half: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``p`` is an array with a probability for each class, ``y_true`` the class's position."""
    sq = F.aggregate(F.transform(p, lambda x, i: (x - (i == F.col(y_true)).cast("double")) * (x - (i == F.col(y_true)).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return _mean(df, sq * (0.5 if scale_by_half else 1.0), weight, by)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def log_loss(df: DataFrame, y_true: str, p: str, normalize: bool = True, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    q = _clip(F.col(p))
    y = F.col(y_true).cast("double")
    return _mean(df, -(y * F.log(q) + (1 - y) * F.log(1 - q)), weight, by, normalize)


def log_loss_multiclass(df: DataFrame, y_true: str, p: str, normalize: bool = True, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``p`` is an array of class probabilities that is not brought to a sum of 1."""
    return _mean(df, -F.log(_clip(F.get(p, F.col(y_true)))), weight, by, normalize)


def hinge_loss(df: DataFrame, y_true: str, decision: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``y_true`` 0/1 and one decision value."""
    margin = F.when(F.col(y_true).cast("double") > 0, F.col(decision)).otherwise(-F.col(decision))
    return _mean(df, F.greatest(F.lit(0.0), 1 - margin), weight, by)


def hinge_loss_multiclass(df: DataFrame, y_true: str, decisions: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The margin is the own decision value less the best other one."""
    others = F.array_max(F.filter(decisions, lambda x, i: i != F.col(y_true)))
    return _mean(df, F.greatest(F.lit(0.0), 1 - (F.get(decisions, F.col(y_true)) - others)), weight, by)


def calibration_curve(df: DataFrame, y_true: str, p: str, bins: int = 5, strategy: str = "uniform") -> DataFrame:
    """``bin``, ``mean_predicted``, ``fraction_positive``, ``n`` of the bins that hold a sample.

    Quantile edges are linear percentiles. They are a single row, joined to all.
    """
    c = F.col(p)
    inner = [i / bins for i in range(1, bins)]
    if strategy == "uniform":
        rows = df.withColumn("_e", F.array(*[F.lit(x) for x in inner]) if inner else F.array().cast("array<double>"))
    elif strategy == "quantile":
        edges = percentiles(df, c, inner).withColumnRenamed("q", "_e") if inner else df.sparkSession.range(1).select(F.array().cast("array<double>").alias("_e"))
        rows = df.crossJoin(F.broadcast(edges))  # one row
    else:
        raise ValueError("strategy must be uniform or quantile")
    rows = rows.withColumn("bin", F.size(F.filter("_e", lambda e: e < c)).cast("long"))
    return rows.groupBy("bin").agg(F.avg(c).alias("mean_predicted"), F.avg(F.col(y_true).cast("double")).alias("fraction_positive"), F.count("*").alias("n"))


def top_k_accuracy(df: DataFrame, y_true: str, scores: str, k: int = 2, normalize: bool = True, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Whether the true class is among the ``k`` best scores; of equal scores the later position ranks first."""
    own = F.get(scores, F.col(y_true))
    better = F.size(F.filter(scores, lambda x, i: (x > own) | ((x == own) & (i > F.col(y_true)))))
    return _mean(df, (better < k).cast("double"), weight, by, normalize)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Sequence", "Column", "DataFrame", "Window", "F", "undefined")]
