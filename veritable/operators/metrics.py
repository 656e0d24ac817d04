"""Classifier evaluation over score tables: confusion, ranking and calibration statistics.

A score table has y (1 = fake, the positive class), prob, and key columns such as model and
split. Ranking statistics first collapse to one row per distinct score, so their windows are
over distinct scores, not rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.operators.shared import join_same, materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def known(scores: DataFrame) -> DataFrame:
    """Rows that count: those with a score and a label. Null ones take no part in any metric."""
    return scores.where("prob is not null and y is not null")


def confusion(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn per key in one pass; a key without known rows has zeros."""
    pred, pos = F.col("prob") >= threshold, F.col("y") == 1
    n = lambda c, name: F.count_if(c).alias(name)
    return scores.groupBy(*keys).agg(n(pred & pos, "tp"), n(pred & ~pos, "fp"), n(~pred & ~pos, "tn"), n(~pred & pos, "fn"))


def classification(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall, f1 (0 for 0/0), balanced accuracy over the classes present."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg = tp + fp + tn + fn, tp + fn, tn + fp
    classes = F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0)
    return counts.select(
        *keys, "tp", "fp", "tn", "fn", n.alias("support"),
        _ratio(tp + tn, n).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, pos).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(_ratio(tp, pos) + _ratio(tn, neg), classes).alias("balanced_accuracy"),
        _ratio(pos, n).alias("positive_rate"), _ratio(tp + fp, n).alias("predicted_positive_rate"),
        F.when(n == 0, "empty_split").when(classes == 1, "single_class").alias("note"),
    )


def distinct_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return known(scores).groupBy(*keys, "prob").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def ranked_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct scores with pos and neg, how many of each lie strictly below (below_pos,
    below_neg), and the totals n_pos and n_neg. Scores are counted once and dealt to sorted
    ranges of (keys, prob), as many as their size asks for; sums over the ranges and within each
    give exact counts, so no task sorts all scores of a key."""
    rows = distinct_scores(scores, keys).repartitionByRange(*(F.asc_nulls_first(k) for k in (*keys, "prob")))
    rows = materialize(rows.withColumn("__b", F.spark_partition_id()), "ranked-scores")
    sizes = rows.groupBy(*keys, "__b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = sizes.select(*keys, "__b", zero(F.sum("p").over(before)).alias("__p"), zero(F.sum("n").over(before)).alias("__n"), F.sum("p").over(whole).alias("n_pos"), F.sum("n").over(whole).alias("n_neg"))
    inside = Window.partitionBy(*keys, "__b").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    out = join_same(rows, starts, [*keys, "__b"])
    return out.select(*keys, "prob", "pos", "neg", (F.col("__p") + zero(F.sum("pos").over(inside))).alias("below_pos"), (F.col("__n") + zero(F.sum("neg").over(inside))).alias("below_neg"), "n_pos", "n_neg")


def ranking(scores: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc, pr_auc, eer and eer_threshold per key, from one ranking: null where one class is
    missing (pr_auc: without positives)."""
    wins = F.sum(F.col("pos") * (2 * F.col("below_neg") + F.col("neg")))
    tp = F.col("n_pos") - F.col("below_pos")
    precision = tp / (tp + F.col("n_neg") - F.col("below_neg"))
    far, frr = _rates()
    best = F.min_by(F.struct(far.alias("far"), frr.alias("frr"), "prob"), F.when(far.isNotNull() & frr.isNotNull(), F.struct(F.abs(far - frr), F.col("prob"))))
    rows = ranked_scores(scores, keys).groupBy(*keys).agg(F.try_divide(wins.cast("double"), F.lit(2.0) * F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"), best.alias("b"))
    return rows.select(*keys, "roc_auc", "pr_auc", ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.prob").alias("eer_threshold"))


def _rates() -> tuple[Column, Column]:
    """False accepts (negatives at or above) and false rejects (positives below)."""
    return F.try_divide((F.col("n_neg") - F.col("below_neg")).cast("double"), "n_neg"), F.try_divide(F.col("below_pos").cast("double"), "n_pos")


def roc_auc(scores: DataFrame, keys: list[str], single_class: float | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties one half; null (or ``single_class``)
    where only one class occurs."""
    # in half units, so that the sum is exact
    wins = F.sum(F.col("pos") * (2 * F.col("below_neg") + F.col("neg")))
    auc = F.try_divide(wins.cast("double"), F.lit(2.0) * F.sum("pos") * F.sum("neg"))
    return ranked_scores(scores, keys).groupBy(*keys).agg((auc if single_class is None else F.coalesce(auc, F.lit(single_class))).alias("roc_auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def pr_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision: precision weighted by the recall each distinct threshold adds."""
    tp = F.col("n_pos") - F.col("below_pos")
    precision = tp / (tp + F.col("n_neg") - F.col("below_neg"))
    return ranked_scores(scores, keys).groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"))


def error_rates(scores: DataFrame, keys: list[str]) -> DataFrame:
    """False accepts (negatives at or above) and false rejects (positives below) at every
    distinct score as threshold."""
    far, frr = _rates()
    return ranked_scores(scores, keys).select(*keys, "prob", far.alias("far"), frr.alias("frr"))


def eer(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Equal error rate at the lowest threshold where the two error rates are closest."""
    gap = F.abs(F.col("far") - F.col("frr"))
    best = F.min_by(F.struct("far", "frr", "prob"), F.struct(gap, F.col("prob")))
    rows = error_rates(scores, keys).where("far is not null and frr is not null").groupBy(*keys).agg(best.alias("b"))
    return rows.select(*keys, ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.prob").alias("eer_threshold"))


def curve_eer(scores: DataFrame, keys: list[str], single_class: float = 0.5) -> DataFrame:
    """Equal error rate from the curve, which also has a threshold above every score;
    ``single_class`` where only one class occurs."""
    scores = known(scores)
    ends = scores.groupBy(*keys).agg(F.lit(float("inf")).alias("prob"), F.lit(0.0).alias("far"), F.lit(1.0).alias("frr"))
    gap = F.abs(F.col("far") - F.col("frr"))
    rows = error_rates(scores, keys).unionByName(ends).where("far is not null and frr is not null")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("far", "frr"), F.struct(gap, -F.col("prob"))).alias("b"))
    classes = scores.groupBy(*keys).agg(F.count_distinct("y").alias("k"))
    return join_same(best, classes, keys).select(*keys, F.when(F.col("k") < 2, F.lit(single_class)).otherwise((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"))


def bin_edges(n: int = 10) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n + 1)]


def bin_of(prob: Column, n: int = 10) -> Column:
    """Equal bins [low, high), the last one closed; null outside 0..1. By the edges' literal
    values: floor(p * n) differs at some of them."""
    edges = bin_edges(n)
    count = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: prob >= e))
    return F.when((prob >= 0) & (prob <= 1), F.least(count, F.lit(n)) - 1)


def reliability(scores: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """bin, n, accuracy and confidence of the bins that hold rows."""
    rows = known(scores).withColumn("bin", bin_of(F.col("prob"), n)).where("bin is not null")
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("accuracy"), F.avg("prob").alias("confidence"))


def reliability_table(scores: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Every bin of every key, empty ones as zeros."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")
    grid = scores.select(*keys).distinct().select(*keys, bins)
    return join_same(grid, reliability(scores, keys, n), [*keys, "bin"], "left").fillna(0, ["n", "accuracy", "confidence"]).select(*keys, "bin", "n", "accuracy", "confidence")


def ece(scores: DataFrame, keys: list[str], n: int = 10, null_on_single_class: bool = False) -> DataFrame:
    """Expected calibration error; all known rows count in the denominator, those outside 0..1 too."""
    total = known(scores).groupBy(*keys).agg(F.count("*").alias("total"), F.count_distinct("y").alias("classes"))
    gaps = reliability(scores, keys, n).groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("gap"))
    value = F.coalesce(F.col("gap"), F.lit(0.0)) / F.col("total")
    return join_same(total, gaps, keys, "left").select(*keys, (F.when(F.col("classes") > 1, value) if null_on_single_class else value).alias("ece"))


def nll(prob: Column, y: Column, eps: float = 1e-7) -> Column:
    """Cross-entropy of one row, the probability kept off 0 and 1."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), prob))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def proper_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    y = F.col("y").cast("double")
    return known(scores).groupBy(*keys).agg(F.avg((F.col("prob") - y) * (F.col("prob") - y)).alias("brier"), F.avg(nll(F.col("prob"), y)).alias("nll"))


def scan_once(scores: DataFrame, keys: list[str], threshold: float = 0.5, n: int = 10) -> DataFrame:
    """tp, fp, tn, fn, ece, brier and nll per key, from one aggregate by key and bin."""
    pred, pos, y = F.col("prob") >= threshold, F.col("y") == 1, F.col("y").cast("double")
    is_known = F.col("prob").isNotNull() & F.col("y").isNotNull()
    count = lambda c, name: F.count_if(c).alias(name)
    squared = (F.col("prob") - y) * (F.col("prob") - y)
    cells = scores.withColumn("__bin", F.when(is_known, bin_of(F.col("prob"), n))).groupBy(*keys, "__bin").agg(
        count(pred & pos, "tp"), count(pred & ~pos, "fp"), count(~pred & ~pos, "tn"), count(~pred & pos, "fn"), count(is_known, "n"),
        F.sum(F.when(is_known, y)).alias("hits"), F.sum(F.when(is_known, F.col("prob"))).alias("sure"), F.sum(squared).alias("squared"), F.sum(F.when(is_known, nll(F.col("prob"), y))).alias("loss"),
    )
    gap = F.sum(F.when(F.col("__bin").isNotNull(), F.col("n") * F.abs(F.col("hits") / F.col("n") - F.col("sure") / F.col("n"))))
    mean = lambda c: F.try_divide(c, F.sum("n"))
    error = F.when(F.sum("n") > 0, F.coalesce(mean(gap), F.lit(0.0)))
    return cells.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")), error.alias("ece"), mean(F.sum("squared")).alias("brier"), mean(F.sum("loss")).alias("nll"))


def calibration(scores: DataFrame, keys: list[str]) -> DataFrame:
    """ece, brier, nll, f1 (rounded to 6 places) and roc_auc; null for a key without known rows."""
    rows = scan_once(scores, keys)
    f1 = classification(rows, keys).select(*keys, "f1")
    rows = join_same(join_same(rows, f1, keys), roc_auc(scores, keys).select(*keys, "roc_auc"), keys, "left")
    return rows.select(*keys, *(F.bround(c, 6).alias(c) for c in ("ece", "brier", "nll", "f1")), "roc_auc")


def all_metrics(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """The full evaluation row per key; null AUC, EER where one class is missing. Two passes: one
    aggregate, one ranking."""
    once = scan_once(scores, keys, threshold)
    rows = join_same(classification(once, keys), ranking(scores, keys).drop("eer_threshold"), keys, "left")
    return join_same(rows, once.select(*keys, "ece", "brier", "nll"), keys)


# --- thresholds --------------------------------------------------------------------------


def threshold_grid(low: float, high: float, step: float) -> list[float]:
    return [float(t) for t in np.arange(low, high, step)]


def _reached(prob: Column, grid: list[float]) -> Column:
    """How many thresholds of the sorted grid a score reaches: for an even grid by arithmetic,
    put right by the thresholds beside the guess."""
    n = len(grid)
    step = (grid[-1] - grid[0]) / max(1, n - 1)
    if n < 3 or any(abs(t - grid[0] - i * step) > step / 4 for i, t in enumerate(grid)):
        return F.size(F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: prob >= t))
    points = F.array(*(F.lit(t) for t in grid))
    guess = F.least(F.lit(n), F.greatest(F.lit(0), F.floor((prob - grid[0]) / step).cast("int") + 1))
    more = F.coalesce(F.get(points, guess) <= prob, F.lit(False)).cast("int")
    less = F.coalesce(F.get(points, guess - 1) > prob, F.lit(False)).cast("int")
    return guess + more - less


def threshold_counts(scores: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """tp, fp, tn, fn at every threshold, of known rows. Rows are first counted by the number of
    thresholds they reach, so the grid multiplies a small table, not the scores."""
    g = sorted(grid)
    cells = known(scores).groupBy(*keys, _reached(F.col("prob"), g).alias("reached")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    points = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(g))))
    wide = cells.select("*", points.alias("t")).select(*keys, "pos", "neg", "reached", "t.i", "t.threshold")
    hit = F.col("reached") > F.col("i")
    s = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return wide.groupBy(*keys, "threshold").agg(s(F.when(hit, F.col("pos")), "tp"), s(F.when(hit, F.col("neg")), "fp"), s(F.when(~hit, F.col("neg")), "tn"), s(F.when(~hit, F.col("pos")), "fn"))


def best_balanced_threshold(scores: DataFrame, keys: list[str], grid: list[float], near: float | None = 0.5, criterion: str = "balanced") -> DataFrame:
    """Threshold of the best balanced accuracy (or Youden index). Of equals the one nearest to
    ``near``, or the first if that is None; 0.5 where one class is missing."""
    m = classification(threshold_counts(scores, keys, grid), [*keys, "threshold"])
    tpr, tnr = _ratio(F.col("tp"), F.col("tp") + F.col("fn")), _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    value = F.bround((tpr + tnr) / 2 if criterion == "balanced" else tpr + tnr - 1, 12)
    tie = F.abs(F.col("threshold") - near) if near is not None else F.lit(0.0)
    rows = m.groupBy(*keys).agg(F.min_by(F.struct(value.alias("value"), F.col("threshold")), F.struct(-value, tie, F.col("threshold"))).alias("b"), F.max(F.col("note").isNotNull()).alias("degenerate"))
    return rows.select(*keys, F.when(F.col("degenerate"), F.lit(0.5)).otherwise(F.col("b.threshold")).alias("threshold"), F.col("b.value").alias("value"))


def best_f1_threshold(scores: DataFrame, keys: list[str], grid: list[float] | None = None) -> DataFrame:
    """The first threshold with the largest F1."""
    m = classification(threshold_counts(scores, keys, grid or [float(t) for t in np.linspace(0.05, 0.95, 19)]), [*keys, "threshold"])
    rows = m.groupBy(*keys).agg(F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b"))
    return rows.select(*keys, "b.threshold", "b.f1")


# --- temperature -------------------------------------------------------------------------


def nll_at(cells: DataFrame, keys: list[str], temperatures: list[float]) -> DataFrame:
    """Mean NLL of calibrated probabilities for each temperature."""
    t = F.explode(F.array(*(F.lit(x) for x in temperatures)))
    rows = cells.select("*", t.alias("temperature"))
    p = 1.0 / (1.0 + F.exp(-F.col("logit") / F.col("temperature")))
    return rows.groupBy(*keys, "temperature").agg((F.sum(F.col("n") * nll(p, F.col("y").cast("double"))) / F.sum("n")).alias("nll"))


def fit_temperature(scores: DataFrame, low: float = 0.01, high: float = 10.0, rounds: int = 4, points: int = 24) -> tuple[float, float, float]:
    """(temperature, NLL before, NLL after) for one score table with logit and y. The NLL has
    one minimum over the temperature; each round evaluates a grid in one aggregate over
    distinct (logit, y) and narrows it. One class only: (1, nll, nll). No rows: ValueError."""
    cells = scores.groupBy("logit", "y").agg(F.count("*").alias("n")).persist()  # read once by every round
    try:
        return _fit_on_cells(cells, low, high, rounds, points)
    finally:
        cells.unpersist()


def _fit_on_cells(cells: DataFrame, low: float, high: float, rounds: int, points: int) -> tuple[float, float, float]:
    classes = cells.agg(F.count_distinct("y").alias("k")).first()["k"]
    if not classes:
        raise ValueError("no rows to fit a temperature on")
    at = lambda ts: {r["temperature"]: r["nll"] for r in nll_at(cells, [], ts).collect()}
    before = at([1.0])[1.0]
    if classes == 1:
        return 1.0, before, before
    best, value = 1.0, before
    for _ in range(rounds):
        grid = [float(x) for x in np.geomspace(low, high, points)]
        found = at(grid)
        best = min(grid, key=lambda t: (found[t], t))
        value = found[best]
        k = grid.index(best)
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    return (best, before, value) if value <= before else (1.0, before, before)


def logit_of(prob: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), prob))
    return F.log(p / (1 - p))


def with_temperature(scores: DataFrame, temperature: float) -> DataFrame:
    return scores.withColumn("prob", 1.0 / (1.0 + F.exp(-F.col("logit") / F.lit(max(temperature, 1e-4)))))


def before_after(scores: DataFrame, keys: list[str], temperature: float) -> DataFrame:
    """Calibration metrics per key at temperature 1 and at the fitted one."""
    both = scores.select("*", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("stage"))
    t = F.when(F.col("stage") == "after", F.lit(temperature)).otherwise(F.lit(1.0))
    return calibration(both.withColumn("prob", 1.0 / (1.0 + F.exp(-F.col("logit") / t))), [*keys, "stage"])

