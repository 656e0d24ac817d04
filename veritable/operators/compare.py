"""Comparing models across splits, and fusing several sources of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER_IS_BETTER = ("eer", "ece", "brier", "nll")


def generalization_gap(metrics: DataFrame, names: list[str], model: str = "model", split: str = "split", seen: str = "test_seen", unseen: str = "test_unseen") -> DataFrame:
    """Seen minus unseen per metric (reversed for error rates), rounded to 6 places; null with
    a note where a side has no rows or no value."""
    at = lambda c, s: F.max(F.when(F.col(split) == s, F.col(c)))
    rows = metrics.groupBy(model).agg(*(at(n, s).alias(f"{n}_{k}") for n in names for s, k in ((seen, "s"), (unseen, "u"))), F.coalesce(at("support", seen), F.lit(0)).alias("n_seen"), F.coalesce(at("support", unseen), F.lit(0)).alias("n_unseen"))
    there = (F.col("n_seen") > 0) & (F.col("n_unseen") > 0)
    gap = lambda n: F.col(f"{n}_u") - F.col(f"{n}_s") if n in LOWER_IS_BETTER else F.col(f"{n}_s") - F.col(f"{n}_u")
    return rows.select(model, *(F.when(there, F.bround(gap(n), 6)).alias(f"{n}_gap") for n in names), F.when(~there, "split_without_rows").alias("note"))


def delta(after: Column, before: Column) -> Column:
    """after - before; null unless both are there and not zero."""
    return F.when((after != 0) & (before != 0), after - before)


def best_by(metrics: DataFrame, value: str, label: str = "model", order: str = "ord", smallest_abs: bool = False) -> DataFrame:
    """The label of the largest value (or smallest magnitude); of equals the first in order."""
    rank = F.abs(F.col(value)) if smallest_abs else -F.col(value)
    rows = metrics.where(F.col(value).isNotNull())
    return rows.agg(F.min_by(label, F.struct(rank, F.col(order))).alias("label"), F.min_by(value, F.struct(rank, F.col(order))).alias("value"))


def compare_models(metrics: DataFrame, base: str, variant: str, value: str = "f1") -> DataFrame:
    """One row: does the variant improve seen and unseen values, does it narrow the gap; null
    where a value is missing."""
    at = lambda m, s: F.max(F.when((F.col("model") == m) & (F.col("split") == s), F.col(value)))
    rows = metrics.agg(at(base, "test_seen").alias("bs"), at(base, "test_unseen").alias("bu"), at(variant, "test_seen").alias("vs"), at(variant, "test_unseen").alias("vu"))
    return rows.select((F.col("vs") > F.col("bs")).alias("improves_seen"), (F.col("vu") > F.col("bu")).alias("improves_unseen"), (F.abs(F.col("vs") - F.col("vu")) < F.abs(F.col("bs") - F.col("bu"))).alias("narrows_gap"))


def comparison_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Long form: model, split, metric, value; rows in no order."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names)))
    return metrics.select("model", "split", pairs.alias("p")).select("model", "split", "p.metric", "p.value")


def fused_logit(p: Column) -> Column:
    """Fixed by the scores it must reproduce: the two small terms are not symmetric."""
    return F.log(p / (1 - p + F.lit(1e-7)) + F.lit(1e-7))


def fuse(parts: DataFrame, key: str, weights: dict[str, float], temperatures: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of each sample's available modalities, weights renormalized to those.
    ``parts``: key, modality, prob. Modalities without a weight, and null probs, are left out."""
    lookup = lambda d, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("modality")), F.lit(other)) if d else F.lit(other)
    w = lookup({k: float(v) for k, v in weights.items()}, None).cast("double")
    t = F.greatest(lookup({k: float(v) for k, v in (temperatures or {}).items()}, 1.0), F.lit(1e-4))
    p = 1.0 / (1.0 + F.exp(-fused_logit(F.col("prob")) / t))
    rows = parts.where("prob is not null").select(key, w.alias("w"), p.alias("p")).where("w is not null")
    return rows.groupBy(key).agg(F.try_divide(F.sum(F.col("w") * F.col("p")), F.sum("w")).alias("prob"), F.count("*").cast("int").alias("n_modalities"))


#: Fixed shares of the three audio models.
TRIAD = (0.4, 0.3, 0.3)


def triad(first: Column, second: Column, third: Column) -> Column:
    """prob, label and confidence of three models' probabilities, mixed by ``TRIAD``: fake from one
    half on. Null if one is missing: the shares are of all three."""
    prob = TRIAD[0] * first + TRIAD[1] * second + TRIAD[2] * third
    fake = prob >= 0.5
    return F.when(prob.isNotNull(), F.struct(prob.alias("prob"), F.when(fake, "FAKE").otherwise("REAL").alias("label"), F.when(fake, prob).otherwise(1.0 - prob).alias("confidence")))


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {k: v / total for k, v in weights.items()}


def early_stopping(history: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """Each epoch with the running best, epochs since it, and whether training had stopped."""
    from pyspark.sql import Window

    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("best", F.max(value).over(upto))
    better = F.col(value) > F.coalesce(F.max(value).over(before), F.lit(float("-inf")))
    rows = rows.withColumn("__at", F.when(better, F.col(epoch))).withColumn("best_epoch", F.max("__at").over(upto)).drop("__at")
    rows = rows.withColumn("stale", F.col(epoch) - F.col("best_epoch"))
    return rows.withColumn("stopped", F.coalesce(F.max((F.col("stale") >= patience).cast("int")).over(before), F.lit(0)) == 1)
