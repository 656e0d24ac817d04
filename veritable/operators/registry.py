"""Registries: joining samples with their artifacts and metadata, and finding what is off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("RAW", "PROCESSED", "FAILED", "EXCLUDED")


def resolve_samples(split: DataFrame, metadata: DataFrame, artifacts: DataFrame, key: str, version: str) -> DataFrame:
    """Split rows with ``resolution``: resolved, missing_metadata (no successful row of this
    version) or missing_file."""
    good = metadata.where((F.col("status") == "success") & (F.col("preprocessing_version") == version)).select(key, F.lit(True).alias("__meta")).distinct()
    there = artifacts.select(key, F.lit(True).alias("__file")).distinct()
    rows = split.join(good, key, "left").join(there, key, "left")
    return rows.withColumn("resolution", F.when(F.col("__meta").isNull(), "missing_metadata").when(F.col("__file").isNull(), "missing_file").otherwise("resolved")).drop("__meta", "__file")


def merge_registry(manifest: DataFrame, metadata: DataFrame, splits: DataFrame, key: str, artifacts: DataFrame | None = None) -> DataFrame:
    """Manifest with status from metadata (none: RAW) and split from split files if present.
    With ``artifacts``, success also needs one, else FAILED."""
    rows = manifest.join(metadata.select(key, F.col("status").alias("__s")), key, "left").join(splits.select(key, F.col("split_role").alias("__role")), key, "left")
    done = F.col("__s") == "success"
    if artifacts is not None:
        rows = rows.join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
        done = done & F.col("__file").isNotNull()
    status = F.when(F.col("__s").isNull(), "RAW").when(done, "PROCESSED").otherwise("FAILED")
    return rows.withColumn("status", status).withColumn("split", F.coalesce("__role", "split")).drop("__s", "__role", "__file")


def orphans(artifacts: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Artifacts that no metadata row knows."""
    return artifacts.join(metadata.select(key), key, "left_anti")


def missing(metadata: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Metadata rows without an artifact."""
    return metadata.where(F.col(key).isNotNull()).join(artifacts.select(key), key, "left_anti")


def matched(artifacts: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    return artifacts.join(metadata.select(key), key, "left_semi")


def held_out_rows(rows: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    """Rows that no split uses, by any of the keys."""
    for k in keys:
        rows = rows.join(used.where(F.col(k).isNotNull()).select(k), k, "left_anti")
    return rows


def reconcile(registry: DataFrame, artifacts: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Three-way full outer reconcile: where each id is found, and why an orphan is one."""
    sides = [df.select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((artifacts, "in_artifacts"), (metadata, "in_metadata"))]
    rows = registry.select(key, "status", F.lit(True).alias("in_registry"))
    for s in sides:
        rows = rows.join(s, key, "full_outer")
    rows = rows.fillna(False, ["in_registry", "in_artifacts", "in_metadata"])
    cause = F.when(F.col("in_artifacts") & ~F.col("in_metadata"), F.when(F.col("status") == "RAW", "stale_output").otherwise("orphaned_file")).when(F.col("in_metadata") & ~F.col("in_artifacts"), "lost_file")
    return rows.withColumn("cause", cause)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules))


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, joined by ``; ``."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules))), "; ")


def reconcile_split(split: DataFrame, registry: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Split rows with the first rule that excludes them (null: valid)."""
    reg = registry.select(key, F.col("status").alias("__status"), F.col("label").alias("__label"), F.lit(True).alias("__known"))
    rows = split.join(reg, key, "left").join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
    rules = [
        ("not_in_registry", F.col("__known").isNull()),
        ("registry_excluded", F.col("__status") == "EXCLUDED"),
        ("registry_failed", F.col("__status") == "FAILED"),
        ("registry_raw", F.col("__status") == "RAW"),
        ("missing_file", F.col("__file").isNull()),
        ("label_mismatch", F.col("label") != F.col("__label")),
        ("bad_label", ~F.coalesce(F.col("label").isin("real", "fake"), F.lit(False))),
    ]
    return rows.withColumn("reason", first_reason(rules)).drop("__status", "__label", "__known", "__file")


def promote(registry: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Status as the files tell: with an artifact PROCESSED, PROCESSED without one back to RAW,
    PROCESSING (a crash) to FAILED; adds what changed."""
    rows = registry.join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
    now = F.when(F.col("__file"), "PROCESSED").when(F.col("status") == "PROCESSED", "RAW").when(F.col("status") == "PROCESSING", "FAILED").otherwise(F.col("status"))
    return rows.withColumn("new_status", now).withColumn("changed", F.col("new_status") != F.col("status")).drop("__file")


def rebuild_metadata(manifest: DataFrame, existing: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """keep (successful and its file is there), recover (file without metadata) or no_crop."""
    rows = manifest.join(existing.select(key, F.col("status").alias("__s")), key, "left").join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
    action = F.when(F.col("__file") & (F.col("__s") == "success"), "keep").when(F.col("__file"), "recover").otherwise("no_crop")
    return rows.withColumn("action", action).drop("__s", "__file")


def eligible(registry: DataFrame, metadata: DataFrame, artifacts: DataFrame, key: str, version: str, retry_failed: bool = False) -> DataFrame:
    """Rows that a resumed run still has to process, with retry_count."""
    meta = metadata.select(key, F.col("status").alias("__s"), F.col("preprocessing_version").alias("__v"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"))
    rows = registry.join(meta, key, "left").join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
    done = (F.col("__v") == version) & (((F.col("__s") == "success") & F.col("__file").isNotNull()) | ((F.col("__s") != "success") & F.lit(not retry_failed)))
    return rows.where(~F.coalesce(done, F.lit(False))).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + F.when(F.col("__s").isNotNull() & (F.col("__s") != "success"), 1).otherwise(0)).drop("__s", "__v", "__file")


def status_table(registry: DataFrame, split: str = "split", status: str = "status") -> DataFrame:
    """Split x status crosstab with every status as a column."""
    return registry.groupBy(split).pivot(status, list(STATUSES)).count().fillna(0, list(STATUSES))


def progress(registry: DataFrame, per_second: float = 3.5) -> DataFrame:
    """One row: counts by status, share done, success rate and hours left at a given pace."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    rows = registry.agg(F.count("*").alias("total"), *(n(s) for s in STATUSES))
    tried = F.col("processed") + F.col("failed")
    return rows.select("total", *(s.lower() for s in STATUSES), F.bround(F.coalesce(F.try_divide(F.col("processed").cast("double"), F.col("total")), F.lit(0.0)), 6).alias("completion"), F.bround(F.coalesce(F.try_divide(F.col("processed").cast("double"), tried), F.lit(0.0)), 6).alias("success_rate"), F.bround(F.col("raw") / F.lit(per_second) / 3600, 6).alias("eta_hours"), (F.col("raw") == 0).alias("complete"))


def audit(registry: DataFrame, artifacts: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Null and domain counts, and PROCESSED rows without a file, in one pass after one join."""
    rows = registry.join(artifacts.select(key, F.lit(True).alias("__file")).distinct(), key, "left")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(key).isNull()).alias("null_ids"),
        F.count_if(F.col(label).isNull()).alias("null_labels"),
        F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("bad_status"),
        F.count_if((F.col("status") == "PROCESSED") & F.col("__file").isNull()).alias("processed_without_file"),
    )


def readiness(checks: DataFrame) -> DataFrame:
    """Overall verdict of rows (check, level in PASS, WARN, FAIL, CRITICAL)."""
    n = lambda s: F.count_if(F.col("level") == s).alias(f"n_{s.lower()}")
    rows = checks.agg(*(n(s) for s in ("PASS", "WARN", "FAIL", "CRITICAL")))
    verdict = F.when(F.col("n_critical") > 0, "CRITICAL").when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return rows.withColumn("overall", verdict)
