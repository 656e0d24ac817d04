"""Whole-dataset audits that compose smaller checks into one report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.normalize import meaningful
from veritable.operators import leakage, manifest

#: Which keys each modality checks, and whether the placeholder 'unknown' counts as a value.
MODALITY_KEYS = {
    "image": {"identity_leakage": "identity_key", "hash_leakage": "file_hash", "source_image_leakage": "source_image_key"},
    "audio": {"speaker_leakage": "speaker_id", "hash_leakage": "file_hash"},
    "video": {"identity_leakage": "identity_id", "video_leakage": "video_id", "hash_leakage": "file_hash", "source_video_leakage": "original_source"},
}


def check_modality(df: DataFrame, modality: str, unseen: list[str], allowed: list[str] | None, balance: DataFrame, least: float = 0.10) -> DataFrame:
    """All violations of one modality's splits."""
    keys: dict[str, tuple[str, Column]] = {}
    for kind, key in MODALITY_KEYS[modality].items():
        filled = F.col(key).isNotNull() & (F.col(key) != "")
        keys[kind] = (key, filled if key == "file_hash" else meaningful(key))
    return leakage.check_splits(df, keys, unseen, allowed, balance, least)


def split_leakage(df: DataFrame, ident: str, path: str, split: str, label: str = "label") -> DataFrame:
    """check, n: ids and paths shared by two splits, names in several splits, ids of both labels in train."""
    pairs = (("train", "valid"), ("train", "test"), ("valid", "test"))
    parts = []
    for name, key in (("id", ident), ("path", path)):
        found = leakage.overlaps(df, key, split, pairs, F.col(key).isNotNull())
        parts.append(found.select(F.concat_ws("_", F.lit(name), "left_role", "right_role").alias("check"), F.col("n_shared").alias("n")))
    base = F.element_at(F.split(F.col(path), "/"), -1)
    names = df.groupBy(base.alias("b")).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi")
    parts.append(names.agg(F.count("*").alias("n")).select(F.lit("name_in_several_splits").alias("check"), "n"))
    both = df.where(F.col(split) == "train").groupBy(ident).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    parts.append(both.agg(F.count("*").alias("n")).select(F.lit("train_id_with_both_labels").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def readiness_checks(split: DataFrame, registry: DataFrame, role: str = "split_role", generator: str = "generator", least_generators: int = 2, coverage: float = 0.90) -> DataFrame:
    """check, subject, level, value: rows per role, generators per role, unseen rows, coverage."""
    roles = split.sparkSession.createDataFrame([(r,) for r in ("train", "val", "test_seen", "test_unseen")], f"{role} string")
    per = roles.join(split.groupBy(role).agg(F.count("*").alias("n"), F.count_distinct(generator).alias("k")), role, "left").fillna(0)
    empty = per.select(F.lit("rows").alias("check"), F.col(role).alias("subject"), F.when(F.col("n") > 0, "PASS").when(F.col(role) == "test_unseen", "CRITICAL").otherwise("FAIL").alias("level"), F.col("n").cast("double").alias("value"))
    kinds = per.where("n > 0").select(F.lit("generators").alias("check"), F.col(role).alias("subject"), F.when(F.col("k") >= least_generators, "PASS").otherwise("WARN").alias("level"), F.col("k").cast("double").alias("value"))
    done = registry.agg(F.coalesce(F.try_divide(F.count_if(F.col("status") == "PROCESSED").cast("double"), F.count("*")), F.lit(0.0)).alias("value"))
    cover = done.select(F.lit("coverage").alias("check"), F.lit("registry").alias("subject"), F.when(F.col("value") >= coverage, "PASS").otherwise("FAIL").alias("level"), "value")
    return empty.unionByName(kinds).unionByName(cover)


def recommendations(facts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row of facts to the texts of the rules that hold, in order."""
    return facts.select(F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in rules)))).alias("recommendation"))


def content_audit(df: DataFrame, hash_col: str, ident: str) -> DataFrame:
    """Every row of a repeated content hash with the size of its group."""
    groups = manifest.duplicate_content(df, hash_col, ident).select(hash_col, "n")
    return df.join(groups, hash_col).select(hash_col, ident, "n")


def stratified_quota(df: DataFrame, label: str, key: str, quota: dict[str, int], seed: str = "s", excluded: DataFrame | None = None) -> DataFrame:
    """Up to ``quota`` rows of each label in hash order, without the rows of ``excluded``."""
    from pyspark.sql import Window

    rows = df if excluded is None else df.join(excluded.select(key), key, "left_anti")
    wanted = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.where(F.col(label).isin(*quota)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.element_at(wanted, F.col(label))).drop("__r")


def crowded_folders(files: DataFrame, path: str = "path", least: int = 8) -> DataFrame:
    """Folders with at least ``least`` image files."""
    from veritable.functions.normalize import category

    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return files.where(category(path) == "image").groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def artwork_rule(paper: Column, lines: Column, sharpness: Column) -> Column:
    return (paper > 0.20) & ((lines >= 3) | (sharpness > 1500))
