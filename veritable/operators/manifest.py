"""Manifests: building, deduplicating and summarizing tables of labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.operators.shared import materialize
from veritable.operators.splits import hash_ranks

LABELS = ("real", "fake")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value, n for several columns in one pass (grouping sets, one shuffle)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def summary(df: DataFrame, label: str = "label", size: str = "file_size") -> DataFrame:
    """One row: rows, labelled, real, fake, unlabelled, bytes, smallest, largest and mean size."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(label) == "real").alias("n_real"),
        F.count_if(F.col(label) == "fake").alias("n_fake"),
        F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.avg(size).alias("mean_bytes"),
    )


def duplicate_content(df: DataFrame, hash_col: str = "file_hash", path: str = "path") -> DataFrame:
    """Hashes that occur more than once, with how often, the first and last path and the first
    five paths in order (each task keeps five rows a hash before the shuffle)."""
    rows = df.where(F.col(hash_col).isNotNull() & (F.col(hash_col) != ""))
    groups = rows.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(path).alias("first_path"), F.max(path).alias("last_path")).where("n > 1")
    five = rows.select(hash_col, path).withColumn("__r", F.row_number().over(Window.partitionBy(hash_col).orderBy(path))).where("__r <= 5")
    return groups.join(five.groupBy(hash_col).agg(F.array_sort(F.collect_list(path)).alias("paths")), hash_col)


def first_wins(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order, without a sort: one minimum per key,
    combined before the shuffle."""
    by = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(F.col(o) if isinstance(o, str) else o for o in order)))
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), by).alias("__row")).select(*(F.col(c) if c == key else F.col(f"__row.`{c}`") for c in df.columns))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, without a sort: one maximum per key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(key, "__row.*")


def deduplicate(df: DataFrame, path: str = "path", ident: str = "sample_id", order: str = "ord", rounds: int = 64) -> DataFrame:
    """The sequential rule, without a sequence: rows in order are kept unless their path, or
    else their id, was kept before; skipped rows block nothing. Adds ``decision``: kept,
    duplicate_path or duplicate_id. Null is a path, and an id, like any other.

    Each round keeps every undecided row that comes first both in its path group and in its
    id group, then decides all rows that meet a kept one. Rounds end when none is undecided
    (one or two for real manifests): each decides the first undecided row at least. Rows that
    wait for each other in a long chain take a round a link; after ``rounds`` of them this raises.
    ``order`` is distinct and not null; a row without it is an error."""
    same = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    if not df.where(F.col(order).isNull()).isEmpty():
        raise ValueError(f"rows without {order}")
    rows = df.select("*", same(path).alias("__p"), same(ident).alias("__i"), F.col(order).alias("__o"))
    open_rows = materialize(rows.select("__p", "__i", "__o"), "undecided")
    kept: list[DataFrame] = []
    while not open_rows.isEmpty():
        if len(kept) == rounds:
            raise RuntimeError(f"rows that wait for each other are not decided after {rounds} rounds")
        first_p, first_i = (open_rows.groupBy(k).agg(F.min("__o").alias(f"{k}o")) for k in ("__p", "__i"))
        first = open_rows.join(first_p.select(F.col("__po").alias("__o")), "__o", "left_semi")
        kept.append(materialize(first.join(first_i.select(F.col("__io").alias("__o")), "__o", "left_semi"), "kept"))
        rest = open_rows.join(kept[-1].select("__p"), "__p", "left_anti")
        open_rows = materialize(rest.join(kept[-1].select("__i"), "__i", "left_anti"), "undecided")
    if not kept:
        return df.withColumn("decision", F.lit("kept")).limit(0)
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    by_path = every.select("__p", F.col("__o").alias("__kp"))
    decided = rows.join(by_path, "__p", "left").join(every.select(F.col("__o").alias("__k"), F.lit(True).alias("__kept")), rows["__o"] == F.col("__k"), "left")
    decision = F.when(F.col("__kept"), "kept").when(F.col("__kp") < F.col("__o"), "duplicate_path").otherwise("duplicate_id")
    return decided.select(*df.columns, decision.alias("decision"))


def class_balance(df: DataFrame, key: str, roles: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Counts and shares per role; roles without rows appear with zeros if ``roles`` lists them."""
    counts = df.groupBy(key).agg(F.count_if(F.col(label) == "real").alias("n_real"), F.count_if(F.col(label) == "fake").alias("n_fake"))
    if roles is not None:
        counts = roles.join(counts, key, "left").fillna(0, ["n_real", "n_fake"])
    n = F.col("n_real") + F.col("n_fake")
    share = lambda c: F.bround(F.coalesce(F.try_divide(F.col(c).cast("double"), n), F.lit(0.0)), 6)
    return counts.select(key, "n_real", "n_fake", n.alias("n"), share("n_real").alias("real_share"), share("n_fake").alias("fake_share"))


def split_statistics(df: DataFrame, key: str = "split_role", generator: str = "generator") -> DataFrame:
    """Role x label x generator counts at three levels of detail, from one pass."""
    return df.rollup(key, "label", generator).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def speaker_statistics(df: DataFrame, key: str = "split_role", speaker: str = "speaker", duration: str = "duration_sec") -> DataFrame:
    known = F.when(F.col(speaker).isNotNull() & ~F.col(speaker).isin("", "unknown"), F.col(speaker))
    return df.groupBy(key).agg(F.count("*").alias("n_clips"), F.count_distinct(known).alias("n_speakers"), F.bround(F.coalesce(F.avg(duration), F.lit(0.0)), 6).alias("avg_duration"))


def top_values(df: DataFrame, value: str, k: int, order: str) -> DataFrame:
    """The k most frequent values; of equals the one seen first."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def violations(df: DataFrame, required: list[str], ident: str) -> DataFrame:
    """One row per broken rule: a required column that is null or empty, or an unknown label."""
    rules = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.concat(F.lit("empty:"), F.lit(c))) for c in required]
    rules.append(F.when(F.coalesce(F.col("label"), F.lit("")).isin(*LABELS), None).otherwise("bad_label"))
    return df.select(ident, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def balanced_subset(df: DataFrame, key: str, most: int, label: str = "label", seed: str = "s") -> DataFrame:
    """min(most, fakes) rows per class, in hash order, cut 70/15/15 by position within class."""
    per = df.where(F.col(label).isin(*LABELS))
    q = per.agg(F.least(F.lit(most), F.count_if(F.col(label) == "fake"), F.count_if(F.col(label) == "real"))).first()[0]
    ranked = hash_ranks(per, key, [label], seed).where(F.col("__r") <= q)
    a = int(q * 0.70)
    b = a + int(q * 0.15)
    return ranked.select(*df.columns, F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "val").otherwise("test").alias("subset"))


def generator_quota(df: DataFrame, key: str, label: str = "label", generator: str = "generator", seed: str = "s") -> DataFrame:
    """All reals, and as many fakes, spread evenly over generators; what small generators
    leave is filled in hash order."""
    real, fake = df.where(F.col(label) == "real"), df.where(F.col(label) == "fake")
    n, kinds = df.agg(F.count_if(F.col(label) == "real"), F.count_distinct(F.when(F.col(label) == "fake", F.col(generator)))).first()
    # rows within quota come first, and of the rest those with the smallest hashes
    per = hash_ranks(fake, key, [generator], seed).withColumn("__over", (F.col("__r") > n // max(kinds, 1)).cast("int"))
    chosen = hash_ranks(per.select(*df.columns, "__over"), key, [], seed, F.col("__over")).where(F.col("__r") <= n)
    return real.unionByName(chosen.select(*df.columns))
