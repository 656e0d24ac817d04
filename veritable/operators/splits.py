"""Assigning rows to train, val, test_seen and test_unseen."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.normalize import ColumnOrName, col, meaningful
from veritable.operators.shared import join_same, numbered

ROLES = ("train", "val", "test_seen", "test_unseen")


def role_table(df: DataFrame, name: str = "split_role") -> DataFrame:
    """The four roles, so that empty ones appear in reports."""
    return df.sparkSession.createDataFrame([(r,) for r in ROLES], f"{name} string")


def upstream_role(upstream: ColumnOrName, generator: ColumnOrName, unseen: list[str]) -> Column:
    """Unseen generators go to test_unseen, the rest by their upstream split; null if unknown."""
    by_split = F.when(col(upstream) == "train", "train").when(col(upstream).isin("valid", "val"), "val").when(col(upstream) == "test", "test_seen")
    return F.when(col(generator).isin(*unseen), "test_unseen").otherwise(by_split)


def md5_fraction(key: ColumnOrName) -> Column:
    """The first 32 bits of the key's md5 as a share of their maximum."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def md5_role(key: ColumnOrName, cuts: tuple[float, float, float] = (0.7, 0.8, 0.9)) -> Column:
    x = md5_fraction(key)
    return F.when(x < cuts[0], "train").when(x < cuts[1], "val").when(x < cuts[2], "test_seen").otherwise("test_unseen")


def md5_percent(key: ColumnOrName) -> Column:
    """The whole 128-bit md5 modulo 100, by halves: 2**64 is 16 modulo 100."""
    half = lambda at: F.conv(F.substring(F.md5(col(key).cast("string")), at, 16), 16, 10).cast("decimal(20,0)") % 100
    return ((half(1) * 16 + half(17)) % 100).cast("int")


def speaker_roles(clips: DataFrame, speaker: str = "speaker", unseen: Column | None = None, min_clips: int = 1, cuts: tuple[int, int] = (70, 85)) -> DataFrame:
    """split_role per clip: every clip of a speaker with any unseen clip is test_unseen; other
    speakers go whole by their md5; speakers with fewer than ``min_clips`` seen clips train.

    One pass over speakers (an aggregate) and one join back; the tainted flag is an
    aggregate, so the clips are never gathered. A clip without a speaker goes by itself:
    test_unseen if it is unseen, else train."""
    flag = F.lit(False) if unseen is None else F.coalesce(unseen, F.lit(False))
    per = clips.groupBy(F.col(speaker).alias("__speaker")).agg(F.bool_or(flag).alias("__tainted"), F.count_if(~flag).alias("__n"))
    roll = md5_percent("__speaker")
    role = F.when(F.col("__tainted"), "test_unseen").when(F.col("__n") < min_clips, "train").when(roll < cuts[0], "train").when(roll < cuts[1], "val").otherwise("test_seen")
    alone = F.when(flag, "test_unseen").otherwise("train")
    known = per.where("__speaker is not null").select("__speaker", role.alias("__role"))
    return clips.withColumn("__alone", alone).join(known, F.col(speaker) == F.col("__speaker"), "left").select(*clips.columns, F.coalesce("__role", "__alone").alias("split_role"))


@dataclass(frozen=True)
class Policy:
    """A split's rules: generators by role, unseen ones, role by upstream split, the least share of
    the smaller class, and pairs of roles that must share nothing."""

    generators: dict[str, list[str]]
    unseen: list[str]
    upstream: dict[str, str]
    least_share: float
    apart: list[tuple[str, str]]


def load_policy(text: str) -> Policy:
    """A policy document: JSON, or YAML where a YAML reader is installed."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ModuleNotFoundError:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("a policy is a mapping")
    rules = raw.get("validation") or {}
    return Policy(
        {str(k): [str(x) for x in v or []] for k, v in (raw.get("split_generators") or {}).items()},
        [str(x) for x in (raw.get("generator_taxonomy") or {}).get("unseen_forgery") or []],
        {str(k): str(v) for k, v in (raw.get("source_split_mapping") or {}).items()},
        float(rules.get("min_minority_class_fraction", 0.10)),
        [(str(a), str(b)) for a, b in rules.get("incompatible_split_pairs") or []],
    )


def policy_roles(policy: Policy, upstream: ColumnOrName, generator: ColumnOrName) -> Column:
    """The role that a policy gives a row; null where its upstream split has none."""
    role = F.lit(None).cast("string")
    for name, value in policy.upstream.items():
        role = F.when(col(upstream) == name, value).otherwise(role)
    return F.when(col(generator).isin(*policy.unseen), "test_unseen").otherwise(role)


def allowed_rows(df: DataFrame, policy: dict[str, list[str]], generator: str = "generator", role: str = "split_role") -> DataFrame:
    """Rows whose generator its role allows; a role without a list allows all."""
    ok = F.lit(True)
    for name, generators in policy.items():
        ok = ok & ((F.col(role) != name) | F.col(generator).isin(*generators))
    return df.where(ok)


def policy_errors(df: DataFrame, policy: dict[str, list[str]], generator: str = "generator", role: str = "split_role") -> DataFrame:
    counts = df.groupBy(role, generator).agg(F.count("*").alias("n"))
    bad = F.col(role).isNull()
    for name, generators in policy.items():
        bad = bad | ((F.col(role) == name) & ~F.coalesce(F.col(generator).isin(*generators), F.lit(False)))
    return counts.where(bad)


def hash_ranks(df: DataFrame, key: str, keys: list[str], seed: str = "s", first: Column | None = None) -> DataFrame:
    """Adds __r, each row's rank from 1 in order of ``first`` (a small number; lower ones come
    before), the hash of ``key`` and then the key and a hash of the row, per combination of
    ``keys`` (null is a value), and __total, the rows of that combination. Ranks come from counts
    of sorted ranges and a rank within a range, so no task sorts a whole combination, nor all
    rows with a null key, which hash like empty ones."""
    rows = df.select("*", (F.lit(0) if first is None else first.cast("int")).alias("__f"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("__h"), F.xxhash64(*df.columns).alias("__x"))
    ranked = numbered(rows, keys, ["__f", "__h", key, "__x"], "__r")
    if not keys:
        return ranked.select(*df.columns, "__r", F.lit(df.count()).alias("__total"))
    return join_same(ranked, df.groupBy(*keys).agg(F.count("*").alias("__total")), keys).select(*df.columns, "__r", "__total")


def hashed_shares(df: DataFrame, key: str, shares: tuple[float, float] = (0.70, 0.15), seed: str = "s", stratum: str | None = None) -> DataFrame:
    """Exact shares in hash order, per stratum if given. Rows with a null stratum are a stratum;
    null keys hash like empty ones."""
    ranked = hash_ranks(df, key, [stratum] if stratum else [], seed)
    a = F.floor(F.col("__total") * shares[0])
    b = a + F.floor(F.col("__total") * shares[1])
    return ranked.withColumn("subset", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "val").otherwise("test")).select(*df.columns, "subset")


def time_aware(df: DataFrame, ts: str, key: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Earliest rows train, latest test, cut by exact position; rows without a time come last.
    Of equal times and keys a hash of the row decides. Positions come from counts of sorted
    ranges, so no task sorts the whole table, nor all rows without a time."""
    rows = df.select("*", F.col(ts).isNull().alias("__late"), F.xxhash64(*df.columns).alias("__x"))
    ranked = numbered(rows, [], ["__late", ts, key, "__x"], "__r")
    total = df.count()
    a = int(total * shares[0])
    b = a + int(total * shares[1])
    return ranked.withColumn("subset", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "val").otherwise("test")).select(*df.columns, "subset")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """1 / count per class, and the weight of fakes relative to reals (null without fakes)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, "n", (1.0 / F.col("n")).alias("weight"))


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.try_divide(F.count_if(F.col(label) == "real").cast("double"), F.count_if(F.col(label) == "fake")).alias("pos_weight"))


def first_n_per_group(df: DataFrame, group: str, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows of each group, in hash order: a reproducible random choice."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def forbidden_features(columns: list[str], forbidden: list[str]) -> list[str]:
    """Feature columns that would leak the target."""
    return sorted(set(columns) & set(forbidden))


def expanding_folds(df: DataFrame, folds: int, position: str) -> DataFrame:
    """fold k tests on block k+1 of folds+1 equal blocks and trains on all before."""
    tests = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    block = df.select("*", F.expr(f"cast({position} * {folds + 1} as int)").alias("__b"))
    return block.select("*", tests.alias("fold")).where("__b <= fold").withColumn("part", F.when(F.col("__b") == F.col("fold"), "test").otherwise("train")).drop("__b")


def usable(key: ColumnOrName) -> Column:
    return meaningful(key)
