"""Leakage between splits: shared identities, contents, sources and generators, and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.normalize import meaningful

PAIRS = (("train", "val"), ("train", "test_seen"), ("train", "test_unseen"), ("val", "test_seen"), ("val", "test_unseen"))


def overlaps(df: DataFrame, key: str, role: str = "split_role", pairs=PAIRS, usable: Column | None = None) -> DataFrame:
    """left_role, right_role, n_shared and the first and last shared key for every pair of
    roles, zeros included (``overlap_examples`` lists more). One pass: each key's set of roles is an aggregate, so no self-join is needed."""
    ok = meaningful(key) if usable is None else usable
    sets = df.where(ok).groupBy(key).agg(F.collect_set(role).alias("__roles"))
    both = F.array(*(F.struct(F.lit(a).alias("left_role"), F.lit(b).alias("right_role")) for a, b in pairs))
    hits = F.filter(both, lambda p: F.array_contains("__roles", p["left_role"]) & F.array_contains("__roles", p["right_role"]))
    found = sets.select(key, F.explode(hits).alias("p")).groupBy("p.left_role", "p.right_role")
    shared = found.agg(F.count("*").alias("n_shared"), F.min(key).alias("first_example"), F.max(key).alias("last_example"))
    wanted = df.sparkSession.createDataFrame(list(pairs), "left_role string, right_role string")
    return wanted.join(F.broadcast(shared), ["left_role", "right_role"], "left").fillna(0, ["n_shared"])


def overlap_examples(df: DataFrame, key: str, role: str = "split_role", pairs=PAIRS, usable: Column | None = None, examples: int = 5) -> DataFrame:
    """The first ``examples`` shared keys of each pair of roles, one row each."""
    ok = meaningful(key) if usable is None else usable
    sets = df.where(ok).groupBy(key).agg(F.collect_set(role).alias("__roles"))
    both = F.array(*(F.struct(F.lit(a).alias("left_role"), F.lit(b).alias("right_role")) for a, b in pairs))
    hits = sets.select(key, F.explode(F.filter(both, lambda p: F.array_contains("__roles", p["left_role"]) & F.array_contains("__roles", p["right_role"]))).alias("p")).select("p.*", F.col(key).alias("example"))
    w = Window.partitionBy("left_role", "right_role").orderBy("example")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)


def generator_leakage(df: DataFrame, unseen: list[str], allowed: list[str] | None = None, role: str = "split_role", generator: str = "generator") -> DataFrame:
    """kind, generator, n: unseen generators in train, and generators that train may not have."""
    per = df.where((F.col(role) == "train") & F.col(generator).isNotNull()).groupBy(generator).agg(F.count("*").alias("n"))
    leaks = per.where(F.col(generator).isin(*unseen)).select(F.lit("generator_leakage").alias("kind"), generator, "n")
    if allowed is None:
        return leaks
    return leaks.unionByName(per.where(~F.col(generator).isin(*allowed)).select(F.lit("generator_policy").alias("kind"), generator, "n"))


def generators_in_common(df: DataFrame, role: str = "split_role", generator: str = "generator", ignore=("", "real", "original", "authentic")) -> DataFrame:
    """Generators of both train and test_unseen."""
    per = df.where(F.col(generator).isNotNull() & ~F.col(generator).isin(*ignore)).groupBy(generator).agg(F.count_if(F.col(role) == "train").alias("n_train"), F.count_if(F.col(role) == "test_unseen").alias("n_unseen"))
    return per.where("n_train > 0 and n_unseen > 0")


def balance_violations(balance: DataFrame, least: float = 0.10, role: str = "split_role") -> DataFrame:
    """Roles with rows whose smaller class is under ``least`` (compared before rounding)."""
    minority = F.try_divide(F.least("n_real", "n_fake").cast("double"), F.col("n_real") + F.col("n_fake"))
    return balance.select(role, "n_real", "n_fake", F.coalesce(minority, F.lit(0.0)).alias("minority"), (F.coalesce(minority, F.lit(1.0)) < least).alias("violated"))


def check_splits(df: DataFrame, keys: dict[str, tuple[str, Column]], unseen: list[str], allowed: list[str] | None, balance: DataFrame, least: float = 0.10) -> DataFrame:
    """All violations, one row each: kind, subject, n. An empty result means the splits pass.
    ``keys``: kind -> (column, which values count)."""
    parts = [generator_leakage(df, unseen, allowed).select("kind", F.col("generator").alias("subject"), "n")]
    for kind, (key, usable) in keys.items():
        found = overlaps(df, key, usable=usable).where("n_shared > 0")
        parts.append(found.select(F.lit(kind).alias("kind"), F.concat_ws("_x_", "left_role", "right_role").alias("subject"), F.col("n_shared").alias("n")))
    low = balance_violations(balance, least).where("violated")
    parts.append(low.select(F.lit("class_balance").alias("kind"), F.col("split_role").alias("subject"), F.least("n_real", "n_fake").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairwise(df: DataFrame, key: str, kind: str, ident: str, order: str, role: str = "split_role", usable: Column | None = None) -> DataFrame:
    """Pairs of rows of different roles with the same key, earlier row first. The number of
    pairs is the result itself; to know only whether and how much is shared, use overlaps."""
    ok = F.col(key).isNotNull() if usable is None else usable
    rows = df.where(ok).select(key, F.col(ident).alias("id"), F.col(order).alias("ord"), F.col(role).alias("role"))
    # keys of a single role cannot make a pair: they are left out before the join
    shared = rows.groupBy(key).agg(F.min("role").alias("lo"), F.max("role").alias("hi")).where("lo <> hi").select(key)
    rows = rows.join(shared, key, "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.role") != F.col("b.role")))
    return pairs.select(F.lit(kind).alias("violation_type"), F.col("a.id").alias("sample_id_1"), F.col("b.id").alias("sample_id_2"), F.col("a.role").alias("split_1"), F.col("b.role").alias("split_2"))


def duplicate_classes(df: DataFrame, key: str, ident: str, role: str = "split_role", usable: Column | None = None) -> DataFrame:
    """The same without pairs: key, role, n rows and the first id, of keys that several roles have."""
    ok = F.col(key).isNotNull() if usable is None else usable
    per = df.where(ok & F.col(role).isNotNull()).groupBy(key, F.col(role).alias("role")).agg(F.count("*").alias("n"), F.min(ident).alias("first_id"))
    several = per.groupBy(key).agg(F.min("role").alias("lo"), F.max("role").alias("hi")).where("lo <> hi").select(key)
    return per.join(several, key, "left_semi")


def count_pairs(classes: DataFrame, key: str, critical: str = "test_unseen") -> DataFrame:
    """n_violations, n_critical (pairs with a row of that role), n_warning and status, as
    ``verdict`` has them of all pairs of ``pairwise``, from the sizes of the classes alone."""
    n, other = F.col("n"), F.when(F.col("role") != critical, F.col("n")).otherwise(F.lit(0))
    # of a key's rows, pairs of different roles: half of all ordered pairs but those of one role
    pairs = lambda c: (F.sum(c) * F.sum(c) - F.sum(c * c)) / 2
    per = classes.groupBy(key).agg(pairs(n).cast("long").alias("every"), pairs(other).cast("long").alias("mild"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = per.agg(zero("every").alias("n_violations"), zero(F.col("every") - F.col("mild")).alias("n_critical"), zero("mild").alias("n_warning"))
    return rows.withColumn("status", _status())


def generator_pairs(df: DataFrame, ident: str, order: str, most: int = 10, role: str = "split_role", generator: str = "generator") -> DataFrame:
    """Example pairs of train and test_unseen rows of a generator, at most most x most each."""
    w = Window.partitionBy(generator, role).orderBy(order)
    first = df.where(F.col(role).isin("train", "test_unseen") & meaningful(generator)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    a = first.where(F.col(role) == "train").select(generator, F.col(ident).alias("sample_id_1"))
    b = first.where(F.col(role) == "test_unseen").select(generator, F.col(ident).alias("sample_id_2"))
    return a.join(b, generator)


def _cost(n: int, bits: int, most: int, agree: int) -> float:
    return comb(most + agree, agree) * n * (500 + n / 2 / 2 ** (bits * agree // (most + agree)))


def bands_to_agree(n: int, bits: int, most: int) -> int:
    """The number of bands that costs least for n hashes: a row for each hash and choice of
    bands, shuffled and sorted for the price of some 500 comparisons, and half the pairs that
    chance lets agree. All give the same pairs of hashes."""
    return min(range(1, 6), key=lambda agree: _cost(n, bits, most, agree))


def near_hash_pairs(hashes: DataFrame, bits: int, most: int, key: str = "hash", agree: int | None = None, role: str | None = None) -> DataFrame:
    """Pairs of distinct hashes at Hamming distance 1..most: (a, b, distance), a < b.

    The bits are cut into most + agree bands; two hashes that differ in at most ``most`` bits
    agree in ``agree`` bands or more, so comparing all that share a cell, for all choices of so many bands,
    misses none. More bands to agree in make longer keys that fewer far hashes share, and more rows per
    hash; None chooses by their number. A pair is reported by its first common choice only, which
    spares a distinct over all candidates. With ``role``, pairs of hashes whose rows are all of one role are left out.

    Cells are dealt to tasks by their number, not by their bytes: rows are few and small, their comparisons many."""
    kept = F.when(F.min("r") == F.max("r"), F.min("r")).alias("role")
    rows = hashes.select(F.col(key).cast("long").alias("h"), (F.col(role) if role else F.lit(None)).cast("string").alias("r")).where("h is not null")
    count = rows.select("h").distinct().count()
    agree = bands_to_agree(count, bits, most) if agree is None else agree
    tasks = 1 + int(_cost(count, bits, most, agree) / 1e8)
    n = most + agree
    edges = [round(bits * k / n) for k in range(n + 1)]
    band = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = list(combinations(range(n), agree))
    # choices are one constant, not a column each: hundreds of columns are more code than the JVM compiles
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(signed(sum(band[k] for k in ks))).cast("long").alias("bands")) for i, ks in enumerate(chosen)))
    rows = rows.groupBy("h").agg(kept).repartition(tasks, "h")
    cells = rows.select("h", "role", F.explode(choices).alias("c")).select("c.choice", F.col("h").bitwiseAND(F.col("c.bands")).alias("cell"), "h", "role")
    # the first common choice: no other band up to its last one agrees
    apart = [[band[k] for k in range(ks[-1]) if k not in ks] for ks in chosen]
    dealt = cells.repartition(tasks, "choice", "cell").sortWithinPartitions("choice", "cell")
    return dealt.mapInArrow(lambda batches: _near_in_cells(batches, most, apart), "a long, b long, distance int")


def _near_in_cells(batches: Iterator[pa.RecordBatch], most: int, apart: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each cell's hashes. Rows come ordered by choice and cell; memory holds one
    cell, a tile of its comparisons, and pairs found until there are enough for a batch."""
    codes: dict[str | None, int] = {None: -1}
    found, size = [], 0
    for choice, h, role in _cells(batches, codes):
        order = np.argsort(h, kind="stable")
        h, role = h[order], role[order]
        u = h.view(np.uint64)
        u = u.astype(np.uint32) if u.max() < 1 << 32 else u
        step = max(1, (1 << 19) // len(h))
        for at in range(0, len(h) - 1, step):
            x = u[at : at + step, None] ^ u[None, at:]
            i, j = np.nonzero(np.bitwise_count(x) <= most)
            i, j = i[i < j], j[i < j]
            x, i, j = x[i, j], i + at, j + at
            ok = (role[i] != role[j]) | (role[i] < 0)
            for mask in apart[choice]:
                ok &= x & x.dtype.type(mask & np.iinfo(x.dtype).max) != 0
            if ok.any():
                found.append((h[i[ok]], h[j[ok]], np.bitwise_count(x[ok]).astype(np.int32)))
                size += len(found[-1][0])
            if size >= 1 << 17:
                yield _batch(found)
                found, size = [], 0
    if found:
        yield _batch(found)


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "distance"])


def _cells(batches: Iterator[pa.RecordBatch], codes: dict[str | None, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(choice, hashes, numbers of their roles) of each cell with several hashes; -1 is no role or several."""
    held: list[tuple[np.ndarray, ...]] = []

    def whole():
        choice, _, h, role = (np.concatenate(c) for c in zip(*held))
        return int(choice[0]), h, role

    for batch in batches:
        role = batch.column("role").dictionary_encode()
        names = np.array([codes.setdefault(r, len(codes)) for r in role.dictionary.to_pylist()] + [-1], np.int32)
        numbers = names[role.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]
        columns = [batch.column(c).to_numpy() for c in ("choice", "cell", "h")] + [numbers]
        choice, cell = columns[:2]
        starts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(cell) != 0)) + 1
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(choice)]):
            if hi > lo:
                if held and (held[-1][0][-1] != choice[lo] or held[-1][1][-1] != cell[lo]):
                    if sum(len(part[0]) for part in held) > 1:
                        yield whole()
                    held = []
                held.append(tuple(c[lo:hi] for c in columns))
    if sum(len(part[0]) for part in held) > 1:
        yield whole()


def near_duplicates(df: DataFrame, hash_col: str, ident: str, role: str, bits: int, most: int) -> DataFrame:
    """Cross-role pairs of rows whose hashes differ in 1..most bits."""
    pairs = near_hash_pairs(df, bits, most, hash_col, role=role)
    left = df.select(F.col(hash_col).alias("a"), F.col(ident).alias("id_1"), F.col(role).alias("role_1"))
    right = df.select(F.col(hash_col).alias("b"), F.col(ident).alias("id_2"), F.col(role).alias("role_2"))
    rows = pairs.join(left, "a").join(right, "b").where("role_1 <> role_2")
    swap = F.col("id_1") > F.col("id_2")
    return rows.select(F.when(swap, F.col("id_2")).otherwise(F.col("id_1")).alias("id_1"), F.when(swap, F.col("id_1")).otherwise(F.col("id_2")).alias("id_2"), F.when(swap, F.col("role_2")).otherwise(F.col("role_1")).alias("role_1"), F.when(swap, F.col("role_1")).otherwise(F.col("role_2")).alias("role_2"), "distance")


def near_clusters(df: DataFrame, hash_col: str, order: str, bits: int, most: int) -> DataFrame:
    """Stars, not transitive: each hash with the number of later-seen hashes close to it."""
    seen = df.groupBy(hash_col).agg(F.min(order).alias("first_seen"))
    pairs = near_hash_pairs(df, bits, most, hash_col)
    rows = pairs.join(seen.select(F.col(hash_col).alias("a"), F.col("first_seen").alias("sa")), "a").join(seen.select(F.col(hash_col).alias("b"), F.col("first_seen").alias("sb")), "b")
    anchor = rows.select(F.least("sa", "sb").alias("anchor"), F.greatest("sa", "sb").alias("member"))
    return anchor.groupBy("anchor").agg(F.count("*").alias("n_near"), F.min("member").alias("first_member"), F.max("member").alias("last_member"))


def verdict(violations: DataFrame) -> DataFrame:
    """Counts by severity, and FAIL, PASS_WITH_WARNINGS or PASS."""
    rows = violations.agg(F.count("*").alias("n_violations"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
    return rows.withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("n_critical") > 0, "FAIL").when(F.col("n_warning") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
