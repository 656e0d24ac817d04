"""Prefix scans of affine maps: smoothing whole streams without one task for each stream.

A step of exponential smoothing, s -> a s + b, is an affine map, and maps compose. A stream is
cut into blocks of positions. Each block composes its maps to one; the maps of blocks are
scanned in the same way, in blocks of blocks, until a stream has one; on the way back every block
learns the value before it and runs its own steps from there. No list is longer than a block,
however long a stream is, and all blocks of a level run side by side.

A map has three numbers: s -> coalesce(a s + b, c), where c is what it gives before the first
value, when s is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.operators.shared import join_same

#: Steps that a block holds.
BLOCK = 256


def ema_map(value: Column, alpha: float) -> Column:
    """Smoothing by one value; a null value changes nothing."""
    x = value.cast("double")
    known = F.struct(F.lit(1 - alpha).alias("a"), (F.lit(alpha) * x).alias("b"), x.alias("c"))
    return F.when(x.isNotNull(), known).otherwise(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("c")))


def _apply(m: Column, s: Column) -> Column:
    return F.coalesce(m["a"] * s + m["b"], m["c"])


def _composed(steps: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("c"))
    return F.aggregate(steps, start, lambda m, s: F.struct((s["m"]["a"] * m["a"]).alias("a"), (s["m"]["a"] * m["b"] + s["m"]["b"]).alias("b"), _apply(s["m"], m["c"]).alias("c")))


def _running(steps: Column, start: Column, before: bool) -> Column:
    """The value before, or after, every step."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), start.cast("double").alias("s"))

    def step(acc: Column, s: Column) -> Column:
        now = _apply(s["m"], acc["s"])
        return F.struct(F.concat(acc["out"], F.array(acc["s"] if before else now)).alias("out"), now.alias("s"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _blocks(rows: DataFrame, keys: list[str], block: int, *carried: Column) -> DataFrame:
    """keys, __g, steps: blocks of rows (keys, __k, m), each with its steps in order."""
    steps = F.array_sort(F.collect_list(F.struct("__k", "m", *carried)), lambda x, y: F.when(x["__k"] < y["__k"], -1).when(x["__k"] > y["__k"], 1).otherwise(0))
    return rows.groupBy(*keys, F.floor(F.col("__k") / block).alias("__g")).agg(steps.alias("steps"))


def _tops(rows: DataFrame) -> int:
    return rows.agg(F.max("__k")).first()[0] or 0


def _carry(maps: DataFrame, keys: list[str], most: int, block: int) -> DataFrame:
    """keys, __k, __s: the value before each map, null before a stream's first."""
    groups = _blocks(maps, keys, block)
    if most < block:
        start = groups.withColumn("__s", F.lit(None).cast("double"))
    else:
        up = groups.select(*keys, F.col("__g").alias("__k"), _composed(F.col("steps")).alias("m"))
        start = join_same(groups, _carry(up, keys, most // block, block).withColumnRenamed("__k", "__g"), [*keys, "__g"])
    pairs = F.arrays_zip(F.transform("steps", lambda s: s["__k"]).alias("k"), _running(F.col("steps"), F.col("__s"), True).alias("s"))
    return start.select(*keys, F.explode(pairs).alias("__x")).select(*keys, F.col("__x.k").alias("__k"), F.col("__x.s").alias("__s"))


def affine_scan(rows: DataFrame, keys: list[str], pos: str, step: Column, name: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """``rows`` with the value after each row's ``step`` (a map as ``ema_map`` makes it), in order
    of ``pos``, whole numbers from 0 or 1 on, within ``keys`` (null is a value). Each pos occurs
    once in a key; what is missing between only makes blocks shorter."""
    others = [c for c in rows.columns if c not in keys]
    base = rows.select(*keys, F.col(pos).cast("long").alias("__k"), step.alias("m"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others))).alias("__row"))
    blocks = _blocks(base, keys, block, F.col("__row"))
    most = _tops(base)
    if most < block:
        start = blocks.withColumn("__s", F.lit(None).cast("double"))
    else:
        up = _blocks(base.drop("__row"), keys, block).select(*keys, F.col("__g").alias("__k"), _composed(F.col("steps")).alias("m"))
        start = join_same(blocks, _carry(up, keys, most // block, block).withColumnRenamed("__k", "__g"), [*keys, "__g"])
    pairs = F.arrays_zip(F.transform("steps", lambda s: s["__row"]).alias("row"), _running(F.col("steps"), F.col("__s"), False).alias("s"))
    out = start.select(*keys, F.explode(pairs).alias("__x"))
    restored = {c: F.col(f"__x.row.c{i}").alias(c) for i, c in enumerate(others)}
    return out.select(*(restored.get(c, F.col(c)) for c in rows.columns), F.col("__x.s").alias(name))


def affine_last(rows: DataFrame, keys: list[str], pos: str, step: Column, name: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """keys and the value after each key's last step."""
    maps = rows.select(*keys, F.col(pos).cast("long").alias("__k"), step.alias("m"))
    most = _tops(maps)
    while True:
        maps = _blocks(maps, keys, block).select(*keys, F.col("__g").alias("__k"), _composed(F.col("steps")).alias("m"))
        if most < block:
            return maps.select(*keys, F.col("m.c").alias(name))
        most //= block
