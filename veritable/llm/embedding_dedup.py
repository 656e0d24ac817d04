"""Operator 7. Embedding near-duplicates by random-hyperplane signs.

Vectors are compared only with vectors of the same label and length. Equal vectors of a
label form one class from the start. In each of ``TABLES`` tables a class falls into the
bucket named by the signs of ``BITS`` random projections; classes that share a bucket are
candidates; those whose other ``SKETCH`` signs differ too much are let go, the rest verified by
their exact cosine in double precision. Links join classes; connected components follow.

Buckets with more than ``CROWDED`` classes are dealt again by ``CROWDED_BITS`` more signs, in
``CROWDED_ROUNDS`` independent ways, so that the chance to find a near pair stays as high
while far pairs rarely meet. No bucket is dropped or cut.

Links are counted without going through all pairs of a group of near copies. Angles obey the
triangle inequality: vectors within half the threshold's angle of one centre all link with
each other. Classes that agree with the smallest class of a bucket of two tables at once
gather into balls around a common centre; those too far from it stand alone. Links within a
ball are counts; two balls that share a bucket are linked, or not, as a whole where the angle
of their centres and their radii settle it, and member by member only where they do not. So a
group of near copies costs its size, not its square, but for members at the rim. The centre is
a helper: whichever vectors it is the mean of, no link is lost or made up.

A vector whose label is null, or that is null, empty, zero or holds a null or non-finite
component, links with nothing and is its own component. So does a row with null vec_id: its
component_id is null and it is kept. Repeated rows with one vec_id are one vector, that of the
largest label and then the largest vector. An empty table gives no rows; long vectors
are rows like others. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import components, materialize, tidy

BITS, TABLES = 12, 32
CROWDED, CROWDED_BITS, CROWDED_ROUNDS = 64, 4, 4
SEED = 4099
#: Classes that a ball's centre is the mean of, at most.
CENTRE_OF = 32
#: Signs of every ball's centre, besides the tables', by which most of the far pairs that share a
#: bucket are told before anything is shuffled for them, and how many standard deviations off a
#: near pair may be: one in some 10^8 is further off.
SKETCH, SKETCH_OFF = 128, 6
#: Radians left out of every bound, far more than rounding can be.
MARGIN = 1e-6


def _planes(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, count]).standard_normal((dims, count))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    return [(rows := np.flatnonzero(sizes == n), flat[starts[rows][:, None] + np.arange(n)]) for n in np.unique(sizes).tolist()]


def _buckets(bits: int, tables: int, extra_bits: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(class, table, bucket, bucket of this and the next table, and a finer bucket per round)."""
        for batch in batches:
            for rows, x in _matrix(batch.column(1)):
                n, d = x.shape
                signs = (x @ _planes(d, tables * (bits + extra_bits * rounds)) > 0).reshape(n, tables, -1)
                key = signs[:, :, :bits] @ (1 << np.arange(bits)) + (d << bits)
                wide = (key << bits) + (np.roll(key, -1, axis=1) & ((1 << bits) - 1))
                fine = signs[:, :, bits:].reshape(n, tables, rounds, extra_bits) @ (1 << np.arange(extra_bits))
                flat = pa.array(fine.reshape(-1).astype(np.int32))
                offsets = pa.array(np.arange(0, n * tables * rounds + 1, rounds, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(rows, tables))), batch.column(2).take(pa.array(np.repeat(rows, tables))), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(key.reshape(-1).astype(np.int64)), pa.array(wide.reshape(-1).astype(np.int64)), pa.ListArray.from_arrays(offsets, flat)], ["rep", "label", "tbl", "bucket", "wide", "fine"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, radius, two halves of the signs of its centre)."""
    for batch in batches:
        for rows, x in _matrix(batch.column(2)):
            signs = np.packbits(x @ _planes(x.shape[1], SKETCH) > 0, axis=1).view(np.int64)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(signs[:, 0]), pa.array(signs[:, 1])], ["ball", "radius", "s1", "s2"])


def _alike(theta: float):
    """Whether two balls (columns s1, s2, radius; t1, t2, radius_b) may hold a near pair: signs
    differ with the chance of the angle over a half turn."""
    p = F.least(F.lit(0.5), (F.col("radius") + F.col("radius_b") + theta + MARGIN) / math.pi)
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return differ <= p * SKETCH + SKETCH_OFF * F.sqrt(p * (1 - p) * SKETCH) + 1


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine of their vectors in double precision)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        a = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        b = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        dot, aa, bb = (np.add.reduceat(v, starts) for v in (a * b, a * a, b * b))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dot / (np.sqrt(aa) * np.sqrt(bb)))], ["a", "b", "cosine"])


def _compare(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, cosine of ``pairs`` (a, b) of one label and length; the others: id, label, embedding."""
    x = left.select(F.col(left.columns[0]).alias("a"), F.col("embedding").alias("x"), F.col("label").alias("la"))
    y = right.select(F.col(right.columns[0]).alias("b"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    full = pairs.join(x, "a").join(y, "b").where("la = lb and size(x) = size(y)").select("a", "b", "x", "y")
    kinds = dict(pairs.dtypes)
    # norms beyond double precision give no cosine and so no link
    return full.mapInArrow(tidy(_cosines), f"a {kinds['a']}, b {kinds['b']}, cosine double").where(~F.isnan("cosine"))


def _angle():
    """Of the column ``cosine``, which rounding may carry beyond 1."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))


def _balls(reps: DataFrame, dealt: DataFrame, theta: float) -> tuple[DataFrame, DataFrame]:
    """(rep, ball, angle to its centre) of every class, and (ball, label, embedding) of every
    centre. Two classes of a ball are within ``theta`` of each other."""
    first = dealt.groupBy("label", "tbl", "wide").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = dealt.join(first, ["label", "tbl", "wide"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    near = _compare(met, reps, reps).where(F.col("cosine") >= math.cos(0.75 * theta)).groupBy("a").agg(F.min("b").alias("b"))
    # a class that others gathered around comes along, unless it gathered elsewhere itself
    ball = near.unionByName(near.select("b").distinct().join(near.select("a"), F.col("a") == F.col("b"), "left_anti").select(F.col("b").alias("a"), "b"))
    ball = materialize(ball, "gathered")
    # row limits per ball are pushed below the shuffle, so no task meets a whole ball
    turn = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    few = ball.withColumn("turn", turn).where(F.col("turn") <= CENTRE_OF).join(reps.withColumnRenamed("rep", "a"), "a")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    unit = few.withColumn("norm", norm).select("b", "label", F.transform("embedding", lambda v: v / F.col("norm")).alias("unit"))
    gathered = unit.groupBy("b").agg(F.first("label").alias("label"), F.collect_list("unit").alias("units"))
    total = F.aggregate(F.slice("units", F.lit(2), F.size("units")), F.get("units", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    centres = materialize(gathered.select("b", "label", total.alias("embedding")), "centres")
    inside = _compare(ball, reps, centres).withColumn("angle", _angle()).where(F.col("angle") <= theta / 2 - MARGIN)
    inside = materialize(inside.select(F.col("a").alias("rep"), F.concat(F.lit("b"), "b").alias("ball"), "angle"), "balls")
    lone = reps.join(inside, "rep", "left_anti")
    name = F.concat(F.lit("s"), "rep")
    placed = inside.unionByName(lone.select("rep", name.alias("ball"), F.lit(0.0).alias("angle")))
    used = inside.select("ball").distinct()
    middle = centres.select(F.concat(F.lit("b"), "b").alias("ball"), "label", "embedding").join(used, "ball", "left_semi")
    return placed, middle.unionByName(lone.select(name.alias("ball"), "label", "embedding"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, bits: int = BITS, tables: int = TABLES, crowded: int = CROWDED) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = named.where("vec_id is not null").groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & F.col("label").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = materialize(rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("embedding", F.transform(x, lambda v: F.when(v == 0, 0).otherwise(v).cast("double"))), "vectors")
    good = rows.where("usable")
    # a class is keyed by two hashes of its vector (128 bits), not by the long array itself
    key = [F.col("label"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    keyed = good.select("vec_id", "embedding", *key)
    classes = keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    member = keyed.drop("embedding").join(classes, ["label", "k1", "k2"]).select("vec_id", "rep", "copies")
    member = materialize(member, "members")
    reps = materialize(good.join(member.where("vec_id = rep").select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("rep"), "embedding", F.col("label").cast("string").alias("label")), "classes")
    dealt = materialize(reps.mapInArrow(tidy(_buckets(bits, tables, CROWDED_BITS, CROWDED_ROUNDS)), "rep long, label string, tbl int, bucket long, wide long, fine array<int>"), "buckets")
    theta = math.acos(threshold)
    placed, middles = _balls(reps, dealt, theta)
    weights = member.where("vec_id = rep").select("rep", "copies")
    placed = materialize(placed.join(weights, "rep"), "placed")
    balls = placed.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("held"), F.min("rep").alias("least"))
    balls = materialize(balls.join(middles, "ball"), "middles")
    sketches = balls.select("ball", F.col("radius").cast("double").alias("radius"), "embedding").mapInArrow(tidy(_sketches), "ball string, radius double, s1 long, s2 long")
    sketches = materialize(sketches, "sketches")
    sizes = dealt.groupBy("label", "tbl", "bucket").count().where("count > 1")
    quiet = dealt.join(sizes.where(F.col("count") <= crowded).drop("count"), ["label", "tbl", "bucket"], "left_semi").withColumn("round", F.lit(0)).withColumn("part", F.lit(0))
    busy = dealt.join(sizes.where(F.col("count") > crowded).drop("count"), ["label", "tbl", "bucket"], "left_semi").select("*", F.posexplode("fine").alias("round", "part"))
    cells = quiet.unionByName(busy).select("rep", F.xxhash64("label", "tbl", "bucket", "round", "part").alias("cell")).join(placed.select("rep", "ball").join(sketches, "ball"), "rep")
    cells = cells.select("cell", "ball", "radius", "s1", "s2").distinct()
    pairs = cells.withColumnRenamed("ball", "a").join(cells.toDF("cell", "b", "radius_b", "t1", "t2"), "cell").where((F.col("a") < F.col("b")) & _alike(theta)).select("a", "b").distinct()
    middle = balls.select("ball", "label", "embedding")
    wide = balls.select("ball", "radius")
    met = _compare(pairs, middle, middle).join(wide.toDF("a", "ra"), "a").join(wide.toDF("b", "rb"), "b").withColumn("d", _angle()).withColumn("r", F.col("ra") + F.col("rb"))
    met = materialize(met.where(F.col("d") <= theta + F.col("r") + MARGIN).select("a", "b", (F.col("d") + F.col("r") <= theta - MARGIN).alias("whole")), "met")
    whole = met.where("whole").select("a", "b")
    whole = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = whole.join(balls.select(F.col("ball").alias("b"), "held"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("held").alias("around"))
    rim = met.where("not whole").join(placed.select(F.col("ball").alias("a"), F.col("rep").alias("x")), "a").join(placed.select(F.col("ball").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = materialize(_compare(rim, reps, reps).where(F.col("cosine") >= threshold).select("a", "b"), "links")
    both = edges.union(edges.select("b", "a"))
    linked = both.join(weights.toDF("b", "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    spokes = placed.join(balls.select("ball", "least"), "ball").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    least = balls.select("ball", "least")
    bridges = met.where("whole").join(least.toDF("a", "la"), "a").join(least.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    edges = edges.union(spokes).union(bridges)
    reached = components(edges).withColumnRenamed("node", "rep")
    of_class = placed.join(balls.select("ball", "held"), "ball").join(around, "ball", "left").join(linked, "rep", "left").join(reached, "rep", "left")
    # a class's own copies are among those its ball holds
    of_class = of_class.select("rep", (F.col("held") - 1 + F.coalesce("around", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    found = member.select("vec_id", "rep").join(of_class, "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = named.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).unionByName(nameless).withColumn("kept", F.expr("vec_id <=> component_id"))
