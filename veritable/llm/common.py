"""Helpers shared by the training-data operators: shared-folder tables, deterministic
row remainders, batch slicing for Arrow functions and distributed connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handled at once by a numpy kernel inside a task; a longer document is its own slice.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one
    machine alone (tests) may leave it unset and gets a folder of its own; on a cluster that
    is an error, as every executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"veritable-{os.getuid()}-{os.getpid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the result no longer
    depends on what computed it, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """A column's name that is not among these, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(columns: list[str], **more: Column) -> Column:
    """All these columns as one struct, numbered, so that their names can't clash."""
    return F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)), *(c.alias(name) for name, c in more.items()))


def unpacked(columns: list[str], name: str = "carried") -> list[Column]:
    return [F.col(f"{name}.c{i}").alias(c) for i, c in enumerate(columns)]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function ``run``, handing free memory back to the system when its task ends.
    Spark uses its Python workers again; what their allocators keep would add up over the
    stages of a job."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents whose labels no model may learn."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and where each row begins in them
    (one entry more than rows). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def prefix_offsets(totals: DataFrame, part: str, amount: str, start: str) -> DataFrame:
    """Second pass of a two-pass prefix sum: ``totals`` has one row per partition."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long").alias(start))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars with the same components (union-find in one task)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x] = top
            x = up
        return top

    def drain() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield drain()
    if parent:
        yield drain()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges``: two integer columns, any names, each link once or more; loops are ignored.
    Returns ``node, component_id`` for every node with a link, where component_id is the
    smallest node that can be reached. Partitions first shrink to spanning stars, then
    large-star and small-star steps alternate until nothing changes. No step gathers the
    neighbours of a node: each is a minimum per node (combined before the shuffle) and an
    equi-join. Raises if ``rounds`` steps do not suffice, rather than return a cut result.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src <> dst")
    stars = materialize(pairs.mapInArrow(tidy(_forest), "src long, dst long").distinct(), "edges")

    def mark(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    seen = mark(stars)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = stars.union(stars.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.first("src"), F.min("dst")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        stars = materialize(small.union(least.select("src", F.col("low").alias("dst"))).distinct(), "edges")
        now = mark(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = stars.select(F.col("dst").alias("node"), F.col("dst").alias("component_id")).distinct()
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("component_id")).union(tops)
