"""Operator 3. SimHash near-duplicates by segment popcounts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints,
so fingerprints within ``distance`` bits lie within that Manhattan distance. The embedding is
cut into two halves: one of them must lie within ``distance // 2``. Each half is a grid
cell; every fingerprint is stored in its own cell and looks into the cells within that
Manhattan distance (one of each pair of opposite steps suffices). Candidates are verified
with the exact Hamming distance.

Equal fingerprints are one class from the start, so a group of exact copies of any size costs
one row. A cell that holds more than ``CROWDED`` distinct fingerprints is not joined with
itself or its neighbours pair by pair: its fingerprints, and those that look into it, name
the points within one bit of themselves, and sharing such a point means to lie within two bits. That finds
the same components with rows in proportion to the fingerprints.

Null and empty texts have fingerprint zero and form one group. Repeated rows are copies; those
that share a doc_id stay or go together. A row with null doc_id links with nothing: its
component_id is null. A long text is hashed shingle by shingle in blocks. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import components, materialize, quoted, tidy, unused

SEED = 42
WIDTH = 3
CROWDED = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED, block: int = 1 << 16) -> int:
    """Majority of the XXH64 bits of a text's word shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        values = np.array([h(line[a:b], seed) for a, b in zip(starts[at : at + block].tolist(), ends[at : at + block].tolist())], ">u8")
        set_bits += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    """(n, 16) segment popcounts of one half of the fingerprint."""
    bits = ((fp[:, None] >> np.arange(32 * half, 32 * half + 32, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    return bits.reshape(len(fp), 16, 2).sum(2)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and half: its own cell (step 0), and as ``look`` the cells one
    step up; the step down is the other fingerprint's step up."""
    weight = 3 ** np.arange(16, dtype=np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for half in (0, 1):
            counts = _half(fp.view(np.uint64), half)
            own = counts @ weight
            steps = own[:, None] + weight
            ok = counts < 2
            who = np.concatenate([fp, np.repeat(fp, 16).reshape(-1, 16)[ok]])
            cell = np.concatenate([own, steps[ok]]) * 2 + half
            look = np.concatenate([np.zeros(len(fp), bool), np.ones(int(ok.sum()), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(who), pa.array(look)], ["cell", "fp", "look"])


def links(classes: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``classes.fp``, so that the components
    are those of all pairs within two bits."""
    if distance != 2:
        raise ValueError("the grid is laid out for a distance of 2")
    cells = materialize(classes.select("fp").mapInArrow(tidy(_cells), "cell long, fp long, look boolean"), "cells")
    sizes = cells.groupBy("cell").agg(F.count_if(~F.col("look")).alias("own"), F.count_if(F.col("look")).alias("looks")).where("own > 0 and own + looks > 1")
    few, many = f"own <= {crowded} and looks <= {32 * crowded}", f"own > {crowded} or looks > {32 * crowded}"
    quiet = cells.join(sizes.where(few).select("cell"), "cell", "left_semi")
    own = quiet.where("not look").select("cell", F.col("fp").alias("a"))
    pairs = own.join(quiet.select("cell", F.col("fp").alias("b"), "look"), "cell")
    pairs = pairs.where("a <> b and (look or a < b)").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    hot = cells.join(sizes.where(many).select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << k).view(np.int64))) for k in range(64)))
    near = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = near.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    return pairs.union(near.join(hubs, "point").select("fp", "low").where("fp <> low"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group)."""
    rows = materialize(fingerprints(docs, text, doc_id), "fingerprints")
    classes = rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reached = components(links(classes))
    # components are over fingerprints; a group's smallest doc_id comes from its classes
    named = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("group"))
    lowest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_class = named.join(lowest, "group").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return rows.join(by_class, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are the smallest of their group, with all their columns; documents
    without an id stay."""
    ids = near_duplicates(docs, text, doc_id).where("doc_id is not null").groupBy("doc_id")
    name = unused("gone", docs.columns)
    gone = ids.agg(F.max(F.expr("doc_id = component_id")).alias("kept")).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(quoted(doc_id)).cast("long") == F.col(name), "left_anti")
