"""Operator 11. Merkle manifest of a dataset as a content-addressed graph.

Every document is a leaf: the hash of its fields. Leaves of a source in order of doc_id, then
the sources' own roots in order of source, form trees of ``ARITY`` children a node. The
manifest stores one record per node, ``digest -> children``, found by nothing but its digest.

A request names a leaf by its source and its rank there. It descends from the root: the digits
of the source's number, then of the rank (base ``ARITY``, most significant first) choose a child
each; the children not chosen are collected. The collected segments, reversed, are the proof:
from the leaf up to the root, hashing a leaf between the segments gives the root again.

All requests below a node share its path, so a node descends once for all of them: each step
joins the wanted nodes of a level with the records by digest, and only the last step meets the
requests themselves. The work is a sixteenth of the leaves and less for each level above.
Ranks come from two passes, counts per sorted range and source, then offsets, so the leaves of
one source never meet in one task, however many there are.

Null doc_ids come first in their source, null sources first of all; rows that share a doc_id
are leaves of their own, in the order of their digests. Null fields hash as ``-``, empty ones
as ``0:``. A long text is hashed where it is read, and never travels. An empty table has no
rows, no records and no root. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import materialize, tidy

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field as a leaf hashes it: ``-`` for null, else its UTF-8 byte count, ``:`` and value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """A row's digest, with some fields replaced."""
    return digest(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append to rows sorted by their first column the place of each among its equals."""
    last, count = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], code[1:] != code[:-1]])
        begin = np.flatnonzero(new)
        first = batch.column(0)[0].as_py()
        rank = np.arange(len(code)) - np.repeat(begin, np.diff(begin, append=len(code)))
        if first == last:
            rank[: begin[1] if len(begin) > 1 else len(code)] += count
        last, count = batch.column(0)[-1].as_py(), int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ranges of (group, order), each sorted and numbered for itself: columns
    ``rank`` within the group's part of the range, and ``part``; and the start of each (group,
    part): what the counts of the group's parts before it add up to, with the group's ``n``.
    Nulls come first. So a group may span any number of tasks."""
    others = [c for c in rows.columns if c != group]
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    sorted_rows = rows.select(group, *others).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema)
    local = sorted_rows.mapInArrow(tidy(_local_ranks), f"{schema}, rank long").withColumn("part", F.spark_partition_id())
    # written before it is counted, so that counts and rows are of the same ranges
    local = materialize(local, name)
    counts = local.groupBy(group, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    return local, counts.select(group, "part", start.alias("start"), F.sum("n").over(whole).cast("long").alias("n"))


def _levels(n: Column) -> Column:
    """Levels of a tree over n leaves: none for one leaf."""
    return sum(((n > ARITY**k).cast("int") for k in range(15)), F.lit(0))


def _grow(nodes: DataFrame, name: str, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over ``nodes`` (tree, rank, n, digest), the tallest of ``levels``: (tree, digest) of
    each tree's top, and a table (digest, children) for each level of inner nodes."""
    tops, records = [], []
    for level in range(levels):
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        # a run has ARITY children at most
        run = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"rank div {ARITY}").alias("rank")).agg(F.first("n").alias("n"), run.alias("run"))
        runs = runs.select("tree", "rank", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.transform("run", lambda c: c["digest"]).alias("children"))
        nodes = materialize(runs.withColumn("digest", digest(F.array_join("children", ""))), f"{name}-{level}")
        records.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
    return _all([*tops, nodes.where("n = 1").select("tree", "digest")]), records


@dataclass
class Manifest:
    """``leaves``: doc_id, leaf (its digest), number of its source, rank there, levels of the
    source's tree, and what was kept. ``sources``: source, number, n, levels, subroot.
    ``subtrees`` and ``top``: (digest, children), a table per level, the lowest first."""

    leaves: DataFrame
    sources: DataFrame
    subtrees: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(docs: DataFrame, **kept: Column) -> Manifest:
    """The manifest of ``docs``; ``kept`` are columns that the leaves carry along."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), *(c.alias(k) for k, c in kept.items()))
    local, starts = ranked(rows, "source", ["doc_id", "leaf"], "leaves")
    starts = materialize(starts, "starts")
    sources, offsets = ranked(starts.select("source", "n").distinct().withColumn("crown", F.lit(0)), "crown", ["source"], "sources")
    sources = sources.withColumnRenamed("n", "leaves").join(offsets, ["crown", "part"])
    # a number for each source stands for it from here on, null included
    sources = materialize(sources.select("source", (F.col("rank") + F.col("start")).alias("number"), F.col("leaves").alias("n"), _levels(F.col("leaves")).alias("levels")), "numbers")
    tall = sources.agg(F.max("levels").alias("levels"), F.count("*").alias("n"), _levels(F.count("*")).alias("top")).first()
    numbered = starts.join(sources.select(F.col("source").alias("of"), "number", "levels"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("part").alias("at"), "start", "n", "number", "levels")
    leaves = local.join(numbered, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    leaves = materialize(leaves.select("number", (F.col("rank") + F.col("start")).alias("rank"), "levels", "n", "doc_id", "leaf", *kept), "ranked")
    tops, subtrees = _grow(leaves.select(F.col("number").alias("tree"), "rank", "n", F.col("leaf").alias("digest")), "subtree", tall["levels"] or 0)
    sources = materialize(sources.join(tops.select(F.col("tree").alias("number"), F.col("digest").alias("subroot")), "number"), "subroots")
    crown = sources.select(F.lit(0).alias("tree"), F.col("number").alias("rank"), F.lit(tall["n"]).alias("n"), F.col("subroot").alias("digest"))
    roots, top = _grow(crown, "top", tall["top"])
    root = roots.first()
    return Manifest(leaves.drop("n"), sources, subtrees, top, root and root["digest"])


_SEGMENT = "array<struct<before:string,after:string>>"


def _descend(start: DataFrame, records: list[DataFrame], wanted: list[DataFrame], name: str) -> DataFrame:
    """``start``: nodes (tree, prefix, left, digest, path, subroot), ``left`` levels above what is
    sought. From the highest level down, nodes open into their children that are ``wanted``;
    trees of fewer levels join in at their height. Nodes with no level left, and their paths."""
    opened = []
    for left in range(len(records), 0, -1):
        # records[k] open nodes with k + 1 levels left
        nodes = _all([start.where(F.col("left") == left), *opened]).join(records[left - 1], "digest")
        child = nodes.select("tree", "prefix", "path", "subroot", "children", F.posexplode("children").alias("digit", "child"))
        path = F.concat("path", F.array(_siblings(F.col("digit"))))
        child = child.select("tree", (F.col("prefix") * ARITY + F.col("digit")).alias("prefix"), F.lit(left - 1).alias("left"), F.col("child").alias("digest"), path.alias("path"), "subroot")
        opened = [materialize(child.join(wanted[left - 1], ["tree", "prefix"], "left_semi"), f"{name}-{left}")]
    return _all([start.where("left = 0"), *opened])


def _siblings(digit: Column) -> Column:
    """The children that the digit does not choose, before and after the chosen one."""
    before = F.slice("children", F.lit(1), digit)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(F.slice("children", digit + 2, F.lit(ARITY)), "").alias("after"))


def _prefixes(requests: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (tree, prefix) above requests (tree, prefix, left) with k levels left to them."""
    out, now = [], requests.distinct()
    for _ in range(levels):
        out.append(now.select("tree", "prefix"))
        now = now.where("left > 0").select("tree", F.expr(f"prefix div {ARITY}").alias("prefix"), (F.col("left") - 1).alias("left")).distinct()
    return out


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests``: number, rank and levels of leaves as the manifest's leaves have them, and
    any columns but path and subroot. Adds ``path``, segments from the leaf to the root, and
    ``subroot``. A request for a leaf that does not exist has no row."""
    spark = requests.sparkSession
    if manifest.root is None:
        return requests.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_SEGMENT).alias("path")).limit(0)
    # N / ARITY rows at most, and less for each level above
    parents = requests.select(F.col("number").alias("tree"), F.expr(f"rank div {ARITY}").alias("prefix"), F.greatest(F.col("levels") - 1, F.lit(0)).alias("left"))
    parents = materialize(parents.distinct(), "parents")
    asked = parents.select(F.col("tree").alias("number")).distinct().join(manifest.sources.select("number", "levels", "subroot"), "number")
    asked = materialize(asked, "asked")
    tops = len(manifest.top)
    start = spark.range(1).select(F.lit(0).alias("tree"), F.col("id").alias("prefix"), F.lit(tops).alias("left"), F.lit(manifest.root).alias("digest"), F.array().cast(_SEGMENT).alias("path"), F.lit(None).cast("string").alias("subroot"))
    wanted = _prefixes(asked.select(F.lit(0).alias("tree"), F.col("number").alias("prefix"), F.lit(tops).alias("left")), tops)
    below = _descend(start, manifest.top, wanted, "from-root").select(F.col("prefix").alias("number"), "path").join(asked, "number")
    # down to the leaves' parents, or a lone leaf: the last digit is the requests' own
    start = below.select(F.col("number").alias("tree"), F.lit(0).cast("long").alias("prefix"), F.greatest(F.col("levels") - 1, F.lit(0)).alias("left"), F.col("subroot").alias("digest"), "path", "subroot")
    inner = manifest.subtrees[1:]
    held = _descend(start, inner, _prefixes(parents, len(inner)), "from-subroot").withColumnRenamed("tree", "number").withColumnRenamed("prefix", "parent")
    if manifest.subtrees:
        held = held.join(manifest.subtrees[0], "digest", "left")
    else:
        held = held.withColumn("children", F.lit(None).cast("array<string>"))
    joined = requests.withColumn("parent", F.expr(f"rank div {ARITY}")).join(held.select("number", "parent", "subroot", "path", "children"), ["number", "parent"])
    digit = F.expr(f"cast(rank % {ARITY} as int)")
    lone = F.col("levels") == 0
    joined = joined.where((F.col("rank") >= 0) & (digit < F.when(lone, 1).otherwise(F.size("children"))))
    path = F.when(lone, F.col("path")).otherwise(F.concat("path", F.array(_siblings(digit))))
    return joined.select(*requests.columns, "subroot", F.reverse(path).alias("path"))


def _all(tables: list[DataFrame]) -> DataFrame:
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf_digest, lambda below, s: digest(s["before"], below, s["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def tampered() -> Column:
    """Rows that the audit changes: their doc_id's checksum is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row proves itself,
    as it is or, where ``tampered``, with its text in lower case (A-Z alone)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # only rows whose digest changes carry a second one
    manifest = build(docs, shown=F.when(tampered(), leaf(text=lower)))
    proved = prove(manifest, manifest.leaves)
    shown = F.coalesce("shown", "leaf")
    out = proved.select("doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(shown, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
