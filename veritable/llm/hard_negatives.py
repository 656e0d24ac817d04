"""Operator 12. Hard negatives by a vertical scan (branch and bound on decomposed vectors).

Vectors are stored by dimension: a block is up to ``BLOCK`` vectors, one column of numbers for
each dimension, with the smallest and largest number of every column. An anchor reads the
columns of a block in descending order of its own magnitude there. After each step the columns
not read yet can add at most, and at least, what their smallest and largest numbers times the
anchor's give; candidates that these bounds rule out leave the bitmap, until what is left has
read every column and its score is exact.

Two scans answer an anchor. The first finds its positives: the best rows of its label. They set
the windows of scores in which its negatives lie. The second scan keeps what may still fall in a
window: rows beyond all windows leave, and rows that the best so far of every window they
can reach already beat. Both keep the best of each block and merge them per anchor, so nothing
is lost, and ties go to the smaller vec_id.

Anchors are a fixed share of the rows, so they don't fit one broadcast: they are dealt into
chunks of at most ``ANCHORS`` vectors and ``ANCHOR_NUMBERS`` numbers, and each chunk is held
against all blocks.

Rows with a null vec_id or label, a null vector or a component that is null or not finite (also
after scaling) take no part. Repeated rows with one vec_id are one row, that of the largest
label and then the largest vector. Only vectors of one length have a score. Sums that could
leave the range in which doubles are exact are added up as whole numbers; scores beyond 64 bits
are the largest or smallest such number in what is returned. An anchor alone in its label, or
without a row in a window, has no row in the result. An empty table gives no rows; long
vectors make smaller blocks. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import materialize, tidy

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is at least 30 and at most 90 percent of its positive's.
LEAST, MOST = 30, 90
BLOCK, BLOCK_NUMBERS = 4096, 1 << 21
ANCHORS, ANCHOR_NUMBERS = 2048, 1 << 20
#: Dimensions read between two looks at the bounds.
STEP = 8
_LONG = (1 << 63) - 1


def _numbers(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, q: the rows that take part, one for each vec_id."""
    x = F.col("embedding")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("embedding"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v * SCALE) & (F.abs(v * SCALE) < float("inf")))
    named = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(whole)
    one = named.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    # floor() of a double would be a 64-bit number, and cut larger ones
    q = F.transform(x, lambda v: F.when(F.abs(v) < 1 << 52, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    return one.select("vec_id", label.cast("long").alias("label"), q.alias("q"))


def _columns(most: int, numbers: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (vec_id, label, q), sorted by length, as blocks of columns."""

    def block(rows: pa.Table, d: int) -> pa.RecordBatch:
        x = rows.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, d).T
        ids, labels = (rows.column(k).combine_chunks() for k in ("vec_id", "label"))
        whole = [pa.array([v], t) for v, t in ((d, pa.int32()), (ids.to_numpy().tobytes(), pa.binary()), (labels.to_numpy().tobytes(), pa.binary()), (np.unique(labels.to_numpy()).tolist(), pa.list_(pa.int64())), ([c.tobytes() for c in np.ascontiguousarray(x)], pa.list_(pa.binary())))]
        return pa.RecordBatch.from_arrays(whole, ["d", "ids", "labels", "kinds", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = defaultdict(list)
        for batch in batches:
            sizes = np.diff(batch.column("q").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                held[d].append(pa.Table.from_batches([batch.filter(pa.array(sizes == d))]))
                room = max(1, min(most, numbers // max(1, d)))
                if sum(t.num_rows for t in held[d]) >= room:
                    rows = pa.concat_tables(held.pop(d))
                    full = rows.num_rows // room * room
                    for at in range(0, full, room):
                        yield block(rows.slice(at, room), d)
                    if full < rows.num_rows:
                        held[d] = [rows.slice(full)]
            for d in [d for d in held if d != int(sizes[-1] if len(sizes) else -1)]:  # sorted: no more of these
                yield block(pa.concat_tables(held.pop(d)), d)
        for d, tables in held.items():
            yield block(pa.concat_tables(tables), d)

    return run


_BLOCK_SCHEMA = "d int, ids binary, labels binary, kinds array<long>, columns array<binary>"


class Block:
    """Vectors by dimension; the numbers are whole, held as doubles."""

    def __init__(self, d: int, ids: bytes, labels: bytes, columns: list[bytes]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.stack([np.frombuffer(c) for c in columns]) if d else np.zeros((0, len(self.ids)))
        self.least, self.most = self.columns.min(1), self.columns.max(1)
        self.size = np.maximum(np.abs(self.least), np.abs(self.most))

    @classmethod
    def of(cls, rows: Iterator[dict], most: int = BLOCK, numbers: int = BLOCK_NUMBERS) -> Iterator[Block]:
        """Blocks of these rows, small ones of one length as one: how many there are does not depend
        on how many tasks have made them."""
        held: list[dict] = []
        n = 0
        for row in rows:
            more = len(row["ids"]) // 8
            if held and (row["d"] != held[0]["d"] or n + more > most or (n + more) * row["d"] > numbers):
                yield cls._merged(held)
                held, n = [], 0
            held.append(row)
            n += more
        if held:
            yield cls._merged(held)

    @classmethod
    def _merged(cls, rows: list[dict]) -> Block:
        whole = lambda parts: b"".join(parts)
        return cls(rows[0]["d"], whole(r["ids"] for r in rows), whole(r["labels"] for r in rows), [whole(c) for c in zip(*(r["columns"] for r in rows))])


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, exact scores) of the candidates that stay. ``alive`` are the places
    to begin with; ``keep(places, lower, upper)`` says which may still matter."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    columns, a = block.columns, anchor
    if float(np.abs(a) @ block.size) >= 2.0**53:
        columns, a = columns.astype(object), a.astype(object)  # whole numbers of any size
        for v in (columns, a):
            v.flat[:] = [int(x) for x in v.flat]
        ends = np.stack([columns.min(1), columns.max(1)]) * a if columns.size else np.zeros((2, len(a)), object)
    else:
        ends = np.stack([block.least, block.most]) * a
    low, high = ends.min(0)[order], ends.max(0)[order]
    low_left, high_left = (np.concatenate([np.cumsum(v[::-1])[::-1], [0]]) for v in (low, high))
    score = np.zeros(len(alive), columns.dtype)
    for at in range(0, len(order), step):
        dims = order[at : at + step]
        part = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
        score = score + a[dims] @ part
        end = at + len(dims)
        stay = keep(alive, _held(score + low_left[end]), _held(score + high_left[end]))
        if not stay.all():
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
    return alive, _held(score)


def _held(scores: np.ndarray) -> np.ndarray:
    """Whole numbers within 64 bits; only those that are no doubles can be beyond."""
    return np.clip(scores, -_LONG, _LONG) if scores.dtype == object and len(scores) else scores


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else None


class Best:
    """The best ``most`` (score, vec_id) so far, higher scores and then smaller ids first."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    @property
    def bar(self):
        return self.rows[-1][0] if len(self.rows) == self.most else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.bar is not None:
            good = scores >= self.bar
            scores, ids = scores[good], ids[good]
        if len(ids):
            order = np.lexsort((ids, -scores))[: self.most] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.most]
            self.rows = sorted([*self.rows, *((int(scores[i]), int(ids[i])) for i in order)], key=lambda r: (-r[0], r[1]))[: self.most]


def _batch(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*found) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _find_positives(anchors: dict[int, list[tuple[int, int, np.ndarray]]], most: int):
    """``anchors``: (vec_id, label, numbers) by length. Best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for block in Block.of(row for batch in batches for row in batch.to_pylist()):
            of_kind = {k: np.flatnonzero(block.labels == k) for k in np.unique(block.labels).tolist()}
            for vec_id, label, a in anchors.get(len(block.columns), ()):
                alive = of_kind.get(label)
                if alive is None:
                    continue
                alive = alive[block.ids[alive] != vec_id]
                top = best.setdefault(vec_id, Best(most))

                def keep(places, lower, upper, top=top):
                    bars = [b for b in (top.bar, _kth(lower, most)) if b is not None]
                    return upper >= max(bars) if bars else np.ones(len(places), bool)

                places, scores = scan(block, a, alive, keep)
                top.add(scores, block.ids[places])
        rows = [(a, s, i) for a, top in best.items() for s, i in top.rows]
        yield _batch(rows, ["anchor_id", "score", "vec_id"], [pa.int64()] * 3)

    return run


def _find_negatives(anchors: dict[int, list[tuple[int, int, np.ndarray]]], windows: dict[int, list[tuple[int, int, int]]], most: int):
    """``windows``: (positive, least score, largest score) by anchor. Best rows of other labels in
    each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        for block in Block.of(row for batch in batches for row in batch.to_pylist()):
            not_kind = {k: np.flatnonzero(block.labels != k) for k in np.unique(block.labels).tolist()}
            every = np.arange(len(block.ids))
            for vec_id, label, a in anchors.get(len(block.columns), ()):
                wanted = windows.get(vec_id)
                alive = not_kind.get(label, every)
                if not wanted or not len(alive):
                    continue
                tops = [best.setdefault((vec_id, positive), Best(most)) for positive, _, _ in wanted]

                def keep(places, lower, upper, wanted=wanted, tops=tops):
                    stay = np.zeros(len(places), bool)
                    for (_, least, largest), top in zip(wanted, tops):
                        sure = lower[(lower >= least) & (upper <= largest)]
                        bars = [b for b in (least, top.bar, _kth(sure, most)) if b is not None]
                        stay |= (upper >= max(bars)) & (lower <= largest)
                    return stay

                places, scores = scan(block, a, alive, keep)
                for (_, least, largest), top in zip(wanted, tops):
                    inside = (scores >= least) & (scores <= largest)
                    top.add(scores[inside], block.ids[places[inside]])
        rows = [(a, p, s, i) for (a, p), top in best.items() for s, i in top.rows]
        yield _batch(rows, ["anchor_id", "positive_id", "score", "vec_id"], [pa.int64()] * 4)

    return run


def _top(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", turn).where(F.col("rank") <= most)


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Scores n with least * score <= 100 * n <= most * score; empty for negative ones."""
    return -(-least * score // 100), most * score // 100


def mine(vectors: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, chunk: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``label`` is the
    label to compare by, ``anchor`` says which rows are anchors, both over vec_id and label."""
    label = F.col("label") if label is None else label
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    rows = materialize(_numbers(vectors, label), "numbers")
    # rows of a label lie together, in as many blocks as they fill
    near = rows.withColumn("d", F.size("q")).repartitionByRange("d", "label", "vec_id").sortWithinPartitions("d", "label", "vec_id").drop("d")
    blocks = materialize(near.mapInArrow(tidy(_columns(block, BLOCK_NUMBERS)), _BLOCK_SCHEMA), "blocks")
    asked = rows.where(anchor).withColumn("d", F.size("q")).repartitionByRange("d", "vec_id").sortWithinPartitions("d", "vec_id").drop("d")
    chunks = materialize(asked.mapInArrow(tidy(_columns(chunk, ANCHOR_NUMBERS)), _BLOCK_SCHEMA), "anchors")
    best, found = [], []
    # a chunk is bounded, whatever the table: the driver holds one at a time
    for part in Block.of((row.asDict() for row in chunks.toLocalIterator()), chunk, ANCHOR_NUMBERS):
        d = len(part.columns)
        anchors = {d: list(zip(part.ids.tolist(), part.labels.tolist(), np.ascontiguousarray(part.columns.T)))}
        own = blocks.where(F.col("d") == d)
        mates = own.where(F.arrays_overlap("kinds", F.array(*(F.lit(k) for k in np.unique(part.labels).tolist()))))
        top = _top(mates.mapInArrow(tidy(_find_positives(anchors, positives)), "anchor_id long, score long, vec_id long"), ["anchor_id"], positives)
        best.append(materialize(top.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives"))
        windows = defaultdict(list)
        for a, p, s in best[-1].collect():  # positives of one chunk
            windows[a].append((p, *window(s)))
        rest = own.mapInArrow(tidy(_find_negatives(anchors, dict(windows), negatives)), "anchor_id long, positive_id long, score long, vec_id long")
        top = _top(rest, ["anchor_id", "positive_id"], negatives)
        found.append(materialize(top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not found:
        return rows.select(*(F.lit(None).cast("int" if n == "rank" else "long").alias(n) for n in names)).limit(0)
    out = [n.join(p, ["anchor_id", "positive_id"]).select(*names) for p, n in zip(best, found)]
    while len(out) > 1:  # a balanced union, however many chunks
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + ([out[-1]] if len(out) % 2 else [])
    return out[0]
