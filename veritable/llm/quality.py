"""Operator 4. Quality scores from random-indexing word vectors and a small network.

Each word kind (hashed into ``BUCKETS``) has a sparse random index vector. Its word vector is
the sum of the index vectors of the words beside it, over every text of the corpus. A
document pools its words' unit vectors (mean and spread), nothing else; a two-layer network in
numpy turns that into a probability, calibrated by a temperature fitted on labelled rows that
the network was not trained on.

Word vectors cover all documents. The network is fitted on at most ``FIT_ROWS`` labelled
rows, chosen by a hash of doc_id; that bound is the only sample. Null and empty texts pool to
the zero vector and get the network's score for it. Without labels of both kinds every score
is the share of label 1 (0.5 without any label). Repeated label rows: the largest label
counts. Of documents that share a doc_id the smallest text teaches. Rows with a null doc_id are
scored like any other, never learned from, and ``held_out`` is null there. A long text
is a slice of its own; the memory beside it does not grow with the number of texts. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import held_out, text_bytes, text_slices, tidy
from veritable.llm.words import shaped_words

BUCKETS, DIMS, SLOTS = 1 << 13, 32, 2
FIT_ROWS = 20_000
SEED = 977
_SLICE = 1 << 19
#: Texts counted at once: a count matrix has at most ``_ROWS`` x ``BUCKETS`` entries.
_ROWS = 256


def _index_vectors(buckets: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, dims, (SLOTS, buckets)), rng.integers(0, 2, (SLOTS, buckets)) * 2.0 - 1


def word_vectors(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """(buckets, dims) sums of neighbours' index vectors over all texts. Each task sends its
    own sums; their size is buckets x dims, whatever the corpus."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors(buckets, dims)
        total = np.zeros(buckets * dims)
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                h, owner = shaped_words(*text_bytes(part.column("text")))
                b = (h % np.uint64(buckets)).astype(np.int64)
                for step in (1, 2):
                    same = np.flatnonzero(owner[step:] == owner[:-step])
                    left, right = b[same], b[same + step]
                    for k in range(SLOTS):
                        total += np.bincount(left * dims + place[k][right], sign[k][right], buckets * dims)
                        total += np.bincount(right * dims + place[k][left], sign[k][left], buckets * dims)
        rows = total.reshape(buckets, dims)
        used = np.flatnonzero(np.abs(rows).sum(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[used, d].astype(np.float32)) for d in range(dims))], ["bucket", *(f"d{d}" for d in range(dims))])

    names = [f"d{d}" for d in range(dims)]
    sums = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(tidy(gather), "bucket int, " + ", ".join(f"{n} float" for n in names))
    out = np.zeros((buckets, dims))
    for r in sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas().itertuples(index=False):
        out[r[0]] = r[1:]
    out -= out.sum(0) / max(1, np.count_nonzero(np.abs(out).sum(1)))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text: mean and spread of its words' vectors."""
    n, (buckets, dims) = len(column), vectors.shape
    h, owner = shaped_words(*text_bytes(column))
    b = (h % np.uint64(buckets)).astype(np.int32)
    out = np.zeros((n, 2 * dims), np.float32)
    both = np.concatenate([vectors, vectors * vectors], 1)
    edges = np.searchsorted(owner, np.arange(0, n + _ROWS, _ROWS))
    for at, i, j in zip(range(0, n, _ROWS), edges[:-1].tolist(), edges[1:].tolist()):
        rows = min(_ROWS, n - at)
        counts = np.bincount((owner[i:j] - at) * buckets + b[i:j], minlength=rows * buckets).astype(np.float32).reshape(rows, buckets)
        sums = counts @ both / np.maximum(counts.sum(1), 1)[:, None]
        out[at : at + rows, :dims] = sums[:, :dims]
        out[at : at + rows, dims:] = np.sqrt(np.maximum(sums[:, dims:] - sums[:, :dims] ** 2, 0))
    return out


class Network:
    """Two layers, trained with Adam on standardized features; a temperature on its logit."""

    def __init__(self, hidden: int = 32, epochs: int = 30, rate: float = 3e-3):
        self.hidden, self.epochs, self.rate = hidden, epochs, rate
        self.mean = self.scale = self.weights = None
        self.temperature, self.constant = 1.0, 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))

    @staticmethod
    def slopes(params: list, z: np.ndarray, t: np.ndarray, keep: float = 1e-4) -> list:
        """Of the mean cross-entropy and half ``keep`` times the squared weights, by each parameter."""
        a = np.tanh(z @ params[0] + params[1])
        d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - t) / len(t)
        back = d[:, None] * params[2] * (1 - a * a)
        return [z.T @ back + keep * params[0], back.sum(0), a.T @ d + keep * params[2], d.sum()]

    def fit(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Network:
        """``calibrate`` marks the rows that only set the temperature."""
        self.constant = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or y.min() == y.max():
            return self
        train = ~calibrate if 0 < calibrate.sum() < len(y) else np.ones(len(y), bool)
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z, t = (x[train] - self.mean) / self.scale, y[train].astype(np.float64)
        params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))]
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(self.epochs):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 256):
                rows = order[at : at + 256]
                grads, step = self.slopes(params, z[rows], t[rows]), step + 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = params
        if calibrate.any():
            logit, t = self.logits(x[calibrate]), y[calibrate]

            def loss(temp: float) -> float:
                s = np.clip(logit / temp, -30, 30)
                return float(np.mean(np.logaddexp(0, s) - t * s))

            self.temperature = min(np.geomspace(0.25, 8, 81).tolist(), key=loss)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on labelled rows that are not held out."""
    vectors = word_vectors(docs)
    known = labels.where(~held_out() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # FIT_ROWS pairs of numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # one row for each id, however often it is repeated
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                x = pool(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    sample = rows.mapInArrow(tidy(features), "doc_id long, y int, x array<float>").toPandas().sort_values("doc_id")
    if sample.empty:
        return vectors, Network()
    x = np.stack(sample["x"].to_list()).astype(np.float64)
    ids = sample["doc_id"].to_numpy().astype(np.uint64)
    calibrate = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(5) == 0
    return vectors, Network().fit(x, sample["y"].to_numpy(), calibrate)


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, held_out, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                s = network.score(pool(part.column("text"), vectors))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double")
