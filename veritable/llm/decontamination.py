"""Operator 1. Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of ``BLOCK`` words, and passages are runs of 2 to 12 blocks. Items are
cut into pieces of at most ``PIECE`` words, and their answer is a piece of its own. A piece is
compared with passages a quarter longer than itself, which begin at every third of their length
or less (of the shortest, every half).

1. TF-IDF. A block's vector keeps the words of the benchmark (hashed into ``FEATURES``), all with
   a positive weight: a leak in most documents makes its own words common.
2. Randomised SVD of the matrix A whose rows are the unit TF-IDF passages of the corpus and, with
   as much weight, those of the benchmark. Each task sends Y = A'(A R) for its rows and a shared
   random R of ``RANK`` + ``EXTRA`` columns; the sum and R'Y give the truncated decomposition
   (one pass, as A'A has no negative eigenvalue). The ``RANK`` largest singular values stay.
3. Retrieval. Passages and pieces are folded into the latent space, each direction divided by
   its singular value s, damped to sqrt(s^2 + ``DAMP`` mean s^2), so that neither common words nor an
   item that leaked often outweigh or lose their direction; a cosine of ``COSINE`` or more makes
   a candidate. Nothing else does.
4. Check. The candidate's surroundings are compared with the whole item, word by word, by the
   longest common subsequence (bit-parallel steps) with stretches of half again the item's
   length, from every word on that can matter. Surroundings that lack too many of the item's
   words, told by bit sets, are spared that. A document is contaminated if an item's share in
   common is ``SHARE`` or more, or ``LOOSE`` or more with its answer (the last ``ANSWER`` words)
   in common to ``SHARE``.

Words are runs of letters and digits, A-Z lower-cased. Null and empty texts are clean; a row with
null doc_id is judged like any other. A long text is cut into passages like any other; its slice
is as long as itself. Items of fewer than ``LEAST`` words are too short for a share: they count
only if all their words stand together, and not at all under ``SHORTEST`` words. Null and empty
items are ignored, repeated ones count once (by the smallest item_id). With no usable item
everything is clean. A benchmark of more than ``MOST_ITEMS`` items or ``MOST_WORDS`` words is
taken in blocks of that size, one after another. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import SLICE_BYTES, packed, text_bytes, text_slices, tidy, unpacked
from veritable.llm.words import plain_words

BLOCK, PIECE, FEATURES, RANK, EXTRA = 8, 64, 1 << 13, 128, 16
#: Passage lengths and how far apart passages begin, in blocks.
SCALES, STRIDES = (2, 3, 4, 6, 8, 12), (1, 1, 1, 2, 2, 3)
COSINE, DAMP = 0.35, 4.0
SHARE, LOOSE, ANSWER, LEAST, SHORTEST = 0.75, 0.6, 8, 8, 3
MOST_ITEMS, MOST_WORDS = 20_000, 2_000_000
SEED = 271
_SLICE = SLICE_BYTES // 8
#: Blocks of a row of the decomposed matrix; rows and pieces handled at once; candidates held.
_ROW, _TILE, _HELD = 4, 2048, 1 << 18
#: Features that a matrix product handles in the randomised SVD; the others go one by one.
_OFTEN = 256


class _Benchmark:
    """The items' words, and the pieces by which they are sought."""

    def __init__(self, texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        h, owner = plain_words(data, offsets)
        every = np.split(h, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if texts else []
        self.which = [i for i, w in enumerate(every) if len(w) >= LEAST]
        self.items = [every[i] for i in self.which]
        self.short = {n: self._joined([i for i, w in enumerate(every) if len(w) == n], every) for n in range(SHORTEST, LEAST)}
        self.known = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        # by upper 16 bits: how many words have them, which answers for most words of a corpus,
        # and the first of these
        self.alike = np.bincount((self.known >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        self.first = np.cumsum(self.alike) - self.alike
        self.seen: dict[int, tuple[_Item, _Item]] = {}
        self.total = np.array([len(w) for w in self.items], np.int64)
        words = np.concatenate([*self.items, np.zeros(0, np.uint64)])
        self.sets = _bit_sets(np.repeat(np.arange(len(self.items)), self.total), (words % np.uint64(FEATURES)).astype(np.int64), len(self.items))
        pieces = [(j, a, b - a) for j, w in enumerate(self.items) for a, b in _cuts(len(w))]
        self.item, self.begin, self.size = np.array(pieces, np.int64).reshape(-1, 3).T
        self.scale = np.minimum(np.searchsorted(np.array(SCALES) * BLOCK, 1.25 * self.size), len(SCALES) - 1)

    @staticmethod
    def _joined(which: list[int], every: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of short items' words together, sorted, and which items they are."""
        h = np.array([_together(every[i], len(every[i]))[0] for i in which], np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], np.array(which, np.int64)[order]

    def bits(self, j: int) -> tuple[_Item, _Item]:
        """Item ``j`` and its answer."""
        if j not in self.seen:
            self.seen[j] = _Item(self.items[j]), _Item(self.items[j][-ANSWER:])
        return self.seen[j]

    def features(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of benchmark words, and their features."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        upper = (h >> np.uint64(48)).astype(np.int64)
        at = np.flatnonzero(self.alike.take(upper))
        some, first = h.take(at), self.first.take(upper.take(at))
        same = np.zeros(len(at), bool)
        for k in range(int(self.alike.max())):
            same |= self.known.take(first + k, mode="clip") == some
        at = at[same]
        return at, (some[same] % np.uint64(FEATURES)).astype(np.int64)

    def rows(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' unit TF-IDF vectors as (piece, feature, value)."""
        words = np.concatenate([self.items[j][b : b + n] for j, b, n in zip(self.item, self.begin, self.size)])
        piece = np.repeat(np.arange(len(self.item)), self.size)
        keys, count = np.unique(piece * FEATURES + (words % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
        row, feature = keys // FEATURES, keys % FEATURES
        return row, feature, _unit(row, weight[feature] * count, len(self.item))


def _cuts(n: int) -> list[tuple[int, int]]:
    """Pieces of an item of n words, and its answer."""
    edges = np.linspace(0, n, -(-n // PIECE) + 1).astype(int).tolist()
    return [*zip(edges[:-1], edges[1:]), *([(n - ANSWER, n)] if n > 2 * ANSWER else [])]


def _together(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _unit(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The values of a sparse matrix with its rows scaled to length one."""
    return (value / np.sqrt(np.maximum(np.bincount(row, value * value, n), 1e-30))[row]).astype(np.float32)


class _Blocks:
    """Sparse counts of benchmark words in the blocks of a slice's texts."""

    def __init__(self, column: pa.Array, bench: _Benchmark, block: int = BLOCK):
        self.h, owner = plain_words(*text_bytes(column))
        words = np.bincount(owner, minlength=len(column))
        self.starts = np.concatenate([[0], np.cumsum(words)])
        blocks = -(-words // block)
        first = np.cumsum(blocks) - blocks
        self.owner = np.repeat(np.arange(len(words)), blocks)
        self.first, self.last = first[self.owner], (first + blocks)[self.owner]
        self.begin = self.starts[self.owner] + (np.arange(len(self.owner)) - self.first) * block
        at, f = bench.features(self.h)
        key, self.count = np.unique((first[owner[at]] + (at - self.starts[owner[at]]) // block) * FEATURES + f, return_counts=True)
        self.block, self.feature = key // FEATURES, key % FEATURES


def _back(rows: np.ndarray, feature: np.ndarray, value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A' times rows: features present, and their sums."""
    order = np.argsort(feature, kind="stable")
    found, place = np.unique(feature[order], return_inverse=True)
    return found, _times(place, row[order], value[order], rows, len(found))


def _times(row: np.ndarray, feature: np.ndarray, value: np.ndarray | None, m: np.ndarray, n: int) -> np.ndarray:
    """A times m for the sparse rows A, sorted by row (ones without ``value``): the k-th entries
    of all rows at once, the rows with most entries first."""
    size = np.bincount(row, minlength=n)
    start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    start, size, m = start[order], size[order], np.ascontiguousarray(m)
    out = np.zeros((n, m.shape[1]), np.float32)
    for k in range(int(size[0]) if n else 0):
        at = start[: np.searchsorted(-size, -k)] + k
        for i in range(0, len(at), 1024):
            more = m.take(feature.take(at[i : i + 1024]), axis=0)
            if value is not None:
                more *= value.take(at[i : i + 1024])[:, None]
            out[i : i + len(more)] += more
    back = np.empty_like(out)
    back[order] = out
    return back


def _gather(total: np.ndarray, p: _Blocks, weight: np.ndarray, start: np.ndarray, often: np.ndarray) -> None:
    """Add A'(A start) to ``total`` for the blocks' unit TF-IDF rows A. The features
    ``often`` go through dense products, the others one by one."""
    column = np.full(FEATURES, -1)
    column[often] = np.arange(len(often))
    for k in range(0, len(p.owner), _TILE):
        i, j = np.searchsorted(p.block, [k, k + _TILE])
        if i == j:
            continue
        block, feature = p.block[i:j] - k, p.feature[i:j]
        value = _unit(block, weight[feature] * p.count[i:j], int(block[-1]) + 1)
        dense = column[feature] >= 0
        x = np.zeros((int(block[-1]) + 1, len(often)), np.float32)
        x[block[dense], column[feature[dense]]] = value[dense]
        rows = x @ start[often]
        block, feature, value = block[~dense], feature[~dense], value[~dense]
        if len(block):
            rows += _times(block, feature, value, start, len(rows))
            f, sums = _back(rows, feature, value, block)
            total[f] += sums
        total[often] += x.T @ rows


class _Item:
    """An item's words as bits."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, one machine word of bits at a time."""
        full = v = (1 << self.n) - 1
        get = self.masks.get
        for w in words:
            if (m := get(w)) and (u := v & m):
                v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count()


def _document_frequency(docs: DataFrame, bench: _Benchmark) -> tuple[np.ndarray, int]:
    """Rows of the matrix that hold each feature, and rows in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                p = _Blocks(part.column("text"), bench, _ROW * BLOCK)
                df[:FEATURES] += np.bincount(p.feature, minlength=FEATURES)
                df[FEATURES] += len(p.owner)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], ["f", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(tidy(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # FEATURES rows
        out[r["f"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def truncated(y: np.ndarray, start: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest singular values of A and its right singular vectors, from
    y = A'A start."""
    shift = 1e-7 * np.linalg.norm(y)
    y = y + shift * start
    core = start.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * values[-1]
    left, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    square = s * s - shift
    keep = np.flatnonzero(square > 1e-6 * square[0])[:rank]
    return np.sqrt(square[keep]), left[:, keep]


def _space(docs: DataFrame, bench: _Benchmark, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What folds a vector of counts into the latent space (FEATURES, rank), and the pieces' unit
    latent vectors."""
    names = [f"d{k}" for k in range(RANK + EXTRA)]
    often = np.argsort(weight, kind="stable")[:_OFTEN]
    start = np.random.default_rng(SEED).standard_normal((FEATURES, len(names))).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, len(names)))
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                _gather(total, _Blocks(part.column("text"), bench, _ROW * BLOCK), weight, start, often)
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, k].astype(np.float32)) for k in range(len(names)))], ["f", *names])

    y = np.zeros((FEATURES, len(names)))
    sums = docs.select("text").mapInArrow(tidy(run), "f int, " + ", ".join(f"{n} float" for n in names)).groupBy("f").agg(*(F.sum(n).alias(n) for n in names))
    for r in sums.toPandas().itertuples(index=False):  # FEATURES rows at most
        y[r[0]] = r[1:]
    row, feature, value = bench.rows(weight)
    own = np.zeros_like(y)
    found, back = _back(_times(row, feature, value, start, len(bench.item)), feature, value, row)
    own[found] = back
    sizes, vectors = truncated(y + max(np.linalg.norm(y) / max(np.linalg.norm(own), 1e-30), 1.0) * own, start.astype(np.float64), RANK)
    fold = (vectors / np.sqrt(sizes**2 + DAMP * np.mean(sizes**2))).astype(np.float32)
    latent = _times(row, feature, value, fold, len(bench.item))
    return weight[:, None].astype(np.float32) * fold, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)


def _candidates(p: _Blocks, bench: _Benchmark, fold: np.ndarray, latent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first block, end block, piece, cosine) of passages near a piece."""
    if not len(p.block):
        return
    at = np.arange(len(p.owner))

    def joined(x: np.ndarray, more: np.ndarray, step: int) -> np.ndarray:
        """Passages x, each with the one of ``more`` that begins ``step`` blocks later in its text."""
        out = x.copy()
        out[:-step] += more[step:]
        ends = np.flatnonzero(at + step >= p.last)
        out[ends] = x[ends]
        return out

    one = _times(np.repeat(p.block, p.count), np.repeat(p.feature, p.count), None, fold, len(p.owner))
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    eight = joined(four, four, 4)
    sums = {2: lambda: two, 3: lambda: joined(two, one, 2), 4: lambda: four, 6: lambda: joined(four, two, 4), 8: lambda: eight, 12: lambda: joined(eight, four, 8)}
    for scale, (blocks, stride) in enumerate(zip(SCALES, STRIDES)):
        pieces = np.flatnonzero(bench.scale == scale)
        if not len(pieces):
            continue
        a = at[(at - p.first) % stride == 0]
        b = np.minimum(a + blocks, p.last[a])
        passages = sums[blocks]()
        for i in range(0, len(a), _TILE):
            x = passages.take(a[i : i + _TILE], axis=0) if stride > 1 else passages[i : i + _TILE]
            size = np.sqrt(np.einsum("ij,ij->i", x, x))
            least = np.where(size > 0, np.float32(COSINE) * size, np.float32(np.inf))[:, None]
            for k in range(0, len(pieces), _TILE):
                product = x @ latent[pieces[k : k + _TILE]].T
                near = np.flatnonzero(product >= least)
                if len(near):
                    r, c = np.divmod(near, product.shape[1])
                    near = product.ravel()[near] / size[r]
                    r += i
                    yield a[r], b[r], pieces[k + c], near


class _Sets:
    """Which words the blocks hold, as sets of 256 bits; a run's set is the union of two runs of
    a power of two blocks."""

    def __init__(self, p: _Blocks, levels: int = 6):
        self.levels = [_bit_sets(p.block, p.feature, len(p.owner))]
        for k in range(levels):
            last = self.levels[-1]
            self.levels.append(last.copy())
            self.levels[-1][: -(1 << k)] |= last[1 << k :]

    def lacks(self, a: np.ndarray, b: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """How many bits of ``sets`` blocks a to b do not hold; 0 for runs beyond the levels."""
        out = np.zeros(len(a), np.int64)
        level = np.floor(np.log2(np.maximum(b - a, 1))).astype(np.int64)
        for k, table in enumerate(self.levels):
            at = np.flatnonzero((level == k) & (b > a))
            out[at] = np.bitwise_count(sets[at] & ~(table[a[at]] | table[b[at] - (1 << k)])).sum(1)
        return out


def _bit_sets(row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    bits = np.zeros((n, 256), bool)
    bits[row, feature % 256] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _regions(p: _Blocks, sets: _Sets, bench: _Benchmark, found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, end word, cosine) where a whole item may lie around its pieces'
    candidates; those that overlap are one."""
    a, b, piece, cosine = (np.concatenate(x) for x in zip(*found))
    item, before, size = bench.item[piece], bench.begin[piece], bench.size[piece]
    total, text = bench.total[item], p.owner[a]
    lo = np.maximum(p.begin[a] - before - before // 2 - size // 2, p.starts[text])
    hi = np.minimum(p.begin[a] + (b - a) * BLOCK + (total - before - size) * 3 // 2 + size // 2 + 1, p.starts[text + 1])
    first = p.first[a] + (lo - p.starts[text]) // BLOCK
    some = total - sets.lacks(first, p.first[a] + -(-(hi - p.starts[text]) // BLOCK), bench.sets[item]) >= LOOSE * total - 1e-9
    text, item, lo, hi, cosine = (x[some] for x in (text, item, lo, hi, cosine))
    group = text * len(bench.items) + item
    order = np.lexsort((lo, group))
    group, lo, hi, cosine = group[order].tolist(), lo[order].tolist(), hi[order].tolist(), cosine[order].tolist()
    k = 0
    while k < len(group):
        end, best, j = hi[k], cosine[k], k + 1
        while j < len(group) and group[j] == group[k] and lo[j] <= end:
            end, best, j = max(end, hi[j]), max(best, cosine[j]), j + 1
        yield group[k] // len(bench.items), group[k] % len(bench.items), lo[k], end, best
        k = j


def _verdict(item: _Item, tail: _Item, words: list[int]) -> tuple[bool, float]:
    """Whether a stretch of ``words``, half again as long as the item, is a leak, and the best
    share of the item in common. A share below ``LOOSE`` is that of all ``words``."""
    got, enough = item.common(words), int(np.ceil(LOOSE * item.n - 1e-9))
    if got < enough:
        return False, got / item.n
    reach, top, leak, a = item.n + item.n // 2, 0, False, 0
    while a < len(words) and top < item.n:
        if words[a] not in item.masks:
            a += 1
            continue
        stretch = words[a : a + reach]
        got = item.common(stretch)
        top = max(top, got)
        leak = leak or got / item.n >= SHARE or (got >= enough and tail.common(stretch) >= SHARE * tail.n)
        # a stretch that begins d words later has at most d more in common
        a += max(1, (top + 1 if leak else min(top + 1, enough)) - got)
    return leak, top / item.n


def _best(part: pa.RecordBatch, bench: _Benchmark, fold: np.ndarray, latent: np.ndarray) -> dict[int, tuple[bool, float, int, float]]:
    """By row: leak, share, item and cosine of the best match."""
    best: dict[int, tuple[bool, float, int, float]] = {}

    def take(text: int, leak: bool, share: float, item: int, cosine: float) -> None:
        now = best.get(text)
        if now is None or (leak, share, -item) > (now[0], now[1], -now[2]):
            best[text] = (leak, share, item, cosine)

    p = _Blocks(part.column("text"), bench)
    found: list[tuple[np.ndarray, ...]] = []
    sets = _Sets(p)

    def check() -> None:
        for text, j, start, end, cosine in _regions(p, sets, bench, found) if found else ():
            item, tail = bench.bits(j)
            take(text, *_verdict(item, tail, p.h[start:end].tolist()), bench.which[j], cosine)
        found.clear()

    for some in _candidates(p, bench, fold, latent) if bench.items else ():
        found.append(some)
        if sum(len(x[0]) for x in found) > _HELD:
            check()
    check()
    for n, (hashes, which) in bench.short.items():
        if len(hashes):
            h = _together(p.h, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for k in np.flatnonzero(hashes[at] == h).tolist():
                text = int(np.searchsorted(p.starts, k, "right")) - 1
                if k + n <= p.starts[text + 1]:
                    take(text, True, 1.0, int(which[at[k]]), 1.0)
    return best


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    """The distinct items in order of item_id, as many at once as the bounds allow."""
    ids, texts, words = [], [], 0
    chosen = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    for r in chosen.orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == MOST_ITEMS or words + len(r["text"]) // 4 > MOST_WORDS):
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        words += len(r["text"]) // 4
    if ids:
        yield ids, texts


_FIELDS = ["doc_id", "text", "contaminated", "item_id", "share", "cosine"]


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id, share and cosine of its best match
    (null, 0 and 0 without a candidate). With ``carry``, a struct that comes along as ``carried``,
    the text stays too, so that rows need not be joined back by their ids."""
    along = [] if carry is None else [carry.alias("carried")]
    rows = docs.select(*along, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.select("*", F.lit(False).alias("contaminated"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("share"), F.lit(0.0).alias("cosine"))
    blocks = _benchmark_blocks(benchmark)
    block = next(blocks, None)
    while block:
        (ids, texts), block = block, next(blocks, None)
        bench = _Benchmark(texts)
        fold, latent = np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32)
        if bench.items:
            df, total = _document_frequency(rows, bench)
            weight = 1.0 + np.log((1.0 + total) / (1.0 + df))
            fold, latent = _space(rows, bench, weight)
        kept = [c for c in out.columns if block or along or c != "text"]  # the texts go on to the next block
        schema = out.select(*kept).schema
        out = out.mapInArrow(tidy(_search(bench, ids, fold, latent, kept)), schema)
    return out if along else out.drop("text")


def _search(bench: _Benchmark, ids: list[int | None], fold: np.ndarray, latent: np.ndarray, kept: list[str]):
    """Adds a block of items to what the blocks before it found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                rows = [list(x) for x in zip(*(part.column(c).to_pylist() for c in _FIELDS[2:]))]
                for i, (leak, share, item, cosine) in _best(part, bench, fold, latent).items():
                    if rows[i][1] is None or (leak, share) > (rows[i][0], rows[i][2]):
                        rows[i] = [leak, ids[item], share, cosine]
                found = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept[:-4]), *found], kept)

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns. Each row is judged by its own
    text, whatever its doc_id is and whichever others share it."""
    others = [c for c in docs.columns if c != "text"]
    rows = find(docs, benchmark, carry=packed(others)).where("not contaminated")
    restored = dict(zip(others, unpacked(others))) | {"text": F.col("text")}
    return rows.select(*(restored[c] for c in docs.columns))
