"""Operator 10. Repeated byte strings by a depth-limited radix sort.

Wanted: every string of ``length`` bytes (100) that also starts earlier in the corpus. To
sort all suffixes would shuffle each byte's suffix, so a sparse set of them is ordered: of
each window only the suffix at its anchor, the place of its smallest 32-byte hash (leftmost if
tied). Equal windows have equal anchors at equal places, and windows side by side mostly share
theirs, so one row stands for a run of some thirty windows. Rows are ordered by digits, most
significant first, and a group of one leaves after each pass:

1. The first digits are the 32 bytes at the anchor, eight a digit, as big-endian numbers: rows
   are range-partitioned and sorted by the bytes themselves.
2. The next digit stands for all bytes that the run's windows cover (a 64-bit hash). Rows that
   agree in it too are equal in every window, so all but the earliest are repeats as a whole.
   Earliest rows whose 32 bytes meet no other cover are done.
3. The rest (mostly the edges of repeated passages) go on to the full depth. Runs whose 32 bytes
   at most ``FEW`` share travel with the bytes they cover; where they meet, their windows are
   sorted by eight bytes at a time, most significant first, and what is alone leaves after
   each pass. Groups left at the full depth are exactly the repeated windows; all but the
   earliest of a group are repeats. Larger groups are split by what follows: their runs are
   spelled out before the shuffle and each window is dealt by its further digits, so that no
   common passage has to fit one task. There the digits are two hashes of 64 bits, of the 32
   bytes and of the window. ``FEW`` decides where windows are compared, not which are equal.

A group that spans partitions goes to pass 3 at the seams. Before each shuffle a piece of text
settles its own repeats. Sorted rows are read as a stream; a task holds one row, or one group
of at most ``FEW`` runs.

A document is known by its doc_id and a tag, a 64-bit hash of its text (zero in a table whose
doc_ids are unique). Where doc_ids repeat, tags are checked first: if two texts of one id share a tag, another seed is taken, so no bytes
of one text are cut out of another. A document's list of runs is shorter than its text; copies of
a row are dealt by the join that brings lists and texts together, which adaptive execution splits
however many there are.

Null text counts as empty; texts under ``length`` bytes keep all. Rows that share doc_id and
text are one document: none repeats itself. Rows that share doc_id but not text are documents
of their own, in the order of their texts' checksums. Rows with null doc_id come before all
others in the same way. An empty table gives no rows. A long text is hashed in chunks. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritable.llm.common import materialize, text_bytes, text_slices, tidy

LENGTH, GRAM = 100, 32
#: A first digit that at most this many unsettled runs share is compared within one task.
FEW = 64
#: Marks, in a run's number of windows, one that its batch has found to be a repeat.
_FLAG = 128
#: Bytes hashed at once; a longer text is cut into overlapping chunks of this size.
CHUNK = 1 << 18
#: Bytes of text whose runs are held back together to settle repeats among them.
HELD = 1 << 22
#: The bytes at an anchor, as four digits.
_DIGITS = ["d0", "d1", "d2", "d3"]
_NULL_ID = -(1 << 63)

_rng = np.random.default_rng(31337)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), np.uint64)
_FACTORS = _rng.integers(1, 1 << 63, 5, np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 63, dtype=np.uint64)) | 1
_SIZE = CHUNK + 4 * LENGTH
with np.errstate(over="ignore"):
    _POWER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SIZE, _BASE, np.uint64))])
    _INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SIZE, pow(_BASE, -1, 1 << 64), np.uint64))])


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = _BYTES[0][data]
    with np.errstate(over="ignore"):
        for k, f in enumerate(_FACTORS):
            h = h[: -(1 << k)] * f + h[1 << k :]
    return _mix(h)


def _prefix(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[1][data] * _POWER[: len(data)], dtype=np.uint64)])


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((prefix[end] - prefix[start]) * _INVERSE[start] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest of ``width`` values (leftmost if tied)."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        size += step
    return place


def _chunks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each text, start of each text in the bytes and, for a cut text, where
    its chunk starts) as (data, rows, offsets, shift)."""
    row = 0
    for part in text_slices(batch, most=CHUNK):
        data, offsets = text_bytes(part.column("text"))
        if len(data) <= CHUNK:
            yield data, np.arange(row, row + part.num_rows), offsets, 0
        else:
            for at in range(0, len(data) - length + 1, CHUNK):
                piece = data[at : at + CHUNK + length - 1]
                yield piece, np.array([row]), np.array([0, len(piece)]), at
        row += part.num_rows


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor hashes, prefix hashes, and per run: text, first window, last window, anchor."""
    h = _gram_hashes(data)
    place = _leftmost_min(h, length - GRAM + 1)
    ok = np.zeros(len(place), bool)
    sizes = np.diff(offsets)
    for a, s in zip(offsets[:-1][sizes >= length].tolist(), sizes[sizes >= length].tolist()):
        ok[a : a + s - length + 1] = True
    windows = np.flatnonzero(ok)
    if not len(windows):
        return None
    anchor = place[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    lo, hi = windows[first], windows[last]
    return h, np.searchsorted(offsets, lo, "right") - 1, lo, hi, anchor[first]


def _first_of_kind(digits: list[np.ndarray], more: list[np.ndarray], doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by digits, document and place: the rows' order, and which of them repeat an earlier
    row of their kind. Rows that are that earlier row itself are left out. ``more``: digits that
    agree, but for chance, where those before do; compared, not sorted by."""
    order = np.lexsort((place, tag, doc, *digits[::-1]))
    seen = np.ones(len(order), bool)
    seen[:1] = False
    for digit in (*digits, *more):
        sorted_digit = digit[order]
        seen[1:] &= sorted_digit[1:] == sorted_digit[:-1]
    top = order[np.maximum.accumulate(np.where(seen, 0, np.arange(len(order))))]
    other = ~seen | (doc[order] != doc[top]) | (tag[order] != tag[top]) | (place[order] != place[top])
    return order[other], seen[other]


def _big_endian(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts like them."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    return (np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _mark_runs(length: int):
    """The runs of each batch's texts. A run whose digits the batch has seen earlier is a
    repeat already: it is flagged, and dealt by its place, so that a very common one does not
    meet in one task."""

    def flush(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, second, doc, tag, place, *bytes_at = map(np.concatenate, zip(*found))
        found.clear()
        # equal bytes have equal hashes: one digit to sort by, and the bytes to compare
        order, seen = _first_of_kind([anchor, second], bytes_at, doc, tag, place)
        doc, tag, place = doc[order], tag[order], place[order]
        dealt = _mix(place.view(np.uint64) ^ _mix((doc ^ tag).view(np.uint64))).view(np.int64)
        digits = [np.where(seen, dealt if k == 0 else 0, d[order]) for k, d in enumerate((*bytes_at, second))]
        return pa.RecordBatch.from_arrays([*map(pa.array, (*digits, doc, tag, np.where(seen, place | _FLAG, place)))], [*_DIGITS, "second", "key", "tag", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, found, held = batch.column("key").to_numpy(), batch.column("tag").to_numpy(), [], 0
            for data, rows, offsets, shift in _chunks(batch, length):
                if len(data) < length or (runs := _runs(data, offsets, length)) is None:
                    continue
                h, text, lo, hi, anchor = runs
                second = _span_hash(_prefix(data), lo, hi + length, (anchor - lo) * 256 + (hi - lo))
                place = lo - offsets[text] + shift
                found.append((h[anchor].view(np.int64), second.view(np.int64), ids[rows[text]], tags[rows[text]], place << 8 | (hi - lo + 1), *(_big_endian(data, anchor + 8 * k) for k in range(4))))
                held += len(data)
                if held >= HELD:
                    yield flush(found)
                    held = 0
            if found:
                yield flush(found)

    return run


_SCHEMA = "first long, key long, tag long, run long, settled boolean"


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by all digits, document and place. settled: the whole run is a repeat; not
    settled: the earliest of its kind, with other kinds under its first digits. From here on
    one number, ``first``, stands for the first digits."""
    kind = held = None  # digits and place of the kind that goes on; a row that waits for the next kind
    n = len(_DIGITS)

    def out(rows: np.ndarray, settled: bool) -> pa.RecordBatch:
        first = np.zeros(len(rows), np.uint64)
        for k in range(n):
            first = _mix(first ^ rows[:, k].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), *(pa.array(rows[:, k]) for k in range(n + 1, n + 4)), pa.array(np.full(len(rows), settled))], ["first", "key", "tag", "run", "settled"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(n + 4)], 1)
        flagged = rows[:, -1] & _FLAG > 0
        if flagged.any():
            yield out(np.concatenate([rows[flagged][:, :-1], rows[flagged][:, -1:] & ~_FLAG], 1), True)
            rows = rows[~flagged]
            if not len(rows):
                continue
        begin = kind is None
        before = np.concatenate([rows[:1] if begin else kind[None], rows[:-1]])
        new = (rows[:, : n + 1] != before[:, : n + 1]).any(1)
        new[0] |= begin
        own = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        top = np.where((own >= 0)[:, None], rows[np.maximum(own, 0)], rows[:1] if begin else kind[None])
        repeats = rows[~new & ((rows[:, n + 1 :] >> [0, 0, 8]) != (top[:, n + 1 :] >> [0, 0, 8])).any(1)]
        if len(repeats):
            yield out(repeats, True)
        kind = top[-1]
        reps = rows[new]
        if not len(reps):
            continue
        at_seam = begin
        if held is not None:
            reps = np.concatenate([held[0][None], reps])
        same = (reps[1:, :n] == reps[:-1, :n]).all(1)
        go = np.zeros(len(reps), bool)
        go[1:] |= same
        go[:-1] |= same
        go[0] |= at_seam or (held is not None and held[1])
        last_goes = bool(go[-1])
        sent = reps[:-1][go[:-1]]
        if len(sent):
            yield out(sent, False)
        held = (reps[-1], last_goes)
    if held is not None:
        yield out(held[0][None], False)


def _ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value for each stretch of the bytes."""
    edges = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - edges[:-1], size) + np.arange(edges[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])


def _as_runs(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(key, tag, run) of windows, those side by side in one run of up to 127."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    gap = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)
    own = np.concatenate([[True], gap | (place[1:] != place[:-1])])
    new = np.concatenate([[True], gap])[own]
    doc, tag, place = doc[own], tag[own], place[own]
    begin = np.flatnonzero(new)
    new |= (place - np.repeat(place[begin], np.diff(begin, append=len(doc)))) % 127 == 0
    begin = np.flatnonzero(new)
    return np.stack([doc[begin], tag[begin], place[begin] << 8 | np.diff(begin, append=len(doc))], 1)


def _windows_of(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's windows: their places, and the run of each."""
    edges = np.cumsum(n)
    return np.repeat(lo - (edges - n), n) + np.arange(int(edges[-1])), np.repeat(np.arange(len(n)), n)


def _spell(length: int):
    """The unsettled runs of each text. A run whose first digits few rows share is sent whole,
    with the bytes that it covers. One that many share is spelled into its windows; a window
    whose digits the batch has seen earlier is sent as a repeat (settled)."""
    names = ["first", "last", "key", "tag", "place", "settled", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            spelled: list[tuple[np.ndarray, ...]] = []
            lists = batch.column("runs")
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            run_of, first_of, few_of = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("run", "first", "few"))
            for data, rows, offsets, shift in _chunks(batch, length):
                if len(data) < length:
                    continue
                a, b = edges[rows[0]], edges[rows[-1] + 1]
                lo, n, first, few = run_of[a:b] >> 8, run_of[a:b] & 255, first_of[a:b], few_of[a:b]
                row = np.repeat(np.arange(len(rows)), np.diff(edges[rows[0] : rows[-1] + 2]))
                if len(rows) == 1:  # perhaps a chunk of a longer text
                    here = (lo >= shift) & (lo + n + length - 1 <= shift + len(data))
                    lo, n, first, few, row = lo[here], n[here], first[here], few[here], row[here]
                if not len(lo):
                    continue
                doc, tag, at = ids[rows[row]], tags[rows[row]], lo - shift + offsets[row]
                if few.any():
                    whole = _ragged(data, at[few], n[few] + length - 1)
                    zero = np.zeros(len(whole), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(first[few]), pa.array(zero), pa.array(doc[few]), pa.array(tag[few]), pa.array(lo[few] << 8 | n[few]), pa.array(zero > 0), whole], names)
                if not few.all():
                    many = ~few
                    p, of = _windows_of(at[many], n[many])
                    last = _span_hash(_prefix(data), p, p + length, np.zeros(1, np.int64)).view(np.int64)
                    spelled.append((first[many][of], last, doc[many][of], tag[many][of], p + (lo - at)[many][of]))
            if spelled:
                first, last, doc, tag, place = map(np.concatenate, zip(*spelled))
                order, seen = _first_of_kind([first, last], [], doc, tag, place)
                first, last, doc, tag, place = (v[order] for v in (first, last, doc, tag, place))
                # settled rows need no company: they are dealt by their place
                yield pa.RecordBatch.from_arrays([*map(pa.array, (np.where(seen, place, first), np.where(seen, doc ^ tag, last), doc, tag, place, seen)), pa.nulls(len(first), pa.binary())], names)

    return run


def _equal_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another one of their group in all ``length`` bytes, and the number of
    each one's class: a radix sort by eight bytes a pass, from the first byte on. What is
    alone in its class leaves after each pass."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    left = np.arange(len(start))
    for depth in [*range(0, length - 8, 8), length - 8]:
        if not len(left):
            break
        digit = np.ascontiguousarray(words[start[left] + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new[:-1])
        together = ~(new[:-1] & new[1:])
        left, group = left[together], group[together]
    return left, group


def _scan_windows(length: int):
    """Rows sorted by digits, key and place: the windows that are repeats, as runs."""

    def inside(rows: pa.RecordBatch) -> np.ndarray:
        """Repeats among whole runs; all runs of a first digit are here."""
        first, doc, tag, run = (rows.column(k).to_numpy() for k in ("first", "key", "tag", "place"))
        lo, n = run >> 8, run & 255
        data, offsets = text_bytes(rows.column("covered"))
        out = []
        step = max(1, CHUNK // (length + 255))
        new = np.concatenate([[True], first[1:] != first[:-1], [True]])
        number, edges = np.cumsum(new[:-1]), np.flatnonzero(new)
        at = 0
        while at < len(first):  # whole groups, some CHUNK bytes of them
            end = int(edges[max(np.searchsorted(edges, at + step, "right") - 1, np.searchsorted(edges, at, "right"))])
            piece = data[offsets[at] : offsets[end]]
            p, of = _windows_of(offsets[at:end] - offsets[at], n[at:end])
            place = p - (offsets[at:end] - offsets[at])[of] + lo[at:end][of]
            left, kind = _equal_windows(piece, p, number[at:end][of], length)
            d, t, w = doc[at:end][of][left], tag[at:end][of][left], place[left]
            order = np.lexsort((w, t, d, kind))
            d, t, w, kind = d[order], t[order], w[order], kind[order]
            top = np.maximum.accumulate(np.where(np.concatenate([[True], kind[1:] != kind[:-1]]), np.arange(len(kind)), 0)) if len(kind) else order
            repeat = (d != d[top]) | (t != t[top]) | (w != w[top])
            out.append(_as_runs(d[repeat], t[repeat], w[repeat]))
            at = end
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, waiting = None, None  # the kind of window that goes on; runs whose group may go on

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["key", "tag", "run"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.filter(batch.column("covered").is_valid())
            if whole.num_rows:
                if waiting is not None:
                    whole = pa.concat_batches([waiting, whole])
                first = whole.column("first").to_numpy()
                cut = int(np.searchsorted(first, first[-1]))
                waiting = whole.slice(cut)
                if cut:
                    yield out(inside(whole.slice(0, cut)))
            spelled = batch.filter(batch.column("covered").is_null())
            if not spelled.num_rows:
                continue
            rows = np.stack([spelled.column(i).to_numpy() for i in range(5)], 1)
            settled = spelled.column("settled").to_numpy(zero_copy_only=False)
            if settled.any():
                yield out(_as_runs(*rows[settled][:, 2:].T))
            rows = rows[~settled]
            if not len(rows):
                continue
            begin = kind is None
            before = np.concatenate([rows[:1] if begin else kind[None], rows[:-1]])
            same = (rows[:, :2] == before[:, :2]).all(1)
            same[0] &= not begin
            own = np.maximum.accumulate(np.where(~same, np.arange(len(rows)), -1))
            top = np.where((own >= 0)[:, None], rows[np.maximum(own, 0)], rows[:1] if begin else kind[None])
            found = rows[same & (rows[:, 2:] != top[:, 2:]).any(1)]
            kind = top[-1]
            if len(found):
                yield out(_as_runs(*found[:, 2:].T))
        if waiting is not None:
            yield out(inside(waiting))

    return run


def _cut(length: int, with_text: bool, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], [], []]
            for text, a, b in zip(batch.column("text").cast(pa.binary()), edges[:-1].tolist(), edges[1:].tolist()):
                raw = text.as_py() or b""
                removed = n_spans = 0
                kept = raw
                if b > a:
                    v = flat[a:b].astype(np.int64)
                    lo = v >> 8
                    edge = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(lo + (v & 255) + length - 1, minlength=len(raw) + 1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)):
                    column.append(value)
            arrays = [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(out[4], pa.string())], [*names, "kept_text"]
            if carried:
                arrays, names = [*arrays, batch.column("carried")], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _tag(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text)


def _seed(rows: DataFrame) -> int | None:
    """The first seed with which no two texts of one key share a tag; None if keys are unique, as
    they mostly are: then no text is read here."""
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return None
    for seed in range(64):
        text = F.col("text")
        marks = rows.select("key", _tag(text, seed).alias("tag"), F.struct(F.xxhash64(F.lit(-1), text), F.xxhash64(F.lit(-2), text)).alias("mark"))
        if marks.groupBy("key", "tag").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").isEmpty():
            return seed
    raise RuntimeError("texts of one doc_id share their tags under every seed")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, carry: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept_text
    (characters that lost a byte are dropped there). ``carry`` is a struct that comes along as
    ``carried``, which spares a join to get other columns back."""
    if not GRAM < length <= GRAM + 126:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 126}")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_NULL_ID)).alias("key"), text.alias("text"), *([carry.alias("carried")] if carry is not None else []))
    # where an id has one row there is nothing to tell apart, and every run carries its tag
    seed = _seed(rows)
    rows = rows.withColumn("tag", F.lit(0).cast("long") if seed is None else _tag(F.col("text"), seed))
    digits = [*_DIGITS, "second"]
    marked = rows.select("key", "tag", "text").mapInArrow(tidy(_mark_runs(length)), ", ".join(f"{d} long" for d in digits) + ", key long, tag long, run long")
    dealt = marked.repartitionByRange(*digits).sortWithinPartitions(*digits, "key", "tag", "run")
    scanned = materialize(dealt.mapInArrow(tidy(_scan_runs), _SCHEMA), "runs")
    reps = scanned.where("not settled").select("first", "key", "tag", "run")
    sizes = reps.groupBy("first").agg((F.count("*") <= FEW).alias("few"))
    edges = reps.join(sizes, "first").groupBy("key", "tag").agg(F.array_sort(F.collect_list(F.struct("run", "first", "few"))).alias("runs"))
    # both joins read the same columns of the texts, so one exchange of them serves both
    spelled = rows.join(edges, ["key", "tag"]).mapInArrow(tidy(_spell(length)), "first long, last long, key long, tag long, place long, settled boolean, covered binary")
    windows = spelled.repartition("first", "last").sortWithinPartitions("first", "last", "key", "tag", "place").mapInArrow(tidy(_scan_windows(length)), "key long, tag long, run long")
    spans = scanned.where("settled").select("key", "tag", "run").union(windows)
    gone = spans.groupBy("key", "tag").agg(F.collect_list("run").alias("spans"))
    fields = StructType()
    for name in ("doc_id", "n_bytes", "n_removed", "n_spans"):
        fields.add(name, "long")
    fields.add("kept_sha256", "string")
    if with_text:
        fields.add("kept_text", "string")
    if carry is not None:
        fields.add("carried", rows.schema["carried"].dataType)
    return rows.join(gone, ["key", "tag"], "left").mapInArrow(tidy(_cut(length, with_text, carry is not None)), fields)
