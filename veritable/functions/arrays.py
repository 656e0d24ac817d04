"""Expressions over arrays of numbers: frame choice, padding, normalizing, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.normalize import ColumnOrName, col


def frame_indices(n: ColumnOrName, k: int) -> Column:
    """All of n frames if there are at most k, else k of them, evenly spread from first to last."""
    if k < 2:
        return F.when(col(n) <= 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint")))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.expr("bigint(1)") * i * (col(n) - 1))
    even = F.transform(spread, lambda x: F.floor(x / (k - 1)).cast("bigint"))
    every = F.when(col(n) <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), col(n).cast("bigint") - 1))
    return F.when(col(n) <= k, every).otherwise(even)


def padded_indices(n: ColumnOrName, k: int) -> Column:
    """k places; places beyond the last frame repeat it."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(i, F.greatest(col(n).cast("int") - 1, F.lit(0))))


def frame_step(source_fps: ColumnOrName, target_fps: float) -> Column:
    """Every how many frames one is kept; an unusable rate counts as 30."""
    fps = F.when(col(source_fps) > 0, col(source_fps)).otherwise(F.lit(30.0))
    return F.greatest(F.lit(1), F.rint(fps / target_fps).cast("int"))


def pad_with_last(x: ColumnOrName, size: int) -> Column:
    return F.when(F.size(col(x)) >= size, F.slice(col(x), 1, size)).otherwise(F.concat(col(x), F.array_repeat(F.element_at(col(x), -1), size - F.size(col(x)))))


def center_fit(x: ColumnOrName, size: int) -> Column:
    """Crop around the middle, or pad with zeros on both sides (one more on the right)."""
    n = F.size(col(x))
    left = F.floor((size - n) / 2).cast("int")
    zero = F.lit(0).cast("double")
    padded = F.concat(F.array_repeat(zero, left), col(x), F.array_repeat(zero, size - n - left))
    return F.when(n >= size, F.slice(col(x), F.floor((n - size) / 2).cast("int") + 1, F.lit(size))).otherwise(padded)


def head_fit(x: ColumnOrName, size: int) -> Column:
    """Cut the tail, or pad it with zeros."""
    n = F.size(col(x))
    return F.when(n >= size, F.slice(col(x), 1, size)).otherwise(F.concat(col(x), F.array_repeat(F.lit(0).cast("double"), size - n)))


def decibels_to_unit(x: ColumnOrName, floor: float = -80.0) -> Column:
    return F.transform(col(x), lambda v: (F.greatest(F.lit(floor), F.least(F.lit(0.0), v)) - floor) / -floor)


def standardize(x: ColumnOrName, mean: float, std: float, scale: float = 255.0) -> Column:
    return F.transform(col(x), lambda v: (v / scale - mean) / std)


def min_max(x: ColumnOrName) -> Column:
    """To 0..1; zeros if the range is under 1e-8."""
    low, high = F.array_min(col(x)), F.array_max(col(x))
    return F.when(high - low < 1e-8, F.transform(col(x), lambda _: F.lit(0.0))).otherwise(F.transform(col(x), lambda v: (v - low) / (high - low)))


def mean_of(x: ColumnOrName) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v) / F.size(col(x))


def mean_step(x: ColumnOrName) -> Column:
    """Mean absolute difference of neighbours; 0 for fewer than two values."""
    n = F.size(col(x))
    steps = F.zip_with(F.slice(col(x), F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(col(x), F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a.cast("double") - b))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / (n - 1))


def squared_distance(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def sign_bits(x: ColumnOrName, n: int) -> Column:
    """Bit i is set where the i-th value is positive, for up to 64 of them."""
    # over the values themselves: x may be an expression, which every mention in the lambda would work out anew
    bits = F.transform(F.slice(col(x), 1, n), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.coalesce(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)), F.lit(0).cast("bigint"))


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hex_to_long(c: ColumnOrName) -> Column:
    """A hash of up to 16 hex digits as a signed long."""
    return F.conv(col(c), 16, -10).cast("bigint")


def crop_box(x: ColumnOrName, y: ColumnOrName, w: ColumnOrName, h: ColumnOrName, width: ColumnOrName, height: ColumnOrName, margin: float = 0.2) -> Column:
    """A box grown by a margin on each side, kept inside the picture; null if nothing is left."""
    mx, my = (col(w) * margin).cast("int"), (col(h) * margin).cast("int")
    x0, y0 = F.greatest(F.lit(0), col(x) - mx), F.greatest(F.lit(0), col(y) - my)
    x1, y1 = F.least(col(width), col(x) + col(w) + mx), F.least(col(height), col(y) + col(h) + my)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def eye_angle(left_x, left_y, right_x, right_y) -> Column:
    return F.degrees(F.atan2(col(right_y) - col(left_y), col(right_x) - col(left_x)))


def pick_face(faces: ColumnOrName, rule: str, center_x: ColumnOrName | None = None, center_y: ColumnOrName | None = None) -> Column:
    """The largest, most confident or most central of an array of (x, y, w, h, confidence);
    the first of equals. Null for an empty array."""
    f = col(faces)
    if rule == "largest":
        rank = lambda b: (b["w"] * b["h"]).cast("double")
    elif rule == "highest_confidence":
        rank = lambda b: b["confidence"].cast("double")
    elif rule == "center":
        rank = lambda b: -F.sqrt(F.pow(b["x"] + b["w"] / 2 - col(center_x), 2) + F.pow(b["y"] + b["h"] / 2 - col(center_y), 2))
    else:
        raise ValueError(f"unknown rule {rule}")
    best = F.array_max(F.transform(f, rank))
    return F.get(F.filter(f, lambda b: rank(b) == best), F.lit(0))


def deviation_shares(features: ColumnOrName) -> Column:
    """For an array of vectors: each one's distance from their mean, as a share of all."""
    f = col(features)
    n = F.size(f)
    total = F.aggregate(f, F.array_repeat(F.lit(0.0), F.size(F.get(f, F.lit(0)))), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    mean = F.transform(total, lambda v: v / n)
    far = F.transform(f, lambda v: F.sqrt(squared_distance(v, mean)))
    return F.transform(far, lambda d: d / (F.aggregate(far, F.lit(0.0), lambda a, v: a + v) + 1e-6))


def _square(v) -> np.ndarray | None:
    """A picture given row by row; None if it is null, empty, not square or holds a null."""
    if v is None or not len(v) or int(np.sqrt(len(v))) ** 2 != len(v):
        return None
    picture = np.asarray(v, float).reshape(int(np.sqrt(len(v))), -1)
    return picture if np.isfinite(picture).all() else None


def _magnitudes(pictures: np.ndarray) -> np.ndarray:
    """Of pictures of one size, as the functions below."""
    return (20 * np.log(np.abs(np.fft.fftshift(np.fft.fft2(pictures), axes=(1, 2))) + 1e-12)).reshape(len(pictures), -1)


def _sharpness(pictures: np.ndarray) -> list[float]:
    p = np.pad(pictures, ((0, 0), (1, 1), (1, 1)), mode="reflect") if pictures.shape[1] > 1 else np.zeros((len(pictures), 3, 3))
    return [float(x.var()) for x in p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]]


def _phashes(pictures: np.ndarray) -> np.ndarray:
    k = np.arange(pictures.shape[1])
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * np.arange(8)[:, None] / (2 * len(k)))
    low = np.stack([(basis @ p @ basis.T).ravel() for p in pictures])
    return np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1).view(">i8").ravel().astype(np.int64)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum_magnitude(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """20 ln of the shifted 2-d spectrum of a square picture given row by row; null for others."""
    for s in batches:
        yield pd.Series([None if (p := _square(v)) is None else _magnitudes(p[None])[0] for v in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def laplacian_variance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Variance of the Laplacian of a square picture, borders reflected; null for others."""
    for s in batches:
        yield pd.Series([None if (p := _square(v)) is None else _sharpness(p[None])[0] for v in s], dtype=object)


@F.pandas_udf(T.LongType())
def perceptual_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64 bits: the low 8x8 cosine coefficients of a square picture above their median; null for others."""
    for s in batches:
        yield pd.Series([None if (p := _square(v)) is None else int(_phashes(p[None])[0]) for v in s], dtype=object)


_FEATURES = pa.struct([("magnitude", pa.list_(pa.float64())), ("sharpness", pa.float64()), ("phash", pa.int64())])


def _picture_rows(v: pa.Array) -> pa.Array:
    flat, edges = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    known = v.is_valid().to_numpy(zero_copy_only=False)
    pictures = [_square(flat[a:b]) if ok else None for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), known.tolist())]
    columns = [[None] * len(v) for _ in _FEATURES]
    sizes = np.array([0 if p is None else len(p) for p in pictures])
    for size in set(sizes[sizes > 0].tolist()):
        at = np.flatnonzero(sizes == size).tolist()
        alike = np.stack([pictures[i] for i in at])
        for column, values in zip(columns, (_magnitudes(alike), _sharpness(alike), _phashes(alike))):
            for i, x in zip(at, values):
                column[i] = x
    columns = [pa.array(c, f.type) for c, f in zip(columns, _FEATURES)]
    return pa.StructArray.from_arrays(columns, fields=list(_FEATURES))


@F.arrow_udf(T.StructType([T.StructField("magnitude", T.ArrayType(T.DoubleType())), T.StructField("sharpness", T.DoubleType()), T.StructField("phash", T.LongType())]))
def picture_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All three in one: each Arrow function over an iterator has a Python process of its own in every
    task. A batch is worked on by the thousand rows."""
    for v in batches:
        parts = [_picture_rows(v.slice(a, 1000)) for a in range(0, len(v), 1000)]
        yield pa.concat_arrays(parts) if parts else pa.array([], _FEATURES)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def log_mel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Log-mel energies in dB below the peak: frames of 400 samples every 160, 40 bands, 16 kHz."""
    rate, size, hop, bands = 16_000, 400, 160, 40
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(size, 1 / rate)
    up = (freq - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - freq) / (points[2:] - points[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    for s in batches:
        out = []
        for v in s:
            x = np.asarray(v, float)
            x = np.pad(x, (0, max(0, size - len(x))))
            frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
            power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ bank.T
            db = 10 * np.log10(np.maximum(power, 1e-10))
            out.append([list(r) for r in np.maximum(db - db.max(), -80.0).T])
        yield pd.Series(out)
