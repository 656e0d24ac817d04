"""Random masks that can be made again: every number comes from a digest of what it is for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions.normalize import ColumnOrName, col


def uniform(seed: int, row: ColumnOrName, draw: Column) -> Column:
    """A number from 0 up to 1 for (seed, row, draw): the first 52 bits of an md5 digest. It is the
    same after a retry, in any order and however rows are partitioned."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(col(row).cast("string"), F.lit("")), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def drop_frames(frames: ColumnOrName, row: ColumnOrName, rate: float, seed: int = 0) -> Column:
    """Frames (arrays of numbers), each set to zeros with chance ``rate``."""
    return F.transform(col(frames), lambda f, i: F.when(uniform(seed, row, i) > rate, f).otherwise(F.transform(f, lambda _: F.lit(0).cast("double"))))


def _stretches(row: ColumnOrName, size: Column, widest: int, count: int, seed: int, first: int) -> list[tuple[Column, Column]]:
    """(start, length) of ``count`` random stretches, each 0 to ``widest`` long; none is as long as all."""
    out = []
    for k in range(count):
        length = F.floor(uniform(seed, row, F.lit(first + 2 * k)) * (widest + 1))
        start = F.floor(uniform(seed, row, F.lit(first + 2 * k + 1)) * (size - length))
        out.append((start, F.when((length > 0) & (length < size), length).otherwise(F.lit(0))))
    return out


def mask_bands(mel: ColumnOrName, row: ColumnOrName, bands: tuple[int, int], steps: tuple[int, int], seed: int = 0) -> Column:
    """A spectrogram (bands of time steps) with random bands and random steps set to zero.
    ``bands`` and ``steps``: (how many stretches, widest one)."""
    x = col(mel)
    n, t = F.size(x), F.size(F.get(x, F.lit(0)))
    hidden_bands = _stretches(row, n, bands[1], bands[0], seed, 0)
    hidden_steps = _stretches(row, t, steps[1], steps[0], seed, 2 * bands[0])

    def within(at: Column, stretches: list[tuple[Column, Column]]) -> Column:
        found = F.lit(False)
        for start, length in stretches:
            found = found | ((at >= start) & (at < start + length))
        return found

    return F.transform(x, lambda band, i: F.transform(band, lambda v, j: F.when(within(i, hidden_bands) | within(j, hidden_steps), F.lit(0.0)).otherwise(v.cast("double"))))
