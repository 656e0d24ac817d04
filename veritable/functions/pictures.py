"""Pictures as arrays of pixels, row by row: turning, and what a picture is drawn on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.arrays import eye_angle
from veritable.functions.normalize import ColumnOrName, col


def rotate(pixels: ColumnOrName, width: int, height: int, center_x: Column, center_y: Column, degrees: Column) -> Column:
    """The picture turned around a point, counterclockwise as it is seen for a positive angle, in its
    old frame. Each pixel asks where it came from and mixes the four pixels there by their
    distances; beyond the border the border's pixels go on. Null for another number of pixels, or
    without an angle."""
    x, cos, sin = col(pixels), F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def pixel(i: Column) -> Column:
        dx, dy = i % width - center_x, F.floor(i / width) - center_y
        at_x, at_y = cos * dx - sin * dy + center_x, sin * dx + cos * dy + center_y
        left, top = F.floor(at_x), F.floor(at_y)
        part_x, part_y = at_x - left, at_y - top
        inside = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
        at = lambda a, b: F.get(x, (inside(b, height) * width + inside(a, width)).cast("int"))
        upper = at(left, top) * (1 - part_x) + at(left + 1, top) * part_x
        lower = at(left, top + 1) * (1 - part_x) + at(left + 1, top + 1) * part_x
        return upper * (1 - part_y) + lower * part_y

    turned = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)
    return F.when((F.size(x) == width * height) & degrees.isNotNull(), turned)


def align_by_eyes(pixels: ColumnOrName, width: int, height: int, left_x: Column, left_y: Column, right_x: Column, right_y: Column) -> Column:
    """The picture turned so that the eyes are level, around the point between them; as it is where
    an eye is missing or both are one point."""
    apart = F.sqrt((right_x - left_x) * (right_x - left_x) + (right_y - left_y) * (right_y - left_y))
    usable = F.coalesce((apart >= 1e-3) & ~F.isnan(apart), F.lit(False))
    turned = rotate(pixels, width, height, (left_x + right_x) / 2, (left_y + right_y) / 2, eye_angle(left_x, left_y, right_x, right_y))
    return F.when(usable, turned).otherwise(col(pixels))


#: Directions of a nearly level line, in degrees.
LEVEL = (-4.0, -2.0, 0.0, 2.0, 4.0)


def edges(gray: np.ndarray, least: float) -> np.ndarray:
    """Inner pixels whose neighbours differ, across and down together, by more than ``least``."""
    out = np.zeros(gray.shape, bool)
    if min(gray.shape) > 2:
        out[1:-1, 1:-1] = np.abs(gray[2:, 1:-1] - gray[:-2, 1:-1]) + np.abs(gray[1:-1, 2:] - gray[1:-1, :-2]) > least
    return out


def level_lines(edge: np.ndarray, votes: int, angles: tuple[float, ...] = LEVEL) -> int:
    """Nearly level lines by a Hough accumulator: each edge pixel votes, for every direction, for
    the line through it, by its distance from the origin. A line is a cell with at least
    ``votes`` that no cell beside it (next direction or distance) beats; of equals the first."""
    y, x = np.nonzero(edge)
    if not len(y):
        return 0
    t = np.radians(angles)[:, None]
    rho = np.floor(y * np.cos(t) - x * np.sin(t) + 0.5).astype(int)
    low = rho.min() - 1
    cells = np.zeros((len(angles) + 2, rho.max() - low + 2), int)
    for k, r in enumerate(rho):
        cells[k + 1] += np.bincount(r - low, minlength=cells.shape[1])
    mine = cells[1:-1, 1:-1]
    first = mine >= votes
    for dt in (-1, 0, 1):
        for dr in (-1, 0, 1):
            if (dt, dr) != (0, 0):
                beside = cells[1 + dt : cells.shape[0] - 1 + dt, 1 + dr : cells.shape[1] - 1 + dr]
                first &= beside < mine if (dt, dr) < (0, 0) else beside <= mine
    return int(first.sum())


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("paper", "saturation", "sharpness")] + [T.StructField("lines", T.IntegerType())]))
def picture_facts(red: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Of pictures given as (red, green, blue, width), values 0 to 255: the share of paper (pale
    and bright pixels), the mean saturation, the variance of the Laplacian and the number of nearly
    level lines, of at least a quarter of the width in edge pixels. Null for what is no picture."""
    for r, g, b, w in red:
        out = []
        for parts in zip(r, g, b, w):
            channels = [None if p is None else np.asarray(p, float) for p in parts[:3]]
            width = int(parts[3]) if parts[3] == parts[3] and parts[3] else 0
            if any(c is None or not len(c) or len(c) % max(width, 1) or len(c) != len(channels[0]) or not np.isfinite(c).all() for c in channels) or width < 1:
                out.append((None, None, None, None))
                continue
            red_, green, blue = (c.reshape(-1, width) for c in channels)
            most, least = np.maximum(np.maximum(red_, green), blue), np.minimum(np.minimum(red_, green), blue)
            saturation = np.divide(255 * (most - least), most, out=np.zeros_like(most), where=most > 0)
            gray = 0.299 * red_ + 0.587 * green + 0.114 * blue
            p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
            laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
            out.append((float(((saturation < 50) & (most > 140)).mean()), float(saturation.mean()), float(laplacian.var()), level_lines(edges(gray, 100.0), max(2, -(-width // 4)))))
        yield pd.DataFrame(out, columns=["paper", "saturation", "sharpness", "lines"]).astype({"lines": "Int32"})


def face_crop(faces: ColumnOrName, width: Column, height: Column, is_art: Column) -> Column:
    """The box to crop to: the largest face (x, y, w, h) of those that take a quarter of each side,
    with a margin of a quarter, if it covers less than half of the picture; else null. Drawings
    stay whole."""
    large = F.filter(col(faces), lambda f: (f["w"] >= width * 0.25) & (f["h"] >= height * 0.25))
    area = F.array_max(F.transform(large, lambda f: f["w"] * f["h"]))
    face = F.get(F.filter(large, lambda f: f["w"] * f["h"] == area), F.lit(0))
    mx, my = (face["w"] * 0.25).cast("int"), (face["h"] * 0.25).cast("int")
    box = F.struct(F.greatest(F.lit(0), face["x"] - mx).alias("x0"), F.greatest(F.lit(0), face["y"] - my).alias("y0"), F.least(width, face["x"] + face["w"] + mx).alias("x1"), F.least(height, face["y"] + face["h"] + my).alias("y1"))
    return F.when(~F.coalesce(is_art, F.lit(False)) & (area / (width * height) < 0.5), box)
