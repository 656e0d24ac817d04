"""Operator 2. Language identification with hyperdimensional profiles.

Every letter gets a random bipolar vector, drawn from its code point alone. A trigram is
the element-wise product of its letters' vectors, each rotated by its place; a text is the
sum of its trigrams' vectors, and a language is the sum of its unit document vectors. A text
belongs to the language whose profile, less what all profiles have in common, has the
largest cosine with it.

Texts are lower-cased; a run of anything but letters counts as one blank, at both ends too.
Null text, or text without a letter: ``und`` with score 0. Training rows with null text,
null language or no letter are ignored; if nothing can be learned all rows are ``und``.
Repeated rows count as often as they occur. A text is its own slice however long it is; the
memory beside it does not grow with the number of texts. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritable.llm.common import text_slices, tidy

DIMENSIONS = 512
SEED = 20177
#: Letters and trigrams numbered at once, trigram vectors multiplied at once, and texts counted
#: at once: a count matrix has at most ``_ROWS`` x ``_BLOCK`` entries, however short the texts.
_LETTERS, _TRIGRAMS, _BLOCK, _ROWS = 160, 1 << 15, 4096, 256
_SLICE = 1 << 19


@cache
def _letter(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dims, np.int8) * 2 - 1


def _trigram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """codes: (n, 3) code points, 0 for the blank."""
    letters, at = np.unique(codes, return_inverse=True)
    table = np.stack([_letter(int(c), dims) for c in letters])
    a, b, c = at.reshape(codes.shape).T
    return np.roll(table, 2, 1)[a] * np.roll(table, 1, 1)[b] * table[c]


class _Vectors:
    """Document vectors of many texts at once: trigram counts times trigram vectors.
    Letters and trigrams are numbered as they come; the tables are emptied when full. Texts
    whose letters do not fit beside the others' are added up without a table: the vectors are
    those of the code points all the same, whatever other texts there are."""

    def __init__(self, dims: int):
        self.dims, self.is_letter = dims, np.full(0x110000, -1, np.int8)
        self.number = np.zeros(_LETTERS**3, np.int32)
        self.found = np.zeros(_LETTERS**3, bool)
        self._clear()

    def _clear(self) -> None:
        self.alphabet = [0]
        self.place = np.zeros(0x110000, np.int16)
        self.row = np.full(_LETTERS**3, -1, np.int32)
        self.vectors = np.zeros((0, self.dims), np.int8)

    def _number(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers; 0 for the blank. There are fewer than ``_LETTERS`` letters."""
        for c in self._letters(points).tolist():
            if not self.place[c]:
                if len(self.alphabet) == _LETTERS:
                    self._clear()
                    return self._number(points)
                self.place[c] = len(self.alphabet)
                self.alphabet.append(c)
        return self.place[points].astype(np.int32)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """The distinct letters, in order."""
        found = np.flatnonzero(np.bincount(points))
        for c in found[self.is_letter[found] < 0].tolist():
            self.is_letter[c] = chr(c).isalpha()
        return found[self.is_letter[found] > 0]

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if len(new):
            if len(self.vectors) + len(new) > _TRIGRAMS:
                self.row.fill(-1)
                self.vectors, new = self.vectors[:0], grams
            letters = np.array(self.alphabet, np.int64)
            codes = np.stack([letters[new // _LETTERS**2], letters[new // _LETTERS % _LETTERS], letters[new % _LETTERS]], 1)
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, _trigram_vectors(codes, self.dims)])
        return self.vectors[self.row[grams]].astype(np.float32)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n, dims) sums of trigram vectors; whether a text has a letter."""
        low = [" " + t.lower() + " " if t else " " for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        letters = self._letters(points)
        if len(letters) < _LETTERS:
            return self._counted(points, owner, len(low))
        # the table takes the texts that do with the lowest letters
        others = (points > letters[_LETTERS - 2]) & (self.is_letter[points] > 0)
        wide = np.bincount(owner[others], minlength=len(low)) > 0
        out, has = self._counted(points[~wide[owner]], owner[~wide[owner]], len(low))
        more, too = self._summed(points[wide[owner]], owner[wide[owner]], len(low))
        return out + more, has | too

    @staticmethod
    def _squeezed(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of blanks as one; also where a trigram of one text begins."""
        keep = np.ones(len(at), bool)
        keep[1:] = (at[1:] != 0) | (at[:-1] != 0) | (owner[1:] != owner[:-1])
        at, owner = at[keep], owner[keep]
        return at, owner, np.flatnonzero(owner[2:] == owner[:-2])

    def _summed(self, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, owner, whole = self._squeezed(np.where(self.is_letter[points] > 0, points, 0).astype(np.int64), owner)
        out = np.zeros((n, self.dims), np.float32)
        has = np.bincount(owner[at != 0], minlength=n) > 0
        # equal trigrams of a text are multiplied once
        order = np.lexsort((at[whole + 2], at[whole + 1], at[whole], owner[whole]))
        whole = whole[order]
        codes, owner = np.stack([at[whole], at[whole + 1], at[whole + 2]], 1), owner[whole]
        first = np.ones(len(whole), bool)
        first[1:] = (codes[1:] != codes[:-1]).any(1) | (owner[1:] != owner[:-1])
        times = np.diff(np.flatnonzero(first), append=len(whole)).astype(np.float32)
        codes, owner = codes[first], owner[first]
        for k in range(0, len(codes), _BLOCK):
            o = owner[k : k + _BLOCK]
            starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            vectors = _trigram_vectors(codes[k : k + _BLOCK], self.dims) * times[k : k + _BLOCK, None]
            out[o[starts]] += np.add.reduceat(vectors, starts)
        return out, has

    def _counted(self, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, owner, whole = self._squeezed(self._number(points), owner)
        has = np.bincount(owner[at != 0], minlength=n) > 0
        out = np.zeros((n, self.dims), np.float32)
        grams = ((at[whole] * _LETTERS + at[whole + 1]) * _LETTERS + at[whole + 2]).astype(np.int32)
        self.found[grams] = True
        kinds = np.flatnonzero(self.found)
        self.found[kinds] = False
        self.number[kinds] = np.arange(len(kinds), dtype=np.int32)
        owner, grams = owner[whole], self.number[grams]
        edges = np.searchsorted(owner, np.arange(0, n + _ROWS, _ROWS))
        for first in range(0, len(kinds), _BLOCK):
            width = min(_BLOCK, len(kinds) - first)
            vectors = self._rows(kinds[first : first + width])
            for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                rows, g = min(_ROWS, n - k * _ROWS), grams[i:j]
                chosen = slice(None) if len(kinds) <= _BLOCK else (g >= first) & (g < first + width)
                places = (owner[i:j][chosen] - np.int32(k * _ROWS)) * np.int32(width) + (g[chosen] - np.int32(first))
                counts = np.bincount(places, minlength=rows * width).astype(np.float32).reshape(rows, width)
                out[k * _ROWS : k * _ROWS + rows] += counts @ vectors
        return out, has


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict[str, list[float]]:
    """Profiles by language. Partitions add up unit document vectors; the driver gets one
    row per language and block of dimensions, whatever the number of documents."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = _Vectors(dims)
        for batch in batches:
            for part in text_slices(batch, most=_SLICE):
                v, has = vectors.of(part.column("text").to_pylist())
                v, langs = _unit(v), np.array(part.column("lang").to_pylist(), object)
                for name in set(langs[has]):
                    sums[name] = sums.get(name, 0) + v[has & (langs == name)].sum(0, dtype=np.float64)
        if sums:
            names = [n for n in sums for _ in range(dims)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(range(dims)) * len(sums), pa.int32()), pa.array(np.concatenate(list(sums.values())))], ["lang", "dim", "x"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(tidy(bundle), "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    out: dict[str, list[float]] = {}
    for r in summed.collect():  # languages x dims
        out.setdefault(r["lang"], [0.0] * dims)[r["dim"]] = r["x"]
    return dict(sorted(out.items()))


def predict(docs: DataFrame, profiles: dict[str, list[float]], keys: list[str | Column], text: str = "text") -> DataFrame:
    """``keys`` columns, then lang_pred and score: the winner's share among the languages'
    cosines (softmax, 0 to 1)."""
    names = list(profiles)
    dims = len(next(iter(profiles.values()), []))
    frame = docs.select(*keys, F.col(text).alias("__text"))
    kept = frame.columns[:-1]
    prototypes = _unit(np.array([profiles[n] for n in names], np.float64).reshape(len(names), dims))
    common = prototypes.mean(0) if len(names) > 1 else np.zeros(dims)
    prototypes = _unit(prototypes - common)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dims) if names else None
        for batch in batches:
            for part in text_slices(batch, "__text", _SLICE):
                pred, conf = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if names:
                    v, has = vectors.of(part.column("__text").to_pylist())
                    cos = _unit(_unit(v.astype(np.float64)) - common) @ prototypes.T
                    best = cos.argmax(1)
                    odds = np.exp(12.0 * (cos - cos.max(1, keepdims=True)))
                    conf = np.where(has, 1 / odds.sum(1), 0.0)
                    pred = [names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(pred, pa.string()), pa.array(conf, pa.float64())], [*kept, "lang_pred", "score"])

    return frame.mapInArrow(tidy(score), StructType(frame.schema.fields[:-1]).add("lang_pred", "string").add("score", "double"))
