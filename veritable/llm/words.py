"""Words of many UTF-8 texts as 64-bit hashes, computed for a whole slice at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(256, _BASE, np.uint64))
_LUT = np.random.default_rng(6151).integers(1, 1 << 63, 256, np.uint64)
_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
#: 0 blank, 1 letters, 2 digits, 3 anything else
_CLASS = np.where(_SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 3))).astype(np.uint8)
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_FOLDED, _WORD = _LUT[_FOLD], _LETTER | _DIGIT


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal ``kind``; no run crosses a text's start."""
    first = np.empty(len(kind), bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    inner = offsets[(offsets > 0) & (offsets < len(kind))]
    first[inner] = True
    starts = np.flatnonzero(first)
    return starts, np.diff(starts, append=len(kind))


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray = _LUT) -> np.ndarray:
    """A polynomial hash of each run. The runs follow one another without gaps."""
    place = np.arange(len(data)).astype(np.uint8) - np.repeat(starts.astype(np.uint8), sizes)
    return _mix(np.add.reduceat(values.take(data) * _POWER.take(place), starts) + sizes.astype(np.uint64))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) runs of letters and digits, and each one's text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _WORD.take(data)
    starts, sizes = _runs(kind, offsets)
    with np.errstate(over="ignore"):
        h = run_hashes(data, starts, sizes, _FOLDED)
    word = np.flatnonzero(kind.take(starts))
    return h.take(word), np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts.take(word), offsets)))


#: What stands for a word written in capitals, and for one that repeats the word before.
CAPITALS, REPEATED, NUMBER = np.uint64(1), np.uint64(2), np.uint64(3)


def shaped_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters, digits and other signs, and each one's text. A word in
    capitals, a number and a word that repeats the last one count as one kind each, whatever
    their letters: rare spellings have no vector worth knowing."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    starts, sizes = _runs(kind, offsets)
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int32), starts)
    lower = np.add.reduceat(((data >= 97) & (data <= 122)).astype(np.int32), starts)
    with np.errstate(over="ignore"):
        h = run_hashes(_FOLD[data], starts, sizes)
    kind = kind[starts]
    owner = np.searchsorted(offsets, starts, "right") - 1
    some = kind > 0
    h, kind, owner, sizes, upper, lower = h[some], kind[some], owner[some], sizes[some], upper[some], lower[some]
    spelled = h.copy()
    h[(kind == 1) & (upper > 1) & (lower == 0)] = CAPITALS
    h[kind == 2] = NUMBER
    letters = np.flatnonzero(kind == 1)
    again = letters[1:][(spelled[letters[1:]] == spelled[letters[:-1]]) & (owner[letters[1:]] == owner[letters[:-1]])]
    h[again] = REPEATED
    return h, owner
