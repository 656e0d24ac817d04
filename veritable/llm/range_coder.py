"""Adaptive context-mixing range coder for token ids, in numpy.

A block of ids is cut into lanes that are coded side by side and share one model, so each
step codes one id of every lane. The model predicts an id by order 2 (the two ids before),
by order 1 (the id before) and by order 0 (how often each id occurred); the chance that each
prediction holds is a mixture of what was seen in that pair of confidences, and what each
order alone has shown. An id that the block has not yet shown is spelled out. Every lane is
a 64-bit carry-less range coder that writes 16-bit words. Model and coders start anew with
each block; all arithmetic on probabilities uses the four basic operations, which give the
same result on any machine.

Block: fixed header, compressed lane lengths, words; ``encode_block`` adds a CRC-32 of all of it and
``decode_block`` checks it before use.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"VTB3"
_HEAD = struct.Struct("<4sIIIII")
_LANES = 8192
_T16, _T32, _T40, _T48 = np.uint64(16), np.uint64(32), np.uint64(1 << 40), np.uint64(1 << 48)
_MASK32, _MASK40 = np.uint64((1 << 32) - 1), np.uint64((1 << 40) - 1)
_ONE, _T48_BITS = np.uint64(1), np.uint64(48)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_HASH_BITS = 17
#: Bits of an outcome's share. A known id is coded with its outcome at once: with both, shares stay
#: well above one part of the shortest range, 2**40.
_OUTCOME_BITS = 12


#: What a prediction's confidence gains when it held (0..3 before) or failed (4..7); one that
#: fails without any gives way to the id that came.
_TRUST = np.array([1, 1, 1, 0, 0, -1, -1, -1]).astype(np.uint32)
_GIVES_WAY = 4


class _Model:
    """A prediction is an id and, in its two lowest bits, a confidence; ids are handled as they
    stand there, times four."""

    def __init__(self, vocabulary: int):
        if vocabulary > 1 << 30:
            raise ValueError("ids are below 2**30")
        self.order2 = np.zeros(1 << _HASH_BITS, np.uint32)
        self.order1 = np.zeros(vocabulary, np.uint32)
        self.seen = np.zeros(vocabulary, np.int64)
        # where an id's share begins, times 2**32, and the share
        self.order0 = np.zeros(vocabulary, np.uint64)
        self.slots, self.bits0 = np.zeros(0, np.uint32), 16
        self.fresh: list[np.ndarray] = []
        self.joint = np.zeros((32, 4))
        self.step = 0
        self._tables()

    def predict(self, h1: np.ndarray, p1: np.ndarray, p2: np.ndarray):
        """Places of the predictions of order 1 (the id before) and 2, both, their confidences,
        and four times the context of each lane."""
        h2 = (((p1 * np.uint32(0x85EBCA6B)) ^ (p2 * np.uint32(0xC2B2AE35))) * np.uint32(0x9E3779B1) >> np.uint32(32 - _HASH_BITS)).astype(np.int64)
        a, b = self.order2.take(h2), self.order1.take(h1)
        s2, s1 = a.astype(np.uint8) & np.uint8(3), b.astype(np.uint8) & np.uint8(3)
        first = (s2 << np.uint8(5)) | (s1 << np.uint8(3)) | (((a ^ b) < 4).view(np.uint8) << np.uint8(2))
        return h1, h2, a, b, s1, s2, first

    def _tables(self) -> None:
        """Shares of the four outcomes in each context: order 2 right, order 1 right, known
        id, new id. The joint counts lean on each order's own record by eight observations."""
        n = self.joint
        c2, c1 = np.arange(32) // 8, np.arange(32) // 2 % 4
        right2 = np.bincount(c2, n[:, 0], 4) + 0.4
        all2 = np.bincount(c2, n.sum(1), 4) + 1.0
        right1 = np.bincount(c1, n[:, 1], 4) + 0.4
        left1 = np.bincount(c1, n[:, 1:].sum(1), 4) + 1.0
        known = (n[:, 2].sum() + 0.5) / (n[:, 2:].sum() + 1.0)
        q = np.empty((32, 4))
        q[:, 0] = (right2 / all2)[c2]
        q[:, 1] = (1 - q[:, 0]) * (right1 / left1)[c1]
        rest = 1 - q[:, 0] - q[:, 1]
        q[:, 2], q[:, 3] = rest * known, rest * (1 - known)
        p = (n + 8.0 * q) / (n.sum(1) + 8.0)[:, None]
        freq = 1 + (p * ((1 << _OUTCOME_BITS) - 8)).astype(np.uint64)
        cum = np.concatenate([np.zeros((32, 1), np.uint64), np.cumsum(freq, 1, dtype=np.uint64)], 1)[:, :4]
        freq[:, 3] = np.uint64(1 << _OUTCOME_BITS) - cum[:, 3]
        self.cum, self.freq = cum.ravel(), freq.ravel()
        self.limits = self.cum.astype(np.uint16)

    def learn(self, x4, seen, outcome, cell) -> None:
        h1, h2, a, b, s1, s2, _ = seen
        self.joint += np.bincount(cell, minlength=128).reshape(32, 4)
        for table, h, guess, trust in ((self.order2, h2, a, s2), (self.order1, h1, b, s1)):
            case = trust | (((guess ^ x4) > 3).view(np.uint8) << np.uint8(2))
            then = guess + _TRUST.take(case)
            np.putmask(then, case == _GIVES_WAY, x4)
            table[h] = then
        self.fresh.append(x4[outcome >= 2])
        self.step += 1
        if self.step < 8 or self.step % (4 if self.step < 32 else 16) == 0:
            self._tables()
        if self.step < 4 or self.step % 32 == 0 or self.step in (4, 8, 16):
            new = np.concatenate(self.fresh) >> np.uint32(2)
            self.fresh.clear()
            self.seen += np.bincount(new, minlength=len(self.seen))
            ids = np.flatnonzero(self.seen)
            # as many bits as the ids seen need, and one more
            self.bits0 = max(16, len(ids).bit_length() + 1)
            counts = self.seen[ids]
            freq = 1 + counts * ((1 << self.bits0) - len(ids)) // max(1, int(counts.sum()))
            self.order0[ids] = (np.cumsum(freq) - freq) << 32 | freq
            self.slots = np.repeat(ids.astype(np.uint32), freq)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(_LANES, n // 64))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _wide(vocabulary: int) -> int:
    """Bits of an id beyond its lower 16."""
    return max(0, (vocabulary - 1).bit_length() - 16)


def _shifts(low: np.ndarray, r: np.ndarray):
    """Brings ranges that are settled in their upper 16 bits, or too short, 16 bits up, in place:
    yields the places to shift and their ``low`` before, until none is left."""
    at, l, w = None, low, r
    while True:
        change = (l + w) ^ l
        some = np.flatnonzero((change < _T48) | (w < _T40))
        if not len(some):
            return
        l, w = l.take(some), w.take(some)
        at = some if at is None else at.take(some)
        cut = np.flatnonzero(change.take(some) >= _T48)
        w[cut] = (~l.take(cut) + _ONE) & _MASK40
        yield at, l
        l, w = l << _T16, w << _T16
        low[at], r[at] = l, w


class _Writer:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _ALL, np.uint64)
        self.lane: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def put(self, who: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray, bits: int = 16) -> None:
        """who: the lanes, as places or as a slice from 0; frequencies add up to 2**bits at most."""
        r = self.range[who] >> np.uint64(bits)
        low = self.low[who] + cum * r
        r *= freq
        for at, l in _shifts(low, r):
            self.lane.append((at if isinstance(who, slice) else who.take(at)).astype(np.uint16))
            self.word.append((l >> _T48_BITS).astype(np.uint16))
        self.low[who], self.range[who] = low, r

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.low), dtype=np.uint16)
        # the shortest range is 2**40: these two words name a number in it, whatever follows them
        last = self.low + _MASK32
        for k in (48, 32):
            self.lane.append(every)
            self.word.append((last >> np.uint64(k)).astype(np.uint16))
        lane, word = np.concatenate(self.lane), np.concatenate(self.word)
        # by lane, then as they came: a sort of single numbers is several times faster than one of places
        every_word = (lane.astype(np.uint64) << _T48_BITS) | (np.arange(len(lane), dtype=np.uint64) << _T16) | word
        every_word.sort()
        return np.bincount(lane, minlength=len(every)), every_word.astype(np.uint16)


class _Reader:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.words = words
        self.at = np.cumsum(sizes) - sizes
        self.low = np.zeros(len(sizes), np.uint64)
        self.range = np.full(len(sizes), _ALL, np.uint64)
        self.code = np.zeros(len(sizes), np.uint64)
        for _ in range(4):
            self.code = (self.code << _T16) | self.words.take(self.at, mode="clip")
            self.at += 1

    def slot(self, who: np.ndarray | slice, bits: int = 16) -> np.ndarray:
        self.r = self.range[who] >> np.uint64(bits)
        return np.minimum((self.code[who] - self.low[who]) // self.r, np.uint64((1 << bits) - 1))

    def take(self, who: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray) -> None:
        low, r = self.low[who] + cum * self.r, self.r * freq
        for at, _ in _shifts(low, r):
            lanes = at if isinstance(who, slice) else who.take(at)
            place = self.at.take(lanes)
            self.code[lanes] = (self.code.take(lanes) << _T16) | self.words.take(place, mode="clip")
            self.at[lanes] = place + 1
        self.low[who], self.range[who] = low, r


def _whole(model: _Model) -> np.uint64:
    """The place within an outcome of one that holds no id: all of it."""
    return _ONE << np.uint64(model.bits0)


def _place(model: _Model, cell: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the share of an outcome, and of the id in it, begins; its size; and the bits of both."""
    share = model.freq.take(cell)
    return (model.cum << np.uint64(model.bits0)).take(cell) + share * (within >> _T32), share * (within & _MASK32), _OUTCOME_BITS + model.bits0


def encode_block(ids: np.ndarray) -> bytes:
    """ids: non-negative integers below 2**30, of a vocabulary that fits memory, as tables have an entry for each."""
    n = len(ids)
    if not n:
        return _sealed(_HEAD.pack(_MAGIC, 0, 0, 0, 0, 0))
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, out, wide = _Model(int(grid.max()) + 1), _Writer(lanes), _wide(int(grid.max()) + 1)
    p1 = p2 = np.zeros(lanes, np.uint32)
    h1 = np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for t in range(steps):
            m = -(-(n - t) // steps)
            x = columns[t, :m]
            x4, place = x << np.uint32(2), x.astype(np.int64)
            seen = model.predict(h1[:m], p1[:m], p2[:m])
            within = model.order0.take(place)
            wrong2, wrong1, new = (((seen[2] ^ x4) > 3).view(np.uint8), ((seen[3] ^ x4) > 3).view(np.uint8), (within == 0).view(np.uint8))
            outcome = wrong2 * (wrong1 * (new + np.uint8(1)) + np.uint8(1))
            cell = (seen[6] | outcome).astype(np.int64)
            out.put(slice(0, m), *_place(model, cell, np.where(outcome == 2, within, _whole(model))))
            new = np.flatnonzero(outcome == 3)
            if len(new):
                ones, ids = np.full(len(new), _ONE), x.take(new).astype(np.uint64)
                if wide:
                    out.put(new, ids >> _T16, ones, wide)
                out.put(new, ids & np.uint64(0xFFFF), ones)
            model.learn(x4, seen, outcome, cell)
            h1, p2, p1 = place, p1, x
    sizes, words = out.finish()
    lengths = zlib.compress(sizes.astype("<u4").tobytes(), 1)
    return _sealed(_HEAD.pack(_MAGIC, n, lanes, int(grid.max()) + 1, len(words), len(lengths)) + lengths + words.astype("<u2").tobytes())


def _sealed(body: bytes) -> bytes:
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if the block is damaged."""
    body = data[:-4]
    if len(data) < _HEAD.size + 4 or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block: checksum differs")
    magic, n, lanes, vocabulary, count, size = _HEAD.unpack_from(body)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    if not n:
        return np.zeros(0, np.uint32)
    steps = _shape(n)[1]
    sizes = np.frombuffer(zlib.decompress(body[_HEAD.size : _HEAD.size + size]), "<u4", lanes).astype(np.int64)
    source = _Reader(sizes, np.frombuffer(body, "<u2", count, _HEAD.size + size))
    model, wide, columns = _Model(vocabulary), _wide(vocabulary), np.zeros((steps, lanes), np.uint32)
    p1 = p2 = np.zeros(lanes, np.uint32)
    h1 = np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for t in range(steps):
            m = -(-(n - t) // steps)
            every = slice(0, m)
            seen = model.predict(h1[:m], p1[:m], p2[:m])
            first, bits = seen[6].astype(np.int64), np.uint64(model.bits0)
            whole = source.slot(every, _OUTCOME_BITS + model.bits0)
            slot = (whole >> bits).astype(np.uint16)
            outcome = (slot >= model.limits.take(first + 1)).view(np.uint8)
            outcome = outcome + (slot >= model.limits.take(first + 2)).view(np.uint8) + (slot >= model.limits.take(first + 3)).view(np.uint8)
            cell = (seen[6] | outcome).astype(np.int64)
            x = np.where(outcome == 0, seen[2], seen[3]) >> np.uint32(2)
            within = np.full(m, _whole(model))
            known = np.flatnonzero(outcome == 2)
            if len(known):
                here = cell.take(known)
                rest = whole.take(known) - (model.cum << bits).take(here)  # of less than 32 bits, but with ids by the million
                short = np.uint32 if _OUTCOME_BITS + model.bits0 <= 32 else np.uint64
                ids = model.slots.take((rest.astype(short) // model.freq.astype(short).take(here)).astype(np.int64))
                x[known], within[known] = ids, model.order0.take(ids)
            source.take(every, *_place(model, cell, within)[:2])
            new = np.flatnonzero(outcome == 3)
            if len(new):
                ones, high = np.full(len(new), _ONE), np.zeros(len(new), np.uint64)
                if wide:
                    high = source.slot(new, wide)
                    source.take(new, high, ones)
                low = source.slot(new)
                source.take(new, low, ones)
                x[new] = (high << _T16) | low
            columns[t, :m] = x
            model.learn(x << np.uint32(2), seen, outcome, cell)
            h1, p2, p1 = x.astype(np.int64), p1, x
    return columns.T.reshape(-1)[:n]
