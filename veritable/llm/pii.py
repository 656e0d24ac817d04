"""Operator 13. Personal data by rules and a semi-Markov conditional random field.

Four kinds: e-mail addresses, IPv4 addresses, card numbers and phone numbers. Base rules find
the plain ones (leftmost, no overlap within a kind; a match that fails its check is dropped).
The random field adds what the rules miss: numbers that run into each other, other separators,
phones without a plus.

The field scores whole segments. A text is cut into tokens (letters and digits together, any
other character alone); a segment is up to ``LONGEST`` tokens, and its features look at all of
it: number of digits, checksum, octets, groups, separators, what stands on either side. A segment's
score is a sum of weights per kind, kinds that follow each other add a weight of their own, and
tokens outside of segments score zero. Dynamic programming over all segmentations picks the best
one, so boundaries and kinds are chosen together: a card after a phone is not one long number.
Segments need four digits or a sign like ``@``, and cannot overlap a base span, so tokens far from
digits are outside in every segmentation: only stretches of words with a digit or ``@``, one space
apart, are looked at. Long stretches are scored block by block.

Weights maximise the likelihood of segmentations (forward-backward over segments, L2, Adam): of
stretches made by a seeded generator, and of stretches of at most ``FIT_DOCS`` documents of the
corpus on average, chosen by hash, in which the base rules are certain. Those two are the only
sample. Everything else reads whole texts.

Null text counts as empty: no spans. Positions are code points. Rows are handled one by one, so
repeated rows and null doc_ids have results like others; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import text_bytes, text_slices, tidy

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
FIT_DOCS, FIT_STRETCHES, MADE = 4000, 800, 1000
#: Tokens of the longest stretch that the field learns from.
FIT_TOKENS = 40
SEED = 1311
#: Tokens scored at once.
_TOKENS = 1 << 13

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_HOT = r"[A-Za-z._%+()\[\]-]*+[0-9@][A-Za-z0-9._%+@()\[\]-]*+"
_STRETCH = re.compile(rf"(?<![A-Za-z0-9._%+@()\[\]-]){_HOT}(?:\x20{_HOT})*+")
_TRIGGER = np.isin(np.arange(256), np.frombuffer(b"0123456789@", np.uint8))


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base rules, sorted."""
    out, end = [], 0
    for m in _LOCAL.finditer(text):
        start, domain = max(m.start(), end), _DOMAIN.match(text, m.end())
        if domain and start < m.end() - 1:
            end = domain.end()
            out.append((start, 0, end))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Values that each feature takes.
_SIZES = {"digits": 21, "letters": 5, "mixed": 4, "at": 9, "marks": 256, "groups": 63, "ends": 20, "card": 8, "octets": 8, "sides": 25, "numbers": 4, "phone": 20, "tokens": LONGEST + 1, "tail": 12}
_OFFSETS = dict(zip(_SIZES, np.concatenate([[0], np.cumsum(list(_SIZES.values()))]).tolist()))
_FEATURES = sum(_SIZES.values())
_MARKS = b" -.()+[_"


class Stretches:
    """The tokens of some stretches (strings of ASCII), one after another, and what features need."""

    def __init__(self, texts: list[str], blocked: list[list[tuple[int, int]]]):
        joined = "".join(texts).encode("ascii")
        c = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        digit = (c >= 48) & (c <= 57)
        letter = ((c | 32) >= 97) & ((c | 32) <= 122)
        alnum = digit | letter
        new = np.ones(len(c), bool)
        new[1:] = ~(alnum[1:] & alnum[:-1])
        new[edges[:-1][sizes > 0]] = True
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(c))
        self.of = np.searchsorted(edges, self.start, "right") - 1
        self.edges = edges
        n = len(self.start)
        self.first = np.searchsorted(self.start, edges[:-1])  # token that each stretch begins with
        self.count = np.searchsorted(self.start, edges[1:]) - self.first
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits_by_char, letters_by_char = total(digit), total(letter)
        self.char = c[self.start] if n else c
        self.n_digits = digits_by_char[self.end] - digits_by_char[self.start]
        n_letters = letters_by_char[self.end] - letters_by_char[self.start]
        self.size = self.end - self.start
        self.is_number = self.n_digits == self.size
        self.is_word = n_letters == self.size
        self.is_alnum = self.n_digits + n_letters == self.size
        octet = np.zeros(n, np.int64)
        for k in range(3):  # the value of numbers of up to three digits
            has = self.is_number & (self.size > k) & (self.size <= 3)
            octet[has] = octet[has] * 10 + c[self.start[has] + k] - 48
        self.is_octet = self.is_number & (self.size <= 3) & (octet <= 255)
        self.digits = total(self.n_digits)
        self.words, self.mixed = total(self.is_word), total(self.is_alnum & ~self.is_word & ~self.is_number)
        self.numbers, self.octets = total(self.is_number), total(self.is_octet)
        self.marks = [total(self.char == m) for m in _MARKS]
        self.others = total(np.isin(self.char, np.frombuffer(b"%]", np.uint8)))
        self.fours = total(self.is_number & (self.size == 4))
        self.ats = total(self.char == 64)
        # a sign like @: "[at]" or "(at)"
        lower = np.append(c, np.zeros(4, np.uint8)) | 32
        spelled = np.zeros(n, bool)
        opens = np.flatnonzero((self.char == 91) | (self.char == 40))
        at = self.start[opens]
        close = np.append(c, np.zeros(4, np.uint8))[at + 3]
        spelled[opens] = (lower[at + 1] == 97) & (lower[at + 2] == 116) & np.where(self.char[opens] == 91, close == 93, close == 41)
        self.spelled = total(spelled)
        # sums of a checksum's digits, doubled at even and at odd places of the digits
        value = c[digit].astype(np.int64) - 48
        doubled = 2 * value - 9 * (value > 4)
        odd = np.arange(len(value)) % 2 == 1
        self.luhn = [total(np.where(odd, doubled, value)), total(np.where(odd, value, doubled))]
        self.longest = np.where(self.is_number, np.minimum(self.size, 6), 0)
        stop = np.zeros(n + 1, np.int64)
        for k, spans in enumerate(blocked):
            for a, b in spans:
                low, high = max(a, 0) + edges[k], min(b + edges[k], edges[k + 1])
                stop[np.searchsorted(self.end, low, "right") : np.searchsorted(self.start, high)] = 1
        self.blocked = np.concatenate([[0], np.cumsum(stop[:-1])])

    def candidates(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, last token) of all segments that end in tokens low to high - 1."""
        last = np.repeat(np.arange(low, high), LONGEST)
        begin = last - np.tile(np.arange(LONGEST), high - low)
        ok = begin >= self.first[self.of[last]]
        begin, last = begin[ok], last[ok]
        head, tail = self.char[begin], self.char[last]
        ok = (self.is_alnum[begin] | (head == 43) | (head == 40)) & (self.is_alnum[last] | (tail == 41))
        ok &= self.blocked[last + 1] == self.blocked[begin]
        signs = self.ats[last + 1] - self.ats[begin] + self.spelled[last + 1] - self.spelled[begin]
        ok &= (signs > 0) | (self.digits[last + 1] - self.digits[begin] >= 4)
        return begin[ok], last[ok]

    def features(self, begin: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
        end = last + 1
        span = lambda sums: sums[end] - sums[begin]
        least = np.minimum
        digits, groups, ats = span(self.digits), span(self.numbers), span(self.ats) + span(self.spelled)
        marks = [span(m) for m in self.marks]
        head, tail = self.char[begin], self.char[last]
        n, first = len(self.start), self.first[self.of[begin]]
        stretch_end = first + self.count[self.of[begin]]
        before = np.where(begin > first, self.char[begin - 1], 32)
        after = np.where(end < stretch_end, self.char[least(end, n - 1)], 32)

        def side(c: np.ndarray) -> np.ndarray:
            return np.select([c == 32, np.isin(c, np.frombuffer(b"()[]", np.uint8)), np.isin(c, np.frombuffer(b".-", np.uint8)), np.isin(c, np.frombuffer(b"@_%+", np.uint8))], [0, 1, 2, 3], 4)

        far = lambda at, ok: ok & self.is_number[np.clip(at, 0, n - 1)]
        number_left = far(begin - 2, (before == 32) & (begin - 2 >= first))
        number_right = far(end + 1, (after == 32) & (end + 1 < stretch_end))
        p, q = self.digits[begin], self.digits[end]
        even = self.luhn[0][q] - self.luhn[0][p]
        odd = self.luhn[1][q] - self.luhn[1][p]
        good = (np.where(q % 2 == 0, odd, even) % 10 == 0) & (digits >= 12) & (digits <= 19)
        plain = (span(self.words) + span(self.mixed) + ats + marks[3] + marks[4] + marks[5] + marks[6] + marks[7] + span(self.others)) == 0
        shape = np.where(groups == 1, 1, np.where((groups == 4) & (span(self.fours) == 4), 2, 3)) * plain
        longest = np.zeros(len(begin), np.int64)
        for k in range(LONGEST):
            longest = np.maximum(longest, np.where(begin + k <= last, self.longest[least(begin + k, n - 1)], 0))
        tail_four = self.is_number[last] & (self.size[last] == 4)
        dotted = (marks[2] > 0) & self.is_word[last] & (self.size[last] >= 2) & (np.where(last > begin, self.char[last - 1], 0) == 46)
        present = sum((m > 0).astype(np.int64) << i for i, m in enumerate(marks))
        shown = np.select([self.is_number[begin], self.is_word[begin], head == 43, head == 40], [0, 1, 2, 3], 4)
        closing = np.select([self.is_number[last], self.is_word[last], tail == 41], [0, 1, 2], 3)
        in_range = np.select([digits < 9, digits < 10, digits <= 11, digits <= 15], [0, 1, 2, 3], 4)
        return {
            "digits": least(digits, 20), "letters": least(span(self.words), 4), "mixed": least(span(self.mixed), 3),
            "at": least(ats, 2) * 3 + dotted * (1 + (marks[0] > 0)), "marks": present,
            "groups": least(groups, 8) * 7 + longest, "ends": shown * 4 + closing, "card": good * 4 + shape,
            "octets": ((groups == 4) & (span(self.octets) == 4)) * 4 + ((marks[2] == 3) & (span(self.words) + span(self.mixed) == 0)) * 2 + (last - begin == 6),
            "sides": side(before) * 5 + side(after), "numbers": number_left * 2 + number_right,
            "phone": in_range * 4 + (head == 43) * 2 + tail_four, "tokens": last - begin + 1, "tail": least(self.size[last], 5) * 2 + self.is_number[last],
        }

    def index(self, begin: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
        """The weight that each segment uses, feature by feature."""
        for name, value in self.features(begin, last).items():
            yield value + _OFFSETS[name]


class Field:
    """weights: per feature and kind. follow: [kind before, kind], 0 being outside."""

    def __init__(self, weights: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.weights = np.zeros((_FEATURES, len(KINDS))) if weights is None else weights
        self.follow = np.zeros((len(KINDS) + 1,) * 2) if follow is None else follow

    def _scores(self, of: Stretches, low: int, high: int) -> np.ndarray:
        """[token - low, tokens - 1, kind] of segments that end in these tokens."""
        out = np.full((high - low, LONGEST, len(KINDS)), -np.inf)
        begin, last = of.candidates(low, high)
        if len(begin):
            out[last - low, last - begin] = sum(self.weights[at] for at in of.index(begin, last))
        return out

    def decode(self, of: Stretches) -> Iterator[tuple[int, int, int, int]]:
        """(stretch, first character, kind, end) of the best segmentation's segments."""
        order = np.argsort(of.count, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and of.count[order[end]] * (end + 1 - at) <= _TOKENS:
                end += 1
            yield from self._viterbi(of, order[at:end])
            at = end

    def _viterbi(self, of: Stretches, which: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        first, n, k = of.first[which], of.count[which], len(KINDS)
        rows, most = len(which), int(n.max(initial=0))
        low = high = 0
        scores = None
        if rows > 1:  # together they are short
            flat = np.concatenate([self._scores(of, f, f + c) for f, c in zip(first.tolist(), n.tolist())] or [np.zeros((0, LONGEST, k))])
            place = np.cumsum(n) - n
        kept = np.full((most + 1, rows, k + 1), -np.inf)
        kept[0, :, 0] = 0
        come = np.full((most + 1, rows, k + 1), -np.inf)  # best way to where a segment of a kind begins
        from_kind = np.zeros((most + 1, rows, k + 1), np.int8)
        length = np.ones((most + 1, rows, k + 1), np.int8)
        for t in range(most):
            both = kept[t][:, :, None] + self.follow
            from_kind[t] = both.argmax(1)
            come[t] = both.max(1)
            if rows > 1:
                now = np.where((t < n)[:, None, None], flat[np.minimum(place + t, len(flat) - 1)], -np.inf)
            else:
                if t >= high:
                    low, high = t, min(most, t + _TOKENS)
                    scores = self._scores(of, int(first[0]) + low, int(first[0]) + high)
                now = scores[t - low][None]
            deep = min(LONGEST, t + 1)
            ways = come[t + 1 - deep : t + 1][::-1, :, 1:].transpose(1, 0, 2) + now[:, :deep]
            kept[t + 1, :, 1:] = ways.max(1)
            length[t + 1, :, 1:] = ways.argmax(1) + 1
            kept[t + 1, :, 0] = come[t][:, 0]
        for r in range(rows):
            t = int(n[r])
            kind = int(kept[t, r].argmax())
            while t > 0:
                begin = t - int(length[t, r, kind])
                if kind:
                    a, b = of.start[first[r] + begin], of.end[first[r] + t - 1]
                    yield int(which[r]), int(a - of.edges[which[r]]), kind - 1, int(b - of.edges[which[r]])
                kind, t = int(from_kind[begin, r, kind]), begin

    def slope(self, of: Stretches, begin: np.ndarray, last: np.ndarray, index: list[np.ndarray], gold: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood and its slope by weights and follow. gold: [segment, kind], 1 where a
        segment is right; pairs: how often kinds follow each other in the right segmentations."""
        n, rows, k, most = of.count, len(of.count), len(KINDS), int(of.count.max())
        score = np.full((len(of.start), LONGEST, k), -np.inf)
        own = sum(self.weights[at] for at in index)
        score[last, last - begin] = own
        place = np.minimum(of.first[:, None] + np.arange(most), len(of.start) - 1)
        now = np.where((np.arange(most) < n[:, None])[:, :, None, None], score[place], -np.inf)

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        ahead = np.full((most + 1, rows, k + 1), -np.inf)
        ahead[0, :, 0] = 0
        come = np.full((most + 1, rows, k + 1), -np.inf)
        for t in range(most):
            come[t] = total(ahead[t][:, :, None] + self.follow, 1)
            deep = min(LONGEST, t + 1)
            ahead[t + 1, :, 1:] = total(come[t + 1 - deep : t + 1][::-1, :, 1:].transpose(1, 0, 2) + now[:, t, :deep], 1)
            ahead[t + 1, :, 0] = come[t][:, 0]
        z = total(ahead[n, np.arange(rows)], 1)
        back = np.full((most + LONGEST + 1, rows, k + 1), -np.inf)
        go = np.full((most + 1, rows, k + 1), -np.inf)
        back[n, np.arange(rows)] = 0
        for t in range(most - 1, -1, -1):
            deep = min(LONGEST, most - t)
            steps = np.arange(deep)
            ways = now[:, t + steps, steps] + back[t + 1 : t + 1 + deep, :, 1:].transpose(1, 0, 2)
            go[t, :, 1:] = total(ways, 1)
            go[t, :, 0] = np.where(t < n[:, None], back[t + 1], -np.inf)[:, 0]
            back[t] = np.where((t < n)[:, None], total(self.follow[None] + go[t][:, None, :], 2), back[t])
        row = of.of[begin]
        a, b = begin - of.first[row], last - of.first[row]
        chance = np.exp(come[a, row, 1:] + own + back[b + 1, row, 1:] - z[row][:, None])
        rest = gold - chance
        slope = np.zeros_like(self.weights)
        for at in index:
            for kind in range(k):
                slope[:, kind] += np.bincount(at, rest[:, kind], _FEATURES)
        alive = np.arange(most)[:, None] < n
        between = np.exp(ahead[:most, :, :, None] + self.follow + go[:most, :, None, :] - z[None, :, None, None])
        follow = pairs - np.where(alive[:, :, None, None], between, 0).sum((0, 1))
        likely = float((gold * own).sum() + (pairs * self.follow).sum() - z.sum())
        return likely, slope, follow

    def fit(self, texts: list[str], spans: list[list[tuple[int, int, int]]], steps: int = 50, rate: float = 0.25, keep: float = 0.05) -> Field:
        """``spans``: (start, kind, end) of the right segments of each text, without overlap. Texts
        with a span that is no segment (it ends within a token, or is too long) teach nothing."""
        lessons = []
        few = [len(re.findall(r"[A-Za-z0-9]+|.", t)) <= 12 for t in texts]
        for short in (True, False):  # apart, as all of a part are padded to its longest
            part = [(t, s) for t, s, f in zip(texts, spans, few) if f == short]
            if lesson := self._lesson(part):
                lessons.append(lesson)
        state = [np.zeros_like(v) for v in (self.weights, self.weights, self.follow, self.follow)]
        for step in range(1, steps + 1):
            slopes = [self.slope(*lesson)[1:] for lesson in lessons]
            for i, values in enumerate((self.weights, self.follow)):
                up = sum(s[i] for s in slopes) - keep * values
                state[2 * i] = 0.9 * state[2 * i] + 0.1 * up
                state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * up * up
                values += rate * state[2 * i] / (1 - 0.9**step) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
        return self

    def _lesson(self, part: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple | None:
        """What ``slope`` takes, of the texts whose spans are segments."""
        of = Stretches([t for t, _ in part], [[] for _ in part])
        segments = set(zip(*(x.tolist() for x in of.candidates(0, len(of.start)))))
        starts, ends = {int(a): i for i, a in enumerate(of.start)}, {int(b): i for i, b in enumerate(of.end)}
        fits = [all((starts.get(a + e), ends.get(b + e)) in segments for a, _, b in right) for (_, right), e in zip(part, of.edges.tolist())]
        part = [p for p, ok, n in zip(part, fits, of.count.tolist()) if ok and 0 < n <= FIT_TOKENS]
        if not part:
            return None
        of = Stretches([t for t, _ in part], [[] for _ in part])
        begin, last = of.candidates(0, len(of.start))
        number = {pair: i for i, pair in enumerate(zip(begin.tolist(), last.tolist()))}
        gold, pairs = np.zeros((len(begin), len(KINDS))), np.zeros_like(self.follow)
        for r, (_, right) in enumerate(part):
            before, at = 0, int(of.first[r])
            for start, kind, end in sorted(right):
                a = int(np.searchsorted(of.start, start + of.edges[r]))
                b = int(np.searchsorted(of.end, end + of.edges[r]))
                gold[number[a, b], kind] = 1
                if a > at:
                    pairs[before, 0] += 1
                    pairs[0, 0] += a - at - 1
                    before = 0
                pairs[before, kind + 1] += 1
                before, at = kind + 1, b + 1
            if left := int(of.first[r] + of.count[r]) - at:
                pairs[before, 0] += 1
                pairs[0, 0] += left - 1
        return of, begin, last, list(of.index(begin, last)), gold, pairs


def made(count: int = MADE, seed: int = SEED) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Stretches with their right spans: one to three of these four kinds and of numbers, names
    and codes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(of[int(i)] for i in rng.integers(0, len(of), n))

    def card() -> str:
        n = pick([16, 16, 16, 15, 13, 19])
        body = pick("3456") + digits(n - 2)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if n == 16:
            return pick(["", "", " ", "-", "."]).join(number[i : i + 4] for i in range(0, 16, 4))
        return pick([number, " ".join((number[:4], number[4:10], number[10:]))]) if n == 15 else number

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{pick('12346789')} ({a}) {b}-{c}", f"+{pick('12346789')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(7)}", f"+{digits(2)}.{a}.{b}.{c}"])

    def mail() -> str:
        name = pick([letters(int(rng.integers(2, 9))), letters(4) + "." + digits(2), letters(3) + "_" + letters(4)])
        host = pick(["mail", "post", ""]) + letters(3) + pick(["", digits(1)]) + "." + pick(["example.", "", "co."]) + pick(["com", "org", "net", "de"])
        return name + pick(["@", "@", "@", " @ ", "[at]", "(at)"]) + host

    def address() -> str:
        return pick([".", ".", ".", "[.]"]).join(str(v) for v in rng.integers(0, 256, 4))

    def none() -> str:
        hexes = letters(int(rng.integers(8, 40)), "0123456789abcdef")
        bad = next(n for n in iter(lambda: digits(16), "") if not luhn(n))
        return pick([digits(int(rng.integers(1, 9))), digits(int(rng.integers(1, 4))), f"{digits(1)}.{digits(1)}.", f"{digits(1)}.{digits(2)}.{digits(2)}", f"19{digits(2)}-0{pick('123456789')}-{pick('12')}{digits(1)}", f"{digits(3)}.{digits(2)}", "5" + hexes, hexes + "7", "AK" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), letters(3) + digits(3), bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{rng.integers(256, 999)}.{rng.integers(256, 999)}.{digits(2)}.{digits(1)}", f"{letters(4)}@{letters(5)}", f"@{letters(5)}{digits(2)}", f"({digits(3)})", f"+{digits(3)}", f"{digits(3)}-{digits(4)}", digits(int(rng.integers(20, 30)))])

    makers = [mail, address, card, phone]
    texts, spans = [], []
    for _ in range(count):
        parts, right, at = [], [], 0
        for _ in range(int(rng.choice([1, 2, 3], p=[0.5, 0.35, 0.15]))):
            kind = int(rng.integers(0, 8))
            text = makers[kind]() if kind < 4 else none()
            open_, close = pick([("", "")] * 6 + [("(", ")"), ("", "."), ("[", "]")])
            if kind < 4:
                right.append((at + len(open_), kind, at + len(open_) + len(text)))
            parts.append(open_ + text + close)
            at += len(parts[-1]) + 1
        texts.append(" ".join(parts))
        spans.append(right)
    return texts, spans


def _open(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(place, stretch, base spans that touch it) of every stretch."""
    at = 0
    for m in _STRETCH.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        end = at
        while end < len(spans) and spans[end][0] < m.end():
            end += 1
        yield m.start(), m[0], [s for s in spans[at:end] if s[2] > m.start()]


def _may_hold(stretch: str, place: int, touching: list[tuple[int, int, int]]) -> bool:
    """Whether anything is left of a stretch, besides its base spans, that a segment could be."""
    rest, at = [], 0
    for s in touching:
        rest.append(stretch[at : max(at, s[0] - place)])
        at = max(at, s[2] - place)
    rest = " ".join([*rest, stretch[at:]])
    return "@" in rest or "at]" in rest.lower() or "at)" in rest.lower() or len(_DIGITS.findall(rest)) >= 4


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """The field, from made stretches and those of some documents of the corpus."""
    texts, spans = made()
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    count = docs.count()

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for place, stretch, touching in _open(text, base):
                    apart = all(a[2] <= b[0] for a, b in zip(touching, touching[1:]))
                    inside = all(s[0] >= place and s[2] <= place + len(stretch) for s in touching)
                    if len(stretch) <= 80 and apart and inside and (not _may_hold(stretch, place, touching) or " " not in stretch and not touching):
                        found.add((stretch, ";".join(f"{a - place},{k},{b - place}" for a, k, b in touching)))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["stretch", "spans"])

    chosen = docs.where(F.col("text").isNotNull()).where(key < min(1.0, fit_docs / max(1, count))).select("text")
    rows = chosen.mapInArrow(tidy(certain), "stretch string, spans string").distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(FIT_STRETCHES)
    for stretch, right in rows.collect():
        texts.append(stretch)
        spans.append([tuple(map(int, s.split(","))) for s in right.split(";") if s])
    return Field().fit(texts, spans)


def find_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text: (start, kind, end), sorted."""
    base = [base_spans(t) for t in texts]
    stretches, blocked, owner = [], [], []
    for i, (text, spans) in enumerate(zip(texts, base)):
        for place, stretch, touching in _open(text, spans):
            if _may_hold(stretch, place, touching):
                stretches.append(stretch)
                blocked.append([(s[0] - place, s[2] - place) for s in touching])
                owner.append((i, place))
    more: list[list[tuple[int, int, int]]] = [list(spans) for spans in base]
    if stretches:
        for k, a, kind, b in field.decode(Stretches(stretches, blocked)):
            i, place = owner[k]
            more[i].append((a + place, kind, b + place))
    return [(spans, sorted(every)) for spans, every in zip(base, more)]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _hot(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit or @."""
    data, offsets = text_bytes(column)
    sums = np.concatenate([[0], np.flatnonzero(_TRIGGER[data])])  # places of all of them
    return np.searchsorted(sums[1:], offsets[1:]) > np.searchsorted(sums[1:], offsets[:-1])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all of them)."""
    field = fit(docs) if field is None else field
    nothing = (hashlib.sha256(b"").hexdigest(), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=1 << 20):
                hot = np.flatnonzero(_hot(part.column("text")))
                counts = np.zeros((part.num_rows, len(KINDS)), np.int64)
                sums, lists = [nothing[0]] * part.num_rows, [nothing[1]] * part.num_rows
                found = find_spans(part.column("text").take(pa.array(hot)).to_pylist(), field)
                for row, (base, every) in zip(hot.tolist(), found):
                    for _, kind, _ in base:
                        counts[row, kind] += 1
                    sums[row] = hashlib.sha256(spelled(base).encode()).hexdigest()
                    lists[row] = spelled(every)
                columns = [part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(sums, pa.string()), pa.array(lists, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
