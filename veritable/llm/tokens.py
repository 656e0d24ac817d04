"""Exact tokenization of many texts through a cache of their pieces.

A pre-tokenizer never joins characters on both sides of white space, so a text's ids are the
ids of its pieces, one after another. Pieces repeat far more often than texts do: each is
encoded once by the tokenizers library and looked up from then on.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veritable.llm.common import text_bytes
from veritable.llm.words import run_hashes

#: The characters with Unicode's White_Space property.
_WHITE = "\t-\r \x85\xa0  -     　"
#: Letters of which every tokenizer here makes words, and signs that it never joins to them;
#: a word that such signs end, before white space, is a piece without them.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r".,!?;:%$&*#|"
_END = f"(?=[{_WHITE}]|$)"
#: How a text is cut for each family. ``byte`` keeps one leading blank with a word and leaves
#: other white space to itself, as byte-level pre-tokenizers do; ``word`` drops white space.
CUTS = {
    "byte": re.compile(f" ?[{_LETTER}]++(?=[{_SIGN}]++{_END})|[{_SIGN}]++{_END}| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"),
    "word": re.compile(f"[{_LETTER}]++(?=[{_SIGN}]++{_END})|[{_SIGN}]++{_END}|[^{_WHITE}]+"),
}
#: The mark, and how byte-level vocabularies show it; what a piece may hold to stand beside one.
_MARK, _SHOWN = "\x01", "ā"
_PLAIN = f"^ ?[0-9{_LETTER}{_SIGN}'\"()\\-]+$"
#: Words that need no mark: a token with the blank begins one, or one with the sign of a word's
#: end ends it, by the family.
_WORD = {"byte": f"^ [{_LETTER}]+$", "word": f"^[{_LETTER}]+$"}
_BLANK, _WORD_END = "Ġ", "</w>"
#: The same cuts in the other regular-expression library, which has no look-ahead: a word and
#: the signs that end it; and texts that need the look-ahead (for ``byte``, white space beside
#: white space) or hold the mark.
_RE2_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RE2_END = rf"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%$&*#|]+)([\t-\r ]|$)"
_RE2_ODD = {"word": _MARK, "byte": rf"[{_RE2_WHITE}][{_RE2_WHITE}]|{_MARK}|[\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"}
#: For ``byte``, the same by bytes: signs, white space, and what begins or is a character that only
#: the expressions tell.
_IS_SIGN, _IS_WHITE, _IS_RARE = 1, 2, 4
_BYTES = bytes(
    _IS_SIGN if chr(c) in ".,!?;:%$&*#|" else _IS_WHITE if c == 32 or 9 <= c <= 13 else _IS_RARE if c in (1, 0xC2, 0xE1, 0xE2, 0xE3) else 0 for c in range(256)
)
#: Characters that byte-level vocabularies show bytes as: itself if it is printed, else one of those
#: from 256 on.
_PRINTED = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
_UNPRINTED = {c: 256 + k for k, c in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_SHOWN_BYTES = "".join(chr(_UNPRINTED.get(c, c)) for c in range(256))
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Pieces kept at most; and those, most used, that stay beyond that and from a task to the next
#: of its worker. Most words that are learned are rare ones, and learning is half the work.
MOST_PIECES, KEPT_PIECES = 1 << 19, 3 << 17


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hashed(pieces: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(pieces)
    sizes = np.diff(offsets, append=len(data) + 1)  # one byte more, so that a last empty piece has a place
    return np.where(sizes, run_hashes(np.append(data, np.uint8(0)), offsets, sizes), np.uint64(0))[:-1]


class PieceTokenizer:
    """``piece_tokenizer`` gives one per worker process; tasks cut its cache down when they end."""

    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.kind, self.cut = cut, CUTS[cut]
        self.words = self._for_words(path) if cut == "byte" else None
        self.mark = self._find_mark()
        self.edge = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.startswith(_BLANK) if cut == "byte" else token.endswith(_WORD_END)
        self._clear()

    def _find_mark(self) -> int | None:
        """The id of a control character that no other token holds: between pieces it shows
        where each one's ids end. None if the vocabulary has such tokens."""
        alone = self.library.encode(_MARK, add_special_tokens=False)
        holds = [t for t in self.library.get_vocab() if _SHOWN in t]
        return alone.ids[0] if len(alone.ids) == 1 and set(holds) <= {_SHOWN, _SHOWN + "</w>"} else None

    @staticmethod
    def _for_words(path: str):
        """The library for words of letters with their blank, given as byte-level vocabularies show
        them: it needs only to part them at the blanks. None if the tokenizer does more than that."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["normalizer"] or not _BYTE_LEVEL.items() <= (told["pre_tokenizer"] or {}).items():
            return None
        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True
        words.no_padding()
        words.no_truncation()
        words.pre_tokenizer = pre_tokenizers.Split(_BLANK, "merged_with_next")
        return words

    def _alone(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids, one after another, and their numbers."""
        ids = [e.ids for e in self.library.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _together(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for ordinary pieces, encoded by the thousand: words of letters side by side,
        any others with a mark on a line of its own between them."""
        if pc.all(pc.match_substring_regex(pieces, _WORD[self.kind])).as_py():
            flat = np.concatenate(self._lines(pieces, "" if self.kind == "byte" else " "))
            edges = np.flatnonzero(self.edge[flat])
            counts = np.diff(edges, append=len(flat)) if self.kind == "byte" else np.diff(edges, prepend=-1)
            if len(counts) == len(pieces) and counts.sum() == len(flat):
                return flat, counts
        line = f"\n{_MARK}\n"
        every = self._lines(pieces, line, line)
        flat = np.concatenate(every)
        is_mark = flat == self.mark
        drop = is_mark.copy()
        for k in range(1, int(np.argmax(is_mark)) + 1):  # ids of the line break before a mark, the same after it
            drop[:-k] |= is_mark[k:]
            drop[k:] |= is_mark[:-k]
        # each text has one mark before each piece, and one at its end that starts no piece
        marks = np.cumsum([int(np.count_nonzero(x == self.mark)) for x in every])
        counts = np.bincount(np.cumsum(is_mark)[~drop], minlength=int(marks[-1]) + 1)[1:]
        return flat[~drop], np.delete(counts, marks - 1).astype(np.int64)

    def _lines(self, pieces: pa.Array, between: str, around: str = "") -> list[np.ndarray]:
        """Ids of each thousand pieces as one text."""
        edges = pa.array(np.append(np.arange(0, len(pieces), 1000), len(pieces)).astype(np.int32))
        joined, library = pc.binary_join(pa.ListArray.from_arrays(edges, pieces), between), self.library
        if self.words and not between:
            library, texts = self.words, [codecs.charmap_decode(t, "strict", _SHOWN_BYTES)[0] for t in joined.cast(pa.binary()).to_pylist()]
        else:
            texts = [f"{around}{t}{around}" for t in joined.to_pylist()]
        # the library's own results are many times larger than ids: a few at once
        few = (texts[k : k + 16] for k in range(0, len(texts), 16))
        return [np.array(e.ids, np.uint32) for some in few for e in library.encode_batch_fast(some, add_special_tokens=False)]

    def _clear(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of the hashes
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.uses = np.zeros(1 << 14, np.int64)
        self.learning = False

    @property
    def numbers(self) -> list[str]:
        """The pieces that are known, by their numbers."""
        return self.pieces.to_pylist()

    def forget(self) -> None:
        """Keep the pieces that were used most, as other stages share the worker; none if a
        task broke off while it learned some."""
        if self.learning:
            self._clear()
        n = len(self.pieces)
        if n > KEPT_PIECES:
            kept = np.sort(np.argpartition(self.uses[:n], n - KEPT_PIECES)[n - KEPT_PIECES :])
            pieces, sizes, starts, uses, flat = self.pieces.take(pa.array(kept)), self.size[kept], self.start[kept], self.uses[kept] // 2, self.flat
            self._clear()
            self._add(pieces, _hashed(pieces))
            self.size, self.uses, self.start = sizes, uses, (np.cumsum(sizes) - sizes).astype(np.int32)
            self.used = int(sizes.sum())
            self.flat = flat[np.repeat(starts - self.start, sizes) + np.arange(self.used)]
        if self.used > 1 << 22:
            self._clear()

    def _add(self, new: pa.Array, h: np.ndarray) -> None:
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.places = np.insert(self.hashes, at, h[order]), np.insert(self.places, at, len(self.pieces) + order)
        self.pieces = pa.concat_arrays([self.pieces, new])

    def _learn(self, new: pa.Array, h: np.ndarray) -> None:
        self.learning = True
        first = len(self.pieces)
        if first + len(new) > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([a, np.zeros(first + len(new), a.dtype)]) for a in (self.start, self.size, self.uses))
        plain, word = (pc.match_substring_regex(new, r).to_numpy(zero_copy_only=False) & (self.mark is not None) for r in (_PLAIN, _WORD[self.kind]))
        for chosen, encode in ((np.flatnonzero(word), self._together), (np.flatnonzero(plain & ~word), self._together), (np.flatnonzero(~plain), self._alone)):
            if not len(chosen):
                continue
            ids, sizes = encode(new.take(pa.array(chosen)))
            need = self.used + len(ids)
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * need, np.uint32)])
            self.flat[self.used : need] = ids
            self.start[first + chosen] = self.used + np.cumsum(sizes) - sizes
            self.size[first + chosen] = sizes
            self.used = need
        self._add(new, h)
        self.learning = False

    def _numbered(self, names: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; those that are new are learned. A hash only proposes a
        piece: one that is not the same to the letter is learned again."""
        h = _hashed(names)
        numbers = np.full(len(names), -1, np.int64)
        if len(self.hashes):
            order, at = np.argsort(h), np.empty(len(h), np.int64)
            at[order] = np.searchsorted(self.hashes, h[order])  # in order, as a cache prefers
            at = np.minimum(at, len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == h)
            found = self.places[at[known]]
            same = pc.equal(names.take(pa.array(known)), self.pieces.take(pa.array(found))).to_numpy(zero_copy_only=False)
            numbers[known[same]] = found[same]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.pieces) + np.arange(len(new))
            self._learn(names.take(pa.array(new)), h[new])
        return numbers

    def _by_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts and each text's number of pieces; each distinct piece
        of the slice is looked up once."""
        if self.kind == "byte":
            return self._by_bytes(texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _RE2_END, r"\1 \2\3"))
        return self._codes(lists.flatten()), np.diff(lists.offsets.to_numpy()).astype(np.int64)

    def _by_bytes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where pieces lie side by side: nothing is copied. A piece begins with a text, at
        a blank, at a line break and after it, and at the signs that end a word."""
        data, edges = text_bytes(texts)
        kinds = np.frombuffer(data.tobytes().translate(_BYTES), np.uint8)
        breaks, sign = data == 10, kinds == _IS_SIGN
        bound = np.zeros(len(data) + 1, bool)
        bound[edges] = True
        cut = bound[:-1] | breaks | (data == 32)
        cut[1:] |= breaks[:-1]
        begins, ends = sign.copy(), sign.copy()
        begins[1:] &= ~sign[:-1] | bound[1:-1]
        ends[:-1] &= ~sign[1:] | bound[1:-1]
        first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        left = data[first - 1]
        letter = ((left | np.uint8(32)) - np.uint8(97) < 26) | ((left >= 0x80) & (left < 0xC0) & (left != 0x97) & (left != 0xB7) & (data[first - 2] == 0xC3))
        ended = bound[after] | (np.append(kinds, np.uint8(0))[after] == _IS_WHITE)
        cut[first[letter & ended & ~bound[first]]] = True
        at = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        return self._codes(pieces), np.diff(np.searchsorted(at, edges))

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts need the look-ahead or hold the mark."""
        if self.kind == "word":
            return pc.match_substring_regex(texts, _RE2_ODD["word"]).to_numpy(zero_copy_only=False)
        data, edges = text_bytes(texts)
        kinds = np.frombuffer(data.tobytes().translate(_BYTES), np.uint8)
        white, odd = kinds == _IS_WHITE, np.zeros(len(texts), bool)
        maybe = kinds == _IS_RARE
        maybe[1:] |= white[1:] & white[:-1]
        rows = np.unique(np.searchsorted(edges, np.flatnonzero(maybe), "right") - 1)
        if len(rows):
            odd[rows] = pc.match_substring_regex(texts.take(pa.array(rows)), _RE2_ODD["byte"]).to_numpy(zero_copy_only=False)
        return odd

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        distinct = pieces.dictionary_encode()
        return self._numbered(distinct.dictionary).take(distinct.indices.to_numpy())

    def _by_regex(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.cut.findall(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return self._codes(pa.array(list(chain.from_iterable(lists)), pa.string())), counts

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids; ``end`` follows each text.
        Null counts as empty."""
        if len(self.pieces) > MOST_PIECES or self.used > 1 << 23:
            self.forget()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        odd = self._odd(texts)
        if not odd.any():
            codes, pieces = self._by_arrow(texts)
        else:
            some = [self._by_regex(texts.filter(pa.array(odd)).to_pylist())]
            if not odd.all():
                some.append(self._by_arrow(texts.filter(pa.array(~odd))))
            order = np.argsort(np.concatenate([np.flatnonzero(odd), np.flatnonzero(~odd)]))
            codes, pieces = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            begin = (np.cumsum(pieces) - pieces)[order]
            pieces = pieces[order]
            codes = codes[np.repeat(begin - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(codes))]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        sizes = self.size[codes]
        stops = np.cumsum(sizes)
        at = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(pieces)])]
        counts = np.diff(at)
        ids = self.flat[np.repeat(self.start[codes] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        if end is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        return out, counts + 1


@lru_cache(maxsize=2)
def piece_tokenizer(path: str, cut: str) -> PieceTokenizer:
    return PieceTokenizer(path, cut)
