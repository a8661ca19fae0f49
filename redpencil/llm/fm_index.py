"""FM-index of word sequences: suffix order, wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import io

import numpy as np

SAMPLE = 16  # every so many words the text position of a suffix is kept


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``s`` in order; the last symbol must be unique.

    The first sort looks at as many symbols as fit into a word; after that only suffixes that are
    still tied are sorted again, each time by twice as many symbols.
    """
    n, bits = len(s), max(1, int(s.max()).bit_length())
    wide = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(wide):
        key <<= bits
        key[:max(0, n - k)] |= s[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    slots = np.arange(n)
    start = np.maximum.accumulate(np.where(np.diff(key, prepend=key[:1] - 1) != 0, slots, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        tied = start == np.append(start[1:], -1)
        tied[1:] |= tied[:-1] & (start[1:] == start[:-1])
        slots, start = slots[tied], start[tied]
        if not len(slots):
            return order
        p = order[slots]
        after = p + wide
        key = start * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        p, key = p[turn], key[turn]
        order[slots] = p
        start = np.maximum.accumulate(np.where(np.diff(key, prepend=key[:1] - 1) != 0, slots, 0))
        rank[p] = start
        wide *= 2


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, words: np.ndarray, before: np.ndarray) -> None:
        self.words, self.before = words, before

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(len(flags) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(words).astype(np.int32)
        return cls(words, np.cumsum(ones, dtype=np.int32) - ones)

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place and the ones before it."""
        word, bit = self.words[i >> 6], (i & 63).astype(np.uint64)
        below = word & ((np.uint64(1) << bit) - np.uint64(1))
        return (word >> bit) & np.uint64(1) != 0, self.before[i >> 6] + np.bitwise_count(below).astype(np.int64)


class FmIndex:
    """Index of the texts of one shard; texts are word lists, and no match runs from one into the next."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.first, self.starts = arrays["first"].astype(np.int64), arrays["starts"].astype(np.int64)
        self.levels = [Bits(*pair) for pair in zip(arrays["words"], arrays["before"], strict=True)]
        self.zeros = arrays["zeros"].tolist()
        self.marks, self.samples = Bits(arrays["mark_words"], arrays["mark_before"]), arrays["samples"].astype(np.int64)
        vocabulary = arrays["vocabulary"].tobytes().split(b" ")
        self.ids = dict(zip(vocabulary, range(1, len(vocabulary) + 1), strict=True))

    @classmethod
    def build(cls, symbols: np.ndarray, lengths: np.ndarray, vocabulary: list[bytes]) -> FmIndex:
        """``symbols``: the word numbers (from 0) of all texts in a row; ``lengths``: words of each text."""
        docs = len(lengths)
        stops = np.cumsum(lengths + 1) - 1  # where the end mark of each text stands
        ends = np.zeros(len(symbols) + docs, bool)
        ends[stops] = True
        text = np.empty(len(ends), np.int64)
        text[ends], text[~ends] = np.arange(docs), symbols + docs  # every end mark sorts as a symbol of its own
        order = suffix_order(text)
        plain = np.where(ends, 0, text - docs + 1)  # in the ranks all end marks are one symbol
        bwt = plain[order - 1]
        levels = max(1, len(vocabulary).bit_length())
        words, before, zeros, x = [], [], [], bwt
        for level in range(levels - 1, -1, -1):
            one = (x >> level) & 1 != 0
            bits = Bits.of(one)
            words.append(bits.words)
            before.append(bits.before)
            zeros.append(int(len(x) - one.sum()))
            x = np.concatenate([x[~one], x[one]])
        starts = np.concatenate([[0], stops[:-1] + 1])
        sampled = order % SAMPLE == 0
        begins = np.zeros(len(text), bool)
        begins[starts] = True  # a walk back never leaves its text
        sampled |= begins[order]
        marks = Bits.of(sampled)
        counts = np.bincount(plain, minlength=len(vocabulary) + 1)
        return cls({
            "first": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), "starts": starts.astype(np.int32),
            "words": np.array(words), "before": np.array(before), "zeros": np.array(zeros, np.int32),
            "mark_words": marks.words, "mark_before": marks.before, "samples": order[sampled].astype(np.int32),
            "vocabulary": np.frombuffer(b" ".join(vocabulary), np.uint8)})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FmIndex:
        with np.load(io.BytesIO(data)) as arrays:
            return cls({k: arrays[k] for k in arrays.files})

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``i`` of the transformed text."""
        base = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - level)) & 1 != 0
            ones, ones_base = bits.at(i)[1], bits.at(base)[1]
            i, base = np.where(one, zeros + ones, i - ones), np.where(one, zeros + ones_base, base - ones_base)
        return i - base

    def _symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbol at each place of the transformed text."""
        symbol = np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.at(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol

    def numbers(self, phrases: list[list[bytes]]) -> np.ndarray:
        """Word numbers of phrases of one length; 0 for words that the shard lacks."""
        get = self.ids.get
        return np.array([[get(w, 0) for w in p] for p in phrases], np.int64)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search: rows of ``phrases`` that occur, and the range of suffixes each begins."""
        which = np.flatnonzero((phrases > 0).all(1))
        p = phrases[which]
        low, high = self.first[p[:, -1]], self.first[p[:, -1] + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            c = p[:, column]
            ranks = self._rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.first[c] + ranks[:len(c)], self.first[c] + ranks[len(c):]
            some = low < high
            which, p, low, high = which[some], p[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word of the suffixes at these rows: walk back to a sampled one and count the steps."""
        place, at, steps = np.zeros(len(rows), np.int64), rows, 0
        walking = np.arange(len(rows))
        while len(walking):
            sampled, number = self.marks.at(at)
            place[walking[sampled]] = self.samples[number[sampled]] + steps
            walking, at = walking[~sampled], at[~sampled]
            symbol = self._symbol(at)
            at = self.first[symbol] + self._rank(symbol, at)
            steps += 1
        text = np.searchsorted(self.starts, place, side="right") - 1
        return text, place - self.starts[text]
