"""Units of text that a tokenizer treats alike wherever they stand: found by numpy, encoded once, put together again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vigilog.llm.common import span_hashes

_SPACE, _FEED = 0x20, 0x0A
_IS_SPACE, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_SPACE[[_SPACE, *range(0x09, 0x0E)]] = True
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words that aren't divided: beyond U+024F, and between U+0080 and U+00BF, where signs and letters mix.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, *range(0xCA, 0x100)]] = True


def join(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts as one, and where each begins, with the end of all at last."""
    return b"".join(texts), np.cumsum([0, *map(len, texts)])


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[at] = True
    return out[:n]


def letter_edges(data: np.ndarray, starts: np.ndarray, whole: tuple[int, ...] = ()) -> np.ndarray:
    """Where letters up to U+024F and other characters meet, but not in words with a byte of `whole` or with characters that are neither for sure.

    A space stays with what follows it.
    """
    n = len(data)
    space = _IS_SPACE[data]
    unsure = _UNSURE[data]
    for b in whole:
        unsure |= data == b
    sign = np.flatnonzero(data == 0xC3)
    sign = sign[sign + 1 < n]
    unsure[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = True
    letter = _IS_LETTER[data]
    edge = np.zeros(n, bool)
    edge[1:] = (letter[1:] != letter[:-1]) & ~space[1:] & ~space[:-1]
    if unsure.any():
        word = np.cumsum(space | _marked(n, starts))
        edge &= ~np.bincount(word, weights=unsure, minlength=int(word[-1]) + 1).astype(bool)[word]
    return edge


def byte_pair_edges(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units of a byte-level BPE begin: its pattern divides there whatever stands on either side.

    Of a run of white space before a word the last one is apart, and a space there belongs to the word.
    """
    n = len(data)
    first = _marked(n, starts)
    space = _IS_SPACE[data]
    before = np.r_[False, space[:-1]] & ~first
    ends = np.r_[first[1:], True]
    after = np.r_[~space[1:], False] & ~ends
    edge = first | (space & ~before) | (space & after) | (~space & before & (np.r_[0, data[:-1]] != _SPACE))
    return edge | letter_edges(data, starts, (0x27,))


def piece_edges(data: np.ndarray, starts: np.ndarray, divide_letters: bool) -> np.ndarray:
    """Where units begin that no piece reaches over: at runs of spaces and around line feeds."""
    n = len(data)
    first = _marked(n, starts)
    space, feed = data == _SPACE, data == _FEED
    edge = first | (space & ~np.r_[False, space[:-1]]) | feed | np.r_[False, feed[:-1]]
    return edge | letter_edges(data, starts) if divide_letters else edge


class UnitCache:
    """Ids of units, encoded once each; a bounded number of units is remembered, by 64-bit hashes.

    encode gives the ids of many units, one after the other, and how many each has. Hashes are looked up all at once in an
    open-addressed table that is never more than half full.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.count, self.used = 0, 0
        self.mask = (1 << (2 * self.most - 1).bit_length()) - 1
        self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it isn't known. No hash is 0."""
        out = np.full(len(hashes), -1, np.int64)
        rows, at = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            key = self.keys[at]
            hit = key == hashes[rows]
            out[rows[hit]] = self.slots[at[hit]]
            on = ~hit & (key != 0)
            rows, at = rows[on], (at[on] + 1) & self.mask
        return out

    def _add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)]
        n, more = self.count, len(hashes)
        if n + more > len(self.size):
            self.begin, self.size = (np.r_[x[:n], np.zeros(n + 2 * more, np.int64)] for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + more] = sizes
        self.begin[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), n + more
        rows, at = np.arange(more), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.keys[at] == 0)
            place, first = np.unique(at[free], return_index=True)
            done = rows[free[first]]
            self.keys[place], self.slots[place] = hashes[done], n + done
            left = np.ones(len(rows), bool)
            left[free[first]] = False
            rows, at = rows[left], (at[left] + 1) & self.mask

    def __call__(self, joined: bytes, starts: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        begin = np.flatnonzero(edge)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        end = np.r_[begin[1:], len(joined)]
        hashes = np.maximum(span_hashes(joined, begin, end), np.uint64(1))
        slot = self._find(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.count + len(new) > self.most:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            self._add(new, *self.encode([joined[begin[i] : end[i]] for i in missing[at]]))
            slot[missing] = self._find(hashes[missing])
        size = self.size[slot]
        upto = np.cumsum(size)
        place = np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto + size, size)
        ids_before = np.r_[0, upto][np.searchsorted(begin, starts)]
        return self.ids[place], np.diff(ids_before)
