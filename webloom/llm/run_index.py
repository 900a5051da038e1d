"""A run-length index of a repetitive collection, and matching statistics streamed over it.

The collection's Burrows-Wheeler transform is kept as runs of equal characters,
with the text positions of the first and last row of each run. A pattern is read
from right to left, all patterns side by side: while the next character is the
one of the run that the row is in, the match grows by a step of the mapping; else
the row moves to the end of the nearest run of that character before or after it,
whichever suffix agrees for longer, and goes on from there. So every place of a
pattern gets a row whose suffix agrees with it for as long as any does. Rows that
agree for `length` characters are one class, with the smallest owner of their texts.
"""

from __future__ import annotations

import numpy as np

#: Characters are nine bits wide, as a separator comes before the 256 bytes; seven make a word.
_BITS, _WORD = 9, 7


def _words(symbols: np.ndarray) -> np.ndarray:
    """The seven characters from each place on, as one number (zeros beyond the end)."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(_WORD, np.uint64)])
    words = np.zeros(n, np.uint64)
    for k in range(_WORD):
        words = (words << np.uint64(_BITS)) | padded[k : k + n]
    return words.view(np.int64)


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that begin there, by doubling; only what is still tied is sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    tied_with = np.concatenate([[False], words[order[1:]] == words[order[:-1]]])
    heads = np.maximum.accumulate(np.where(tied_with, 0, np.arange(n)))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = heads, -1
    open_ = np.flatnonzero(tied_with | np.append(tied_with[1:], False))
    step = _WORD
    while len(open_):
        places = order[open_]
        key = (rank[places] << 32) | (rank[np.minimum(places + step, n)] + 1)
        again = np.argsort(key, kind="stable")
        key, places = key[again], places[again]
        order[open_] = places
        same = np.concatenate([[False], key[1:] == key[:-1]])
        rank[places] = open_[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
        open_ = open_[same | np.append(same[1:], False)]
        step *= 2
    return order


class RunIndex:
    """Index of `texts`, given as bytes one after the other with their sizes, and the owner of each."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int):
        ends = np.cumsum(sizes)
        self.starts = ends - sizes + np.arange(len(sizes))  # a separator ends each text
        symbols = np.zeros(len(data) + len(sizes), np.uint16)
        text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        separator = ends + np.arange(len(sizes))
        inside = np.ones(len(symbols), bool)
        inside[separator] = False
        symbols[inside] = data.astype(np.uint16) + 1
        self.length, self.symbols, self.words = length, symbols, _words(symbols)
        order = suffix_order(self.words)
        self._classes(order, separator[text_of], owners[text_of])
        before = symbols[order - 1]  # the last row's is that of the text's end
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        lengths = np.diff(np.append(first, len(before)))
        self.run_start, self.run_char = first, before[first].astype(np.int64)
        self.first_place, self.last_place = order[first], order[first + lengths - 1]  # the sampled run ends
        self.last_row = first + lengths - 1
        # Runs by character and then place: what their rows are mapped to begins where those before them end.
        self.by_char = np.argsort(self.run_char, kind="stable")
        self.keys = self.run_char[self.by_char] * len(first) + self.by_char
        mapped = np.cumsum(lengths[self.by_char]) - lengths[self.by_char]
        self.maps_to = np.empty_like(mapped)
        self.maps_to[self.by_char] = mapped

    def _classes(self, order: np.ndarray, end: np.ndarray, owner: np.ndarray) -> None:
        """First rows of classes of at least `length` equal characters, and the smallest owner of each."""
        long = end[order] - order >= self.length
        near = np.flatnonzero(long[1:] & long[:-1])
        a, b = order[near], order[near + 1]
        same = np.ones(len(near), bool)
        for k in (*range(0, self.length - _WORD, _WORD), self.length - _WORD):
            same &= self.words[a + k] == self.words[b + k]
        joined = np.zeros(len(order), bool)
        joined[near[same] + 1] = True
        self.class_row = np.flatnonzero(~joined)
        self.class_owner = np.minimum.reduceat(owner[order], self.class_row)

    def _agreement(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For how many characters, `most` at the most, the text agrees from `a` and from `b` on."""
        found, left = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        last = len(self.words) - 1
        while len(left):
            x = self.words[np.minimum(a[left] + found[left], last)] ^ self.words[np.minimum(b[left] + found[left], last)]
            equal = np.full(len(left), 0)
            for k in range(1, _WORD + 1):
                equal += (x >> (_BITS * (_WORD - k))) == 0
            found[left] += equal
            left = left[(equal == _WORD) & (found[left] < most[left])]
        return np.minimum(found, most)

    def owners_of(self, texts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """(offset of each text's windows, smallest owner of each window) of some of the texts, streamed as patterns.

        A text of n characters has n - length + 1 windows; `none` stands where nothing as long agrees.
        """
        sizes = np.diff(np.append(self.starts, len(self.symbols)))[texts] - 1
        windows = sizes - self.length + 1
        offsets = np.concatenate([[0], np.cumsum(windows)])
        found = np.full(offsets[-1], none, np.int64)
        order = np.argsort(-sizes, kind="stable")  # those still being read come first
        start, size, offset = self.starts[texts][order], sizes[order], offsets[:-1][order]
        row, match, run = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        runs = len(self.run_start)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            at = start[:live] + size[:live] - 1 - step  # where the pattern's next character is
            char = self.symbols[at].astype(np.int64)
            q, j = row[:live], run[:live]
            moved = np.flatnonzero(self.run_char[j] != char)
            if len(moved):
                c, known = char[moved], match[moved]
                place = np.searchsorted(self.keys, c * runs + j[moved])
                up, down = self.by_char[np.maximum(place - 1, 0)], self.by_char[np.minimum(place, runs - 1)]
                has_up, has_down = (place > 0) & (self.run_char[up] == c), (place < runs) & (self.run_char[down] == c)
                most = np.minimum(known, size[:live][moved])
                agree_up = np.where(has_up, self._agreement(at[moved] + 1, self.last_place[up], most), -1)
                agree_down = np.where(has_down, self._agreement(at[moved] + 1, self.first_place[down], most), -1)
                goes_up = agree_up >= agree_down
                j[moved] = np.where(goes_up, up, down)
                q[moved] = np.where(goes_up, self.last_row[up], self.run_start[down])
                match[moved] = np.maximum(agree_up, agree_down)
            q[:] = self.maps_to[j] + (q - self.run_start[j])
            match[:live] += 1  # 0 where no text has the character
            j[:] = np.searchsorted(self.run_start, q, side="right") - 1
            long = np.flatnonzero(match[:live] >= self.length)
            if len(long):
                owner = self.class_owner[np.searchsorted(self.class_row, q[long], side="right") - 1]
                found[offset[long] + size[long] - 1 - step] = owner
        return offsets, found
