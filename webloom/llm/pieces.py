"""Distinct pieces of many texts, found with array operations.

Most pieces of a text repeat. The texts of a chunk are joined into one array of
code points; pieces get a polynomial hash from prefix sums, equal hashes are
confirmed character by character, and only one of each kind of piece is ever
handled as a string. What belongs to the kinds (ids, counts, scores) is then
laid out over all pieces with gathers.
"""

from __future__ import annotations

import dataclasses
import functools
import re

import numpy as np

#: Stands between texts; a lone surrogate never occurs in valid UTF-8.
SEPARATOR = "\ud800"

#: Longer texts are handled in parts of about so many characters.
PART_CHARS = 500_000

#: A part begins with a space between two letters or digits of any script, or with a stop after a
#: letter that stays itself in lower case, where no word or piece goes on and nothing composes.
_PLAIN = r"A-Za-z0-9\u0621-\u064a\u0905-\u0939\u0e01-\u0e2e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
_STOP = r",.;:!?()\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c\u300d\u0964\u060c\u061b\u061f\u06d4"
_CUT = re.compile(rf"[^\W_](?= [^\W_])|[{_PLAIN}](?=[{_STOP}])")

_BASE = 0x9E3779B97F4A7C15


def parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """The text in parts of about `limit` characters; whole where there is no place for a cut."""
    found, at = [], 0
    while len(text) - at > limit and (m := _CUT.search(text, at + limit)):
        found.append(text[at : m.end()])
        at = m.end()
    return [*found, text[at:]]


def join(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, its code points, first and last place of each text)."""
    joined = SEPARATOR.join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), first, first + lengths


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclasses.dataclass
class Pieces:
    """kinds: the distinct pieces; number: the kind of every piece; ends: for each text, the pieces up to its end."""

    kinds: list[str]
    number: np.ndarray
    ends: np.ndarray

    def lay_out(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pieces in order, values up to the end of each text); `flat` holds `sizes` values for each kind."""
        values, before = ragged(flat, np.cumsum(sizes) - sizes, sizes, self.number)
        return values, before[self.ends]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of `flat` that `number` names, one after the other; values before each run and after the last)."""
    each = sizes[number]
    before = np.concatenate([[0], np.cumsum(each)])
    return flat[np.arange(before[-1]) + np.repeat(starts[number] - before[:-1], each)], before


def distinct(joined: str, cps: np.ndarray, starts: np.ndarray, stops: np.ndarray, last: np.ndarray) -> Pieces:
    """The pieces [starts, stops) of the joined text by kind; `last`: where each text ends."""
    ends = np.searchsorted(starts, last)
    if not len(starts):
        return Pieces([], np.zeros(0, np.int64), ends)
    sizes = stops - starts
    up, down = _powers(1 << int(len(cps)).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps + np.uint32(1)) * up[: len(cps)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if not _confirmed(cps, starts, sizes, first[number]):
        return _by_string(joined, starts, stops, ends)
    return Pieces([joined[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())], number, ends)


def _confirmed(cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: np.ndarray) -> bool:
    """Whether every piece has the characters of its model."""
    if (sizes != sizes[model]).any():
        return False
    before = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
    return bool((cps[at] == cps[at + np.repeat(starts[model] - starts, sizes)]).all())


def _by_string(joined: str, starts: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> Pieces:
    """The same without hashes, should two kinds ever share one."""
    place: dict[str, int] = {}
    number = [place.setdefault(joined[a:b], len(place)) for a, b in zip(starts.tolist(), stops.tolist())]
    return Pieces(list(place), np.array(number, np.int64), ends)
