"""Regex-free pre-tokenisation of text for byte-level BPE.

The splitting rule is the public one for this vocabulary family:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

It is run as a finite automaton over an array of code points. The table of
character classes is asked of the library whose results must be met, once on
the driver, and sent along with the tasks. Each character, with at most two characters of look-ahead folded into its symbol, is a
transition function on eight states. Functions compose associatively, so the
state before every character comes from a prefix scan over small integers that
name the functions: inside blocks first, then over block totals.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

from webloom.llm import pieces

LETTER, NUMBER, OTHER, JOINING_SPACE, LAST_SPACE, INNER_SPACE, CONTRACTION_2, CONTRACTION_3, BREAK = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)

_BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this character)."""
    if symbol == BREAK:
        return FRESH, True
    if symbol == JOINING_SPACE:
        return AFTER_SPACE, True
    if symbol == LAST_SPACE:
        return FRESH, True
    if symbol == INNER_SPACE:
        return IN_SPACES, state != IN_SPACES
    if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (CONTRACTION_2, CONTRACTION_3):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == CONTRACTION_2 else TWO_LEFT), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
    return run, state not in (run, AFTER_SPACE)


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(generators, composition, application, starts): the transition monoid as tables."""
    of_symbol = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    known: dict[tuple, int] = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in of_symbol:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array(list(known), np.uint8)
    n = len(functions)
    compose = np.zeros((n, n), np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[s] for s in f)]
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    return np.array([known[f] for f in of_symbol], np.uint16), compose.ravel(), functions.ravel(), starts.ravel()


#: Planes that have characters (fixed values: 0 to 3 and 14); what the others may hold is no letter, number or space.
_PLANES = (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))


def _members(library: str, pattern: str, characters: str) -> str:
    """The characters that match, by the Unicode version of the library itself."""
    if library == "tiktoken":
        import tiktoken

        keeps = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return bytes(keeps.encode_ordinary(characters)).decode()
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True)
    return "".join(piece for piece, _ in split.pre_tokenize_str(characters))


@functools.cache
def classes(library: str) -> bytes:
    """Class of every code point as "tiktoken" or "tokenizers" has it, compressed: for closures of tasks."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, _PLANES))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (LAST_SPACE, r"\s")):
        table[np.frombuffer(_members(library, pattern, every).encode("utf-32-le"), np.uint32)] = kind
    table[0x20] = JOINING_SPACE
    table[ord(pieces.SEPARATOR)] = BREAK
    return zlib.compress(table.tobytes())


@functools.lru_cache(maxsize=2)
def table_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _symbols(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    symbols = table[cps]
    space = (symbols == LAST_SPACE) | (symbols == JOINING_SPACE)
    followed = np.ones(len(cps), bool)
    followed[:-1] = space[1:] | (symbols[1:] == BREAK)
    symbols[space & followed] = INNER_SPACE
    marks = np.flatnonzero(cps == 0x27)
    if len(marks):
        padded = np.zeros(len(cps) + 2, np.uint32)
        padded[:-2] = cps
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[marks[short]] = CONTRACTION_2
        symbols[marks[long]] = CONTRACTION_3
    return symbols


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by an associative scan."""
    generators, compose, apply, _ = _machine()
    n_functions = len(apply) // 8
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, np.uint16)
    padded[:n] = generators[symbols]
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    before = np.zeros((_BLOCK, blocks), np.uint16)
    acc = np.zeros(blocks, np.int64)
    for k in range(_BLOCK):
        before[k] = acc
        acc = compose[acc * n_functions + columns[k]].astype(np.int64)
    # Exclusive scan over block totals by doubling.
    totals, reach = acc, 1
    while reach < blocks:
        joined = totals.copy()
        joined[reach:] = compose[totals[:-reach] * n_functions + totals[reach:]]
        totals, reach = joined, 2 * reach
    entry = np.zeros(blocks, np.int64)
    entry[1:] = apply[totals[:-1] * 8 + FRESH]
    return apply[before.astype(np.int64) * 8 + entry].T.ravel()[:n]


def piece_starts(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of the first character of every piece (and of every separator)."""
    if not len(cps):
        return np.zeros(0, np.int64)
    symbols = _symbols(cps, table)
    states = _states_before(symbols)
    return np.flatnonzero(_machine()[3][states.astype(np.int64) * 9 + symbols])


def split(texts: list[str], packed: bytes) -> pieces.Pieces:
    """The pieces of all texts by kind, found in one pass; `packed` comes from `classes`."""
    joined, cps, _, last = pieces.join(texts)
    starts = piece_starts(cps, table_of(packed))
    stops = np.append(starts[1:], len(cps))
    own = cps[starts] != ord(pieces.SEPARATOR)
    return pieces.distinct(joined, cps, starts[own], stops[own], last)
