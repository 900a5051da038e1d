"""Exact token counts at every prefix, for a BPE vocabulary with word ends.

A word's encoding is found by dynamic programming over its prefixes: the
encoding of a prefix is the encoding of a shorter prefix plus the one token
that is compatible with its last token, so one pass stores the count of every
prefix. Counts of whole words are summed over a text, again as a prefix table;
`tokens_of` and `words_within` answer from that table, without encoding again,
how many tokens the first words have and how many words fit a budget.

Character classes and, where a text has characters that may combine or whose
lower case is not plain, the whole normalisation are the tokenizers library's
own. Each kind of word in a chunk of texts is counted once.

Null and empty texts count 0 tokens. Special strings inside a text count as
their single token, as the library does by default. Other columns are ignored;
repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, pieces, pretokenize

CACHE_ENTRIES, CACHE_CHARS = 200_000, 64

#: Characters outside these ranges may combine with others or have an unusual lower case.
_UNUSUAL = re.compile("[^\x00-\u02ff\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3000-\u3029\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordCounter(dict):
    """word (normalised) -> its number of tokens, by prefix dynamic programming."""

    def __init__(self, path: str, classes: bytes):
        super().__init__()
        self.classes, self.normaliser = classes, tokenizer(path).normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = set(model["vocab"])
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[left, right] = rank
            self.parts[left + right] = left, right
            self.made[left + right] = rank
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._compatible: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._prefixes: dict[str, tuple[int, str]] = {}
        plain = [t for t in self.vocabulary if self._is_token(t)]
        self.inner = {t for t in plain if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)] for t in plain if t.endswith(self.end)}
        self.longest = max(map(len, self.inner | self.final))

    def _crosses(self, left: str, right: str, below: float = float("inf")) -> bool:
        """Whether some merge spans the border of two adjacent tokens before both are whole (or before rank `below`)."""
        xs = [(left, float("inf"))]
        while xs[-1][0] in self.parts:
            xs.append((self.parts[xs[-1][0]][1], self.made[xs[-1][0]]))
        ys = [(right, float("inf"))]
        while ys[-1][0] in self.parts:
            ys.append((self.parts[ys[-1][0]][0], self.made[ys[-1][0]]))
        for x, x_until in xs:
            for y, y_until in ys:
                rank = self.rank.get((x, y))
                if rank is not None and rank < below and rank < x_until and rank <= y_until:
                    return True
        return False

    def _is_token(self, token: str) -> bool:
        """Whether the merges make this token out of its own symbols."""
        if (known := self._whole.get(token)) is not None:
            return known
        if token in self.parts:
            left, right = self.parts[token]
            known = self._is_token(left) and self._is_token(right) and not self._crosses(left, right, self.made[token])
        else:
            known = len(token.removesuffix(self.end)) == 1
        self._whole[token] = known
        return known

    def _fits(self, left: str, right: str) -> bool:
        if (known := self._compatible.get((left, right))) is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[left, right] = not self._crosses(left, right)
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of word[:k] taken as a whole word, for k = 0 .. len(symbols)."""
        return self._table(word, every=True)

    def _table(self, word: str, every: bool) -> list[int]:
        s = word.encode().decode("latin-1").translate(self.symbols)
        n, inner, final, longest = len(s), self.inner, self.final, self.longest
        keep = n <= CACHE_CHARS
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for k in range(1, n):
            if keep and (known := self._prefixes.get(s[:k])) is not None:
                counts[k], last[k] = known
                continue
            for j in range(max(0, k - longest), k):
                if (token := s[j:k]) in inner and (not j or self._fits(last[j], token)):
                    counts[k], last[k] = counts[j] + 1, token
                    break
            if keep:
                if len(self._prefixes) >= CACHE_ENTRIES:
                    self._prefixes.clear()
                self._prefixes[s[:k]] = counts[k], last[k]
        ended = [0] * (n + 1)
        for k in range(1, n + 1) if every else range(n, n + 1):
            for j in range(max(0, k - longest), k):
                if (token := s[j:k]) in final and (not j or self._fits(last[j], token + self.end)):
                    ended[k] = counts[j] + 1
                    break
        return ended

    def __missing__(self, word: str) -> int:
        count = self._table(word, every=False)[-1]
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = count
        return count

    def normalise(self, text: str) -> str:
        """The text as the library cuts it into words; white space may differ."""
        return self.normaliser.normalize_str(text) if _UNUSUAL.search(text) else text.lower()

    def _segments(self, text: str) -> list[str | None]:
        """The text between special strings, each of which is a None."""
        if self.special_pattern is None or "<|" not in text:
            return pieces.parts(text)
        found, at = [], 0
        for hit in self.special_pattern.finditer(text):
            found += [*pieces.parts(text[at : hit.start()]), None]
            at = hit.end()
        return [*found, *pieces.parts(text[at:])]

    def ends(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens up to the end of every word of all texts, counted from its text's beginning; words before each text and after the last).

        A special string is a word of one token."""
        segments = [self._segments(t) for t in texts]
        counts, sizes = [], []
        for group in _groups([s for own in segments for s in own], pieces.PART_CHARS):
            some, per = self._counts([self.normalise(s) if s is not None else None for s in group])
            counts.append(some)
            sizes.append(per)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        of_segments = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)
        before = of_segments[np.cumsum([0, *map(len, segments)])]
        total = np.concatenate([[0], np.cumsum(counts)])
        return total[1:] - np.repeat(total[before[:-1]], np.diff(before)), before

    def _of_characters(self, word: str) -> np.ndarray:
        """Tokens of word[:c] for c = 1 .. len(word), as the library cuts it: an apostrophe with part of its letters is two words."""
        counts = np.array(self._table(word, every=True))
        found = counts[np.cumsum([len(c.encode()) for c in word])]
        if word[0] == "'" and len(word) == 3 and word[1].isalpha():
            found[1] = self["'"] + self[word[1]]
        return found

    def every_prefix(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(normalised texts, tokens of each of their prefixes from the empty one on, prefixes before each text and after the last).

        Texts here hold no special strings. A kind of word is tabulated once; its table is laid out wherever it stands.
        """
        made = [self.normalise(t) for t in texts]
        joined, cps, first, last = pieces.join(made)
        starts, stops = word_bounds(cps, pretokenize.table_of(self.classes))
        found = pieces.distinct(joined, cps, starts, stops, last)
        tables = [self._of_characters(k) for k in found.kinds]
        sizes = np.fromiter(map(len, tables), np.int64, len(tables))
        flat = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        values, before = pieces.ragged(flat, np.cumsum(sizes) - sizes, sizes, found.number)
        whole = values[before[1:] - 1] if len(found.number) else np.zeros(0, np.int64)
        ahead = np.cumsum(whole) - whole  # tokens of all words before each word
        # One place more than characters for every text: the separators, and the end, stand for "all of it".
        out = np.zeros(len(cps) + 1, np.int64)
        inside = np.arange(len(values)) + np.repeat(starts - before[:-1], np.diff(before))
        out[inside + 1] = values + np.repeat(ahead, np.diff(before))
        ends = np.zeros(len(cps) + 1, np.int64)
        ends[stops] = ahead + whole
        covered = np.zeros(len(cps) + 1, bool)
        covered[inside + 1] = True
        filled = np.where(covered, out, np.maximum.accumulate(ends))  # between words nothing is added
        of_text = np.repeat(np.arange(len(texts)), last - first + 1)
        at = np.arange(len(of_text)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of_text]
        base = np.concatenate([[0], np.cumsum(whole)])[np.searchsorted(starts, first)]
        counts = filled[at] - base[of_text]
        counts[np.cumsum(last - first + 1) - (last - first + 1)] = 0
        return made, counts, np.concatenate([[0], np.cumsum(last - first + 1)])

    def _counts(self, segments: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of every word, number of words of each segment)."""
        joined, cps, _, last = pieces.join(["" if s is None else s for s in segments])
        found = pieces.distinct(joined, cps, *word_bounds(cps, pretokenize.table_of(self.classes)), last)
        per_kind = np.fromiter(map(self.__getitem__, found.kinds), np.int64, len(found.kinds))
        special = np.fromiter((s is None for s in segments), bool, len(segments))
        counts = np.insert(per_kind[found.number], found.ends[special], 1)
        return counts, np.diff(np.concatenate([[0], found.ends])) + special


def _groups(segments: list[str | None], limit: int) -> Iterator[list[str | None]]:
    at, total = 0, 0
    for i, s in enumerate(segments):
        total += len(s or "")
        if total >= limit or i + 1 == len(segments):
            yield segments[at : i + 1]
            at, total = i + 1, 0


def word_bounds(cps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the words of normalised text by the tokenizer file's rule (a fixed value):

    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
    """
    kind = table[cps]
    inside, alone = kind <= pretokenize.OTHER, kind == pretokenize.NUMBER
    change = np.ones(len(cps) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    start, stop = inside & (change[:-1] | alone), inside & (change[1:] | alone)
    # An apostrophe that is a run of its own takes one or two of the letters that follow.
    marks = np.flatnonzero((cps == 0x27) & start & stop)
    padded = np.append(cps, [0, 0]).astype(np.uint32)
    one, two = padded[marks + 1], padded[np.minimum(marks + 2, len(cps))]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, length in ((marks[short], 1), (marks[long], 2)):
        start[at + 1] = stop[at] = False
        stop[at + length] = True
        following = at + length + 1
        following = following[following < len(cps)]
        start[following] = inside[following]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def counter(path: str, classes: bytes) -> WordCounter:
    return WordCounter(path, classes)


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, token_ends), one row per input row: the tokens up to the end of each of its words."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path, classes)
        for rows, texts in common.chunks(batches):
            ends, before = model.ends(texts)
            table = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ends))
            yield pa.RecordBatch.from_arrays([rows, pa.array([len(t.encode()) for t in texts]), table], names=["doc_id", "n_bytes", "token_ends"])

    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    classes = pretokenize.classes("tokenizers")
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, token_ends array<long>")


def every_prefix(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, normalised, counts), one row per input row: the tokens of every prefix of the normalised text, by its characters from 0 on.

    A cut anywhere, inside a word or not, is answered from `counts` by `tokens_before` and
    `characters_within`. Null for texts with a special string, whose parts are no text.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path, classes)
        for rows, texts in common.chunks(batches, 200_000):
            special = [model.special_pattern is not None and model.special_pattern.search(t) is not None for t in texts]
            made, counts, before = model.every_prefix(["" if s else t for s, t in zip(special, texts)])
            none = pa.array(special)
            table = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(counts))
            columns = [pc.if_else(none, pa.scalar(None, x.type), x) for x in (pa.array(made, pa.string()), table)]
            yield pa.RecordBatch.from_arrays([rows, *columns], names=["doc_id", "normalised", "counts"])

    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    classes = pretokenize.classes("tokenizers")
    return texts.mapInArrow(run, f"doc_id {kind}, normalised string, counts array<long>")


def tokens_before(characters: Column | int, counts: Column) -> Column:
    """Tokens of the text's first characters, by a column of `every_prefix`; of all where there are fewer."""
    at = F.lit(characters) if isinstance(characters, int) else characters
    return F.get(counts, F.least(at, F.size(counts) - 1))


def characters_within(budget: Column | int, counts: Column) -> Column:
    """The length of the longest prefix within a budget. A longer prefix may take fewer tokens, so all are looked at."""
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits).cast("long")


def tokens_of(words: Column | int, ends: Column) -> Column:
    """Tokens of the first `words` words, by a column of `prefix_table`; of all where there are fewer."""
    at = F.least(F.lit(words) if isinstance(words, int) else words, F.size(ends))
    return F.when(at > 0, F.get(ends, at - 1)).otherwise(F.lit(0).cast("long"))


def words_within(budget: Column | int, ends: Column) -> Column:
    """The most leading words whose tokens stay within a budget."""
    return F.size(F.filter(ends, lambda e: e <= budget)).cast("long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_words, fitting_words), one row per input row;
    fitting_words is the number of leading words within `limit` tokens."""
    ends = F.col("token_ends")
    counted = prefix_table(docs, path).select("doc_id", "n_bytes", tokens_of(F.size(ends), ends).alias("n_tokens"), F.size(ends).cast("long").alias("n_words"), words_within(limit, ends).alias("fitting_words"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_words", "fitting_words")
