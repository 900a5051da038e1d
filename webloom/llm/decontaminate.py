"""Benchmark decontamination with one word-level Aho-Corasick automaton.

Test items are normalised to words; every window of `window` consecutive words
(the whole item where it is shorter) is a pattern over the alphabet of
benchmark words. A text is normalised once into the same alphabet, scanned
once, and hits are mapped back to word positions and to offsets in the original
text. All windows that end at a word are reported, so overlaps are complete.

The automaton holds the benchmark, not the corpus. A node's letters are searched one by
one, so a word is spelled in two characters, its group and its own, and no node has more
than about the square root of the number of words. One automaton has room for the words of
`max_bytes` of benchmark; a worker builds it once. A benchmark of more than `pass_bytes`,
too large for a worker's memory, is scanned for in several passes, and their hits are united.

Null texts have no words, and neither have null items; items of null item_id
make their texts hit but are not counted or named. Repeated items are one. Empty texts
have no words, either. Repeated rows each get their row. `report` leaves other columns
out, `keep` hands them on, whatever their names. An empty table of texts gives an empty
one; an empty benchmark marks nothing.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common

#: Bytes of benchmark text in one automaton, in which there are fewer words than code points, and in the automata of one pass.
MAX_BYTES, PASS_BYTES = 4 << 20, 4 << 20

#: ASCII digits, lower-case letters and all bytes of other characters stay; the rest separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SKIPPED = range(0xD800, 0xE000)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


#: Stands for a word that no item has.
_UNKNOWN = "\0\0"


class Windows:
    """The automaton over items; a word is two characters, so that windows begin at even places only."""

    def __init__(self, items: list[tuple], window: int):
        each = [(item_id, words(text or "")) for item_id, text in items]
        letters = _spelling(dict.fromkeys(itertools.chain.from_iterable(found for _, found in each)))
        owners: dict[str, frozenset] = {}
        for item_id, found in each:
            own = frozenset([item_id])
            spelled = "".join(map(letters.__getitem__, found))
            for i in range(max(1, len(found) - window + 1) if found else 0):
                pattern = spelled[2 * i : 2 * (i + window)]
                before = owners.setdefault(pattern, own)
                if not own <= before:
                    owners[pattern] = before | own
        self.letter = letters.get
        self.automaton = ahocorasick.Automaton() if owners else None
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern) // 2, ids))
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(merged hit ranges in words, end exclusive; ids of items with a hit)."""
        if self.automaton is None:
            return [], set()
        spelled = "".join(map(self.letter, found, repeat(_UNKNOWN)))
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for last, (length, ids) in self.automaton.iter(spelled):
            end = (last + 1) // 2
            begin = end - length
            items |= ids
            while ranges and begin <= ranges[-1][1]:
                begin = min(begin, ranges.pop()[0])
            ranges.append((begin, end))
        return ranges, items


def _spelling(known: Iterable[bytes]) -> dict[bytes, str]:
    """Two characters for each word: one of about as many groups as a group has words, and one of its own that names no group."""
    known = list(known)
    groups = math.isqrt(len(known)) + 1

    def letter(code: int) -> str:
        return chr(code if code < _SKIPPED.start else code + len(_SKIPPED))

    return {word: letter(1 + n % groups) + letter(1 + groups + n) for n, word in enumerate(known)}


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point range of each word in the original text."""
    spans, begin = [], None
    for i, c in enumerate(text):
        inside = c >= "\x80" or "0" <= c <= "9" or "A" <= c <= "Z" or "a" <= c <= "z"
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            spans.append((begin, i))
            begin = None
    return [*spans, (begin, len(text))] if begin is not None else spans


class Automata:
    """The automata of one pass; items of (item_id as a string or None, text)."""

    def __init__(self, items: list[tuple], window: int, max_bytes: int):
        groups, size = [[]], 0
        for item in items:
            n = len(item[1].encode())
            if size and size + n > max_bytes:
                groups.append([])
                size = 0
            groups[-1].append(item)
            size += n
        self.each = [Windows(group, window) for group in groups]

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        ranges, items = self.each[0].scan(found)
        for more in self.each[1:]:
            others, ids = more.scan(found)
            ranges, items = merged([*ranges, *others]), items | ids
        return ranges, items

    def hits(self, found: list[bytes]) -> bool:
        return any(a.scan(found)[0] for a in self.each)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            begin, end = out[-1][0], max(end, out.pop()[1])
        out.append((begin, end))
    return out


#: A worker's automata, by what they are made of; only the latest.
_BUILT: dict[str, Automata] = {}


def _built(key: str, shared, window: int, max_bytes: int) -> Automata:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automata(shared.value, window, max_bytes)
    return _BUILT[key]


def _passes(benchmark: DataFrame, window: int, max_bytes: int, pass_bytes: int) -> Iterator[Callable[[], Automata]]:
    """For each pass a function that gives a worker its automata; one pass up to `pass_bytes`."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // pass_bytes) or 1
    for k in range(n):
        # The size of what comes to the driver has just been counted.
        items = sorted((tuple(r) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()), key=repr)
        shared = benchmark.sparkSession.sparkContext.broadcast(items)
        key = hashlib.sha256(repr((items, window, max_bytes)).encode()).hexdigest()
        yield functools.partial(_built, key, shared, window, max_bytes)


def scan(docs: DataFrame, automata: Callable[[], Automata]) -> DataFrame:
    """(doc_id, n_words, ranges, spans, items) per row, for one pass."""
    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automata()
        pairs = pa.list_(pa.list_(pa.int64()))
        for ids, taken in common.chunks(batches):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for text in taken:
                found = words(text)
                ranges, hit = model.scan(found)
                where = word_offsets(text) if ranges else []
                for column, value in zip(rows, (len(found), ranges, [(where[a][0], where[b - 1][1]) for a, b in ranges], sorted(x for x in hit if x is not None))):
                    column.append(value)
            kinds = (pa.int64(), pairs, pairs, pa.list_(pa.string()))
            columns = [ids, *(pa.array(c, k) for c, k in zip(rows, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "ranges", "spans", "items"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, ranges array<array<long>>, spans array<array<long>>, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, ranges of hit words, spans of the original text, item ids as sorted strings."""
    passes = list(_passes(benchmark, window, max_bytes, pass_bytes))
    if len(passes) == 1:
        return scan(docs, passes[0])
    # Rows are told apart by a number of their own, as doc_ids may repeat or be null.
    numbered = common.stage(docs.select("doc_id", "text").withColumn("row_number", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.col("row_number").alias("doc_id"), "text")
    every = functools.reduce(DataFrame.unionByName, (common.stage(scan(keyed, automata), "hits") for automata in passes))
    united = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        *(_merged(F.flatten(F.collect_list(c))).alias(c) for c in ("ranges", "spans")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return numbered.select("doc_id", F.col("row_number")).join(united.withColumnRenamed("doc_id", "row_number"), "row_number").drop("row_number")


def _merged(ranges):
    """`merged` as a column."""
    step = lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)[1] >= x[0]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array(F.element_at(a, -1)[0], F.greatest(F.element_at(a, -1)[1], x[1])))),
    ).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(ranges), F.array().cast("array<array<bigint>>"), step)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    found = find(docs, benchmark, window)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of `docs` without a hit, as they are; each is decided where it stands, so doc_ids do not matter."""
    for automata in _passes(benchmark, window, max_bytes, pass_bytes):
        docs = _without_hits(docs, automata)
    return docs


def _without_hits(docs: DataFrame, automata: Callable[[], Automata]) -> DataFrame:
    def begin():
        model = automata()
        return lambda batch, place: batch.filter(pa.array([not model.hits(words(text.as_py() or "")) for text in batch.column(place)], pa.bool_()))

    return common.map_rows(docs, begin)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
