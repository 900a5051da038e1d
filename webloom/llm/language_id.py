"""Language identification: known words first, character n-grams for the rest.

A word seen in training is scored by its smoothed log frequency in every
language. An unknown word falls back to its longest known character n-grams,
from five characters down to one, as the mean of their log frequencies. A text
gets the language of the greatest sum; its score is the posterior share.

Learning counts all words and n-grams of a bounded sample of each language's
labelled documents with Spark, and keeps every one of them. A table of at most
`most_cells` numbers goes to all workers; a greater one stays a table and is
joined with the documents' distinct words, with the same results.

Texts that are null or without letters are `und` with score 0, as is everything
if there is nothing to learn from. Ties go to the language that sorts first.
Other columns are ignored; repeated rows get repeated results.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, pieces, pretokenize

#: Labelled documents to learn from, about, for each language; the longest n-grams.
MAX_DOCS, LONGEST = 2_000, 5

#: Numbers in the tables that are sent to every worker (four bytes each), at most.
MOST_CELLS = 24_000_000

#: Words whose rows a worker keeps.
CACHE_ENTRIES = 100_000

_SPREAD = 1 << 20


@dataclasses.dataclass
class Model:
    """languages in sorted order; table (length, part, row): log frequencies by language, with length 0 for words."""

    languages: list[str]
    table: DataFrame | None


def _words(texts: list[str], packed: bytes) -> pieces.Pieces:
    """The runs of letters of the lower-cased texts."""
    joined, cps, _, last = pieces.join([t.lower() for t in texts])
    inside = np.concatenate([[False], pretokenize.table_of(packed)[cps] == pretokenize.LETTER, [False]])
    return pieces.distinct(joined, cps, np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1, last)


def _counted(batches: Iterator[pa.RecordBatch], packed: bytes) -> Iterator[tuple[pa.Array, list[tuple[list[str], np.ndarray, np.ndarray]]]]:
    """For each chunk the key column and, part by part, (kinds, row and kind of each word that a row has, times that it has it)."""
    for rows, texts in common.chunks(batches):
        found = []
        for group in [[p] for p in pieces.parts(texts[0])] if len(texts) == 1 else [texts]:
            w = _words(group, packed)
            owner = np.repeat(np.arange(len(group)), np.diff(np.concatenate([[0], w.ends])))
            pairs, times = np.unique(owner * max(1, len(w.kinds)) + w.number, return_counts=True)
            found.append((w.kinds, pairs, times))
        yield rows, found


def word_counts(docs: DataFrame, key: str) -> DataFrame:
    """(key, part, n): how often each row, told by a column of any type, has each word; in parts of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _counted(batches, packed):
            for kinds, pairs, times in found:
                owner, kind = np.divmod(pairs, max(1, len(kinds)))
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(owner)), pa.array(kinds, pa.string()).take(pa.array(kind)), pa.array(times)], names=["doc_id", "part", "n"])

    packed = pretokenize.classes("tiktoken")
    keyed = common.doc_texts(docs.select(F.col(key).alias("doc_id"), "text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, part string, n long").withColumnRenamed("doc_id", key)


def _spread(word: str) -> list[tuple[str, int]]:
    """Every n-gram of a word with its ends marked, and its length."""
    marked = f"_{word}_"
    return [(marked[k : k + length], length) for length in range(1, LONGEST + 1) for k in range(len(marked) - length + 1)]


def _grams(words: DataFrame, *keep: str) -> DataFrame:
    """(keep…, part, length) for every n-gram of `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                each = list(map(_spread, some.column("part").to_pylist()))
                owner = pa.array(np.repeat(np.arange(len(each)), list(map(len, each))))
                grams = [pa.array([g for own in each for g, _ in own], pa.string()), pa.array([n for own in each for _, n in own], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(owner) for k in keep), *grams], names=[*keep, "part", "length"])

    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    return words.select(*keep, "part").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "part string", "length int"]))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out()).select("doc_id", "lang", "text")
    # One row for each language.
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], None)
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(_SPREAD, -(-_SPREAD * max_docs // n)))])
    taken = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)) < shares[F.col("lang")])
    words = common.stage(word_counts(taken, "lang").groupBy("lang", "part").agg(F.sum("n").alias("n")), "language-words")
    every = words.withColumn("length", F.lit(0)).unionByName(_grams(words, "lang", "n"))
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    counts = common.stage(every.groupBy("length", "part").agg(*each), "language-counts")
    # At most one row for words and each length.
    totals = counts.groupBy("length").agg(F.count(F.lit(1)).alias("parts"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]).collect()
    below = F.create_map(*[x for r in totals for x in (F.lit(r["length"]), F.array(*[F.lit(float(r[f"n{i}"] + 0.5 * r["parts"])) for i in range(len(languages))]))])
    row = F.array(*[F.log((F.col(f"n{i}") + 0.5) / below[F.col("length")][i]).cast("float") for i in range(len(languages))])
    return Model(languages, counts.select("length", "part", row.alias("row")))


class Tables:
    """The model's tables as sorted 64-bit hashes and matrices, for words (0) and n-grams of each length."""

    def __init__(self, model: Model):
        self.languages = model.languages
        found = model.table.toArrow()
        lengths, hashes = found.column("length").to_numpy(), np.fromiter(map(_hash, found.column("part").to_pylist()), np.uint64, found.num_rows)
        rows = found.column("row").combine_chunks().values.to_numpy().reshape(-1, len(self.languages))
        self.tables = []
        for length in range(LONGEST + 1):
            own = np.flatnonzero(lengths == length)
            own = own[np.argsort(hashes[own])]
            self.tables.append((hashes[own], rows[own]))

    def find(self, length: int, texts: list[str]) -> np.ndarray:
        """The row number of each text in its table, -1 where it is not there."""
        known = self.tables[length][0]
        if not len(known):
            return np.full(len(texts), -1)
        wanted = np.fromiter(map(_hash, texts), np.uint64, len(texts))
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, at, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        at = self.find(0, words)
        out[at >= 0] = self.tables[0][1][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for length in range(LONGEST, 0, -1):
            grams = [(i, marked[k : k + length]) for i in left.tolist() for marked in (f"_{words[i]}_",) for k in range(len(marked) - length + 1)]
            at = self.find(length, [g for _, g in grams])
            owner = np.fromiter((i for i, _ in grams), np.int64, len(grams))[at >= 0]
            np.add.at(out, owner, self.tables[length][1][at[at >= 0]])
            times = np.bincount(owner, minlength=len(words))
            out[times > 0] /= times[times > 0, None]
            left = left[times[left] == 0]
        return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Scorer:
    """A worker's rows of the words that it has seen."""

    def __init__(self, tables: Tables, packed: bytes):
        self.tables, self.packed = tables, packed
        self.rows = np.zeros((CACHE_ENTRIES, len(tables.languages)))
        self.place: dict[str, int] = {}

    def _places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > len(self.rows):
            self.place, new = {}, words
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]))
        if new:
            at = len(self.place)
            self.rows[at : at + len(new)] = self.tables.rows(new)
            self.place.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sums of rows, numbers of words) of each text."""
        if len(texts) == 1 and len(texts[0]) > pieces.PART_CHARS:
            sums, sizes = zip(*(self._totals([p]) for p in pieces.parts(texts[0])))
            return np.sum(sums, 0), np.sum(sizes, 0)
        return self._totals(texts)

    def _totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = _words(texts, self.packed)
        ends = np.concatenate([[0], found.ends])
        each = self.rows[self._places(found.kinds)][found.number] if found.kinds else np.zeros((0, self.rows.shape[1]))
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
        return np.diff(sums[ends], axis=0), np.diff(ends)


def identify(docs: DataFrame, model: Model, most_cells: int = MOST_CELLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row."""
    if not model.languages:
        found = common.doc_texts(docs).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    elif model.table.count() * (2 + len(model.languages)) <= most_cells:
        found = _by_tables(docs, model)
    else:
        found = _by_join(docs, model)
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def _by_tables(docs: DataFrame, model: Model) -> DataFrame:
    shared, packed = docs.sparkSession.sparkContext.broadcast(Tables(model)), pretokenize.classes("tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, packed)
        names = pa.array([*scorer.tables.languages, "und"])
        for rows, texts in common.chunks(batches):
            sums, sizes = scorer.totals(texts)
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1)[:, None]).sum(1)
            some = sizes > 0
            yield pa.RecordBatch.from_arrays([rows, names.take(pa.array(np.where(some, best, len(names) - 1))), pa.array(np.where(some, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _mean(rows: Column, languages: int) -> list[Column]:
    return [F.avg(rows[i]) for i in range(languages)]


def _by_join(docs: DataFrame, model: Model) -> DataFrame:
    """The same without a broadcast: each distinct word of the documents is scored once, by joins."""
    n = len(model.languages)
    numbered = common.stage(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "numbered")
    counts = common.stage(word_counts(numbered, "rid"), "word-counts")
    words = counts.select("part").distinct()
    known = model.table.where("length = 0").select("part", "row")
    found = common.stage(words.join(known, "part", "left").withColumn("word", F.monotonically_increasing_id()), "words")
    grams = _grams(found.where("row is null"), "word")  # told by numbers, as words may be long
    hits = grams.join(model.table.where("length > 0"), ["length", "part"])
    means = hits.groupBy("word", "length").agg(F.array(*_mean(F.col("row"), n)).alias("mean"))
    backed = means.groupBy("word").agg(F.max_by("mean", "length").alias("mean"))
    nothing = F.array_repeat(F.lit(0.0), n)
    rows = found.join(backed, "word", "left").select("part", F.coalesce(F.col("row").cast("array<double>"), "mean", nothing).alias("row"))
    sums = counts.join(rows, "part").groupBy("rid").agg(F.array(*[F.sum(F.col("n") * F.col("row")[i]) for i in range(n)]).alias("sums"))
    best = F.array_max("sums")
    share = F.lit(1.0) / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = F.array(*[F.lit(lang) for lang in model.languages])[F.array_position("sums", best).cast("int") - 1]
    scored = sums.select("rid", name.alias("lang_pred"), share.alias("score"))
    out = numbered.select("rid", "doc_id").join(scored, "rid", "left")
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
