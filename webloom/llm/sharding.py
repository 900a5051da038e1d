"""Shards of near-equal bytes by histogram sort.

Rows are keyed by 40 bits of their text's hash over 24 bits of their doc_id's,
so equal texts are neighbours and even a text that holds most rows can be cut.
The bytes below candidate keys are counted exactly, by partial histograms in
every task; each splitter's interval shrinks round the exact target until its
error is within tolerance or no key is left to try. Splitters of shards are held
to a narrow tolerance; those of the ranges inside a shard, which only bound a
task's work, to a wide one that the first probes mostly meet. All splitters are
refined together, in array operations. Then whole rows move once,
to ranges of bounded size; each shard is a run of such ranges, so that the number
of tasks follows the data and not the number of shards. `write` stores a folder
of files per shard and range, and `read` takes the results from the stored texts.

Null texts have no bytes (size 1). Rows of one key stay together, so identical
rows cannot be cut apart; equal doc_ids of unequal texts are rows like any others.
Empty texts have one byte, too, and count as equal texts. An empty table gives an
empty one. All columns of the input are stored and read back; one that is named
like a result, or like a name used here, is called document_… instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.llm import common

#: Candidate keys per splitter and round, and its allowed error in shares of a range, for shards and for ranges in them; candidates of a round at least; bytes in a range.
PROBES, RANGE_PROBES, TOLERANCE, RANGE_TOLERANCE, SCAN_PROBES, RANGE_BYTES = 16, 4, 0.001, 0.25, 4096, 256 << 20

_SIGN = np.uint64(1 << 63)

_KEY, _RANGE, _BEFORE = "__shard_key", "__shard_range", "__rows_before"
_STORED = ("shard", _RANGE, "slot")
_RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _renamed(docs: DataFrame) -> DataFrame:
    """`docs` without names that are used here."""
    own, names = {c.lower() for c in (*_RESULTS, _KEY, _RANGE, _BEFORE)}, []
    for c in docs.columns:
        names.append(common.free_name([*docs.columns, *names], f"document_{c}") if c.lower() in own else c)
    return docs.toDF(*names)


def with_sizes(docs: DataFrame) -> DataFrame:
    """`docs` with size and text_crc32."""
    text = F.col("text").cast("string")
    body = F.coalesce(text, F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(body)})


def with_keys(docs: DataFrame) -> DataFrame:
    """`docs` with size, text_crc32 and the sort key."""
    by_text = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 24), 24)
    by_row = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(1)), 40)
    return with_sizes(docs).withColumn(_KEY, by_text.bitwiseOR(by_row))


def _histogram(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) with a key below each of the sorted probes, and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            slot = np.searchsorted(probes, batch.column(_KEY).to_numpy(), side="right")
            rows += np.bincount(slot, minlength=len(rows))
            size += np.bincount(slot, batch.column("size").to_numpy(), minlength=len(size))
        seen = np.flatnonzero(rows)
        columns = [pa.array(seen, pa.int32()), pa.array(size[seen].astype(np.int64)), pa.array(rows[seen])]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "bytes", "rows"])

    partial = keys.select(_KEY, "size").mapInArrow(run, "slot int, bytes long, rows long")
    total = partial.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toArrow()  # at most one row per probe
    out = np.zeros((2, len(probes) + 1), np.int64)
    slots = total.column("slot").to_numpy()
    out[0, slots], out[1, slots] = total.column("bytes").to_numpy(), total.column("rows").to_numpy()
    return tuple(np.cumsum(out, 1))


def _number(keys: np.ndarray) -> np.ndarray:
    """Signed keys as unsigned numbers in the same order, or back."""
    return keys.view(np.uint64) ^ _SIGN


def splitters(histogram: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], shards: int, per_shard: int) -> np.ndarray:
    """shards * per_shard - 1 sorted keys that cut near equal bytes; histogram(keys): exact bytes and rows below each and of all."""
    n = shards * per_shard - 1
    if not n:
        return np.zeros(0, np.int64)
    of_shard = np.arange(1, n + 1) % per_shard == 0
    tolerance = np.where(of_shard, TOLERANCE, RANGE_TOLERANCE)
    low, high = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    rows_low, rows_high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    best, error = high.copy(), np.full(n, np.inf)
    first = max(n, PROBES * shards)
    probes = np.arange(1, first + 1, dtype=np.uint64) * np.uint64((1 << 64) // (first + 1))  # keys are hashes
    while len(probes):
        probes = np.sort(probes)
        below, rows = histogram(_number(probes).view(np.int64))
        share = int(below[-1]) / (n + 1)
        target = share * np.arange(1, n + 1)
        at = np.searchsorted(below[:-1], target)  # the first probe with the target's bytes below it
        after, before = np.minimum(at, len(probes) - 1), np.maximum(at - 1, 0)
        for near in (after, before):
            off = np.abs(below[near] - target)
            better = off < error
            best, error = np.where(better, probes[near], best), np.where(better, off, error)
        closer = (at < len(probes)) & (probes[after] <= high)
        high, rows_high = np.where(closer, probes[after], high), np.where(closer, rows[after], np.minimum(rows_high, rows[-1]))
        closer = (at > 0) & (probes[before] >= low)
        low, rows_low = np.where(closer, probes[before], low), np.where(closer, rows[before], rows_low)
        # An interval with one row holds no better cut.
        open_ = np.flatnonzero((high - low > np.uint64(1)) & (rows_high - rows_low > 1) & (error > tolerance * share))
        # Splitters of one interval share its probes; few intervals get more each, and so need fewer scans.
        lows, group = np.unique(low[open_], return_inverse=True)
        highs, many = np.zeros_like(lows), np.zeros(len(lows), np.int64)
        np.maximum.at(highs, group, high[open_])
        np.add.at(many, group, np.where(of_shard[open_], PROBES, RANGE_PROBES))
        many = np.maximum(many, SCAN_PROBES // max(1, len(lows)))
        steps = np.repeat(many + 1, many).astype(np.uint64)
        k = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1).astype(np.uint64)
        start, width = np.repeat(lows, many), np.repeat(highs - lows, many)
        probes = np.unique(start + width // steps * k + width % steps * k // steps)
        probes = probes[~np.isin(probes, np.concatenate([lows, highs]))]
    return _number(np.sort(best)).view(np.int64)


def _placed(docs: DataFrame, shards: int, range_bytes: int) -> DataFrame:
    """`docs` with size, text_crc32, shard, range and slot, by one exchange of its rows."""
    keyed = with_keys(_renamed(docs))
    keys = common.stage(keyed.select(_KEY, "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * range_bytes)))
    counted = lambda probes: _histogram(keys, probes)
    cuts = splitters(counted, shards, per_shard) if total else np.zeros(0, np.int64)
    below = counted(cuts)[1]
    first = np.concatenate([[0], below[:-1]])  # rows before each range
    number = np.arange(len(first))
    spark = docs.sparkSession
    # Sixteen bytes for each range, of 256 MB.
    edges, offsets = spark.sparkContext.broadcast(cuts), spark.sparkContext.broadcast(first - first[number - number % per_shard])

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, key.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("long")
    def rows_before(number: pd.Series) -> pd.Series:
        return pd.Series(offsets.value[number.to_numpy()])

    # Both before the exchange: a Python function after it would lose the order in which files are written.
    placed = keyed.withColumn(_RANGE, range_of(_KEY)).withColumn(_BEFORE, rows_before(_RANGE))
    placed = placed.withColumn("shard", F.floor(F.col(_RANGE) / per_shard).cast("int"))
    order = Window.partitionBy("shard", _RANGE).orderBy(_KEY, "doc_id", "text_crc32", "size")
    return placed.withColumn("slot", F.row_number().over(order) - 1 + F.col(_BEFORE)).drop(_KEY, _BEFORE)


def _results(rows: DataFrame) -> DataFrame:
    return rows.drop(_RANGE, "law", "grown_shard").withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def shard(docs: DataFrame, shards: int = 16, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    return _results(_placed(docs, shards, range_bytes))


def write(docs: DataFrame, out: str, shards: int = 16, range_bytes: int = RANGE_BYTES) -> None:
    """Store whole rows of `docs` with their slots below {out}, in a folder per shard and range in it."""
    rows = _placed(docs, shards, range_bytes).drop("size", "text_crc32")
    rows.write.partitionBy("shard", _RANGE).option("compression", "zstd").parquet(out)


def read(docs: DataFrame, out: str) -> DataFrame:
    """The rows stored below {out}, with the columns of `docs` and results as `shard` gives them."""
    schema = StructType([f for f in _renamed(docs).schema])
    for name, kind in zip(_STORED, ("integer", "integer", "long")):
        schema.add(name, kind)
    return _results(with_sizes(docs.sparkSession.read.schema(schema).parquet(out)))


def write_and_read(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, from the written files."""
    out = common.new_path(docs.sparkSession, "shards")
    write(docs, out, shards)
    return read(docs, out).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def plan(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    return shard(docs.select("doc_id", "text"), shards).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
