"""Token ids in files of byte-aligned variable-length integers.

Ids are replaced by their frequency rank, so common ids take one byte. Each
block keeps four 2-bit lengths per control byte in one stream and the value
bytes in another; a block is decoded by numpy table lookup alone. Blocks are
rows of a Parquet table (its files are the shards), in ascending doc_id order;
the rank table, bounded by the vocabulary, lies beside them.

Null and empty texts hold the end id only. Null doc_ids come first. Rows with
equal doc_id are ordered by a hash of their ids; repeated rows are rows like any
others. Other columns, of any name, are left out. An empty table gives files without
blocks, and no rows. Special strings in a text
become their single id, as the library does by default.

The tokenizers library encodes: its model is given each kind of piece once, after which
the ids are laid out over all places of the piece; whole texts go to it where they hold a
special string or the file's splitting is not the plain byte-level one.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import common, pieces, pretokenize
from webloom.llm.bpe import CACHE_ENTRIES, Cache, binaries

#: Ids in a block, unless one document alone has more.
BLOCK_IDS = 1 << 18

#: Byte-level vocabularies write bytes as characters: those that can be seen stay, the others follow from 256 on (fixed values).
_SEEN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
_ALPHABET = np.arange(256, dtype="<u2")
_ALPHABET[np.setdiff1d(_ALPHABET, _SEEN)] = np.arange(256, 512 - len(_SEEN))

#: Stands between pieces in bytes, where UTF-8 never has it.
_BETWEEN = b"\xff"


def _spelled(kinds: list[str]) -> list[str]:
    """The pieces in the characters of the vocabulary, by one table lookup for all of them."""
    joined = np.frombuffer(_BETWEEN.join(map(str.encode, kinds)), np.uint8)
    return _ALPHABET[joined].tobytes().decode("utf-16-le").split(_BETWEEN.decode("latin-1"))


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """The library's ids of texts, as one array."""

    def __init__(self, path: str, classes: bytes):
        self.model, self.classes = tokenizer(path), classes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"] or {}
        #: Whether pieces are those of `pretokenize` and nothing changes them before.
        self.by_piece = spec["normalizer"] is None and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        self.cache = Cache(CACHE_ENTRIES, self._of_kinds)

    def _of_kinds(self, kinds: list[str]) -> Iterator[list[int]]:
        """Ids of each piece, straight from the library's model: a piece needs no more splitting, and no record of its places."""
        tokenize = self.model.model.tokenize
        for spelled in _spelled(kinds) if kinds else ():
            yield [token.id for token in tokenize(spelled)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, ids)])
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(ends[-1])), ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and after the last)."""
        if not self.by_piece or any(s in t for s in self.special for t in texts):
            return self._whole(texts)
        if len(texts) == 1 and len(texts[0]) > pieces.PART_CHARS:
            values = np.concatenate([self._split([part])[0] for part in pieces.parts(texts[0])])
            return values, np.array([0, len(values)])
        return self._split(texts)

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = pretokenize.split(texts, self.classes)
        values, ends = found.lay_out(*self.cache.ids(found.kinds))
        return values, np.concatenate([[0], ends])


@functools.lru_cache(maxsize=2)
def encoder(path: str, classes: bytes) -> Encoder:
    return Encoder(path, classes)


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, classes)
        for rows, texts in common.chunks(batches):
            values, ends = model.encode(texts)
            values = np.insert(values.astype(width), ends[1:], end_id)
            yield pa.RecordBatch.from_arrays([rows, binaries(values, ends + np.arange(len(ends)))], names=["doc_id", "ids"])

    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    width, classes = _width(tokenizer(path).get_vocab_size()), pretokenize.classes("tokenizers")
    return texts.mapInArrow(run, f"doc_id {kind}, ids binary")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(encoded: DataFrame, width: str) -> DataFrame:
    """(id, n) over all rows; each task sends at most one row per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column("ids").to_pylist():
                found = np.bincount(np.frombuffer(packed, width), minlength=len(total))
                found[: len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, value bytes) of unsigned 32-bit integers."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: the bytes its four values take, and where each of their 16 bytes lies (-1: zero)."""
    lengths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
    begin = np.cumsum(lengths, 1) - lengths
    byte = np.arange(4)
    where = np.where(byte < lengths[:, :, None], begin[:, :, None] + byte, -1)
    return lengths.sum(1), where.reshape(256, 16)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of `pack`. Past the last value the data is read as zeros."""
    total, where = _tables()
    marks = np.frombuffer(control, np.uint8)
    begin = np.cumsum(total[marks]) - total[marks]
    padded = np.zeros(len(data) + 17, np.uint8)  # the last quad may be partial; the final byte is the zero
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    at = where[marks]
    at = np.where(at < 0, len(padded) - 1, np.minimum(at + begin[:, None], len(padded) - 1))
    return padded[at].reshape(-1).view("<u4")[:n]


_BLOCK_SCHEMA = "shard int, block int, start long, doc_ids array<{0}>, counts array<long>, control binary, data binary"


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 0) -> None:
    """Encode `docs` and write {out}/blocks and {out}/ranks."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    width = _width(tokenizer(path).get_vocab_size())
    staged = common.new_path(spark, "ids")
    encode(docs, path, end_id).write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.parquet(staged)
    kind = docs.schema["doc_id"].dataType.simpleString()

    ranked = sorted(((r["n"], r["id"]) for r in id_counts(encoded, width).collect()), key=lambda x: (-x[0], x[1]))
    ranks = spark.createDataFrame([(int(i), k) for k, (_, i) in enumerate(ranked)], "id long, rank long")
    ranks.coalesce(1).write.parquet(f"{out}/ranks")
    to_rank = np.zeros(max((i for _, i in ranked), default=0) + 1, "<u4")
    to_rank[[i for _, i in ranked]] = np.arange(len(ranked))
    to_rank = spark.sparkContext.broadcast(to_rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            control, data = pack(to_rank.value[np.concatenate(parts)])
            names = pa.concat_arrays(ids)
            columns = [pa.array([x], k) for x, k in ((shard, pa.int32()), (number, pa.int32()), (start, pa.int64()))]
            columns += [pa.ListArray.from_arrays([0, len(names)], names), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([control]), pa.array([data])]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "start", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for i, packed in enumerate(batch.column("ids")):
                part = np.frombuffer(packed.as_py(), width)
                if parts and held + len(part) > BLOCK_IDS:
                    yield block()
                    number, start = number + 1, start + held
                    ids, parts, held = [], [], 0
                ids.append(batch.column("doc_id").slice(i, 1))
                parts.append(part)
                held += len(part)
        if parts:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, _BLOCK_SCHEMA.format(kind)).write.option("compression", "zstd").parquet(f"{out}/blocks")
    common.remove_path(spark, staged)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files: start counts the ids of all documents before,
    ids are little-endian unsigned 32-bit integers with the end id."""
    stored = spark.read.parquet(f"{path}/blocks")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    to_id = spark.sparkContext.broadcast(np.array([r["id"] for r in by_rank], "<u4"))

    # One row per shard file, so small enough for the driver.
    totals = stored.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    before, offsets = 0, {}
    for r in totals:
        offsets[r["shard"]] = before
        before += r["n"]
    offsets = spark.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, counts = batch.column("doc_ids"), batch.column("counts")
            for i, (shard, start, control, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "control", "data")))):
                n = counts[i].values.to_numpy()
                ids = to_id.value[unpack(control, data, int(n.sum()))]
                ends = np.concatenate([[0], np.cumsum(n)])
                begin = ends[:-1] + start + offsets.value[shard]
                yield pa.RecordBatch.from_arrays([doc_ids[i].values, pa.array(begin), binaries(ids, ends)], names=["doc_id", "start", "ids"])

    return stored.mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written files."""
    spark = docs.sparkSession
    out = common.new_path(spark, "token-store")
    write(docs, out, path)
    return read(spark, out).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
