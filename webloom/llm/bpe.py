"""Byte-level BPE encoding and decoding by a rank file.

Pieces come from `pretokenize` (no regex); each kind of piece in a chunk of
texts is looked up once in a bounded cache, or merged, and its ids are laid out
over all pieces with array gathers. Work is map-only: no shuffle, and a lost
task is simply run again.

Null and empty texts give no ids and decode to no bytes. Other columns of the
input are ignored. Repeated rows give repeated results, one per row.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, pieces, pretokenize

#: Entries of a worker's piece cache, and the longest piece that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64

#: Characters of a chunk; smaller than elsewhere, as ids and decoded bytes are held beside the texts.
CHUNK_CHARS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank merges first, leftmost on ties.

    A linked list with a heap of candidate pairs, so that very long pieces
    cost n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that begins here; 0: merged away
    left = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = ends[i]
        if not mid or mid >= end or ends[mid] != end:  # one of the two parts has changed
            continue
        ends[i], ends[mid] = end, 0
        if end < n:
            left[end] = i
            if (rank := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if (j := left[i]) >= 0 and (rank := ranks.get(piece[j:end])) is not None:
            heapq.heappush(heap, (rank, j, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Cache:
    """Ids of pieces in two generations: what has not been asked for since the last half of the entries came goes first."""

    def __init__(self, entries: int, make: Callable[[list[str]], Iterable[list[int]]]):
        self.entries, self.make = entries, make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all kinds, number of ids of each)."""
        packed = self._packed(kinds)
        return np.frombuffer(b"".join(packed), np.uint32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4

    def _packed(self, kinds: list[str]) -> list[bytes]:
        found = list(map(self.new.get, kinds))
        absent = [i for i, v in enumerate(found) if v is None]
        for i in absent:
            found[i] = self.old.get(kinds[i])
        missing = [i for i in absent if found[i] is None]
        for i, ids in zip(missing, self.make([kinds[i] for i in missing])):
            found[i] = array.array("I", ids).tobytes()
        if 2 * (len(self.new) + len(absent)) > self.entries:
            self.new, self.old = {}, self.new
        self.new.update((kinds[i], found[i]) for i in absent if len(kinds[i]) <= CACHE_CHARS)
        return found


class Encoder:
    """Ids of texts, and bytes of ids, as numpy arrays."""

    def __init__(self, path: str, classes: bytes):
        self.ranks, self.classes = read_ranks(path), classes
        self.cache = Cache(CACHE_ENTRIES, lambda kinds: (merge(kind.encode(), self.ranks) for kind in kinds))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and after the last)."""
        found = pretokenize.split(texts, self.classes)
        values, ends = found.lay_out(*self.cache.ids(found.kinds))
        return values, np.concatenate([[0], ends])

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text, part by part."""
        values = np.concatenate([self.encode([part])[0] for part in pieces.parts(text)])
        return values, np.array([0, len(values)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes before each id and after the last)."""
        return pieces.ragged(self.bytes, self.places, self.lengths, ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str, classes: bytes) -> Encoder:
    return Encoder(path, classes)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of an array; ends: values before each row and after the last."""
    offsets = (ends * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers; with
    `offsets` also token_offsets, the byte at which each token starts and the length;
    with `decoded` also the bytes that the ids decode to, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, classes)
        for rows, texts in common.chunks(batches, CHUNK_CHARS):
            values, ends = model.encode_long(texts[0]) if len(texts) == 1 else model.encode(texts)
            columns = [rows, pa.array(np.diff(ends)), binaries(values, ends)]
            if offsets or decoded:
                raw, before = model.decode(values)
            if offsets:
                columns.append(pa.array([(before[a : b + 1] - before[a]).tolist() for a, b in itertools.pairwise(ends)], pa.list_(pa.int64())))
            if decoded:
                columns.append(binaries(raw, before[ends]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    classes = pretokenize.classes("tiktoken")
    names = ["doc_id", "n_tokens", "ids"] + ["token_offsets"] * offsets + ["decoded"] * decoded
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", token_offsets array<long>" * offsets + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids of each row stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, b"")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                decoded = pa.array([model.decode(np.frombuffer(x, "<u4"))[0].tobytes() for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: n_tokens and SHA-256 of its packed ids and of the bytes they decode to."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(docs, path, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
