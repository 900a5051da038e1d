"""Removal of long repeated byte strings, whichever documents they are in.

Every byte goes that is covered by a string of LENGTH bytes that also starts in a
document with a smaller doc_id. Work is divided by content:

1. Documents are packed in compressed chunks, which are written once.
2. In every window of LENGTH bytes the substring of ANCHOR bytes with the least hash
   is its anchor; windows next to one another mostly share it and make a fragment.
   Equal windows have equal anchors, so only they can meet. Chunks send the hashes
   of their anchors, packed, and learn which ones another chunk has, too.
3. Chunks send the distinct fragments of such anchors to buckets by anchor, each with
   the smallest doc_id that has it. A bucket builds a run-length index of its
   fragments (see run_index) and streams each fragment over it: windows that a
   fragment of a smaller doc_id holds are marked.
4. Marks go back to the chunks, which cut their documents.

An anchor of very many fragments (say a common phrase) would make a bucket grow
with the corpus, so its windows go one by one instead, as fingerprints of 128 bits
that spread over all buckets and meet their equals there; that is exact, too, and
nothing is left out. A chunk or bucket is all that a task holds at a time.

Texts shorter than LENGTH, null and empty ones among them, stay whole. Rows of one
doc_id do not count as repeats of one another; rows of null doc_id give way to all
others, not to one another. doc_ids are integers. An empty table gives an empty
one; further columns, of any name, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common
from webloom.llm.run_index import RunIndex

LENGTH, ANCHOR = 50, 20
_WINDOWS = LENGTH - ANCHOR + 1

#: Bytes of a chunk; of text for each bucket of fragments; anchors for each bucket of hashes.
CHUNK_BYTES, BUCKET_BYTES, BUCKET_ANCHORS = 4_000_000, 1_000_000, 128_000

#: Fragments of an anchor from which its windows go one by one, and different ones of them by a byte of their hash.
HOT, HOT_KINDS = 4_096, 48

_BLOCK = 1 << 17
_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _at(data: np.ndarray, shift: int, n: int) -> np.ndarray:
    """The eight bytes from each of `n` places on, as one number; a view."""
    return np.ndarray((n,), _U, data, shift, (1,))


def _hashed(data: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the LENGTH bytes from each place on."""
    n = len(data) - LENGTH - 7
    h = np.full(len(places), seed, _U)
    for shift in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + _at(data, shift, n)[places])
    return h


class Chunk:
    """Texts one after the other, and their fragments: start, number of windows, anchor's hash, document."""

    def __init__(self, blob: bytes, sizes: np.ndarray, ids: np.ndarray):
        self.n = int(sizes.sum())
        raw = pa.Codec("zstd").decompress(blob, self.n) if self.n else b""
        self.data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(LENGTH + 16, np.uint8)])
        self.sizes, self.ids, self.ends = sizes, ids, np.cumsum(sizes)
        found = list(self._blocks())
        whole = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
        self.start, self.windows = whole(0), whole(1)
        self.anchor = _mixed(whole(2).astype(_U) ^ _U(0x94D049BB133111EB))  # least hashes are small ones; buckets need even ones
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.owner = self.ids[self.doc] if len(self.start) else np.zeros(0, np.int64)

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        steps = np.zeros(self.n + 1, np.int8)
        long = self.sizes >= LENGTH
        np.add.at(steps, (self.ends - self.sizes)[long], 1)
        np.add.at(steps, (self.ends - LENGTH + 1)[long], -1)
        valid = np.cumsum(steps[:-1], dtype=np.int8) > 0
        low = _U((1 << 18) - 1)
        for begin in range(0, self.n, _BLOCK):
            here = valid[begin : begin + _BLOCK]
            if not here.any():
                continue
            m = len(here) + _WINDOWS - 1
            part = self.data[begin : begin + m + ANCHOR + 8]
            if len(part) < m + ANCHOR + 8:
                part = np.concatenate([part, np.zeros(m + ANCHOR + 8 - len(part), np.uint8)])
            h = _mixed(_at(part, 0, m) * _U(0x9E3779B97F4A7C15) + _at(part, 8, m))
            h = _mixed(h * _U(0x9E3779B97F4A7C15) + _at(part, ANCHOR - 8, m))
            least, span = (h & ~low) | np.arange(m, dtype=_U), 1
            while 2 * span <= _WINDOWS:
                least, span = np.minimum(least[:-span], least[span:]), 2 * span
            if span < _WINDOWS:
                least = np.minimum(least[: span - _WINDOWS], least[_WINDOWS - span :])
            first = here.copy()
            first[1:] &= (least[1:] != least[:-1]) | ~here[:-1]
            start = np.flatnonzero(first)
            stop = np.flatnonzero(here & np.append((least[1:] != least[:-1]) | ~here[1:], True))
            yield start + begin, stop - start + 1, h[(least[start] & low).astype(np.int64)]

    def contents(self, chosen: np.ndarray) -> np.ndarray:
        """A number for each of some fragments, equal where their bytes are; hashes that agree by chance are told apart by the bytes."""
        start, size = self.start[chosen], self.windows[chosen] + LENGTH - 1
        key = _mixed(_hashed(self.data, start, 1) * _U(3) + _hashed(self.data, start + size - LENGTH, 2)) ^ self.anchor[chosen]
        while True:
            _, first, own = np.unique(key, return_index=True, return_inverse=True)
            other = start[first[own]]
            words = _at(self.data, 0, len(self.data) - 7)
            differs = np.zeros(len(key), bool)
            for shift in range(0, LENGTH + _WINDOWS, 8):
                at = np.minimum(shift, size - 8)
                differs |= words[start + at] != words[other + at]
            if not differs.any():
                return key
            key[differs] = _mixed(key[differs] + _U(1))

    def wanted(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fragments of which another document may have a part, those whose windows go one by one), from two bits for each distinct anchor."""
        distinct, own = np.unique(self.anchor, return_inverse=True)
        least, most = np.full(len(distinct), _NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, own, self.owner)
        np.maximum.at(most, own, self.owner)
        again = (told[0::2] > 0) | (least != most)
        return again[own], (told[1::2] > 0)[own]


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, sizes, blob): texts of `docs` in compressed chunks, as they come; null ids stand last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            blob = pa.Codec("zstd", compression_level=3).compress(b"".join(texts), asbytes=True)
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_buffer()
                if ids and (size + len(text := bytes(text)) > chunk_bytes or len(ids) >= 50_000):
                    yield made()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(_NO_ID if doc_id is None else doc_id)
                texts.append(bytes(text))
                size += len(text)
        if ids:
            yield made()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return plain.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, blob binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n not in ("ids", "sizes")}
            ids, sizes = (batch.column(n)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in ("ids", "sizes"))
            yield row, Chunk(row.pop("blob"), sizes, ids)


_ENTRY = np.dtype([("hash", "u1", 5), ("count", "u1"), ("kind", "u1")])


def _hashes(held: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, pack): the distinct anchors of each chunk, 40 bits below those of the bucket, with a count of their fragments and a byte of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _opened(batches):
            every = np.ones(len(chunk.start), bool)
            content = chunk.contents(every)
            _, first = np.unique(content, return_index=True)
            anchor, one, count = np.unique(chunk.anchor[first], return_index=True, return_counts=True)
            bucket = (anchor >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)
            packs = np.empty(len(anchor), _ENTRY)
            packs["hash"] = ((anchor << _U(bits)) >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            packs["count"] = np.minimum(count, 255)
            packs["kind"] = content[first][one] & _U(255)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            stops = np.append(cuts[1:], len(bucket))
            made = [packs[a:b].tobytes() for a, b in zip(cuts.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([row["chunk"]] * len(cuts), pa.int64()), pa.array(made, pa.binary())], names=["bucket", "chunk", "pack"])

    return held.mapInArrow(run, "bucket long, chunk long, pack binary")


def _told(hashes: DataFrame, hot: int, kinds: int) -> DataFrame:
    """(chunk, bucket, n, mask): two bits for each anchor of a pack: another chunk has it, too; it is hot."""

    def run(table: pa.Table) -> pa.Table:
        packs = [np.frombuffer(b.as_buffer(), _ENTRY) for b in table.column("pack")]
        sizes = [len(p) for p in packs]
        every = np.concatenate(packs)
        padded = np.zeros((len(every), 8), np.uint8)
        padded[:, :5] = every["hash"]
        anchor = padded.view(_U).ravel()
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        total = np.add.reduceat(every["count"][order].astype(np.int64), first)
        most = np.maximum.reduceat(every["count"][order], first)
        different = np.bincount(np.unique(group * 256 + every["kind"][order]) // 256, minlength=len(first))
        bits = np.zeros((len(every), 2), np.uint8)
        bits[order, 0] = (np.diff(np.append(first, len(order))) > 1)[group]
        bits[order, 1] = ((total > hot) & ((different >= kinds) | (most > hot // kinds)))[group]
        masks, at = [], 0
        for size in sizes:
            masks.append(np.packbits(bits[at : at + size].ravel()).tobytes())
            at += size
        columns = [table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(masks, pa.binary())]
        return pa.table(columns, names=["chunk", "bucket", "n", "mask"])

    return hashes.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, n long, mask binary")


class _Sent:
    """What a chunk sends to the buckets, in order: distinct fragments, and fingerprints of the windows of hot anchors."""

    def __init__(self, chunk: Chunk, masks: list[dict] | None, buckets: int):
        told = [np.unpackbits(np.frombuffer(m["mask"], np.uint8))[: 2 * m["n"]] for m in sorted(masks or [], key=lambda m: m["bucket"])]
        again, hot = chunk.wanted(np.concatenate(told) if told else np.zeros(0, np.uint8))
        self.fragment = np.flatnonzero(again & ~hot)
        singles = np.flatnonzero(again & hot)
        n = chunk.windows[singles]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.place = np.repeat(chunk.start[singles], n) + within  # of each window that goes by itself
        prints = np.stack([_hashed(chunk.data, self.place, 1), _hashed(chunk.data, self.place, 2)], axis=1)
        content = chunk.contents(self.fragment)
        # What is equal within the chunk is sent once, with the smallest of its doc_ids.
        key = np.concatenate([content, prints[:, 0] ^ _mixed(prints[:, 1])])
        group = np.concatenate([chunk.anchor[self.fragment], prints[:, 0]])
        owner = np.concatenate([chunk.owner[self.fragment], chunk.ids[np.searchsorted(chunk.ends, self.place, side="right")]])
        bucket = (_mixed(group) % _U(buckets)).astype(np.int64)
        single = np.arange(len(key)) >= len(self.fragment)
        order = np.lexsort((key, single, bucket))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (single[order][1:] != single[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])]) if len(order) else np.zeros(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = order[new]
        self.owner_of_all = owner
        self.owner = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner
        self.bucket, self.group, self.single = bucket[first], group[first], single[first]
        self.at = np.where(self.single, first - len(self.fragment), chunk.start[self.fragment[np.minimum(first, len(self.fragment) - 1)]] if len(self.fragment) else 0)
        self.size = np.where(self.single, 0, chunk.windows[self.fragment[np.minimum(first, len(self.fragment) - 1)]] + LENGTH - 1 if len(self.fragment) else 0)
        self.prints = prints

    def packs(self, chunk: Chunk) -> Iterator[tuple[int, dict]]:
        cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else np.zeros(0, np.int64)
        codec = pa.Codec("zstd", compression_level=1)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(self.bucket)).tolist()):
            fragments = np.arange(a, b)[~self.single[a:b]]
            size = self.size[fragments]
            reach = np.arange(size.sum()) + np.repeat(self.at[fragments] - (np.cumsum(size) - size), size)
            text = chunk.data[reach].tobytes()
            singles = np.arange(a, b)[self.single[a:b]]
            yield int(self.bucket[a]), {
                "sizes": size.astype(np.uint8).tobytes(),
                "groups": (self.group[fragments] >> _U(32)).astype(np.uint32).tobytes(),
                "owners": self.owner[a:b].tobytes(),
                "text": codec.compress(text, asbytes=True),
                "prints": self.prints[self.at[singles]].tobytes(),
            }


_PACK = ("sizes", "groups", "owners", "text", "prints")


def _fragments(known: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, sizes, groups, owners, text, prints): what chunks send to the buckets of fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _opened(batches):
            packs = list(_Sent(chunk, row["masks"], buckets).packs(chunk))
            columns = [pa.array([b for b, _ in packs], pa.int64()), pa.array([row["chunk"]] * len(packs), pa.int64())]
            columns += [pa.array([p[c] for _, p in packs], pa.binary()) for c in _PACK]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", *_PACK])

    return known.mapInArrow(run, "bucket long, chunk long, " + ", ".join(f"{c} binary" for c in _PACK))


def marked(sizes: np.ndarray, groups: np.ndarray, owners: np.ndarray, text: bytes) -> np.ndarray:
    """For each fragment the windows, as bits, that a fragment of a smaller owner holds.

    Equal fragments are one, with the smallest owner; those that alone have their
    anchor can share a window with equal ones only. The others make the index.
    """
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(text[e - s : e], len(known)) for s, e in zip(sizes.tolist(), ends.tolist())), np.int64, len(sizes))
    n = len(known)
    least = np.full(n, _NO_ID)
    np.minimum.at(least, number, owners)
    group = np.zeros(n, groups.dtype)
    group[number] = groups
    _, own, count = np.unique(group, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[own] > 1)
    bits = np.zeros(n, np.uint32)
    if len(shared):
        kept = list(known)
        parts = [kept[i] for i in shared.tolist()]
        index = RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), least[shared], LENGTH)
        offsets, smallest = index.owners_of(np.arange(len(parts)), _NO_ID)
        windows = np.diff(offsets)
        text_of = np.repeat(np.arange(len(parts)), windows)
        place = np.arange(len(smallest)) - offsets[text_of]
        hit = smallest < least[shared][text_of]
        np.bitwise_or.at(bits, shared[text_of[hit]], np.uint32(1) << place[hit].astype(np.uint32))
    return np.where(least[number] < owners, np.uint32(0xFFFFFFFF), bits[number])


def _marks(fragments: DataFrame) -> DataFrame:
    """(chunk, bucket, marks): for what each chunk sent, in order, the windows that go from the document that counted as its owner."""

    def run(table: pa.Table) -> pa.Table:
        rows = [{c: table.column(c)[i].as_buffer() for c in _PACK} for i in range(table.num_rows)]
        sizes = [np.frombuffer(r["sizes"], np.uint8).astype(np.int64) for r in rows]
        groups = [np.frombuffer(r["groups"], np.uint32) for r in rows]
        owners = [np.frombuffer(r["owners"], np.int64) for r in rows]
        codec = pa.Codec("zstd")
        text = b"".join(codec.decompress(r["text"], int(s.sum()), asbytes=True) if len(s) else b"" for r, s in zip(rows, sizes))
        bits = marked(np.concatenate(sizes), np.concatenate(groups), np.concatenate([o[: len(s)] for o, s in zip(owners, sizes)]), text)
        prints = np.concatenate([np.frombuffer(r["prints"], [("a", _U), ("b", _U)]) for r in rows])
        of_prints = np.concatenate([o[len(s) :] for o, s in zip(owners, sizes)])
        _, own = np.unique(prints, return_inverse=True)
        least = np.full(len(prints), _NO_ID)
        np.minimum.at(least, own, of_prints)
        single = np.where(least[own] < of_prints, np.uint32(0xFFFFFFFF), np.uint32(0)) if len(prints) else np.zeros(0, np.uint32)
        made, at, after = [], 0, 0
        for s, o in zip(sizes, owners):
            rest = len(o) - len(s)
            made.append(np.concatenate([bits[at : at + len(s)], single[after : after + rest]]).astype(np.uint32).tobytes())
            at, after = at + len(s), after + rest
        return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(made, pa.binary())], names=["chunk", "bucket", "marks"])

    return fragments.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, marks binary")


def _removed(chunk: Chunk, sent: _Sent, marks: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go."""
    steps = np.zeros(chunk.n + 1, np.int32)

    def cover(place: np.ndarray, size: np.ndarray | int) -> None:
        np.add.at(steps, place, 1)
        np.add.at(steps, place + size, -1)

    bits = marks[sent.number]
    bits = np.where(sent.owner_of_all > sent.owner[sent.number], np.uint32(0xFFFFFFFF), bits) if len(bits) else bits
    m = len(sent.fragment)
    windows = chunk.windows[sent.fragment]
    every = (np.uint32(1) << windows.astype(np.uint32)) - np.uint32(1)
    own = bits[:m] & every
    whole = own == every
    start = chunk.start[sent.fragment]
    cover(start[whole], windows[whole] + LENGTH - 1)
    some = np.flatnonzero((own != 0) & ~whole)
    for k in range(_WINDOWS):
        cover(start[some[(own[some] >> np.uint32(k)) & np.uint32(1) > 0]] + k, LENGTH)
    cover(sent.place[bits[m:] != 0], LENGTH)
    return np.cumsum(steps[:-1], dtype=np.int32, out=steps[:-1]) > 0


def _cut(known: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of the documents of chunks (chunk, ids, sizes, blob, masks, marks)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _opened(batches):
            sent = _Sent(chunk, row["masks"], buckets)
            told = [np.frombuffer(m["marks"], np.uint32) for m in sorted(row["marks"] or [], key=lambda m: m["bucket"])]
            gone = _removed(chunk, sent, np.concatenate(told) if told else np.zeros(0, np.uint32))
            first = np.zeros(chunk.n + 1, bool)
            first[np.minimum(chunk.ends - chunk.sizes, chunk.n)] = True
            edge = np.flatnonzero(gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]])))
            stop = np.flatnonzero(gone & (first[1:] | ~np.append(gone[1:], False))) + 1
            doc = np.searchsorted(chunk.ends, edge, side="right")
            begin = (chunk.ends - chunk.sizes)[doc]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(chunk.ids)))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(edge - begin), pa.array(stop - begin)], fields=list(span)))
            kept = chunk.data[: chunk.n][~gone].tobytes()
            stay = np.zeros(chunk.n + 1, np.int32)
            np.cumsum(~gone, dtype=np.int32, out=stay[1:])
            bounds = np.concatenate([[0], stay[chunk.ends]]).astype(np.int32)  # documents lie one after the other
            texts = pa.Array.from_buffers(pa.binary(), len(chunk.ids), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
            ids = pa.array(chunk.ids, mask=chunk.ids == _NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.sizes), spans, texts], names=["doc_id", "n_bytes", "spans", "kept"])

    return known.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def deduplicate(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, kinds: int = HOT_KINDS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal removed runs as [start, end) of bytes, and the bytes that stay."""
    held = common.stage(chunks(docs, chunk_bytes), "chunks")
    total = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / 15 / BUCKET_ANCHORS))))
    buckets = max(1, math.ceil(total / bucket_bytes))
    grouped = lambda df, *c: df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", *c)).alias(c[-1] + "s" if c[-1] == "mask" else c[-1]))
    masks = grouped(common.stage(_told(_hashes(held, bits), hot, kinds), "anchors"), "n", "mask")
    known = held.join(masks, "chunk", "left")
    marks = grouped(common.stage(_marks(_fragments(known, buckets)), "marks"), "marks")
    return _cut(known.join(marks, "chunk", "left"), buckets)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return deduplicate(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
