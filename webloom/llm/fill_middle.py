"""Fill-in-middle: texts cut in three and put together with the middle last.

A task takes Arrow batches and stays in Arrow: texts become lists of units (code
points, that share the text's buffer), lists are flattened with the index of
their parent, a unit's ordinal and its text's two cuts give its role, units are
filtered by role and joined again, and the pieces of each text are joined with
the markers between them. A long text goes through in segments, so what a task
holds beside its texts is bounded by SEGMENT_BYTES.

Null and empty texts are plain, as are texts that hold a marker, so that every
output can be undone. Cuts depend on doc_id and seed only: rows of one doc_id are
cut alike where their lengths are equal, and repeated rows give equal rows. A
null doc_id counts as an empty one. Cuts may fall together or at an end, which
leaves pieces empty. An empty table gives an empty one; further columns, of any
name, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import doc_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text that are laid out as units at a time.
SEGMENT_BYTES = 1_000_000


def _draws(seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits for each doc_id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array without nulls."""
    _, offsets, data = texts.buffers()
    own = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    return own, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _segments(texts: pa.StringArray, limit: int) -> tuple[np.ndarray, pa.StringArray]:
    """(parent of each segment, segments): texts cut between code points, so that none is longer than `limit`."""
    offsets, data = _buffers(texts)
    cuts, parents = [0], []
    base = int(offsets[0])
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = start
        while True:
            stop = min(at + limit, end)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
            parents.append(i)
            cuts.append(stop - base)
            at = stop
            if at >= end:
                break
    whole = data[base : int(offsets[-1])]
    return np.array(parents, np.int64), pa.StringArray.from_buffers(len(parents), pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(whole))


def units(texts: pa.StringArray) -> pa.ListArray:
    """Each text as the list of its code points; they share the texts' bytes."""
    offsets, data = _buffers(texts)
    first, last = int(offsets[0]), int(offsets[-1])
    starts = np.flatnonzero(data[first:last] & 0xC0 != 0x80).astype(np.int32) + np.int32(first)
    lists = np.searchsorted(starts, offsets).astype(np.int32)
    bounds = np.append(starts, np.int32(last))
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), texts.buffers()[2] or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(lists), flat)


def _joined(values: pa.Array, counts: np.ndarray) -> pa.StringArray:
    """`values` rebuilt as lists of the given lengths, each joined to one string."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), "")


def pieces(texts: pa.StringArray, lower: np.ndarray, upper: np.ndarray, limit: int = SEGMENT_BYTES) -> list[pa.StringArray]:
    """[prefixes, middles, suffixes] of texts that are cut after `lower` and after `upper` units."""
    parents, segments = _segments(texts, limit)
    sizes = pc.binary_length(segments).to_numpy()
    group = np.cumsum(sizes) // limit
    done: list[list[pa.Array]] = [[], [], []]
    before, last = 0, -1  # units of the text that the last group left open
    for start, stop in zip(*(x.tolist() for x in _runs(group))):
        laid = units(segments.slice(start, stop - start))
        own = parents[start:stop]
        lengths = pc.list_value_length(laid).to_numpy()
        ends = np.cumsum(lengths)
        # Where a text goes on from a segment before, its ordinals do, too.
        open_text = np.searchsorted(own, own)
        base = ends - lengths - (ends - lengths)[open_text] + np.where(own == last, before, 0)
        before, last = int(base[-1] + lengths[-1]), int(own[-1])
        parent = pc.list_parent_indices(laid).to_numpy()
        flat = pc.list_flatten(laid)
        ordinal = np.arange(len(flat)) - (ends - lengths - base)[parent]
        text = own[parent]
        head, tail = ordinal < lower[text], ordinal >= upper[text]
        for role, chosen in enumerate((head, ~(head | tail), tail)):
            picked = flat.filter(pa.array(chosen))
            done[role].append(_joined(picked, np.bincount(parent[chosen], minlength=len(own))))
    per_text = np.bincount(parents, minlength=len(texts))
    return [_joined(pa.concat_arrays(parts) if parts else pa.array([], pa.string()), per_text) for parts in done]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys)) if len(keys) else starts


def _transformed(batch: pa.RecordBatch, plain_percent: int, suffix_first_percent: int, limit: int) -> pa.RecordBatch:
    texts = pa.concat_arrays([batch.column("text")])
    h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
    n = pc.utf8_length(texts).to_numpy().astype(np.int64)
    a, b = h1 % (n + 1), h2 % (n + 1)
    lower, upper = np.minimum(a, b), np.maximum(a, b)
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= 100 - plain_percent)
    cut = pa.array(np.flatnonzero(~plain))
    rows = cut.to_numpy()
    prefix, middle, suffix = pieces(texts.take(cut), lower[rows], upper[rows], limit)
    last = (h4 % 100 < suffix_first_percent)[rows]
    first_piece = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, "")
    last_piece = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, "")
    made = pc.binary_join_element_wise(pc.if_else(pa.array(last), last_piece, first_piece), MIDDLE, middle, "")
    output = pc.replace_with_mask(texts, pa.array(~plain), made) if len(rows) else texts
    form = np.where(plain, "plain", np.where(h4 % 100 < suffix_first_percent, "spm", "psm"))
    columns = [batch.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(lower, mask=plain), pa.array(upper - lower, mask=plain), output]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20, limit: int = SEGMENT_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Of the texts that can be cut, `plain_percent` stay as they are; of the others
    `suffix_first_percent` begin with the suffix (spm), the rest with the prefix (psm).
    """
    drawn = doc_texts(docs).select("doc_id", "text", *_draws(seed))
    kind = drawn.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy()
            for start, stop in zip(*(x.tolist() for x in _runs(np.cumsum(sizes, dtype=np.int64) // limit))):
                yield _transformed(batch.slice(start, stop - start), plain_percent, suffix_first_percent, limit)

    return drawn.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text that is cut holds a marker, so the first one found is the one put there."""

    def pieces_of(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(F.substring(output, len(first) + 1, 2**31 - 1), second, 2)
        tail = F.split(F.get(head, F.lit(1)), MIDDLE, 2)
        return F.get(head, F.lit(0)), F.get(tail, F.lit(0)), F.get(tail, F.lit(1))

    prefix, suffix, middle = pieces_of(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = pieces_of(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)
    )


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    made = transform(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        *("doc_id", "n", "form", "prefix_chars", "middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
