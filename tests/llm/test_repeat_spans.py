"""op11 and its run-length index against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import queries, repeat_spans, run_index

SF = "/root/testdata/sf0.001"


def plain_version(rows, length=50):
    """[(doc_id, n_bytes, spans, kept)] by a table of all strings of `length` bytes."""
    raw = [(d, t if isinstance(t, bytes) else (t or "").encode()) for d, t in rows]
    rank = lambda d: np.iinfo(np.int64).max if d is None else d
    least = {}
    for d, t in raw:
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min(least.get(t[i : i + length], rank(d)), rank(d))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < rank(d):
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        out.append((d, len(t), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_index_against_all_windows():
    rng = random.Random(1)
    for _ in range(150):
        length, letters = rng.choice([7, 8, 10, 50]), rng.choice(["ab", "abcd", "\0\xff"])
        base = "".join(rng.choice(letters) for _ in range(200))
        texts = set()
        for _ in range(rng.randrange(1, 30)):
            start = rng.randrange(120)
            t = list(base[start : start + rng.randrange(length, length + 31)])
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(letters)
            if len(t) >= length:
                texts.add("".join(t).encode("latin-1"))
        texts = sorted(texts, key=lambda t: rng.random())
        owners = np.array([rng.randrange(10) for _ in texts])
        sizes = np.array([len(t) for t in texts])
        index = run_index.RunIndex(np.frombuffer(b"".join(texts), np.uint8), sizes, owners, length)
        _, found = index.owners_of(np.arange(len(texts)), 99)
        least = {}
        windows = [(t[i : i + length], o) for t, o in zip(texts, owners) for i in range(len(t) - length + 1)]
        for w, o in windows:
            least[w] = min(least.get(w, 99), o)
        assert found.tolist() == [least[w] for w, _ in windows]
        # Equal characters before suffixes in order share runs.
        assert len(index.run_start) <= len(index.symbols) and len(index.first_place) == len(index.last_place) == len(index.run_start)


def texts_of(rng):
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for d in range(120):
        t = " ".join(rng.choice([*passages, *words, rng.choice(words)]) for _ in range(rng.randrange(1, 14)))
        if rng.random() < 0.3:
            t = list(t)
            t[rng.randrange(len(t))] = "é"
            t = "".join(t)
        rows.append((d * 7 % 120, t))
    line = "x" * 49
    return rows + [(500, line), (501, line + "y"), (502, line + "y"), (503, "z" + line + "y"), (504, "a" * 500), (505, "a" * 300), (506, "ab" * 200), (507, "ba" * 150)]


ODD = [(600, None), (601, ""), (602, "short"), (None, "n" * 60 + "m"), (None, "n" * 60 + "m"), (603, "n" * 60), (604, "twice " * 20), (604, "twice " * 20), (-9, "minus " * 30), (605, "minus " * 30), (606, "日本語" * 40), (607, "本語日" * 40)]


@pytest.mark.parametrize("chunk_bytes, bucket_bytes, hot, kinds", [(repeat_spans.CHUNK_BYTES, repeat_spans.BUCKET_BYTES, 4_096, 48), (2_000, 3_000, 4_096, 48), (700, 5_000, 2, 1), (3_000, 2_000, 0, 1)])
def test_spans(spark, chunk_bytes, bucket_bytes, hot, kinds):
    rows = texts_of(random.Random(chunk_bytes)) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("chunk", "ids", "bucket", "spans", "kept")})
    found = repeat_spans.deduplicate(docs, chunk_bytes, bucket_bytes, hot, kinds).collect()
    got = sorted((repr(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in found)
    assert got == sorted((repr(d), *more) for d, *more in plain_version(rows))
    assert sum(len(r["spans"]) for r in found) > 100


def test_empty(spark):
    assert repeat_spans.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(tuple(r)[:4] for r in repeat_spans.report(none).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_hashes_that_agree_by_chance(monkeypatch):
    """Fragments are told apart by their bytes where hashes agree."""
    raw = b"".join(bytes([65 + k]) * 60 for k in range(20))
    import pyarrow as pa

    chunk = repeat_spans.Chunk(pa.Codec("zstd").compress(raw, asbytes=True), np.full(20, 60), np.arange(20))
    chunk.anchor = np.zeros_like(chunk.anchor)
    monkeypatch.setattr(repeat_spans, "_hashed", lambda data, places, seed: np.zeros(len(places), np.uint64))
    content = chunk.contents(np.ones(len(chunk.start), bool))
    of = {}
    for key, start, windows in zip(content, chunk.start, chunk.windows):
        of.setdefault(int(key), set()).add(raw[start : start + windows + 49])
    assert all(len(texts) == 1 for texts in of.values()) and len(of) == 20


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in plain_version(rows)]
    found = queries.op11_repeat_spans(spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_long_text_in_bounded_memory():
    """A text of 20 MB, half of it a copy of the other half, is a chunk of its own."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(1)
    half = rng.integers(97, 123, 10_000_000, dtype=np.uint8).tobytes()
    raw = half + half
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    chunk = repeat_spans.Chunk(pa.Codec("zstd").compress(raw, asbytes=True), np.array([len(raw)]), np.array([7]))
    windows = np.sort(chunk.start)
    assert chunk.windows.sum() == len(raw) - 49 and windows[0] == 0 and (np.diff(windows) > 0).all()
    n = len(np.unique(chunk.anchor))
    sent = repeat_spans._Sent(chunk, [{"bucket": 0, "n": n, "mask": np.packbits(np.zeros(2 * n, np.uint8)).tobytes()}], 20)
    assert len(sent.fragment) == 0 and not repeat_spans._removed(chunk, sent, np.zeros(0, np.uint32)).any()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1_000
