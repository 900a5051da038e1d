"""op12 against a plain version, with its segments and odd rows."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import fill_middle, queries

SF = "/root/testdata/sf0.001"


def plain_version(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, low, high - low, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "é", "\U0001f600" * 5, "x<P>y", "a<S>", "<M>", "<<P", "a\nb\r\n<", "<" * 40, "S>" * 30, "ä\x00b" * 7, "日本語" * 1000, "ab" * 3000]


@pytest.mark.parametrize("limit", [7, 1000, fill_middle.SEGMENT_BYTES])
def test_odd_texts(spark, limit):
    rows = [(i, t) for i, t in enumerate(ODD * 8)] + [(None, "no id"), (3, "é"), (3, "é"), (-5, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "output", "h1")})
    got = fill_middle.transform(docs, limit=limit).collect()
    want = [(d, *plain_version(d, t)) for d, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert fill_middle.report(docs.limit(0)).count() == 0


def test_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in docs:
        *most, output = plain_version(d, t)
        want.append((d, *most, sha(output), sha(t or "")))
    got = queries.op12_fill_middle(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_units_share_the_bytes():
    texts = pa.array(["aé", "", "\U0001f600z"]).slice(0)
    assert fill_middle.units(texts).to_pylist() == [["a", "é"], [], ["\U0001f600", "z"]]
    assert fill_middle.units(texts.slice(2)).to_pylist() == [["\U0001f600", "z"]]
