"""Nothing of the input is lost: columns with clashing names, and secrets of any length."""

import base64
import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import common, secret_scan, sharding

CLASHES = ("size", "TEXT_CRC32", "law", "shard", "slot", "grown_shard", "__shard_key", "__shard_range", "__rows_before", "document_size", "lang.x")


def test_shards_keep_every_column(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "doc_id long, text string")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES))
    out = common.new_path(spark, "shards")
    sharding.write(docs, out, 4)
    stored = sharding.read(docs, out)
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    given = [c for c in stored.columns if c not in own]
    assert len(given) == len(docs.columns) and set(own) < set(stored.columns)
    names = ["`" + c + "`" for c in given]
    assert sorted(map(tuple, stored.select(*names).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["size"] for r in stored.select("size").collect()} == {7}
    found = sharding.write_and_read(docs, 4)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and found.count() == 60


def test_pipeline_keeps_row_numbers_of_the_input(spark):
    rows = [(1, "a b c d e f g h", "first"), (2, "a b c d e f g h", "second"), (3, None, "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row_number string").withColumn("__ROW_NUMBER_", F.lit("x"))
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema["__row_number"].dataType.simpleString() == "string"
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e f g h", "first", "x"), (3, None, "third", "x")]


@pytest.mark.parametrize("extra", [0, 12_000, 40_000, 2_000_000])
def test_web_tokens_with_long_headers(extra):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    token = ".".join((part({"alg": "RS256", "x5c": ["A" * extra]}), part({"sub": "someone"}), "s" * 43))
    assert secret_scan.scan(f"see {token} here") == [(4, 4 + len(token), "jwt")]
    assert secret_scan.mask(f"see {token} here") == "see [jwt] here"


def test_deep_headers():
    """A header that nests too deeply to be read is told by its first character."""
    part = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    for head, found in ((b'{"a":' + b"[" * 100_000, 1), (b'{"a": nothing}', 0)):
        token = ".".join((part(head), part(b'{"sub": "someone"}'), "s" * 43))
        assert len(secret_scan.scan(token)) == found
