"""op10 moves whole rows into files, and its results come from them."""

import glob
import zlib

import pytest
from pyspark.sql import functions as F

from webloom.llm import common, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("range_bytes", [sharding.RANGE_BYTES, 20_000])
def test_files_hold_whole_rows(spark, tmp_path, range_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write(docs, f"{tmp_path}/out", 4, range_bytes)
    ranges = glob.glob(f"{tmp_path}/out/shard=*/__shard_range=*")
    assert len({r.split("/")[-2] for r in ranges}) == 4 and len(ranges) == 4 if range_bytes > 1 << 20 else len(ranges) > 8
    assert all(len(glob.glob(f"{r}/*.parquet")) == 1 for r in ranges)
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, stored.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    of_files = sharding.read(docs, f"{tmp_path}/out").select(*columns)
    assert sorted(map(tuple, of_files.collect())) == sorted(map(tuple, sharding.shard(docs, 4, range_bytes).select(*columns).collect()))
    # Files are in order of slots, so a reader may take them as they are.
    for path in ranges:
        slots = [r["slot"] for r in spark.read.parquet(path).select("slot").collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_query_reads_its_files(spark, monkeypatch):
    paths = []
    write = sharding.write
    monkeypatch.setattr(sharding, "write", lambda docs, out, *more: (paths.append(out), write(docs, out, *more)))
    rows = queries.op10_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(paths[0]).collect()}
    assert len(rows) == len(texts) and all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "x" * 200_000), (3, "x" * 200_000), (4, "é\n")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("size", "shard", "slot", "law", "n")})
    got = sharding.write_and_read(odd).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 4, 6, 200_001, 200_001]
    assert sharding.write_and_read(odd.limit(0)).count() == 0
    out = common.new_path(spark, "shards")
    sharding.write(odd, out)
    assert {r["n"] for r in sharding.read(odd, out).collect()} == {"clash"}
