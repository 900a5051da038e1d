"""Postings by bucket, made within a document's row, against those that are grouped by shuffles."""

from pyspark.sql import functions as F

from webloom.operators import index, segments


def test_postings_within_a_row(spark):
    texts = [("Ab ab", "c, ab! C 7ä 7Ä"), ("", "x " * 300 + "y"), ("only here", ""), ("", ""), ("a a", "a a")]
    docs = spark.createDataFrame([(f"d{i}", *t) for i, t in enumerate(texts)], "link_id string, title string, content string")
    rows = index.by_bucket(docs.select("link_id", index.terms(F.col("title")).alias("title"), index.terms(F.col("content")).alias("content")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert rows.count() == rows.select("link_id", "bucket").distinct().count()
    columns = ["term", "link_id", "field", "positions", "n"]
    got = index.laid_out(rows)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, index.postings(docs).select(columns).collect()))
    assert {(r[0], r[1]): r[2] for r in got.where("of_document is not null").select("link_id", "term", "of_document").collect()}[("d0", "ab")] == 3
    assert got.where(index.bucket(F.col("term")) != F.col("bucket")).isEmpty()


def test_ids_in_bytes(spark):
    ids = ["0123abcd-0000-1111-2222-fedcba987654", "0123ABCD-0000-1111-2222-fedcba987654", "", "x", "é" * 8, "0" * 16, "\x01" + "a" * 16]
    packed = segments._packed(F.col("id"))
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", packed.alias("p")).select("id", segments._unpacked(F.col("p")).alias("back"), F.length("p").alias("n")).collect()
    assert [r["back"] for r in rows] == ids and rows[0]["n"] == 17
