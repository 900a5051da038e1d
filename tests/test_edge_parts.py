from pyspark.sql import functions as F

from webloom import storage
from webloom.operators import linkgraph


def test_more_edges_are_merged_in_more_parts(spark, monkeypatch):
    """Ten times the edges make ten times the parts, so that no task sorts more of them."""
    monkeypatch.setattr(storage, "PART_ROWS", 100)
    now = F.timestamp_seconds(F.lit(1_000))
    for n in (300, 3000):
        pair = [(F.col("id") % 50).cast("string").alias("src"), F.col("id").cast("string").alias("dst")]
        links = spark.range(n).select(F.col("id").cast("string").alias("id"))
        edges = spark.range(n - 100).select(*pair, F.concat(F.lit("e"), "id").alias("id"), F.timestamp_seconds(F.lit(5)).alias("updated_at"))
        found = linkgraph.upsert_edges(edges, spark.range(n - 200, n).select(*pair), links, now)
        assert found.rdd.getNumPartitions() == (n + 100) // 100
        rows = {r["dst"]: (r["id"], r["t"]) for r in found.withColumn("t", F.unix_timestamp("updated_at")).collect()}
        assert len(rows) == n and rows["0"] == ("e0", 5) and rows[str(n - 150)] == (f"e{n - 150}", 1_000)


def test_links_are_not_broadcast(spark):
    """Links that are small on disk are no small table of strings in every task."""
    links = spark.range(100).select(F.col("id").cast("string").alias("id"))
    edges = spark.range(120).select(F.col("id").cast("string").alias("src"), (F.col("id") % 10).cast("string").alias("dst"))
    found = linkgraph.unknown_ends(edges, links)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 20
