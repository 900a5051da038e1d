"""The Parquet tables of a directory, and the link graph and index laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.schema import uuid_of
from webloom.storage import spread

#: 2024-01-01 00:00:00 UTC.
EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_seconds(ntz):
    """Seconds since 1970 of a timestamp's day, whatever the session's time zone."""
    return F.unix_date(ntz.cast("date")).cast("long") * 86_400


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a link, retrieved one minute after the page before."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(uuid_of(F.col("url")).alias("id"), "url", F.timestamp_seconds(EPOCH + F.col("page_id") * 60).alias("retrieved_at"))


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as links."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("http://supplier/"), "s_suppkey").alias("url"), F.col("s_suppkey").alias("k"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("http://part/"), "p_partkey").alias("url"), F.col("p_partkey").alias("k"))
    return s.unionByName(p).select(uuid_of(F.col("url")).alias("id"), "url", F.timestamp_seconds(EPOCH + F.col("k")).alias("retrieved_at"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each supplier and part that were traded, updated on the last day."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = spread(lines.select("l_suppkey", "l_partkey", "l_shipdate"), lines.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max(day_seconds(F.col("l_shipdate"))).alias("t"))
    src, dst = F.concat(F.lit("http://supplier/"), "l_suppkey"), F.concat(F.lit("http://part/"), "l_partkey")
    return pairs.select(uuid_of(F.concat_ws(">", src, dst)).alias("id"), uuid_of(src).alias("src"), uuid_of(dst).alias("dst"), F.timestamp_seconds("t").alias("updated_at"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as an index: one entry per document, with a rank made of its id."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id")
    return docs.select(
        uuid_of(url).alias("link_id"),
        url.alias("url"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("source", F.lit(" "), "lang")).alias("title"),
        F.col("text").alias("content"),
        F.timestamp_seconds(EPOCH + F.col("doc_id")).alias("indexed_at"),
        (F.col("doc_id") % 101 / 101).alias("pagerank"),
    )


#: The same tables for DuckDB, as the heads of WITH clauses.
def _uuid(x: str) -> str:
    return rf"regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def _days(x: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', CAST({x} AS DATE)) * 86400"


PAGE_LINKS_SQL = f"page_links AS (SELECT {_uuid('url')} AS id, url, {EPOCH} + page_id * 60 AS retrieved_at FROM pages)"
TRADE_LINKS_SQL = f"""trade_links AS (SELECT {_uuid('url')} AS id, url, {EPOCH} + k AS retrieved_at FROM (
  SELECT 'http://supplier/' || s_suppkey AS url, s_suppkey AS k FROM supplier UNION ALL SELECT 'http://part/' || p_partkey, p_partkey FROM part))"""
TRADE_EDGES_SQL = f"""trade_edges AS (SELECT {_uuid("src || '>' || dst")} AS id, {_uuid('src')} AS src, {_uuid('dst')} AS dst, t AS updated_at FROM (
  SELECT 'http://supplier/' || l_suppkey AS src, 'http://part/' || l_partkey AS dst, max({_days('l_shipdate')}) AS t FROM lineitem GROUP BY ALL))"""
INDEXED_SQL = f"""indexed AS (SELECT {_uuid('url')} AS link_id, url, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || ' ' || lang END AS title, text AS content,
  {EPOCH} + doc_id AS indexed_at, (doc_id % 101) / 101.0::DOUBLE AS pagerank FROM (SELECT *, 'http://' || source || '/' || doc_id AS url FROM documents))"""
