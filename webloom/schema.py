"""Schemas, identifiers and constants of the link graph and the text index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("retrieved_at", T.TimestampType())])
EDGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("updated_at", T.TimestampType())])
DOCUMENTS = T.StructType(
    [
        T.StructField("link_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("pagerank", T.DoubleType()),
    ]
)

NIL_UUID = "00000000-0000-0000-0000-000000000000"


def zero_time() -> Column:
    """The time of what was never retrieved: a value before all others, not null."""
    return F.to_timestamp(F.lit("0001-01-01 00:00:00"))


def uuid_of(value: Column) -> Column:
    """A UUID string that depends on `value` only."""
    return F.regexp_replace(F.md5(value.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
