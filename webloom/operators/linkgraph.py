"""The link graph: scans, upserts and maintenance of links and edges.

A table is a DataFrame; a change makes a new one from the old one and the new
rows, so that a pass is one job and its result is written once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.schema import uuid_of
from webloom.storage import spread


class NotFound(LookupError):
    pass


class UnknownEdgeLinks(ValueError):
    pass


def _in_range(column: str, start: str, end: str) -> Column:
    return (F.col(column) >= start) & (F.col(column) < end)


def links_in_range(links: DataFrame, start: str, end: str, before: datetime | Column) -> DataFrame:
    """Links with start <= id < end that were retrieved before a time."""
    return links.where(_in_range("id", start, end) & (F.col("retrieved_at") < before))


def edges_in_range(edges: DataFrame, start: str, end: str, before: datetime | Column) -> DataFrame:
    """Edges whose source is in [start, end), updated before a time."""
    return edges.where(_in_range("src", start, end) & (F.col("updated_at") < before))


def links_due(links: DataFrame, now: datetime | Column, seconds: int) -> DataFrame:
    """Links not retrieved within the last `seconds`."""
    return links.where(F.col("retrieved_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one id; an empty DataFrame if there is none."""
    return rows.where(F.col(key) == value)


def find(rows: DataFrame, key: str, value: str):
    """The row of one id; NotFound if there is none."""
    if (row := lookup(rows, key, value).first()) is None:
        raise NotFound(value)
    return row


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """One row per URL: the existing id stays (a new one is made of the URL), the newest time wins."""
    old = links.select("url", "id", "retrieved_at")
    fresh = new.select("url", F.lit(None).cast("string").alias("id"), "retrieved_at")
    merged = old.unionByName(fresh).groupBy("url").agg(F.min("id").alias("id"), F.max("retrieved_at").alias("retrieved_at"))
    return merged.select(F.coalesce("id", uuid_of(F.col("url"))).alias("id"), "url", "retrieved_at")


def unknown_ends(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with an end that is not a link."""
    # Merge joins, as links are small on disk and become large tables of strings where they are broadcast.
    ids = links.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi")
    return edges.join(known.select("src", "dst").distinct().hint("merge"), ["src", "dst"], "left_anti")


def upsert_edges(edges: DataFrame, new: DataFrame, links: DataFrame, now: datetime | Column) -> DataFrame:
    """One row per (src, dst): the existing id stays, and edges seen again are updated now.

    UnknownEdgeLinks if a new edge has an end that is not a link. Edges are counted first,
    as rows of strings are sorted to be merged, in parts of a bounded size.
    """
    if not unknown_ends(new, links).isEmpty():
        raise UnknownEdgeLinks("an edge ends at an unknown link")
    return merge_edges(edges, new, now, edges.count() + new.count())


def merge_edges(edges: DataFrame, new: DataFrame, now: datetime | Column, size: int | None = None) -> DataFrame:
    """The same without the check; `size`: how many edges there are, old and new ones, if that is known."""
    old = edges.select("src", "dst", "id", "updated_at")
    fresh = new.select("src", "dst", F.lit(None).cast("string").alias("id"), F.lit(now).alias("updated_at"))
    both = old.unionByName(fresh)
    both = both if size is None else spread(both, size, "src", "dst")
    merged = both.groupBy("src", "dst").agg(F.min("id").alias("id"), F.max("updated_at").alias("updated_at"))
    return merged.select(F.coalesce("id", uuid_of(F.concat_ws(">", "src", "dst"))).alias("id"), "src", "dst", "updated_at")


def cascade_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that stay when links are deleted; deleted has an id column."""
    ids = deleted.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def remove_stale_edges(edges: DataFrame, src: str | Column, before: datetime | Column) -> DataFrame:
    """Edges without those of one source that were last updated before a time."""
    return edges.where(~((F.col("src") == src) & (F.col("updated_at") < before)))


def keep_current_edges(edges: DataFrame, crawled: DataFrame, before: datetime | Column) -> DataFrame:
    """The same for every source in `crawled` (id) at once."""
    sources = crawled.select(F.col("id").alias("src"), F.lit(True).alias("__crawled")).distinct()
    marked = edges.join(sources, "src", "left")
    return marked.where(~(F.coalesce("__crawled", F.lit(False)) & (F.col("updated_at") < before))).select(*edges.columns)


def submit_links(links: DataFrame, submitted: DataFrame, now: datetime | Column) -> DataFrame:
    """Add URLs given by users: http and https only, fragments cut off."""
    url = F.regexp_replace(F.trim("url"), "#.*", "")
    valid = submitted.select(url.alias("url"), F.lit(now).alias("retrieved_at")).where(F.col("url").rlike(r"^(?i)https?://[^/]+"))
    return upsert_links(links, valid)
