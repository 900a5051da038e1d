"""Ranked search over indexed documents, through postings.

A query takes the postings of its terms only: from a written index by its
folders, else from postings made on the way, where the condition on terms stands
right above the tokens. What matches is joined with the documents.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import parse_query
from webloom.operators import index
from webloom.storage import stage

PAGE = 10

#: Pages that end behind so many rows are found by ranges.
_FIRST_ROWS = 10_000


def query_tokens(expression: str) -> list[str]:
    text = "".join(c if c.isalnum() else " " for c in expression.lower())
    return list(dict.fromkeys(text.split()))


@dataclasses.dataclass
class Page:
    """rows: (link_id, pagerank, score) in order; postings: how many were read, of how many that the terms have."""

    rows: list[tuple[str, float, float]]
    read: int
    postings: int


def ordered_tokens(expression: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in expression.lower()).split()


def _of_terms(postings: DataFrame, wanted: list[str]) -> DataFrame:
    own = postings.where(F.col("term").isin(*wanted))
    if "bucket" in postings.columns:
        own = own.where(F.col("bucket").isin(*(r[0] for r in postings.sparkSession.createDataFrame([(t,) for t in wanted], "t string").select(index.bucket(F.col("t"))).collect())))
    return own


def _less(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def phrase_hits(own: DataFrame, phrase: list[str]) -> DataFrame:
    """link_ids of documents that have the terms one after the other in a field."""
    places = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), F.array().cast("array<int>")) for t in phrase]
    each = own.groupBy("link_id", "field").agg(*(p.alias(f"p{i}") for i, p in enumerate(places)))
    starts = reduce(F.array_intersect, [_less(F.col(f"p{i}"), i) for i in range(len(phrase))])
    return each.where(F.size(starts) > 0).select("link_id").distinct()


def search(documents: DataFrame, expression: str, kind: str | None = None, operator: str = "or", postings: DataFrame | None = None) -> DataFrame:
    """The documents that match, with `score`: the frequency of the terms among theirs.

    kind is "match" or "phrase"; by default quotes round the expression decide.
    A match asks for any of the terms (or all, with operator="and") in title or
    content; a phrase for consecutive terms in one of the two. `postings` are
    those of the documents, made on the way if they are not given.
    """
    if kind is None:
        kind, expression = parse_query(expression)
    wanted = query_tokens(expression)
    if not wanted:
        return documents.where(F.lit(False)).withColumn("score", F.lit(0.0))
    own = _of_terms(index.postings(documents) if postings is None else postings, wanted)
    hits = own.groupBy("link_id").agg(F.sum("n").alias("n"), F.countDistinct("term").alias("terms"), F.max("total").alias("total"))
    if operator == "and" and kind != "phrase":
        hits = hits.where(F.col("terms") == len(wanted))
    if kind == "phrase":
        hits = hits.join(phrase_hits(own, ordered_tokens(expression)), "link_id", "left_semi")
    score = (F.col("n") / F.greatest("total", F.lit(1))).cast("double").alias("score")
    return documents.join(hits.select("link_id", score), "link_id")


def by_rank(hits: DataFrame) -> list[Column]:
    """Greatest rank first, then score."""
    return [F.coalesce("pagerank", F.lit(0.0)).desc(), F.col("score").desc(), F.col("link_id").asc()]


def by_sum(hits: DataFrame) -> list[Column]:
    """Greatest sum of rank and score first."""
    return [(F.coalesce("pagerank", F.lit(0.0)) + F.col("score")).desc(), F.col("link_id").asc()]


def page(hits: DataFrame, offset: int = 0, size: int = PAGE, order=by_rank) -> DataFrame:
    """One page of hits with its place; the title falls back to the URL. A top-k sort, not a full one; ranges for pages far behind."""
    if offset + size > _FIRST_ROWS:
        far = numbered(hits, order).where((F.col("place") > offset) & (F.col("place") <= offset + size))
        return far.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")))
    top = hits.orderBy(*order(hits)).offset(offset).limit(size)
    place = F.row_number().over(Window.orderBy(*order(hits))) + offset  # over at most `size` rows
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    return top.withColumn("place", place).withColumn("title", title)


def ranked(hits: DataFrame, order=by_rank) -> DataFrame:
    """All hits in order."""
    return hits.orderBy(*order(hits))


def numbered(hits: DataFrame, order=by_rank) -> DataFrame:
    """All hits with their `place` in order, from 1.

    Hits are sorted in ranges, side by side; a place is the number of hits in the
    ranges before plus that in its own, so no task sees all of them.
    """
    columns = order(hits)
    dealt = hits.repartitionByRange(*columns).sortWithinPartitions(*columns)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = stage(dealt.select("*", F.spark_partition_id().alias("__range"), nth.alias("__nth")), "hits")
    counts = dict(laid.groupBy("__range").count().collect())  # one row for each range
    before, sums = 0, []
    for part in sorted(counts):
        sums.append((part, before))
        before += counts[part]
    starts = hits.sparkSession.createDataFrame(sums, "__range int, __before long")
    return laid.join(F.broadcast(starts), "__range").withColumn("place", F.col("__before") + F.col("__nth") + 1).drop("__range", "__nth", "__before")


def stream(hits: DataFrame, offset: int = 0) -> DataFrame:
    """All hits after `offset`, in order and without rank, each with the total; the search runs once."""
    every = stage(numbered(hits), "numbered")
    total = every.count()
    rest = every.where(F.col("place") > offset).orderBy("place")
    return rest.drop("pagerank", "place").withColumn("total", F.lit(total).cast("long"))


def pagination(total: int, offset: int, rows: int, size: int = PAGE) -> dict[str, int | None]:
    """from, to and total of a page, and the offsets of its neighbours."""
    return {
        "from": offset + 1,
        "to": offset + rows,
        "total": total,
        "prev": max(0, offset - size) if offset > 0 else None,
        "next": offset + rows if offset + rows < total else None,
    }
