"""Periodic passes over the graph's state, as Structured Streaming queries.

Every pass writes what it has changed, and commits it with one small file that
also names the last micro-batch that went in, so that a batch that is run again
after a failure, in this process or a later one, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.operators import crawl, linkgraph, pagerank
from webloom.operators.partition import Range
from webloom.schema import zero_time
from webloom.storage import stage
from webloom.streaming.state import GraphState


def _now() -> datetime:
    return datetime.now(timezone.utc)


def crawl_service(pages: DataFrame, state: GraphState, checkpoint: str, interval: str | None = None, now: Callable[[], datetime] | None = None) -> StreamingQuery:
    """A query that crawls every micro-batch of `pages` (url, html) into `state`.

    With an interval it ticks for ever; without one it takes what is there and
    ends. Passes on one state must not overlap.
    """
    clock = now or _now

    def tick(batch: DataFrame, number: int) -> None:
        if number <= state.batch(checkpoint):
            return
        some = stage(batch.select("url", "html").dropDuplicates(["url"]), "pages")
        _store(state, some, clock(), checkpoint, number)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return pages.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _store(state: GraphState, pages: DataFrame, now: datetime, source: str | None = None, batch: int = -1, private: DataFrame | None = None) -> int:
    links, edges, removed, documents = crawl.changes(*state.read(), pages, F.lit(now), private)
    return state.write(links, edges, documents, source, batch, True, removed)


def seed(state: GraphState, urls: DataFrame) -> int:
    """Add the links `urls` (url) that are not known yet, as never retrieved."""
    links = state.table("links")
    new = urls.select("url").distinct().join(links.select("url"), "url", "left_anti").withColumn("retrieved_at", zero_time())
    return state.write(linkgraph.upsert_links(links.limit(0), new), None, None, None, -1, True)


def crawl_due(state: GraphState, fetched: DataFrame, now: datetime, older_than: int, part: int = 0, parts: int = 1, private: DataFrame | None = None) -> int:
    """One tick: crawl the links of a UUID range that were not retrieved within `older_than` seconds; how many pages were read.

    `fetched` (url, status, content_type, html) is what the web answers, with one row
    for a URL. A link that has no answer, or one that is not worth reading, stays due.
    The range is part `part` of `parts` equal ones, so that several services share a graph.
    """
    start, end = Range.full(parts).part(part)
    due = linkgraph.links_due(state.table("links", start, end), F.lit(now), older_than)
    answers = due.select("url").join(crawl.fetch_filter(fetched, private), "url")
    pages = stage(answers.select("url", "html"), "due")
    count = pages.count()
    if count:
        _store(state, pages, now, private=private)
    return count


def crawl_until_done(state: GraphState, fetched: DataFrame, now: Callable[[int], datetime], older_than: int, private: DataFrame | None = None, max_passes: int | None = None) -> int:
    """Ticks over all links, `now(k)` being the time of the k-th, until none of those that are due can be read; the number of ticks that read any.

    Links that one pass finds are due in the next.
    """
    passes = 0
    while (max_passes is None or passes < max_passes) and crawl_due(state, fetched, now(passes), older_than, private=private):
        passes += 1
    return passes


def rank_pass(state: GraphState, config: pagerank.Config = pagerank.Config(on_unknown_dst="drop"), now: datetime | None = None) -> int:
    """Rank the links retrieved and the edges updated before the pass began, and store their scores; the number of supersteps.

    Scores are a table of their own, so documents are not written again.
    """
    start = F.lit(now or _now())
    links = state.table("links").where(F.col("retrieved_at") < start)
    edges = state.table("edges").where(F.col("updated_at") < start)
    found = pagerank.pagerank(links, edges, config)
    state.set_scores(found.scores.select(F.col("id").alias("link_id"), F.col("score").alias("pagerank")))
    return found.supersteps


def every(state: GraphState, checkpoint: str, interval: str, action: Callable[[GraphState], object]) -> StreamingQuery:
    """A query that runs `action` on the state at an interval, say `rank_pass` or a `crawl_due` of one range.

    Run it in one place for what has one leader. Passes on one state must not overlap.
    """
    ticks = state.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: action(state)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per time window of a stream of events, with a watermark for late ones."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
