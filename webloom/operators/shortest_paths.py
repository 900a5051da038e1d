"""Shortest paths from one vertex, by relaxation of the changed frontier."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.bsp import UnknownVertex
from webloom.storage import stage

#: Tables of improvements that are read side by side before they are made one.
_MOST_TABLES = 8


def shortest_paths(edges: DataFrame, source: str, max_steps: int | None = None) -> DataFrame:
    """(dst, cost, prev) of every vertex that can be reached over `edges` (src, dst, cost); prev is null at the source.

    Costs are whole and not negative. Of equal costs the first stays, and the
    smaller predecessor among those of one superstep. Edges are staged and
    partitioned by source once. A superstep joins only the vertices that
    improved, and writes only those that it improves; as costs fall, the least
    row of a vertex is the one that counts.
    """
    links = stage(edges.groupBy("src", "dst").agg(F.min("cost").cast("long").alias("cost")), "links")
    if not links.where("cost < 0").isEmpty():
        raise ValueError("negative edge cost")
    links = links.select("src", F.col("dst").alias("to"), F.col("cost").alias("more")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    frontier = edges.sparkSession.createDataFrame([(source, 0, None)], "dst string, cost long, prev string")
    tables, step = [frontier], 0
    while max_steps is None or step < max_steps:
        step += 1
        tried = frontier.select(F.col("dst").alias("src"), "cost").join(links, "src")
        offers = tried.groupBy(F.col("to").alias("dst")).agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.col("src").alias("prev"))).alias("offer"))
        # Few vertices have offers, and only their known costs are looked up.
        offers = stage(offers, "offers")
        asked = [t.join(offers.select("dst"), "dst", "left_semi") for t in tables]
        known = _least(asked).select("dst", F.col("cost").alias("known"))
        better = offers.join(known, "dst", "left").where("known is null or offer.cost < known")
        frontier = stage(better.select("dst", "offer.cost", "offer.prev"), "improved")
        if frontier.isEmpty():
            break
        tables.append(frontier)
        if len(tables) > _MOST_TABLES:
            tables = [stage(_least(tables), "distances")]
    links.unpersist()
    return _least(tables)


def _least(tables: list[DataFrame]) -> DataFrame:
    """The row of least cost of each vertex; a later table holds only lower costs."""
    if len(tables) == 1:
        return tables[0]
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.groupBy("dst").agg(F.min(F.struct("cost", "prev")).alias("m")).select("dst", "m.cost", "m.prev")


def with_paths(found: DataFrame) -> DataFrame:
    """(dst, cost, path): each vertex with the vertices on its way from the source, both ends included.

    Ways grow along predecessors, one level of the tree at a time, so that a vertex is joined once.
    """
    found = stage(found, "found")
    level = stage(found.where("prev is null").select("dst", "cost", F.array("dst").alias("path")), "paths")
    every, levels = level, 1
    while True:
        ends = level.select(F.col("dst").alias("prev"), "path")
        following = found.join(ends, "prev").select("dst", "cost", F.concat("path", F.array("dst")).alias("path"))
        level = stage(following, "paths")
        if level.isEmpty():
            return every
        every, levels = every.unionByName(level), levels + 1
        if levels > _MOST_TABLES:
            every, levels = stage(every, "ways"), 1


def path_to(found: DataFrame, dst: str) -> tuple[list[str], int]:
    """(path, cost) of one vertex, by walking back from it."""
    row = found.where(F.col("dst") == dst).first()
    if row is None:
        raise UnknownVertex(f"no path to {dst!r}")
    path, cost = [dst], row["cost"]
    while row["prev"] is not None:
        path.append(row["prev"])
        row = found.where(F.col("dst") == row["prev"]).first()
    return path[::-1], cost
