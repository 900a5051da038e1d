"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common

#: Vertices that one task merges in memory before it hands its forest on.
FOREST_VERTICES = 500_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, v: int) -> int:
        parent = self.parent
        root = v
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(v, v)) != root:
            parent[v], v = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> list[tuple[int, int]]:
        return [(v, self.find(v)) for v in self.parent]


def local_stars(edges: DataFrame) -> DataFrame:
    """(v, root) for the forest of each task's own edges: same components, at most one row per vertex and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
            if len(forest.parent) > FOREST_VERTICES:
                yield _pairs(forest.stars())
                forest = Forest()
        yield _pairs(forest.stars())

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: A vertex of more than this share of all rows, and of so many, is hot; there are fewer than 2 / HOT_SHARE such, whatever the size.
HOT_SHARE, HOT_ROWS = 1 / 2048, 256


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of its neighbourhood.

    Rows of hot vertices take it from a table of these, so that no task gets the rows of a whole star.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hot = least.where(F.col("n") > limit).select("a", "m").collect()  # a few thousand rows at most
    up = both.where("b > a")
    tied = up.join(least.select("a", "m"), "a")
    if hot:
        known = F.broadcast(edges.sparkSession.createDataFrame([tuple(r) for r in hot], "a long, m long"))
        others = up.join(known.select("a"), "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
        tied = up.join(known, "a").unionByName(others)
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are tied to the smallest of them; of these there are no more than tasks that made stars of their own."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex with an edge (a, b); root is the smallest vertex of the component.

    Each round is two joins on one vertex and is written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain.
    """
    found = common.stage(local_stars(edges.where("a <> b")).distinct(), "stars")
    while not _are_stars(found):
        limit = max(HOT_ROWS, int(found.count() * HOT_SHARE))
        found = common.stage(_small_star(_large_star(found, limit)), "stars")
    roots = found.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return found.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each vertex is either a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down = 1)").isEmpty()
