"""Greedy graph colouring by random priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.storage import stage

#: Tables of colours that are read side by side before they are made one.
_MOST_TABLES = 16


def color(vertices: DataFrame, edges: DataFrame, seed: int = 42, hubs_first: bool = False) -> DataFrame:
    """(id, color) of every vertex of `vertices` (id, optional pre_color) over undirected `edges` (src, dst).

    In each superstep a vertex takes its smallest free colour if no uncoloured
    neighbour has a greater (token, id); tokens are hashes of seed and id.
    With `hubs_first` vertices of more neighbours come before others, in classes of
    powers of two and by token within a class; where few have many neighbours, as in
    most graphs, ways of falling rank, and so supersteps, are far fewer.
    Given colours stay as they are. A superstep reads and writes what has no colour
    yet, and the pairs between such vertices.
    """
    own = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    pairs = stage(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    given = F.col("pre_color") if "pre_color" in vertices.columns else F.lit(None)
    none = F.array().cast("array<int>")
    every = vertices.select("id", F.xxhash64(F.lit(seed), "id").alias("token"), given.cast("int").alias("color"))
    if hubs_first:
        size = pairs.groupBy(F.col("a").alias("id")).agg(F.floor(F.log2(F.count(F.lit(1)))).alias("size"))
        every = every.join(size, "id", "left").withColumn("token", F.struct(F.coalesce("size", F.lit(-1)).alias("size"), "token")).drop("size")
    every = stage(every, "vertices")
    colored = every.where("color is not null").select("id", "color")
    left = every.where("color is null").select("id", "token", none.alias("used"))
    done: list[DataFrame] = [colored]
    while True:
        # What was coloured leaves the frontier: its neighbours note the colour, and its pairs go.
        told = pairs.join(colored.select(F.col("id").alias("b"), "color"), "b").groupBy(F.col("a").alias("id")).agg(F.collect_set("color").alias("new"))
        left = stage(left.join(told, "id", "left").select("id", "token", F.array_union("used", F.coalesce("new", none)).alias("used")), "left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        gone = colored.select("id")
        pairs = stage(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "pairs")
        near = left.select(F.col("id").alias("b"), F.struct("token", "id").alias("rank"))
        rivals = pairs.join(near, "b").groupBy(F.col("a").alias("id")).agg(F.max("rank").alias("rival"))
        # The used colours of a vertex are at most its largest neighbour colour, never its neighbours.
        used = F.array_sort("used")
        free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), used))
        turn = F.col("rival").isNull() | (F.col("rival") < F.struct("token", "id"))
        marked = stage(left.join(rivals, "id", "left").select("id", "token", "used", F.when(turn, free).alias("color")), "marked")
        colored = marked.where("color is not null").select("id", "color")
        left = marked.where("color is null").select("id", "token", "used")
        done.append(colored)
        if len(done) > _MOST_TABLES:
            done = [stage(reduce(DataFrame.unionByName, done), "colors")]


def stats(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertices, colors, conflicts, most_neighbours): the largest colour, edges of equal ends, and the largest degree."""
    a = colors.select(F.col("id").alias("src"), F.col("color").alias("ca"))
    b = colors.select(F.col("id").alias("dst"), F.col("color").alias("cb"))
    own = edges.select("src", "dst").where("src <> dst").distinct()
    clash = own.join(a, "src").join(b, "dst").agg(F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("conflicts"))
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").count().agg(F.max("count").alias("most_neighbours"))
    size = colors.agg(F.count(F.lit(1)).alias("vertices"), F.max("color").alias("colors"))
    return size.join(clash).join(degree)  # one row each
