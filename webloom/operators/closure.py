"""Transitive closure of dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.storage import stage

#: Levels that are read side by side before they are made one table.
_MOST_LEVELS = 16


def all_dependencies(depends: DataFrame, root: str, leaves: DataFrame | None = None) -> DataFrame:
    """(id, depth): everything that `root` depends on, over `depends` (id, on), with the step it was found in.

    What is in `leaves` (id) is not expanded. The root is in the result only if
    a cycle leads back to it. Links are staged once; a level joins what the
    level before has found.
    """
    links = depends.select("id", "on")
    if leaves is not None:
        links = links.join(leaves.select("id"), "id", "left_anti")
    links = stage(links.distinct(), "links")
    level = stage(links.where(F.col("id") == root).select(F.col("on").alias("id"), F.lit(1).alias("depth")), "level")
    seen, levels, depth = level, 1, 1
    while not level.isEmpty():
        depth += 1
        following = level.select("id").join(links, "id").select(F.col("on").alias("id")).distinct()
        level = stage(following.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen, levels = seen.unionByName(level), levels + 1
        if levels > _MOST_LEVELS:
            seen, levels = stage(seen, "seen"), 1
    return seen
