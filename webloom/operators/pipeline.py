"""Branches of a dataflow.

Stages are functions from DataFrame to DataFrame; what runs them, how many at a
time, and what happens when one fails is Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame


def broadcast(rows: DataFrame, *processes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every process on all rows; their outputs together. Each branch reads `rows` again, so stage what is dear to compute."""
    if not processes:
        raise ValueError("at least one process is needed")
    return reduce(DataFrame.unionByName, (p(rows) for p in processes))
