"""Vertex programs in supersteps, over DataFrames.

A program gives two plans per superstep: the new rows of the vertices that take
part, from their old ones and grouped messages, and the messages that they send. The
loop folds the named aggregates into one row per step, so that one small row
reaches the driver. A superstep writes the rows of those that took part; frozen
vertices stay where they lie, and the newest row of a vertex counts.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.storage import stage


#: Tables of newer rows that are read side by side before they are made one.
_MOST_TABLES = 6


class UnknownVertex(ValueError):
    pass


class UnknownEdgeSource(ValueError):
    pass


@dataclasses.dataclass
class Config:
    max_steps: int | None = None
    on_unknown_dst: str = "error"

    def __post_init__(self):
        if self.max_steps is not None and self.max_steps < 1:
            raise ValueError("max_steps must be at least 1")
        if self.on_unknown_dst not in ("error", "drop"):
            raise ValueError("on_unknown_dst is 'error' or 'drop'")


@dataclasses.dataclass
class Program:
    """compute(step, vertices that take part, with `inbox`, aggregates) -> their new rows (id, active, …); a vertex freezes with active = false;
    send(step, new rows, aggregates) -> (dst, message…) or None; fold: named aggregates of the messages by dst, which become the struct `inbox`;
    aggregates: columns over the new rows; those in `start` are accumulators, which begin there
    and take up every step's value, the others hold the last step's."""

    compute: Callable[[int, DataFrame, dict], DataFrame]
    send: Callable[[int, DataFrame, dict], DataFrame | None]
    fold: Callable[[], dict[str, Column]]
    aggregates: Callable[[int], list[Column]] = lambda step: []
    keep_running: Callable[[int, dict], bool] = lambda step, aggregates: True
    start: dict[str, float] = dataclasses.field(default_factory=dict)


class Accumulator:
    """A number that supersteps add to; delta is what was added since it was last asked for."""

    def __init__(self, value: float = 0):
        self.set(value)

    def set(self, value: float) -> None:
        self.value = self._last = value

    def add(self, value: float | None) -> None:
        self.value += value or 0

    def delta(self) -> float:
        last, self._last = self._last, self.value
        return self.value - last


@dataclasses.dataclass
class Result:
    """computed: how many vertices took part in the last superstep."""

    vertices: DataFrame
    supersteps: int
    aggregates: dict
    computed: int = 0


def build(vertices: DataFrame, edges: DataFrame, order: str | None = None, on_unknown_src: str = "error") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph: one row for each id, that of the greatest `order` (by default the greatest row); edges stay, repeated ones, too.

    Edges of unknown sources raise UnknownEdgeSource, or are left out with "drop"; where they end is looked at when a message is sent.
    """
    rest = [c for c in vertices.columns if c != "id"]
    if rest:
        row = F.struct(*rest)
        last = F.max_by(row, order).alias("r") if order else F.max(row).alias("r")
        vertices = vertices.groupBy("id").agg(last).select("id", *(f"r.{c}" for c in rest))
    else:
        vertices = vertices.distinct()
    known = vertices.select(F.col("id").alias("src"))
    if on_unknown_src == "error":
        unknown = edges.join(known, "src", "left_anti").select("src").first()
        if unknown is not None:
            raise UnknownEdgeSource(f"edge of unknown vertex {unknown[0]!r}")
        return vertices, edges
    return vertices, edges.join(known, "src", "left_semi").select(*edges.columns)


def check_destinations(messages: DataFrame, vertices: DataFrame, config: Config) -> DataFrame:
    known = vertices.select(F.col("id").alias("dst"))
    if config.on_unknown_dst == "drop":
        return messages.join(known, "dst", "left_semi")
    unknown = messages.join(known, "dst", "left_anti").select("dst").first()
    if unknown is not None:
        raise UnknownVertex(f"message to unknown vertex {unknown[0]!r}")
    return messages


def _newest(tables: list[DataFrame]) -> DataFrame:
    """One row for each vertex: that of the last table that has it. Older tables only lose the ids that newer ones hold."""
    found = tables[-1]
    for older in reversed(tables[:-1]):
        found = found.unionByName(older.join(found.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return found


def run(vertices: DataFrame, program: Program, config: Config = Config()) -> Result:
    """Supersteps until no vertex is active and no message waits, the program says stop, or max_steps.

    A vertex takes part if it is active or has messages; the others stay as they are
    and are not written again. A column that only `compute` gives is null in a vertex
    that never took part.
    """
    if "active" not in vertices.columns:
        vertices = vertices.withColumn("active", F.lit(True))
    first = stage(vertices, "vertices")
    tables, inbox, step, aggregates, took_part = [first], None, 0, dict(program.start), 0
    totals = {name: Accumulator(value) for name, value in program.start.items()}
    size = first.count()
    while config.max_steps is None or step < config.max_steps:
        if inbox is None:
            taking_part = tables[-1].where("active").withColumn("inbox", F.lit(None))  # who is active took part in the last step
        else:
            folds = program.fold()
            folded = inbox.groupBy(F.col("dst").alias("id")).agg(*(c.alias(k) for k, c in folds.items())).select("id", F.struct(*folds).alias("inbox"))
            taking_part = _newest(tables).join(folded, "id", "left").where(F.col("active") | F.col("inbox").isNotNull())
        computed = stage(program.compute(step, taking_part, aggregates), "vertices")
        count = [F.sum(F.col("active").cast("long")).alias("active"), F.count(F.lit(1)).alias("computed")]
        found = computed.agg(*count, *program.aggregates(step)).first().asDict()
        took_part = found.pop("computed")
        tables = [computed] if took_part == size else [*tables, computed]
        if len(tables) > _MOST_TABLES:
            # The last table stays by itself, as only its vertices can be active.
            tables = [stage(_newest(tables[:-1]), "vertices"), computed]
        for name, total in totals.items():
            total.add(found[name])
        aggregates = found | {name: total.value for name, total in totals.items()}
        messages = program.send(step, computed, aggregates)
        if messages is not None:
            inbox = stage(check_destinations(messages, first, config), "messages")
        waiting = messages is not None and not inbox.isEmpty()
        inbox = inbox if messages is not None else None
        step += 1
        if not program.keep_running(step - 1, aggregates) or not (waiting or aggregates["active"]):
            break
    return Result(_newest(tables), step, aggregates, took_part)


def broadcast(vertices: DataFrame, edges: DataFrame, sources: DataFrame, value: int) -> DataFrame:
    """(id, value): every out-neighbour of a source holds `value` after two supersteps, the others 0."""
    links = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").select("dst")
    program = Program(
        compute=lambda step, v, _: v.select("id", (F.coalesce(F.col("inbox.value"), F.lit(0)) if step else F.lit(0)).alias("value"), F.lit(step == 0).alias("active")),
        send=lambda step, v, _: links.withColumn("value", F.lit(value)) if step == 0 else None,
        fold=lambda: {"value": F.max("value")},
    )
    return run(vertices.select("id"), program, Config(max_steps=2)).vertices.select("id", "value")


def aggregate(vertices: DataFrame, value: str, offset: float = 0) -> Result:
    """A superstep in which every vertex adds its value to `total`, which starts at an offset, and 1 to `vertices`."""
    program = Program(
        compute=lambda step, v, _: v.select("id", value, F.lit(False).alias("active")),
        send=lambda step, v, _: None,
        fold=dict,
        aggregates=lambda step: [F.sum(value).alias("total"), F.count(F.lit(1)).alias("vertices")],
        start={"total": offset, "vertices": 0},
    )
    return run(vertices.select("id", value), program, Config(max_steps=1))


def out_degree(edges: DataFrame) -> DataFrame:
    """(id, degree), every edge counted, however often it repeats."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
