import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import bsp, closure, coloring, pagerank, shortest_paths

#: Edges of four small graphs, scores of A, B and C that are known for them (fixed values, within 0.01), and the superstep of the stop.
RANKED = [
    ([("A", "B"), ("B", "C"), ("C", "A")], (1 / 3, 1 / 3, 1 / 3), 2),
    ([("A", "B"), ("B", "C"), ("C", "A"), ("C", "B")], (0.2145, 0.3937, 0.3879), 14),
    ([("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")], (0.2569, 0.4860, 0.2569), 42),
    ([("A", "B"), ("B", "C")], (0.1842, 0.3411, 0.4745), 12),
]


def graph(spark, edges):
    pairs = [tuple(e) for e in (edges.split() if isinstance(edges, str) else edges)]
    return spark.createDataFrame([(v,) for v in sorted({x for p in pairs for x in p})], "id string"), spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("edges,scores,stop", RANKED)
def test_pagerank_golden(spark, edges, scores, stop):
    found = pagerank.pagerank(*graph(spark, edges))
    got = dict(found.scores.collect())
    assert found.supersteps == stop and found.settled
    assert [got[v] for v in "ABC"] == pytest.approx(scores, abs=0.01)
    assert sum(got.values()) == pytest.approx(1, abs=0.001)


def test_pagerank_rules(spark):
    vertices, edges = graph(spark, "AB BA AA AX")
    vertices = vertices.where("id <> 'X'")
    with pytest.raises(bsp.UnknownVertex):
        pagerank.pagerank(vertices, edges)
    assert pagerank.pagerank(vertices, edges, pagerank.Config(on_unknown_dst="drop")).scores.count() == 2
    assert pagerank.pagerank(vertices.limit(0), edges).scores.count() == 0
    with pytest.raises(ValueError):
        pagerank.Config(damping=1.5)
    assert pagerank.Config(damping=0).damping == 0.85
    slow = graph(spark, RANKED[2][0])
    with pytest.raises(pagerank.NotSettled):
        pagerank.pagerank(*slow, pagerank.Config(max_steps=5))
    cut = pagerank.pagerank(*slow, pagerank.Config(steps=5))
    assert (cut.supersteps, cut.settled) == (5, False)


def test_pagerank_by_brute_force(spark):
    """Repeated edges, links to oneself and dead ends, against the formula in numpy."""
    rng = np.random.default_rng(6)
    n = 60
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (220, 2)) if a % 7]
    share = np.zeros((n, n))
    for a, b in pairs:
        share[b, a] += a != b
    degree = share.sum(0)
    share, dead, score = share / np.maximum(degree, 1), degree == 0, np.full(n, 1 / n)
    while True:
        last, score = score, 0.15 / n + 0.85 * (share @ score + score[dead].sum() / n)
        if np.abs(score - last).sum() < 0.001:
            break
    found = pagerank.pagerank(spark.createDataFrame([(str(i),) for i in range(n)], "id string"), spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string"))
    got = dict(found.scores.collect())
    assert [got[str(i)] for i in range(n)] == pytest.approx(score, abs=1e-9)


def cheapest(edges, source):
    """Supersteps in plain Python: (cost, way) of every vertex, the smaller predecessor on ties within a step."""
    best, frontier = {source: (0, (source,))}, {source}
    while frontier:
        offers = {}
        for a, b, cost in edges:
            if a in frontier:
                offer = (best[a][0] + cost, a)
                offers[b] = min(offers.get(b, offer), offer)
        frontier = {b for b, (cost, _) in offers.items() if b not in best or cost < best[b][0]}
        best |= {b: (offers[b][0], (*best[offers[b][1]][1], b)) for b in sorted(frontier)}
    return best


@pytest.mark.parametrize("most", [shortest_paths._MOST_TABLES, 2])
def test_shortest_paths(spark, monkeypatch, most):
    monkeypatch.setattr(shortest_paths, "_MOST_TABLES", most)
    rng = np.random.default_rng(9)
    edges = [(f"v{a}", f"v{b}", int(c)) for a, b, c in zip(rng.integers(0, 40, 130), rng.integers(0, 40, 130), rng.integers(0, 30, 130))]
    edges += [(f"v{i}", f"v{i + 1}", 3) for i in range(12)] + [("x", "y", 1)]
    frame = spark.createDataFrame(edges, "src string, dst string, cost long")
    found = shortest_paths.shortest_paths(frame, "v0")
    want = cheapest(edges, "v0")
    assert {r["dst"]: (r["cost"], tuple(r["path"])) for r in shortest_paths.with_paths(found).collect()} == want
    assert shortest_paths.path_to(found, "v12") == (list(want["v12"][1]), want["v12"][0])
    with pytest.raises(bsp.UnknownVertex):
        shortest_paths.path_to(found, "y")
    with pytest.raises(ValueError):
        shortest_paths.shortest_paths(frame.withColumn("cost", F.col("cost") - 20), "v0")


@pytest.mark.parametrize("given", [{}, {"0": 1, "3": 1}])
def test_coloring(spark, given):
    _, edges = graph(spark, "01 02 12 13 23 34")
    vertices = spark.createDataFrame([(str(i), given.get(str(i))) for i in range(6)], "id string, pre_color int")
    colors = dict(coloring.color(vertices, edges).collect())
    assert colors["5"] == 1 and None not in colors.values() and max(colors.values()) <= 4
    assert all(colors[a] != colors[b] for a, b in edges.collect())
    assert all(colors[v] == c for v, c in given.items())
    row = coloring.stats(coloring.color(vertices, edges), edges).first()
    assert row["conflicts"] == 0 and row["most_neighbours"] == 3


def test_dependencies(spark):
    edges = spark.createDataFrame([("p0", "p1"), ("p0", "r1"), ("p1", "r1"), ("p1", "r2")], "id string, on string")
    assert {r["id"] for r in closure.all_dependencies(edges, "p0").collect()} == {"p1", "r1", "r2"}
    long = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)] + [("5", "2")], "id string, on string")
    assert {r["id"]: r["depth"] for r in closure.all_dependencies(long, "0").collect()} == {str(i): i for i in range(1, 41)}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, on string")
    assert {r["id"] for r in closure.all_dependencies(cycle, "a").collect()} == {"a", "b"}


def test_supersteps(spark):
    vertices, edges = graph(spark, "01 02 03")
    got = dict(bsp.broadcast(vertices, edges, vertices.where("id = '0'"), 42).collect())
    assert got == {"0": 0, "1": 42, "2": 42, "3": 42}
    many = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("n"))
    assert bsp.aggregate(many, "n", 5).aggregates == {"active": 0, "total": 1005, "vertices": 1000}
    total = bsp.Accumulator(3)
    total.add(4)
    total.add(None)
    assert (total.value, total.delta(), total.delta()) == (7, 4, 0)
    total.set(1)
    assert (total.value, total.delta()) == (1, 0)
    # An accumulator takes up every step; other aggregates hold the last one.
    counting = bsp.Program(lambda s, v, a: v.select("id", F.lit(True).alias("active")), lambda s, v, a: None, dict, lambda s: [F.count(F.lit(1)).alias("seen"), F.count(F.lit(1)).alias("last")], start={"seen": 0})
    assert bsp.run(vertices, counting, bsp.Config(max_steps=3)).aggregates == {"active": 4, "seen": 12, "last": 4}
    lost = bsp.Program(lambda s, v, a: v.select("id", F.lit(True).alias("active")), lambda s, v, a: v.limit(1).select(F.lit("?").alias("dst"), F.lit(1).alias("m")), lambda: {"m": F.sum("m")})
    with pytest.raises(bsp.UnknownVertex):
        bsp.run(vertices, lost, bsp.Config(max_steps=2))
    with pytest.raises(ValueError):
        bsp.Config(max_steps=0)


def test_frozen_vertices_are_left_alone(spark):
    """Vertex b is inactive and gets no message, c is woken once; only who takes part is computed and written."""
    vertices = spark.createDataFrame([("a", 0, True), ("b", 0, False), ("c", 0, False)], "id string, n int, active boolean")
    seen = []

    def compute(step, v, _):
        seen.append(sorted(r["id"] for r in v.select("id").collect()))
        return v.select("id", (F.col("n") + 1).alias("n"), ((F.col("id") == "a") & (F.lit(step) < 2)).alias("active"))

    program = bsp.Program(
        compute=compute,
        send=lambda step, v, _: v.where("id = 'a'").select(F.lit("c").alias("dst")) if step == 0 else None,
        fold=lambda: {"n": F.count(F.lit(1))},
        aggregates=lambda step: [F.sum("n").alias("sum")],
    )
    found = bsp.run(vertices, program)
    assert seen == [["a"], ["a", "c"], ["a"]] and found.supersteps == 3
    assert {r["id"]: (r["n"], r["active"]) for r in found.vertices.collect()} == {"a": (3, False), "b": (0, False), "c": (1, False)}
    assert (found.computed, found.aggregates["sum"]) == (1, 3)


def test_freezing_by_brute_force(spark):
    """A token walks on; whoever holds it counts. Many steps, so tables of newer rows are made one."""
    size, steps = 23, 11
    vertices = spark.createDataFrame([(i, 0, i == 0) for i in range(size)], "id long, held int, active boolean")
    program = bsp.Program(
        compute=lambda step, v, _: v.select("id", (F.col("held") + 1).alias("held"), F.lit(False).alias("active")),
        send=lambda step, v, _: v.select(((F.col("id") * 3 + 1) % size).alias("dst")) if step < steps - 1 else None,
        fold=lambda: {"n": F.count(F.lit(1))},
    )
    held, at = [0] * size, 0
    for _ in range(steps):
        held[at] += 1
        at = (at * 3 + 1) % size
    found = bsp.run(vertices, program)
    assert found.supersteps == steps and [r["held"] for r in found.vertices.orderBy("id").collect()] == held


def test_graph_build(spark):
    given = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 3, 3), ("b", 7, 1)], "id string, value int, nth int")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), ("y", "a")], "src string, dst string")
    with pytest.raises(bsp.UnknownEdgeSource):
        bsp.build(given, edges)
    vertices, kept = bsp.build(given, edges, "nth", on_unknown_src="drop")
    assert sorted((r["id"], r["value"]) for r in vertices.collect()) == [("a", 3), ("b", 7)]
    assert sorted(map(tuple, kept.collect())) == [("a", "b"), ("a", "b"), ("a", "z")]
    with pytest.raises(bsp.UnknownVertex):
        bsp.check_destinations(kept.select("dst"), vertices, bsp.Config())


def test_hubs_are_split(spark):
    """A star of 20,000 edges over four partitions: none holds twice the median, and scores are as without."""
    star = spark.range(20_000).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"))
    links, hubs = pagerank._split(star, 100)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 200)]
    sizes = sorted(r["count"] for r in links.repartition(4, "src", "part").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    rng = np.random.default_rng(3)
    pairs = {(str(a), str(b)) for a, b in rng.integers(0, 40, (300, 2))} | {("0", str(b)) for b in range(40)}
    vertices, edges = graph(spark, sorted(pairs))
    whole, split = (dict(pagerank.pagerank(vertices, edges, pagerank.Config(hub_edges=n)).scores.collect()) for n in (10**6, 3))
    assert split.keys() == whole.keys() and all(split[v] == pytest.approx(s, abs=1e-12) for v, s in whole.items())


def test_colors_by_the_rule(spark):
    """Each vertex has the least colour that its neighbours of greater rank, and those with a given colour, do not have."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (260, 2))})
    vertices = spark.createDataFrame([(i, 2 if i == 5 else 1 if i % 20 == 3 else None) for i in range(62)], "id long, pre_color int")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    rank = {r["id"]: (r["t"], r["id"]) for r in vertices.select("id", F.xxhash64(F.lit(42), "id").alias("t")).collect()}
    want = {r["id"]: r["pre_color"] for r in vertices.collect() if r["pre_color"] is not None}
    near = {i: {b for p in pairs if i in p for b in p} - {i} for i in range(62)}
    given = set(want)
    for v in sorted(set(range(62)) - given, key=rank.get, reverse=True):
        used = {want[u] for u in near[v] if u in given or rank[u] > rank[v]}
        want[v] = next(c for c in range(1, 99) if c not in used)
    assert dict(coloring.color(vertices, edges).collect()) == want
