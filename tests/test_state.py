"""State that is merged when it is read: against a plain model, in the bytes that a step writes, and in the folders that a scan opens."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from webloom.schema import uuid_of
from webloom.streaming import service
from webloom.streaming.state import GraphState, part_of

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def links_of(spark, numbers, day=1):
    data = spark.createDataFrame([(f"http://t.example/{n}",) for n in numbers], "url string")
    return data.select(uuid_of(F.col("url")).alias("id"), "url", F.lit(DAY + dt.timedelta(days=day)).alias("retrieved_at"))


def edges_of(spark, pairs):
    data = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    return data.select(F.concat_ws("-", "src", "dst").alias("id"), uuid_of(F.col("src")).alias("src"), uuid_of(F.col("dst")).alias("dst"), F.lit(DAY).alias("updated_at"))


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files)


def test_steps_against_a_model(spark, tmp_path):
    """Random upserts and deletes, as many as make folders merge, with a reader who keeps an old version."""
    rng, model, state = random.Random(4), {}, GraphState(spark, f"{tmp_path}/s", parts=2)
    for step in range(9):
        set_ = {(rng.randrange(12), rng.randrange(4)) for _ in range(rng.choice([1, 3, 20]))}
        gone = {(rng.randrange(12), rng.randrange(4)) for _ in range(4)} - set_
        removed = edges_of(spark, gone).select("src", "dst")
        state.write(None, edges_of(spark, set_).withColumn("id", F.concat("id", F.lit(f":{step}"))), None, "source", step, True, removed)
        for pair in set_:
            model[pair] = f"{pair[0]}-{pair[1]}:{step}"
        for pair in gone:
            model.pop(pair, None)
        assert sorted(r["id"] for r in state.table("edges").select("id").collect()) == sorted(model.values())
    again = GraphState(spark, f"{tmp_path}/s", parts=2)
    assert again.batch("source") == 8 and sorted(again.versions()) == [6, 7, 8]
    assert len(again._notes()["tables"]["edges"]) <= 5
    folders = os.listdir(f"{tmp_path}/s/data/edges")
    assert {f for n in (6, 7, 8) for f, _ in again._notes(n)["tables"]["edges"]} == set(folders)


def test_a_step_writes_as_much_as_it_changes(spark, tmp_path):
    written = {}
    for rows in (300, 30_000):
        state = GraphState(spark, f"{tmp_path}/{rows}", parts=2)
        base = spark.range(rows).select(F.concat(F.lit("http://t.example/"), "id").alias("url"))
        state.write(base.select(uuid_of(F.col("url")).alias("id"), "url", F.lit(DAY).alias("retrieved_at")), None, None, None, -1, True)
        before = size_of(f"{tmp_path}/{rows}")
        state.write(links_of(spark, range(100)), None, None, None, -1, True)
        written[rows] = size_of(f"{tmp_path}/{rows}") - before
        newest = state.table("links").agg(F.count(F.lit(1)), F.sum(F.when(F.col("retrieved_at") > DAY, 1))).first()
        assert tuple(newest) == (rows, 100)
    assert written[30_000] < 1.3 * written[300]


def test_scores_do_not_write_documents(spark, tmp_path):
    state = GraphState(spark, f"{tmp_path}/s", parts=2)
    pages = spark.createDataFrame([(f"http://t.example/{n}", f'<a href="/{(n + 1) % 20}">' + "word %d " % n * 5_000) for n in range(20)], "url string, html string")
    service._store(state, pages, DAY)
    before = size_of(f"{tmp_path}/s")
    service.rank_pass(state)
    assert size_of(f"{tmp_path}/s") - before < before / 5
    assert {round(r["pagerank"], 6) for r in state.read()[2].collect()} == {0.05}
    # A page that is crawled again keeps its rank.
    service._store(state, pages.limit(1), DAY + dt.timedelta(days=1))
    assert {round(r["pagerank"], 6) for r in state.read()[2].collect()} == {0.05}


def test_ranks_leave_out_what_came_after_the_start(spark, tmp_path):
    state = GraphState(spark, f"{tmp_path}/s", parts=2)
    state.write(links_of(spark, ["a", "b"], 0).unionByName(links_of(spark, ["late"], 5)), None, None, None, -1, True)
    service.rank_pass(state, now=DAY + dt.timedelta(days=2))
    assert state.table("scores").count() == 2


def test_scans_of_a_range_open_its_folders(spark, tmp_path):
    state = GraphState(spark, f"{tmp_path}/s", parts=8)
    state.write(links_of(spark, range(400)), None, None, None, -1, True)
    state.write(links_of(spark, range(40), 2), None, None, None, -1, True)
    start, end = "40000000-0000-0000-0000-000000000000", "60000000-0000-0000-0000-000000000000"
    found = state.table("links", start, end)
    every = state.table("links").where((F.col("id") >= start) & (F.col("id") < end))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) and found.count() > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(__part") >= 2
    newest = state._folder("links", sorted(os.listdir(f"{tmp_path}/s/data/links"))[0], (start, end))
    assert {r["f"].split("__part=")[1].split("/")[0] for r in newest.select(F.input_file_name().alias("f")).distinct().collect()} == {"2"}
    ids = [r[0] for r in spark.sql("select uuid() from range(200)").collect()]
    data = spark.createDataFrame([(i,) for i in ids], "id string")
    assert all(r["p"] == part_of(r["id"], 5) for r in data.select("id", part_of(F.col("id"), 5).alias("p")).collect())


WEB = "url string, status int, content_type string, html string"


def test_due_links_of_ranges(spark, tmp_path):
    """Two services with half of the ids each crawl what one does; what has no answer stays due; what was read is due again later."""
    web = spark.createDataFrame(
        [
            ("http://t.example/0", 200, "text/html", '<a href="/1"><a href="/2"><a href="/none"><a href="/a.png">'),
            ("http://t.example/1", 200, "text/html", '<a href="/3">'),
            ("http://t.example/2", 500, "text/html", '<a href="/4">'),
            ("http://t.example/3", 200, "text/html", '<a href="/0"><a href="http://10.0.0.1/x">'),
            ("http://t.example/4", 200, "text/html", ""),
        ],
        WEB,
    )
    state = GraphState(spark, f"{tmp_path}/s", parts=4)
    service.seed(state, web.limit(1).select("url"))
    reads = []
    for k in range(6):
        reads.append(service.crawl_due(state, web, DAY + dt.timedelta(minutes=k), 3_600, k % 2, 2))
    assert sum(reads) == 3 and reads[-2:] == [0, 0]
    times = {r["url"][-4:]: r["y"] for r in state.table("links").select("url", F.year("retrieved_at").alias("y")).collect()}
    assert {u for u, y in times.items() if y > 1} == {"le/0", "le/1", "le/3"} and {u for u, y in times.items() if y == 1} == {"le/2", "none"}
    assert {r["url"][-1] for r in state.read()[2].collect()} == {"0", "1", "3"}
    assert service.crawl_until_done(state, web, lambda k: DAY + dt.timedelta(minutes=90 + k), 3_600) == 1
    changed = web.withColumn("html", F.when(F.col("url").endswith("/0"), '<a href="/3">').otherwise(F.col("html")))
    service.crawl_until_done(state, changed, lambda k: DAY + dt.timedelta(days=1, minutes=k), 3_600)
    urls = {r["id"]: r["url"][-1] for r in state.table("links").select("id", "url").collect()}
    assert {(urls[r["src"]], urls[r["dst"]]) for r in state.table("edges").collect()} == {("0", "3"), ("1", "3"), ("3", "0")}


def test_ranks_at_an_interval(spark, tmp_path):
    state = GraphState(spark, f"{tmp_path}/s", parts=1)
    state.write(links_of(spark, range(3), 0), None, None, None, -1, True)
    query = service.every(state, f"{tmp_path}/c", "1 second", service.rank_pass)
    try:
        began = time.time()
        while GraphState(spark, f"{tmp_path}/s").version < 2 and time.time() < began + 90:
            time.sleep(1)
    finally:
        query.stop()
    assert state.version >= 2 and state.table("scores").count() == 3
