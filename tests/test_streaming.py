import datetime as dt

from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.streaming import service

PAGES = "url string, html string"


def crawl_once(spark, tmp_path, state, day):
    source = spark.readStream.schema(PAGES).parquet(f"{tmp_path}/pages")
    service.crawl_service(source, state, f"{tmp_path}/checkpoint", now=lambda: dt.datetime(2024, 1, day)).awaitTermination(120)


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")


def links_of(state):
    links, edges, documents = state.read()
    urls = {r["id"]: r["url"] for r in links.select("id", "url").collect()}
    return {(urls[r["src"]][-1], urls[r["dst"]][-1]) for r in edges.select("src", "dst").collect()}, {r["url"][-1:]: (r["title"], round(r["pagerank"], 4)) for r in documents.select("url", "title", "pagerank").collect()}


def test_ticks_with_ranks_between(spark, tmp_path):
    """Three crawls with a rank pass after each, and a new process (a new state) before each."""
    add(spark, tmp_path, [("http://t.example/a", '<title>A</title><a href="/b">'), ("http://t.example/b", '<a href="/a">')])
    crawl_once(spark, tmp_path, service.GraphState(spark, f"{tmp_path}/state"), 1)
    service.rank_pass(service.GraphState(spark, f"{tmp_path}/state"))
    assert links_of(service.GraphState(spark, f"{tmp_path}/state")) == ({("a", "b"), ("b", "a")}, {"a": ("A", 0.5), "b": ("", 0.5)})
    add(spark, tmp_path, [("http://t.example/c", '<title>C</title><a href="/a">')])
    crawl_once(spark, tmp_path, service.GraphState(spark, f"{tmp_path}/state"), 2)
    edges, documents = links_of(service.GraphState(spark, f"{tmp_path}/state"))
    assert edges == {("a", "b"), ("b", "a"), ("c", "a")} and documents["a"] == ("A", 0.5) and documents["c"] == ("C", 0.0)
    service.rank_pass(service.GraphState(spark, f"{tmp_path}/state"))
    ranks = {k: r for k, (_, r) in links_of(service.GraphState(spark, f"{tmp_path}/state"))[1].items()}
    assert ranks["a"] > ranks["b"] > ranks["c"] > 0
    add(spark, tmp_path, [("http://t.example/a", '<title>A2</title><a href="/c">')])
    crawl_once(spark, tmp_path, service.GraphState(spark, f"{tmp_path}/state"), 3)
    state = service.GraphState(spark, f"{tmp_path}/state")
    edges, documents = links_of(state)
    assert edges == {("a", "c"), ("b", "a"), ("c", "a")} and documents["a"] == ("A2", ranks["a"])
    service.rank_pass(state)
    assert state.version == 5 and sorted(state.versions()) == [3, 4, 5] and state.batch(f"{tmp_path}/checkpoint") == 2


def test_failures_leave_the_state(spark, tmp_path, monkeypatch):
    """A tick that fails after a rank pass keeps the last version; the same batch goes in once when it is run again."""
    state = service.GraphState(spark, f"{tmp_path}/state")
    add(spark, tmp_path, [("http://t.example/a", '<a href="/b">')])
    crawl_once(spark, tmp_path, state, 1)
    service.rank_pass(state)
    before = links_of(state)
    add(spark, tmp_path, [("http://t.example/b", '<a href="/a">')])
    write, tables = service.GraphState.write, []

    def fails(self, links, edges, documents, *more):
        links.write.parquet(f"{self.path}/v{max(self.versions()) + 1}/links")  # a part of a version, without its end
        raise OSError("lost")

    monkeypatch.setattr(service.GraphState, "write", fails)
    try:
        crawl_once(spark, tmp_path, state, 2)
    except Exception as e:
        tables.append(str(e))
    assert tables and "lost" in tables[0] and links_of(service.GraphState(spark, f"{tmp_path}/state")) == before
    monkeypatch.setattr(service.GraphState, "write", write)
    crawl_once(spark, tmp_path, service.GraphState(spark, f"{tmp_path}/state"), 2)
    after = links_of(state)
    assert after[0] == {("a", "b"), ("b", "a")}
    # The batch went in, but the query did not note it: it is offered again.
    version = state.version
    state.write(*crawl.crawl(*state.read(), spark.createDataFrame([], PAGES), F.lit(dt.datetime(2024, 1, 2))), f"{tmp_path}/checkpoint", 9)
    add(spark, tmp_path, [("http://t.example/b", "")])
    crawl_once(spark, tmp_path, state, 3)
    assert state.version == version + 1 and links_of(state)[0] == after[0]
