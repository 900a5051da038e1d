"""An index kept in segments against one made anew, pages with an early stop against all hits, and places without one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import index, search
from webloom.operators.segments import TextIndex

DOCS = "link_id string, title string, content string, pagerank double"
WORDS = [f"w{i}" for i in range(30)]


def some(rng, ids):
    return [(f"{i:03d}", " ".join(rng.choices(WORDS, k=2)), " ".join(rng.choices(WORDS, weights=range(30, 0, -1), k=rng.randrange(1, 40))), float(rng.randrange(50))) for i in ids]


def exhaustive(rows, terms, order, score, operator="or"):
    """All hits of rows {id: (title, content, rank)} in order."""
    tokens = {d: (t + " " + c).split() for d, (t, c, _) in rows.items()}
    n, average = len(rows), sum(map(len, tokens.values())) / max(1, len(rows))
    hits = []
    for d, words in tokens.items():
        have = [t for t in terms if t in words]
        if not have or operator == "and" and len(have) < len(terms):
            continue
        if score == "share":
            value = sum(words.count(t) for t in have) / len(words)
        else:
            df = {t: sum(t in w for w in tokens.values()) for t in have}
            value = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / average)) for t in have)
        hits.append((d, rows[d][2], value))
    key = {"rank": lambda h: (-h[1], -round(h[2], 9), h[0]), "sum": lambda h: (-round(h[1] + h[2], 9), h[0]), "score": lambda h: (-round(h[2], 9), h[0])}[order]
    return sorted(hits, key=key)


def test_changes_against_an_index_made_anew(spark, tmp_path):
    rng, rows = random.Random(6), {}
    kept = TextIndex(spark, f"{tmp_path}/kept", blocks=4)
    for step, ids in enumerate([range(120), range(110, 125), [7, 7, 200], range(0, 60, 3)]):
        new = some(rng, ids)
        kept.upsert(spark.createDataFrame(new, DOCS))
        last = {}
        for d, t, c, r in new:
            last[d] = max(last.get(d, (r, t, c)), (r, t, c))
        rows |= {d: (t, c, r) for d, (r, t, c) in last.items()}
        if step in (1, 2):
            gone = [f"{i:03d}" for i in (3, 50, 111, 999)]
            kept.delete(spark.createDataFrame([(g,) for g in gone], "link_id string"))
            rows = {d: v for d, v in rows.items() if d not in gone}
    anew = index.postings(spark.createDataFrame([(d, *v[:2]) for d, v in rows.items()], "link_id string, title string, content string"))
    columns = ["term", "link_id", "field", "positions", "n", "total"]
    assert sorted(map(str, kept.postings().select(*columns).collect())) == sorted(map(str, anew.select(*columns).collect()))
    assert len(kept._notes()["segments"]) <= 4
    for order, score, operator in (("score", "bm25", "or"), ("sum", "bm25", "and")):
        page = kept.page("w0 w7 w7", 3, 10, order=order, score=score, operator=operator)
        want = exhaustive(rows, ["w0", "w7"], order, score, operator)[3:13]
        assert [r[0] for r in page.rows] == [h[0] for h in want] and [r[2] for r in page.rows] == pytest.approx([h[2] for h in want])
    again = TextIndex(spark, f"{tmp_path}/kept")
    pair = next(c.split()[:2] for _, c, _ in rows.values() if len(c.split()) > 2)
    found = {r[0] for r in again.page('"' + " ".join(pair) + '"', size=200).rows}
    assert found == {d for d, (t, c, _) in rows.items() for text in (t, c) if f" {' '.join(pair)} " in f" {text} "}


def test_early_stop(spark, tmp_path):
    """Ranks, and long documents without much relevance, let most postings be; new ranks move the stop."""
    rows = [(f"{i:04d}", "", ("pear " * (30 if i < 8 else 1)) + "plum " * (20 + i % 7), float(i % 500)) for i in range(4_000)]
    docs = {d: (t, c, r) for d, t, c, r in rows}
    kept = TextIndex(spark, f"{tmp_path}/kept", blocks=32)
    kept.upsert(spark.createDataFrame(rows, DOCS))
    for order, score in (("rank", "share"), ("sum", "bm25"), ("rank", "bm25")):
        page = kept.page("pear", 0, 10, order=order, score=score)
        assert [r[0] for r in page.rows] == [h[0] for h in exhaustive(docs, ["pear"], order, score)[:10]]
        assert 0 < page.read < page.postings / 4, (order, page.read, page.postings)
    kept.set_ranks(spark.createDataFrame([("0001", 9_000.0), ("3999", 8_000.0)], "link_id string, pagerank double"))
    page = kept.page("pear", 0, 3)
    docs["0001"], docs["3999"] = (*docs["0001"][:2], 9_000.0), (*docs["3999"][:2], 8_000.0)
    assert [r[0] for r in page.rows] == [h[0] for h in exhaustive(docs, ["pear"], "rank", "share")[:3]] and page.read < page.postings
    assert kept.page("none").rows == [] and kept.page("...").rows == [] and kept.page("pear", 5_000).rows == []


def test_places_without_one_task(spark):
    hits = spark.range(2_000).select(F.format_string("%04d", "id").alias("link_id"), (F.col("id") % 7).cast("double").alias("pagerank"), (F.col("id") % 5 / 5).alias("score"), F.lit("").alias("title"), F.lit("u").alias("url"))
    want = [r["link_id"] for r in search.ranked(hits).collect()]
    far = search.numbered(hits.repartition(5))
    assert [r["link_id"] for r in far.orderBy("place").collect()] == want and [r["place"] for r in far.orderBy("place").collect()] == list(range(1, 2_001))
    rest = search.stream(hits, 1_990)
    assert [r["link_id"] for r in rest.collect()] == want[1_990:] and rest.first()["total"] == 2_000
    for plan in (far, rest):
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    one = search.page(hits, 1_000, 10)
    few = search._FIRST_ROWS
    try:
        search._FIRST_ROWS = 100
        assert [tuple(r) for r in search.page(hits, 1_000, 10).orderBy("place").select("link_id", "place").collect()] == [tuple(r) for r in one.select("link_id", "place").collect()]
    finally:
        search._FIRST_ROWS = few
