"""The SQL of page texts on references of every form, against the expressions."""

import duckdb
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.plans import queries

TEXTS = ["and&amp", "&amp;lt; &amp;amp &ampamp; &ampx &copysr; &copy&copy;2 &notit; &notin;", "&#34&#34; &#x41&#X42;c &#0; &#128; &#xD800 &#99999999999999999999; &#1114112;", "&nosuch; &nosuch & &; a&b", "  &nbsp; x &emsp;", "", "plain"]


def test_references(spark):
    pages = [(i, f"<title>{t}</title><p>{t}</p>") for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(pages, "k int, html string").select("k", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("content"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (k INT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    want = con.execute(f"SELECT k, {queries._TITLE_SQL}, {queries._TEXT_SQL} FROM pages ORDER BY k").fetchall()
    assert [tuple(r) for r in frame.orderBy("k").collect()] == want
