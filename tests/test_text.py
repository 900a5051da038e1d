import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from webloom.functions import scalars, text
from webloom.operators import pipeline


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_sentences(spark):
    assert one(spark, "a+.b tail. X", text.sentences) == ["a+.", "b tail.", " X"]
    assert one(spark, "Hello world! Is 3.14 pi? End", text.sentences) == ["Hello world!", " Is 3.", "14 pi?", " End"]
    assert one(spark, "", text.sentences) == []


def test_summary(spark):
    body = "Nothing here at all. Alpha beta gamma. Skip this one now. Beta wins the day today."
    assert one(spark, body, lambda c: text.summary(c, ["beta"])) == "Alpha beta gamma... Beta wins the day today."
    assert one(spark, body, lambda c: text.summary(c, ["beta"], 10)) == "Alpha bet..."
    assert one(spark, body, lambda c: text.summary(c, ["zzz"])) == ""


def test_highlight(spark):
    assert one(spark, "Test KEYWORD1 keyword2", lambda c: text.highlight(c, ["keyword1", "KEYWORD2"])) == "Test <em>KEYWORD1</em> <em>keyword2</em>"
    assert one(spark, "a.b (c)", lambda c: text.highlight(c, ["."])) == "a<em>.</em>b (c)"
    assert text.parse_query('"a b"') == ("phrase", "a b") and text.parse_query("a") == ("match", "a")


@pytest.mark.parametrize("n,said", [(9, "Fizz"), (25, "Buzz"), (15, "FizzBuzz"), (0, "0"), (7, "7")])
def test_fizzbuzz(spark, n, said):
    assert one(spark, str(n), lambda c: scalars.fizzbuzz(c.cast("int"))) == said


def test_scalars(spark):
    assert one(spark, "42.0", lambda c: scalars.vat_inclusive_price(c.cast("double"), F.lit(0.10))) == pytest.approx(46.2)
    assert one(spark, "64 bytes: icmp_seq=1 ttl=64 time=42000 ms", scalars.rtt_ms) == 42_000
    assert one(spark, "no reply", scalars.rtt_ms) is None
    assert [one(spark, str(k), lambda c: scalars.backoff_ms(c.cast("int"))) for k in (0, 3, 31)] == [2, 16, 32_000]
    assert one(spark, '{"price": 3.5}', scalars.price_of_json) == 3.5
    assert one(spark, "a", lambda c: scalars.same_bytes(c, F.lit("a"))) and not one(spark, None, lambda c: scalars.same_bytes(c, F.lit("a")))


def test_branches(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    out = pipeline.broadcast(rows, *(lambda df, k=k: df.select(F.concat("t", F.lit(k)).alias("t")) for k in ("1", "2")))
    assert sorted(r["t"] for r in out.collect()) == ["a1", "a2", "b1", "b2"]
    with pytest.raises(ValueError):
        pipeline.broadcast(rows)


def split(value):
    """Sentences by a window of three characters, in plain Python."""
    kind = lambda c: {"Ll": "lower", "Lu": "upper"}.get(unicodedata.category(c), {"S": "symbol", "N": "number", "P": "mark"}.get(unicodedata.category(c)[0], "space" if c.isspace() else ""))
    found, at, i = [], 0, 0
    while i + 3 < len(value) - 0:
        one, stop, after = value[i], value[i + 1], value[i + 2]
        if i >= at and stop in ".!?" and (kind(one) in ("lower", "symbol", "number", "space") and kind(after) in ("mark", "space", "number", "upper") or kind(one) == "symbol"):
            found.append(value[at : i + 2])
            at = i + 2
        i += 1
    return [*found, value[at:]] if value[at:] else found


def summed_up(value, terms, budget=256):
    rated = []
    for i, sentence in enumerate(split(value)):
        found = sentence.split()
        hits = sum(w.lower() in {t.lower() for t in terms} for w in found)
        if hits:
            rated.append((-hits / len(found), i, sentence))
    taken = []
    for _, i, sentence in sorted(rated):
        if budget <= 0:
            break
        cut = sentence[:budget] + "..." if len(sentence) > budget else sentence
        budget -= len(cut)
        taken.append((i, cut))
    out, last = "", None
    for i, sentence in sorted(taken):
        out += (".." if last is not None and i != last + 1 else "") + sentence + ("" if sentence.endswith(".") else ".")
        last = i
    return out.strip()


def test_documents_by_brute_force(spark):
    where = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(where):
        pytest.skip("test tables are not here")
    terms = ["the", "of", "LA"]
    docs = spark.read.parquet(where).select("text").where("text is not null")
    for r in docs.select("text", text.sentences(F.col("text")).alias("parts"), text.summary(F.col("text"), terms).alias("summary")).collect():
        assert r["parts"] == split(r["text"]) and "".join(r["parts"]) == r["text"]
        assert r["summary"] == summed_up(r["text"], terms)
