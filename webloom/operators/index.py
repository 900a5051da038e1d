"""The text index: documents keyed by link, and the terms of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.schema import zero_time


class MissingLinkId(ValueError):
    pass


def upsert(documents: DataFrame, new: DataFrame, check: bool = False) -> DataFrame:
    """Documents with the new ones in place of the old; a known document keeps its rank.

    `new` has link_id, url, title, content and indexed_at; a rank of its own counts
    for documents that are not known yet. Of several new rows with one id the last by
    indexed_at counts. MissingLinkId with `check` if an id is null.
    """
    if check and not new.where(F.col("link_id").isNull()).isEmpty():
        raise MissingLinkId("a document has no link id")
    rank = F.col("pagerank") if "pagerank" in new.columns else F.lit(0.0)
    fresh = new.where(F.col("link_id").isNotNull()).select("link_id", F.struct("url", "title", "content", "indexed_at", rank.cast("double").alias("pagerank")).alias("n"))
    fresh = fresh.groupBy("link_id").agg(F.max_by("n", F.struct("n.indexed_at", "n")).alias("n"))
    old = documents.select("link_id", F.struct("url", "title", "content", "indexed_at", "pagerank").alias("o"))
    both = old.join(fresh, "link_id", "full")
    text = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("url", "title", "content", "indexed_at")]
    return both.select("link_id", *text, F.when(F.col("o").isNotNull(), F.col("o.pagerank")).otherwise(F.col("n.pagerank")).alias("pagerank"))


def update_scores(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents with ranks from `scores` (link_id, pagerank); unknown ids get an empty document of zero time."""
    both = documents.join(scores.select("link_id", F.col("pagerank").alias("__score")), "link_id", "full")
    return both.select(
        "link_id",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "content")),
        F.coalesce("indexed_at", zero_time()).alias("indexed_at"),
        F.coalesce("__score", "pagerank").alias("pagerank"),
    )


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(documents: DataFrame) -> DataFrame:
    """(term, link_id, field, positions, n, total): one row per term, document and field, with the document's number of terms."""
    split = documents.select("link_id", terms(F.col("title")).alias("title"), terms(F.col("content")).alias("content"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in ("title", "content")])).alias("f")
    each = split.select("link_id", (F.size("title") + F.size("content")).alias("total"), fields)
    each = each.select("link_id", "total", "f.field", F.posexplode("f.terms").alias("position", "term"))
    grouped = each.groupBy("term", "link_id", "field").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return grouped.select("term", "link_id", "field", "positions", "n", "total")


#: Folders of a written index; a term is in one of them.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def by_bucket(split: DataFrame) -> DataFrame:
    """`split`, whose title and content are arrays of terms, as a row for each bucket of a document's terms: `bucket`, and in `places` what `laid_out` reads.

    The terms of a document are sorted and grouped within its row, so nothing is
    shuffled. In `places` each term begins a line, its places in the title follow after
    spaces and those in the content after commas; terms hold neither.
    """
    rest = [c for c in split.columns if c not in ("title", "content")]
    at = lambda field, k: F.transform(field, lambda t, i: F.struct(bucket(t).alias("bucket"), t.alias("term"), F.lit(k).alias("field"), i.alias("position")))
    laid = split.select(*rest, F.sort_array(F.concat(at("title", 0), at("content", 1))).alias("s"))
    same = lambda i, name: (i > 0) & (F.get("s", i)[name] == F.get("s", i - 1)[name])
    every = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    begun = laid.select(*rest, "s", F.filter(every(F.lit(0), F.size("s")), lambda i: ~same(i, "bucket")).alias("starts"))
    place = lambda i: F.concat(F.when(same(i, "term"), "").otherwise(F.concat(F.lit("\n"), F.get("s", i)["term"])), F.when(F.get("s", i)["field"] == 0, " ").otherwise(","), F.get("s", i)["position"].cast("string"))
    lines = lambda i, k: F.substr(F.array_join(F.transform(every(i, F.coalesce(F.get("starts", k + 1), F.size("s"))), place), ""), F.lit(2))
    groups = F.transform("starts", lambda i, k: F.struct(F.get("s", i)["bucket"].alias("bucket"), lines(i, k).alias("places")))
    # Outer explodes here and below: of a plain one the optimizer makes the array twice, to ask whether it is empty.
    return begun.select(*rest, F.explode_outer(groups).alias("g")).where("g is not null").select(*rest, "g.bucket", "g.places")


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows of `by_bucket` as postings: term, field, positions, n, and in the first row of a term and document its number in all fields, `of_document`."""
    rest = [c for c in rows.columns if c != "places"]
    lines = rows.select(*rest, F.explode_outer(F.split("places", "\n")).alias("line")).withColumn("head", F.split(F.substring_index("line", ",", 1), " "))
    content = F.when(F.contains("line", F.lit(",")), F.split(F.substr("line", F.locate(",", "line") + 1), ",")).otherwise(F.array().cast("array<string>"))
    read = lines.select(*rest, F.get("head", F.lit(0)).alias("term"), F.slice("head", F.lit(2), F.size("head") - 1).cast("array<int>").alias("title"), content.cast("array<int>").alias("content"))
    n = (F.size("title") + F.size("content")).cast("long")
    field = lambda name, first: F.struct(F.lit(name).alias("field"), F.col(name).alias("positions"), F.when(first, n).alias("of_document"))
    both = F.array(field("title", F.lit(True)), field("content", F.size("title") == 0))
    each = read.select(*rest, "term", F.explode_outer(F.filter(both, lambda f: F.size(f["positions"]) > 0)).alias("f"))
    return each.select(*rest, "term", "f.field", "f.positions", F.size("f.positions").cast("long").alias("n"), "f.of_document")


def write_postings(found: DataFrame, path: str, *then: str) -> None:
    """Store postings in a folder for each bucket of terms, sorted, so that a search reads the folders and row groups of its terms only; `then` sorts within a term.

    `found` are postings or rows of `by_bucket`. A bucket is dealt by document, so that
    a term that all documents have is not for one task.
    """
    if "places" in found.columns:
        dealt = laid_out(found.repartition("bucket", F.pmod(F.xxhash64("link_id"), F.lit(16))))
    else:
        dealt = found.repartition(bucket(F.col("term")), F.pmod(F.xxhash64("link_id"), F.lit(16))).withColumn("bucket", bucket(F.col("term")))
    ordered = dealt.sortWithinPartitions("bucket", "term", *then, "link_id")
    ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
