"""The crawl pass: fetched pages in, links, edges and documents out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import index, linkgraph
from webloom.schema import uuid_of, zero_time
from webloom.storage import stage


def fetch_filter(fetched: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """Rows of (url, status, content_type, …) worth reading: no excluded file name,
    no private host, a status of 200 to 299 and an HTML content type."""
    kept = fetched.where(~urls.excluded(F.col("url")))
    kept = drop_private(kept, urls.host(F.col("url")), private)
    return kept.where(F.col("status").between(200, 299) & F.col("content_type").contains("html"))


def drop_private(rows: DataFrame, host: Column, addresses: DataFrame | None) -> DataFrame:
    """Rows whose host is not private. Literal addresses are tested as they are;
    `addresses` (host, ip) stands for name resolution, and names it lacks count as public."""
    rows = rows.where(~urls.private_ip(host))
    if addresses is None:
        return rows
    hidden = addresses.where(urls.private_ip(F.col("ip"))).select(F.col("host").alias("__host")).distinct()
    return rows.join(hidden, host == F.col("__host"), "left_anti")


def extract_links(pages: DataFrame, private: DataFrame | None = None, encode: bool = False) -> DataFrame:
    """(url, link, nofollow, place): each page's distinct targets in order of appearance.

    Targets are resolved against the page's base, lose their fragment, and stay
    if they are http or https, no excluded file, and on the page's own host or a
    host that is not private. A host that is given with a port of another site
    cannot be resolved and is dropped. With `encode`, paths are percent-encoded where
    they need it, and targets that are no URLs are dropped.
    """
    read = pages.select("url", html.base_href(F.col("html")).alias("href"), html.link_tags(F.col("html")).alias("tags"))
    base = read.select("url", html.base_url(F.col("href"), F.col("url")).alias("base"), "tags")
    resolved = F.transform(
        "tags",
        lambda t: F.struct(urls.without_fragment(urls.resolve(t["href"], F.col("base"))).alias("link"), html.is_nofollow(t["tag"]).alias("nofollow")),
    )
    # Resolved before they are laid out, so that no filter works a link out again.
    found = base.select("url", "base", F.posexplode(resolved).alias("place", "t")).select("url", "base", "place", F.col("t.link").alias("link"), F.col("t.nofollow").alias("nofollow"))
    if encode:
        found = found.where(urls.parsable(F.col("link"))).withColumn("link", urls.encoded(F.col("link")))
    found = found.where(F.col("link").isNotNull() & urls.scheme(F.col("link")).isin("http", "https") & ~urls.excluded(F.col("link")))
    own = urls.host(F.col("link")) == urls.host(F.col("base"))
    other_port = F.col("link").rlike(r"^[A-Za-z]+://[^/?#]*:\d+(?:[/?#]|$)")
    found = found.withColumn("__own", own).where(F.col("__own") | ~other_port)
    foreign = drop_private(found.where(~F.col("__own")), urls.host(F.col("link")), private)
    kept = found.where("__own").unionByName(foreign) if private is not None else found.where(F.col("__own") | ~urls.private_ip(urls.host(F.col("link"))))
    first = kept.groupBy("url", "link").agg(F.min(F.struct("place", "nofollow")).alias("f"))
    return first.select("url", "link", F.col("f.nofollow").alias("nofollow"), F.col("f.place").alias("place"))


def extract_text(pages: DataFrame) -> DataFrame:
    """(url, title, content)."""
    return pages.select("url", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("content"))


def crawl(links: DataFrame, edges: DataFrame, documents: DataFrame, pages: DataFrame, now: datetime | Column, private: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, edges, documents) after a pass over `pages` (url, html).

    Pages are upserted as retrieved now, targets as not retrieved yet. Targets
    that are not nofollow get an edge; edges of a crawled page that it no longer
    has are dropped. Documents keep the rank they had. What is found on the pages and
    the new links are staged, so that no page is read twice for its links.
    """
    found = stage(extract_links(pages, private), "found")
    seen = pages.select("url", F.lit(now).cast("timestamp").alias("retrieved_at"))
    targets = found.select(F.col("link").alias("url")).distinct().select("url", zero_time().alias("retrieved_at"))
    new_links = stage(linkgraph.upsert_links(links, seen.unionByName(targets)), "links")
    ids = new_links.select("id", "url")
    ends = found.where(~F.col("nofollow")).join(ids.select(F.col("id").alias("src"), "url"), "url")
    ends = ends.join(ids.select(F.col("id").alias("dst"), F.col("url").alias("link")), "link").select("src", "dst")
    crawled = ids.join(pages.select("url"), "url", "left_semi").select("id")
    new_edges = linkgraph.keep_current_edges(linkgraph.merge_edges(edges, ends, now), crawled, now)
    text = extract_text(pages).join(ids, "url").select(F.col("id").alias("link_id"), "url", "title", "content", F.lit(now).cast("timestamp").alias("indexed_at"))
    return new_links, new_edges, index.upsert(documents, text)


def changes(links: DataFrame, edges: DataFrame, documents: DataFrame, pages: DataFrame, now: datetime | Column, private: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links, edges, removed edges, documents) that a pass over `pages` changes, as `crawl` would; what it leaves alone is not in them.

    Of the old tables only rows of the pages and of their targets are taken up.
    """
    at = F.lit(now).cast("timestamp")
    found = stage(extract_links(pages, private), "found")
    seen = pages.select("url", at.alias("retrieved_at"))
    targets = found.select(F.col("link").alias("url")).distinct().select("url", zero_time().alias("retrieved_at"))
    touched = seen.unionByName(targets).groupBy("url").agg(F.max("retrieved_at").alias("retrieved_at"))
    old = links.join(touched.select("url"), "url", "left_semi").select("url", "id", "retrieved_at", F.col("retrieved_at").alias("before"))
    fresh = touched.select("url", F.lit(None).cast("string").alias("id"), "retrieved_at", F.lit(None).cast("timestamp").alias("before"))
    merged = old.unionByName(fresh).groupBy("url").agg(*(f(c).alias(c) for f, c in ((F.min, "id"), (F.max, "retrieved_at"), (F.max, "before"))))
    known = stage(merged.select(F.coalesce("id", uuid_of(F.col("url"))).alias("id"), "url", "retrieved_at", "before"), "links")
    ids = known.select("id", "url")
    ends = found.where(~F.col("nofollow")).join(ids.select(F.col("id").alias("src"), "url"), "url")
    ends = stage(ends.join(ids.select(F.col("id").alias("dst"), F.col("url").alias("link")), "link").select("src", "dst").distinct(), "ends")
    crawled = ids.join(pages.select("url"), "url", "left_semi")
    of_pages = stage(edges.join(crawled.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns), "edges")
    new_edges = linkgraph.merge_edges(of_pages.join(ends, ["src", "dst"], "left_semi").select(*edges.columns), ends, at)
    removed = of_pages.where(F.col("updated_at") < at).join(ends, ["src", "dst"], "left_anti").select("src", "dst")
    text = extract_text(pages).join(crawled, "url").select(F.col("id").alias("link_id"), "url", "title", "content", at.alias("indexed_at"))
    of_documents = documents.join(crawled.select(F.col("id").alias("link_id")), "link_id", "left_semi").select(*documents.columns)
    new_links = known.where(F.col("before").isNull() | (F.col("before") < F.col("retrieved_at"))).select("id", "url", "retrieved_at")
    return new_links, new_edges, removed, index.upsert(of_documents, text)


def crawl_count(pages: DataFrame) -> DataFrame:
    """(pages): distinct pages of a pass."""
    return pages.agg(F.countDistinct(uuid_of(F.col("url"))).alias("pages"))
