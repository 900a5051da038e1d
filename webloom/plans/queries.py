"""Registered queries over the Parquet tables, each with the DuckDB SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html import entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, scalars, text, urls
from webloom.operators import bsp, closure, coloring, crawl, index, linkgraph, pagerank, pipeline, search, shortest_paths
from webloom.operators.partition import Range
from webloom.operators.segments import TextIndex
from webloom.schema import uuid_of
from webloom.sources.tables import (
    EPOCH,
    INDEXED_SQL,
    PAGE_LINKS_SQL,
    TRADE_EDGES_SQL,
    TRADE_LINKS_SQL,
    _uuid,
    indexed,
    page_links,
    table,
    trade_edges,
    trade_links,
)
from webloom.storage import shared_dir, stage

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql is not None:
            _SQL[query.__name__] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _seconds(column: str):
    return F.unix_timestamp(column).alias(column)


def _at(seconds: int):
    return F.timestamp_seconds(F.lit(seconds))


# Scans

_MIDDLE = ("40000000-0000-0000-0000-000000000000", "c0000000-0000-0000-0000-000000000000")
_BEFORE = EPOCH + 6_000


@register(f"WITH {PAGE_LINKS_SQL} SELECT * FROM page_links WHERE id >= '{_MIDDLE[0]}' AND id < '{_MIDDLE[1]}' AND retrieved_at < {_BEFORE}")
def links_in_range(spark, sf_dir):
    found = linkgraph.links_in_range(page_links(spark, sf_dir), *_MIDDLE, _at(_BEFORE))
    return found.select("id", "url", _seconds("retrieved_at"))


_EDGES_BEFORE = 850_000_000


@register(f"WITH {TRADE_EDGES_SQL} SELECT * FROM trade_edges WHERE src >= '{_MIDDLE[0]}' AND src < '{_MIDDLE[1]}' AND updated_at < {_EDGES_BEFORE}")
def edges_in_range(spark, sf_dir):
    found = linkgraph.edges_in_range(trade_edges(spark, sf_dir), *_MIDDLE, _at(_EDGES_BEFORE))
    return found.select("id", "src", "dst", _seconds("updated_at"))


@register(f"WITH {PAGE_LINKS_SQL} SELECT * FROM page_links WHERE id IN (SELECT min(id) FROM page_links)")
def find_link(spark, sf_dir):
    links = page_links(spark, sf_dir)
    least = links.agg(F.min("id")).first()[0]
    return linkgraph.lookup(links, "id", least).select("id", "url", _seconds("retrieved_at"))


@register(f"WITH {INDEXED_SQL} SELECT link_id, url, title, content, indexed_at, round(pagerank, 6) AS pagerank FROM indexed WHERE link_id = (SELECT max(link_id) FROM indexed)")
def find_doc(spark, sf_dir):
    docs = indexed(spark, sf_dir)
    greatest = docs.agg(F.max("link_id")).first()[0]
    return linkgraph.lookup(docs, "link_id", greatest).select("link_id", "url", "title", "content", _seconds("indexed_at"), F.round("pagerank", 6).alias("pagerank"))


@register(f"WITH {PAGE_LINKS_SQL} SELECT * FROM page_links WHERE retrieved_at < {EPOCH + 86_400} - 3600 * 20")
def links_due_for_crawl(spark, sf_dir):
    due = linkgraph.links_due(page_links(spark, sf_dir), _at(EPOCH + 86_400), 3_600 * 20)
    return due.select("id", "url", _seconds("retrieved_at"))


# Changes

_NEW_LINKS_SQL = f"new_links AS (SELECT CASE WHEN page_id % 3 = 0 THEN url || '/new' ELSE url END AS url, {EPOCH} + page_id * 30 + 9000 AS retrieved_at FROM pages)"


@register(f"""WITH {PAGE_LINKS_SQL}, {_NEW_LINKS_SQL}
  SELECT coalesce(min(id), {_uuid('url')}) AS id, url, max(retrieved_at) AS retrieved_at
  FROM (SELECT id, url, retrieved_at FROM page_links UNION ALL SELECT NULL, url, retrieved_at FROM new_links) GROUP BY url""")
def upsert_links(spark, sf_dir):
    new = table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("url"),
        F.timestamp_seconds(EPOCH + F.col("page_id") * 30 + 9_000).alias("retrieved_at"),
    )
    return linkgraph.upsert_links(page_links(spark, sf_dir), new).select("id", "url", _seconds("retrieved_at"))


_NOW = 1_000_000_000


@register(f"""WITH {TRADE_EDGES_SQL}, fresh AS (SELECT DISTINCT {_uuid("'http://supplier/' || s_suppkey")} AS src, {_uuid("'http://part/' || (s_suppkey % 50 + 1)")} AS dst FROM supplier)
  SELECT coalesce(min(id), {_uuid("src || '>' || dst")}) AS id, src, dst, max(updated_at) AS updated_at
  FROM (SELECT src, dst, id, updated_at FROM trade_edges UNION ALL SELECT src, dst, NULL, {_NOW} FROM fresh) GROUP BY src, dst""")
def upsert_edges(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(
        uuid_of(F.concat(F.lit("http://supplier/"), "s_suppkey")).alias("src"), uuid_of(F.concat(F.lit("http://part/"), F.col("s_suppkey") % 50 + 1)).alias("dst")
    )
    out = linkgraph.upsert_edges(trade_edges(spark, sf_dir), new, trade_links(spark, sf_dir), _at(_NOW))
    return out.select("id", "src", "dst", _seconds("updated_at"))


@register(f"""WITH {TRADE_EDGES_SQL}, {TRADE_LINKS_SQL}, known AS (SELECT id FROM trade_links WHERE retrieved_at % 10 <> 3)
  SELECT id, src, dst FROM trade_edges WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)""")
def edge_fk_violations(spark, sf_dir):
    known = trade_links(spark, sf_dir).where(F.unix_timestamp("retrieved_at") % 10 != 3)
    return linkgraph.unknown_ends(trade_edges(spark, sf_dir), known).select("id", "src", "dst")


@register(f"""WITH {TRADE_EDGES_SQL}, {TRADE_LINKS_SQL}, deleted AS (SELECT id FROM trade_links WHERE retrieved_at % 10 = 3)
  SELECT id, src, dst FROM trade_edges WHERE src NOT IN (SELECT id FROM deleted) AND dst NOT IN (SELECT id FROM deleted)""")
def cascade_edges(spark, sf_dir):
    deleted = trade_links(spark, sf_dir).where(F.unix_timestamp("retrieved_at") % 10 == 3)
    return linkgraph.cascade_edges(trade_edges(spark, sf_dir), deleted).select("id", "src", "dst")


@register(f"""WITH {TRADE_EDGES_SQL} SELECT * FROM trade_edges WHERE NOT (src = {_uuid("'http://supplier/1'")} AND updated_at < {_EDGES_BEFORE})""")
def remove_stale_edges(spark, sf_dir):
    left = linkgraph.remove_stale_edges(trade_edges(spark, sf_dir), uuid_of(F.lit("http://supplier/1")), _at(_EDGES_BEFORE))
    return left.select("id", "src", "dst", _seconds("updated_at"))


@register(f"""WITH {INDEXED_SQL}, fresh AS (
    SELECT CASE WHEN indexed_at % 3 = 0 THEN {_uuid("url || '/new'")} ELSE link_id END AS link_id, 'again' AS title, indexed_at + 5 AS indexed_at, 0.5::DOUBLE AS pagerank FROM indexed)
  SELECT coalesce(f.link_id, o.link_id) AS link_id, CASE WHEN f.link_id IS NOT NULL THEN f.title ELSE o.title END AS title,
    CASE WHEN f.link_id IS NOT NULL THEN f.indexed_at ELSE o.indexed_at END AS indexed_at,
    round(CASE WHEN o.link_id IS NOT NULL THEN o.pagerank ELSE f.pagerank END, 6) AS pagerank
  FROM indexed o FULL JOIN fresh f ON o.link_id = f.link_id""")
def index_upsert(spark, sf_dir):
    """All documents indexed again, a third of them under other ids; each twice, of which the later counts."""
    docs = indexed(spark, sf_dir)
    seconds = F.unix_timestamp("indexed_at")
    link_id = F.when(seconds % 3 == 0, uuid_of(F.concat("url", F.lit("/new")))).otherwise(F.col("link_id"))
    again = lambda title, later: docs.select(link_id.alias("link_id"), "url", F.lit(title).alias("title"), "content", F.timestamp_seconds(seconds + later).alias("indexed_at"), F.lit(0.5).alias("pagerank"))
    out = index.upsert(docs, again("again", 5).unionByName(again("before", 4)))
    return out.select("link_id", "title", _seconds("indexed_at"), F.round("pagerank", 6).alias("pagerank"))


@register(f"""WITH {INDEXED_SQL}, {PAGE_LINKS_SQL}, scores AS (SELECT link_id, (indexed_at % 5) / 8.0::DOUBLE AS s FROM indexed UNION ALL SELECT id, 0.75 FROM page_links)
  SELECT coalesce(i.link_id, s.link_id) AS link_id, coalesce(url, '') AS url, coalesce(title, '') AS title, round(coalesce(s, pagerank), 6) AS pagerank,
    coalesce(indexed_at, -62135596800) AS indexed_at FROM indexed i FULL JOIN scores s ON i.link_id = s.link_id""")
def update_scores(spark, sf_dir):
    docs = indexed(spark, sf_dir)
    scores = docs.select("link_id", (F.unix_timestamp("indexed_at") % 5 / 8).alias("pagerank"))
    scores = scores.unionByName(page_links(spark, sf_dir).select(F.col("id").alias("link_id"), F.lit(0.75).alias("pagerank")))
    out = index.update_scores(docs, scores)
    seconds = F.when(F.year("indexed_at") < 1000, F.lit(-62_135_596_800)).otherwise(F.unix_timestamp("indexed_at"))
    return out.select("link_id", "url", "title", F.round("pagerank", 6).alias("pagerank"), seconds.alias("indexed_at"))


@register("SELECT count(DISTINCT url) AS pages FROM pages")
def crawl_count(spark, sf_dir):
    return crawl.crawl_count(table(spark, sf_dir, "pages"))


@register(f"""WITH {PAGE_LINKS_SQL}, valid AS (SELECT regexp_replace(u, '#.*', '') AS url FROM (
    SELECT CASE WHEN page_id % 4 = 0 THEN 'ftp://x/' || page_id ELSE url || '#top' END AS u FROM pages) WHERE regexp_matches(u, '^(?i)https?://[^/]+'))
  SELECT coalesce(min(id), {_uuid('url')}) AS id, url, max(retrieved_at) AS retrieved_at
  FROM (SELECT id, url, retrieved_at FROM page_links UNION ALL SELECT NULL, url, {EPOCH + 10_000_000} FROM valid) GROUP BY url""")
def submit_links(spark, sf_dir):
    given = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://x/"), "page_id")).otherwise(F.concat("url", F.lit("#top"))).alias("url"))
    return linkgraph.submit_links(page_links(spark, sf_dir), given, _at(EPOCH + 10_000_000)).select("id", "url", _seconds("retrieved_at"))


# Filters and extraction

#: The extraction patterns for RE2, in which SQL runs them (fixed values, those of functions/html.py and urls.py).
_LINK_RE = r"""(?i)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>"""
_EXCLUDED_RE = r"(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$"

_FETCHED_SQL = """fetched AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'http://10.0.0.' || (page_id % 256) || '/x' WHEN page_id % 7 = 0 THEN url || '.PNG' ELSE url END AS url,
  CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 3 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages)"""


def _fetched(spark, sf_dir):
    p = F.col("page_id")
    url = F.when(p % 11 == 0, F.concat(F.lit("http://10.0.0."), p % 256, F.lit("/x"))).when(p % 7 == 0, F.concat("url", F.lit(".PNG"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url.alias("url"),
        F.when(p % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(p % 3 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
    )


@register(f"WITH {_FETCHED_SQL} SELECT page_id, url FROM fetched WHERE NOT regexp_matches(url, '{_EXCLUDED_RE}')")
def crawlable_pages(spark, sf_dir):
    return _fetched(spark, sf_dir).where(~urls.excluded(F.col("url"))).select("page_id", "url")


@register(f"""WITH {_FETCHED_SQL} SELECT page_id, url FROM fetched WHERE NOT regexp_matches(url, '{_EXCLUDED_RE}') AND url NOT LIKE 'http://10.%'
  AND status BETWEEN 200 AND 299 AND contains(content_type, 'html')""")
def fetch_filter(spark, sf_dir):
    return crawl.fetch_filter(_fetched(spark, sf_dir)).select("page_id", "url")


_IP_SQL = "(c_custkey * 7919) % 224 || '.' || (c_custkey * 31) % 256 || '.' || c_custkey % 256 || '.' || c_nationkey"


@register(f"""SELECT ip, (v BETWEEN 2130706432 AND 2147483647) OR (v BETWEEN 167772160 AND 184549375) OR (v BETWEEN 2886729728 AND 2887778303)
    OR (v BETWEEN 3232235520 AND 3232301055) OR (v BETWEEN 2851995648 AND 2852061183) OR (v BETWEEN 0 AND 16777215) OR v = 4294967295 AS private
  FROM (SELECT ip, ((split_part(ip, '.', 1)::BIGINT * 256 + split_part(ip, '.', 2)::BIGINT) * 256 + split_part(ip, '.', 3)::BIGINT) * 256 + split_part(ip, '.', 4)::BIGINT AS v
    FROM (SELECT {_IP_SQL} AS ip FROM customer))""")
def private_hosts(spark, sf_dir):
    c = F.col("c_custkey")
    ip = F.concat_ws(".", *(x.cast("string") for x in ((c * 7919) % 224, (c * 31) % 256, c % 256, F.col("c_nationkey"))))
    return table(spark, sf_dir, "customer").select(ip.alias("ip")).select("ip", urls.private_ipv4(F.col("ip")).alias("private"))


_IP6_SQL = "CASE c_custkey % 6 WHEN 0 THEN 'fe80::' || hex(c_custkey) WHEN 1 THEN 'FD' || lpad(hex(c_custkey % 256), 2, '0') || ':0:0::' || hex(c_custkey) WHEN 2 THEN '2001:db8::' || hex(c_custkey) WHEN 3 THEN '::' || hex(c_custkey % 5) WHEN 4 THEN 'febf:1:2:3:4:5:6:' || hex(c_custkey % 65536) ELSE 'fec0::' || hex(c_custkey % 65536) || ':1' END"


@register(f"SELECT c_custkey, {_IP6_SQL} AS ip, c_custkey % 6 IN (0, 1, 4) OR (c_custkey % 6 = 3 AND c_custkey % 5 = 1) AS private FROM customer")
def private_hosts_v6(spark, sf_dir):
    """Addresses of the second family: link-local and unique local ones, the loopback, and neighbours of these that are public."""
    c = F.col("c_custkey")
    short = F.hex(c % 65536)
    ip = (
        F.when(c % 6 == 0, F.concat(F.lit("fe80::"), F.hex(c)))
        .when(c % 6 == 1, F.concat(F.lit("FD"), F.lpad(F.hex(c % 256), 2, "0"), F.lit(":0:0::"), F.hex(c)))
        .when(c % 6 == 2, F.concat(F.lit("2001:db8::"), F.hex(c)))
        .when(c % 6 == 3, F.concat(F.lit("::"), F.hex(c % 5)))
        .when(c % 6 == 4, F.concat(F.lit("febf:1:2:3:4:5:6:"), short))
        .otherwise(F.concat(F.lit("fec0::"), short, F.lit(":1")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")).select("c_custkey", "ip", urls.private_ip(F.col("ip")).alias("private"))


@register("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '::ffff:10.1.2.' || c_custkey % 256 WHEN 1 THEN '::FFFF:ac1' || hex(c_nationkey % 16) || ':' || hex(c_custkey % 65536)
    WHEN 2 THEN '0:0:0:0:0:ffff:' || hex(c_custkey % 65536) || ':1' ELSE '::10.1.2.' || c_custkey % 256 END AS ip,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN c_custkey % 65536 // 256 IN (0, 10, 127) OR c_custkey % 65536 BETWEEN 44048 AND 44063 OR c_custkey % 65536 IN (49320, 43518) ELSE false END AS private FROM customer""")
def private_hosts_mapped(spark, sf_dir):
    """Addresses of the first family in the form of the second, with a dotted tail or in digits; the last kind only looks like one."""
    c = F.col("c_custkey")
    ip = (
        F.when(c % 4 == 0, F.concat(F.lit("::ffff:10.1.2."), c % 256))
        .when(c % 4 == 1, F.concat(F.lit("::FFFF:ac1"), F.hex(F.col("c_nationkey") % 16), F.lit(":"), F.hex(c % 65536)))
        .when(c % 4 == 2, F.concat(F.lit("0:0:0:0:0:ffff:"), F.hex(c % 65536), F.lit(":1")))
        .otherwise(F.concat(F.lit("::10.1.2."), c % 256))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")).select("c_custkey", "ip", urls.private_ip(F.col("ip")).alias("private"))


def _quad(value):
    return F.concat_ws(".", *(F.floor(value / 256**k).cast("long") % 256 for k in (3, 2, 1, 0)))


@register("""WITH n AS (SELECT DISTINCT s_suppkey * 2654435761 % 4294967296 AS v, 8 + s_suppkey % 21 AS bits FROM supplier), h AS (SELECT DISTINCT c_custkey * 40503 * 65537 % 4294967296 AS v FROM customer)
  SELECT v // 16777216 || '.' || v // 65536 % 256 || '.' || v // 256 % 256 || '.' || v % 256 AS ip FROM h
  WHERE EXISTS (SELECT 1 FROM n WHERE n.v // (2::BIGINT ** (32 - bits))::BIGINT = h.v // (2::BIGINT ** (32 - bits))::BIGINT)""")
def hosts_in_networks(spark, sf_dir):
    """Addresses that are in any network of a table; a network for each supplier, with host bits set."""
    value = F.col("s_suppkey") * 2_654_435_761 % 4_294_967_296
    networks = table(spark, sf_dir, "supplier").select(F.concat(_quad(value), F.lit("/"), 8 + F.col("s_suppkey") % 21).alias("cidr"))
    hosts = table(spark, sf_dir, "customer").select(_quad(F.col("c_custkey") * 40_503 * 65_537 % 4_294_967_296).alias("ip"))
    return urls.in_networks(hosts, networks)


_LINKS_SQL = f"""tags AS (SELECT url, unnest(regexp_extract_all(html, '{_LINK_RE.replace("'", "''")}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_LINK_RE.replace("'", "''")}', 1), 1) - 1 AS place FROM pages),
  resolved AS (SELECT url, place, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href, '#.*', '') AS link FROM tags WHERE href <> ''),
  found AS (SELECT url, link, min(place) AS place FROM resolved WHERE NOT regexp_matches(link, '{_EXCLUDED_RE}') GROUP BY ALL)"""


@register(f"WITH {_LINKS_SQL} SELECT url, link, place::INT AS place, FALSE AS nofollow FROM found")
def extract_links(spark, sf_dir):
    return crawl.extract_links(table(spark, sf_dir, "pages")).select("url", "link", "place", "nofollow")


@register(f"""WITH tags AS (SELECT url, page_id, unnest(regexp_extract_all(html, '{_LINK_RE.replace("'", "''")}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_LINK_RE.replace("'", "''")}', 1), 1) - 1 AS place FROM pages),
  resolved AS (SELECT url, place, 'https://mirror.example' || regexp_replace(href, '#.*', '') AS link, page_id % 2 = 0 AS nofollow FROM tags WHERE href <> '')
  SELECT url, link, min(place)::INT AS place, nofollow FROM resolved WHERE NOT regexp_matches(link, '{_EXCLUDED_RE}') GROUP BY ALL""")
def extract_links_of_based_pages(spark, sf_dir):
    """The links of all pages with a base put before them, and every link of each second page marked nofollow."""
    marked = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r"(?i)<a\b", '<a rel="nofollow"')).otherwise(F.col("html"))
    based = F.concat(F.lit('<base href="https://mirror.example/d'), "page_id", F.lit('">\n'), marked)
    return crawl.extract_links(table(spark, sf_dir, "pages").select("url", based.alias("html"))).select("url", "link", "place", "nofollow")


_ENCODED_SQL = """CASE WHEN regexp_full_match(path, '[A-Za-z0-9\\-_.~!$&''()*+,;=:@\\[\\]%/]*') THEN link
  ELSE origin || array_to_string(list_transform(string_split(url_decode(path), ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9\\-_.~$&+,/:;=@]') THEN c ELSE url_encode(c) END), '') || substr(link, length(origin) + length(path) + 1) END"""


@register(f"""WITH {_LINKS_SQL}, parts AS (SELECT url, link, place, regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM found)
  SELECT url, {_ENCODED_SQL} AS link, min(place)::INT AS place FROM parts GROUP BY ALL""")
def encoded_links(spark, sf_dir):
    """The links of all pages as they are asked for: percent-encoded."""
    return crawl.extract_links(table(spark, sf_dir, "pages"), encode=True).select("url", "link", "place")


@register(f"WITH {_LINKS_SQL} SELECT url, place::INT AS place, link FROM resolved")
def resolve_urls(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("url", F.posexplode(html.link_tags(F.col("html"))).alias("place", "t")).where(F.col("t.href") != "")
    return tags.select("url", "place", urls.without_fragment(urls.resolve(F.col("t.href"), F.col("url"))).alias("link"))


#: What a number from 128 to 159 stands for: code page 1252, where it has a character.
_OLD_SQL = ", ".join("'" + (bytes([k]).decode("cp1252", "ignore") or chr(k)) + "'" for k in range(128, 160))
_REFERENCE_SQL = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def _names_sql(names) -> str:
    """A map from names to their characters in the public table."""
    word = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{word(n)}: {word(entities.html5[n])}" for n in names) + "}"


_WHOLE_SQL = _names_sql(n for n in entities.html5 if n.endswith(";"))
#: Names that may stand without a semicolon, the longest first.
_BARE_NAMES = sorted((n for n in entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _unescape_sql(x: str) -> str:
    """All references, with a semicolon or without one where HTML allows that, replaced once: the rule of `html.unescape`."""
    code = "CASE WHEN r[2:3] IN ('#x', '#X') THEN try_cast('0x' || regexp_replace(r[4:], ';', '') AS BIGINT) ELSE try_cast(regexp_replace(r[3:], ';', '') AS BIGINT) END"
    number = f"""list_transform([{code}], lambda n: CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN [{_OLD_SQL}][n - 127] ELSE chr(n::INT) END)[1]"""
    bare = f"list_transform([regexp_extract(r, '^&({'|'.join(_BARE_NAMES)})', 1)], lambda b: CASE WHEN b <> '' THEN {_names_sql(_BARE_NAMES)}[b] || r[length(b) + 2:] END)[1]"
    decoded = f"CASE WHEN r IS NULL THEN '' WHEN r[2] = '#' THEN {number} ELSE coalesce({_WHOLE_SQL}[r[2:]], {bare}, r) END"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{_REFERENCE_SQL}'), list_transform(regexp_extract_all({x}, '{_REFERENCE_SQL}'), lambda r: {decoded})), lambda p: p[1] || coalesce(p[2], '')), '')"


_COLLAPSE = "regexp_replace({}, '[\\t\\n\\f\\r ]+', ' ', 'g')"
_SPACES_SQL = "'" + html.SPACES + "'"
_TITLE_SQL = f"trim({_unescape_sql(_COLLAPSE.format('''regexp_replace(regexp_extract(html, '(?i)<title.*?>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')'''))}, {_SPACES_SQL})"
_BARE_SQL = "html"
for _tag in ("title", "script", "style"):
    _BARE_SQL = f"regexp_replace({_BARE_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_BARE_SQL = f"regexp_replace(regexp_replace({_BARE_SQL}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"
_TEXT_SQL = f"trim({_unescape_sql(_COLLAPSE.format(_BARE_SQL))}, {_SPACES_SQL})"


@register(f"SELECT url, {_TITLE_SQL} AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", html.title(F.col("html")).alias("title"))


@register(f"SELECT url, {_TEXT_SQL} AS content FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", html.text(F.col("html")).alias("content"))


@register(r"""SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(hp, ':\d*$', '') AS host, hp AS host_port
  FROM (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) AS hp FROM pages)""")
def page_hosts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("url", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.host_port(u).alias("host_port"))


@register(f"""WITH {_LINKS_SQL}, urls AS (SELECT url, true AS page FROM pages UNION ALL SELECT link, false FROM found),
  links AS (SELECT url, bool_or(page) AS page FROM urls GROUP BY url)
  SELECT {_uuid('url')} AS id, url, CASE WHEN page THEN {EPOCH} ELSE -62135596800 END AS retrieved_at FROM links""")
def crawl_links(spark, sf_dir):
    """The links after a crawl of all pages into an empty graph."""
    links = _crawled(spark, sf_dir)[0]
    seconds = F.when(F.year("retrieved_at") < 1000, F.lit(-62_135_596_800)).otherwise(F.unix_timestamp("retrieved_at"))
    return links.select("id", "url", seconds.alias("retrieved_at"))


def _crawled(spark, sf_dir):
    from webloom.schema import DOCUMENTS, EDGES, LINKS

    empty = [spark.createDataFrame([], s) for s in (LINKS, EDGES, DOCUMENTS)]
    return crawl.crawl(*empty, table(spark, sf_dir, "pages").select("url", "html"), _at(EPOCH))


@register(f"""WITH {_LINKS_SQL} SELECT {_uuid("s || '>' || d")} AS id, s AS src, d AS dst FROM (SELECT {_uuid('url')} AS s, {_uuid('link')} AS d FROM found)""")
def crawl_edges(spark, sf_dir):
    return _crawled(spark, sf_dir)[1].select("id", "src", "dst")


@register(f"SELECT {_uuid('url')} AS link_id, url, {_TITLE_SQL} AS title, {_TEXT_SQL} AS content, 0.0::DOUBLE AS pagerank FROM pages")
def crawl_documents(spark, sf_dir):
    return _crawled(spark, sf_dir)[2].select("link_id", "url", "title", "content", "pagerank")


_FAN_OUT = 32


def _tree_of_pages(spark, sf_dir):
    """What a web answers in which page k links to pages 32k + 1 to 32k + 32, besides its own links; one page in 13 is not found."""
    pages = table(spark, sf_dir, "pages").groupBy(urls.without_fragment(F.col("url")).alias("url")).agg(F.min(F.struct("page_id", "html")).alias("p"))
    pages = pages.select("url", F.col("p.page_id").alias("k"), F.col("p.html").alias("html"))
    below = pages.select(F.floor((F.col("k") - 1) / _FAN_OUT).alias("k"), F.concat(F.lit('<a href="'), "url", F.lit('">')).alias("tag")).groupBy("k").agg(F.collect_list("tag").alias("tags"))
    return pages.join(below, "k", "left").select(
        "url", "k", F.when(F.col("k") % 13 == 5, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.concat(F.concat_ws("\n", F.coalesce("tags", F.array().cast("array<string>"))), F.lit("\n"), "html").alias("html")
    )


@register(f"""WITH RECURSIVE src AS (SELECT regexp_replace(url, '#.*', '') AS u, min(page_id) AS k FROM pages GROUP BY 1),
  reach(k, u, depth) AS (SELECT k, u, 0 FROM src WHERE k = (SELECT min(k) FROM src)
    UNION ALL SELECT c.k, c.u, depth + 1 FROM reach r JOIN src c ON floor((c.k - 1) / {_FAN_OUT}.0) = r.k WHERE r.k % 13 <> 5),
  crawled AS (SELECT p.page_id, u, depth FROM reach JOIN pages p ON p.page_id = k WHERE k % 13 <> 5), {_LINKS_SQL},
  every AS (SELECT u AS url, {EPOCH} + 60 * depth AS t FROM crawled UNION ALL SELECT u, -62135596800 FROM reach
    UNION ALL SELECT link, -62135596800 FROM found JOIN pages USING (url) WHERE page_id IN (SELECT page_id FROM crawled))
  SELECT url, max(t) AS retrieved_at FROM every GROUP BY url""")
def crawl_from_seed(spark, sf_dir):
    """Ticks from one seed until no link that is due can be read; what one tick finds the next one fetches. The k-th tick is at minute k."""
    from datetime import datetime, timezone

    from webloom.streaming import service

    fetched = stage(_tree_of_pages(spark, sf_dir), "web")
    state = service.GraphState(spark, f"{shared_dir(spark)}/webloom-{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}")
    service.seed(state, fetched.orderBy("k").limit(1).select("url"))
    service.crawl_until_done(state, fetched, lambda k: datetime.fromtimestamp(EPOCH + 60 * k, timezone.utc), older_than=10**8)
    seconds = F.when(F.year("retrieved_at") < 1000, F.lit(-62_135_596_800)).otherwise(F.unix_timestamp("retrieved_at"))
    return state.table("links").select("url", seconds.alias("retrieved_at"))


# Search

_TERMS = ("worthless", "clown")
_TOKENS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN]+'), lambda t: t <> '')"
_HITS_SQL = f"""{INDEXED_SQL}, tokens AS (SELECT *, {_TOKENS_SQL.format('title')} AS tt, {_TOKENS_SQL.format('content')} AS tc FROM indexed),
  hits AS (SELECT *, (len(list_filter(tt, lambda t: t IN {_TERMS})) + len(list_filter(tc, lambda t: t IN {_TERMS}))) / greatest(len(tt) + len(tc), 1)::DOUBLE AS score
    FROM tokens WHERE list_has_any(tt, {list(_TERMS)}) OR list_has_any(tc, {list(_TERMS)}))"""


#: Stored indexes by application and tables; searches share them.
_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _new_index(spark) -> TextIndex:
    return TextIndex(spark, f"{shared_dir(spark)}/webloom-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")


def _stored(spark, sf_dir) -> TextIndex:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        made = _new_index(spark)
        made.upsert(indexed(spark, sf_dir))
        _INDEXES[key] = made
    return _INDEXES[key]


def _match(spark, sf_dir, expression=" ".join(_TERMS)):
    return search.search(indexed(spark, sf_dir), expression, postings=_stored(spark, sf_dir).postings(search.query_tokens(expression)))


def _placed(spark, page, first=1):
    """(link_id, score, place) of a page's rows."""
    rows = [(r[0], r[2], first + i) for i, r in enumerate(page.rows)]
    return spark.createDataFrame(rows, "link_id string, score double, place int")


def _hit_columns(hits):
    return hits.select("link_id", F.round("pagerank", 6).alias("pagerank"), F.round("score", 9).alias("score"))


@register(f"WITH {_HITS_SQL} SELECT link_id, round(pagerank, 6) AS pagerank, round(score, 9) AS score FROM hits")
def search_match(spark, sf_dir):
    return _hit_columns(search.ranked(_match(spark, sf_dir)))


@register(f"WITH {_HITS_SQL} SELECT link_id, round(pagerank + score, 6) AS rank FROM hits")
def search_additive(spark, sf_dir):
    hits = search.ranked(_match(spark, sf_dir), search.by_sum)
    return hits.select("link_id", F.round(F.col("pagerank") + F.col("score"), 6).alias("rank"))


@register(f"""WITH {INDEXED_SQL} SELECT link_id, round(pagerank, 6) AS pagerank FROM indexed
  WHERE contains(' ' || array_to_string({_TOKENS_SQL.format('content')}, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string({_TOKENS_SQL.format('title')}, ' ') || ' ', ' of the ')""")
def search_phrase(spark, sf_dir):
    return _match(spark, sf_dir, '"Of the"').select("link_id", F.round("pagerank", 6).alias("pagerank"))


@register(f"WITH {_HITS_SQL} SELECT count(*) AS total FROM hits")
def search_total(spark, sf_dir):
    return _match(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@register(f"""WITH {_HITS_SQL} SELECT link_id, coalesce(nullif(title, ''), url) AS title, place::INT AS place FROM (
    SELECT *, row_number() OVER (ORDER BY pagerank DESC, score DESC, link_id) AS place FROM hits) WHERE place BETWEEN 11 AND 20""")
def search_page(spark, sf_dir):
    found = _placed(spark, _stored(spark, sf_dir).page(" ".join(_TERMS), offset=10), 11)
    titles = indexed(spark, sf_dir).select("link_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")).alias("title"))
    return titles.join(F.broadcast(found), "link_id").select("link_id", "title", "place")  # a page's rows


_BM25_SQL = " + ".join(
    f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * size / average))" for i in range(len(_TERMS))
)
_COUNTED_SQL = ", ".join(f"len(list_filter(tt, lambda t: t = '{t}')) + len(list_filter(tc, lambda t: t = '{t}')) AS n{i}" for i, t in enumerate(_TERMS))


def _bm25_sql(source: str) -> str:
    return f"""tokens AS (SELECT *, {_TOKENS_SQL.format('title')} AS tt, {_TOKENS_SQL.format('content')} AS tc FROM {source}),
  counted AS (SELECT link_id, len(tt) + len(tc) AS size, {_COUNTED_SQL} FROM tokens),
  sums AS (SELECT count(*)::DOUBLE AS n, avg(size) AS average, {', '.join(f'count(*) FILTER (n{i} > 0) AS d{i}' for i in range(len(_TERMS)))} FROM counted),
  scored AS (SELECT link_id, {_BM25_SQL} AS score FROM counted, sums WHERE {' OR '.join(f'n{i} > 0' for i in range(len(_TERMS)))})"""


@register(f"""WITH {INDEXED_SQL}, {_bm25_sql('indexed')}
  SELECT link_id, round(score, 9) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, link_id) AS place FROM scored) WHERE place <= 20""")
def search_relevant(spark, sf_dir):
    """The twenty most relevant documents, with an early stop."""
    page = _stored(spark, sf_dir).page(" ".join(_TERMS), size=20, order="score", score="bm25")
    return _placed(spark, page).select("link_id", F.round("score", 9).alias("score"), "place")


_CHANGED_SQL = """changed AS (SELECT link_id, title, CASE WHEN indexed_at % 3 = 0 THEN 'a clown, ' || lang ELSE content END AS content FROM (SELECT *, split_part(url, '/', 3) AS lang FROM indexed) WHERE indexed_at % 11 <> 0)"""


@register(f"""WITH {INDEXED_SQL}, {_CHANGED_SQL}, {_bm25_sql('changed')} SELECT link_id, round(score, 9) AS score, (SELECT count(*) FROM scored) AS total,
    place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, link_id) AS place FROM scored) WHERE place <= 20""")
def search_after_changes(spark, sf_dir):
    """The same over an index in which a third of the documents came again with other texts and every eleventh was deleted."""
    docs, seconds = indexed(spark, sf_dir), F.unix_timestamp("indexed_at")
    kept = _new_index(spark)
    kept.upsert(docs)
    kept.upsert(docs.where(seconds % 3 == 0).withColumn("content", F.concat(F.lit("a clown, "), F.element_at(F.split("url", "/"), 3))))
    kept.delete(docs.where(seconds % 11 == 0))
    page = kept.page(" ".join(_TERMS), size=20, order="score", score="bm25")
    total = kept.postings(list(_TERMS)).agg(F.countDistinct("link_id").alias("total"))
    return _placed(spark, page).join(F.broadcast(total)).select("link_id", F.round("score", 9).alias("score"), "total", "place")  # one row


@register(f"""WITH {_HITS_SQL} SELECT link_id, place FROM (SELECT *, row_number() OVER (ORDER BY pagerank DESC, score DESC, link_id) AS place FROM hits) WHERE place > 15 AND place <= 40""")
def search_far_page(spark, sf_dir):
    """Places 16 to 40 out of hits that are numbered range by range."""
    return search.numbered(_match(spark, sf_dir)).where("place > 15 AND place <= 40").select("link_id", "place")


@register(f"""WITH {_HITS_SQL} SELECT link_id, url, title, content, indexed_at, (SELECT count(*) FROM hits) AS total FROM (
    SELECT *, row_number() OVER (ORDER BY pagerank DESC, score DESC, link_id) AS place FROM hits) WHERE place > 5""")
def search_stream(spark, sf_dir):
    return search.stream(_match(spark, sf_dir), offset=5).select("link_id", "url", "title", "content", _seconds("indexed_at"), "total")


@register(f"""WITH {_HITS_SQL}, t AS (SELECT count(*) AS total FROM hits), p AS (SELECT total, least(10, greatest(total - 10, 0)) AS n FROM t)
  SELECT 11 AS "from", 10 + n AS "to", total, 0 AS prev, CASE WHEN 10 + n < total THEN 10 + n END AS next FROM p""")
def pagination(spark, sf_dir):
    hits = _match(spark, sf_dir)
    n = F.least(F.lit(10), F.greatest(F.col("total") - 10, F.lit(0)))
    counted = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("n", n)
    return counted.select(F.lit(11).alias("from"), (F.lit(10) + F.col("n")).alias("to"), "total", F.lit(0).alias("prev"), F.when(10 + F.col("n") < F.col("total"), 10 + F.col("n")).alias("next"))


_WORDS_SQL = "list_filter(regexp_split_to_array({}, '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}]+'), lambda w: w <> '')"


@register(f"""SELECT doc_id, round(len(list_filter(w, lambda x: lower(x) IN ('the', 'of', 'les'))) / greatest(len(w), 1)::DOUBLE, 9) AS ratio FROM (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents)""")
def match_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.match_ratio(F.col("text"), ["The", "of", "les"]), 9).alias("ratio"))


_SPACE_SQL = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@register(rf"""WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
  w AS (SELECT *, lag(c, 2) OVER o || lag(c) OVER o || c AS three FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT *, sum(CASE WHEN i < n AND regexp_full_match(three, '(?s)[\p{{Ll}}\p{{S}}\p{{N}}{_SPACE_SQL}][.!?][\p{{P}}\p{{N}}\p{{Lu}}{_SPACE_SQL}]|\p{{S}}[.!?].') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM w)
  SELECT doc_id, place::INT AS place, string_agg(c, '' ORDER BY i) AS sentence FROM g GROUP BY doc_id, place""")
def sentences(spark, sf_dir):
    """Every sentence of every document, with its place. SQL looks at three characters at a time."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@register()
def summaries(spark, sf_dir):
    """The summary of every hit, escaped and highlighted."""
    terms = list(_TERMS)
    summary = text.summary(F.col("content"), terms)
    return _match(spark, sf_dir).select("link_id", text.highlight(text.escape_html(summary), terms).alias("summary"))


@register(r"""SELECT doc_id, regexp_replace(regexp_replace(e, '(?i)(the)', '<em>\1</em>', 'g'), '(?i)(em)', '<em>\1</em>', 'g') AS marked FROM (
  SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') AS e FROM documents)""")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.highlight(text.escape_html(F.col("text")), ["the", "em"]).alias("marked"))


@register(f"""WITH {INDEXED_SQL}, t AS (SELECT link_id, field, {_TOKENS_SQL.format('txt')} AS tokens FROM (SELECT link_id, 'title' AS field, title AS txt FROM indexed UNION ALL SELECT link_id, 'content', content FROM indexed))
  SELECT term, link_id, field, count(*) AS n FROM (SELECT link_id, field, unnest(tokens) AS term FROM t) GROUP BY ALL""")
def postings(spark, sf_dir):
    return _stored(spark, sf_dir).postings().select("term", "link_id", "field", "n")


# Aggregates and small functions


@register("SELECT sum(l_quantity) + 5 AS total, count(*) AS vertices FROM lineitem")
def bsp_aggregators(spark, sf_dir):
    """A superstep over all lines as vertices; the accumulator starts at 5."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity")
    found = bsp.aggregate(lines, "l_quantity", 5).aggregates
    return spark.createDataFrame([(found["total"], found["vertices"])], "total double, vertices long")


@register("SELECT l_suppkey AS id, count(*) AS degree FROM lineitem GROUP BY 1")
def out_degree(spark, sf_dir):
    return bsp.out_degree(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@register("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares FROM embeddings")
def sum_of_squares(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.sum_of_squares(F.col("embedding")), 4).alias("squares"))


@register("""SELECT l_suppkey AS vendor, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def quote_fan_in(spark, sf_dir):
    """The last quote of each vendor over the children that answered; the third one failed."""
    lines = table(spark, sf_dir, "lineitem")
    child = lambda flag: lambda df: df.where(F.col("l_returnflag") == flag)
    quotes = pipeline.broadcast(lines, child("A"), child("R"))
    return quotes.groupBy(F.col("l_suppkey").alias("vendor")).agg(F.max_by("l_extendedprice", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("price"))


@register("SELECT o_orderkey AS n, CASE WHEN o_orderkey = 0 THEN '0' WHEN o_orderkey % 15 = 0 THEN 'FizzBuzz' WHEN o_orderkey % 3 = 0 THEN 'Fizz' WHEN o_orderkey % 5 = 0 THEN 'Buzz' ELSE o_orderkey::VARCHAR END AS said FROM orders")
def fizzbuzz(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), scalars.fizzbuzz(F.col("o_orderkey")).alias("said"))


@register("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem")
def vat_price(spark, sf_dir):
    gross = scalars.vat_inclusive_price(F.col("l_extendedprice"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(gross, 4).alias("gross"))


@register("SELECT event_id, round(value * (1 + CAST(json_extract(props, '$.k') AS DOUBLE) / 100), 6) AS gross FROM events")
def vat_price_json(spark, sf_dir):
    price = scalars.price_of_json(F.to_json(F.struct(F.col("value").alias("price"))))
    rate = F.from_json("props", "k double")["k"] / 100
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.vat_inclusive_price(price, rate), 6).alias("gross"))


@register("SELECT event_id, least(CAST(2 * pow(2, event_id % 32) AS BIGINT), 32000) AS wait_ms FROM events")
def exp_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.backoff_ms(F.col("event_id") % 32).alias("wait_ms"))


@register(r"""SELECT event_id, CAST(regexp_extract('64 bytes from 8.8.8.8: icmp_seq=1 ttl=56 time=' || (event_id % 5000) || ' ms', 'time[=<]([\d.]+)[ ]?ms', 1) AS FLOAT)::DOUBLE AS rtt_ms FROM events""")
def extract_rtt(spark, sf_dir):
    line = F.concat(F.lit("64 bytes from 8.8.8.8: icmp_seq=1 ttl=56 time="), F.col("event_id") % 5000, F.lit(" ms"))
    return table(spark, sf_dir, "events").select("event_id", scalars.rtt_ms(line).alias("rtt_ms"))


@register("SELECT c.conv_id, c.turn, u.conv_id AS to_user FROM conversations c JOIN (SELECT DISTINCT conv_id FROM conversations) u ON u.conv_id // 10 = c.conv_id // 10 AND u.conv_id <> c.conv_id")
def chat_broadcast(spark, sf_dir):
    """Every turn to all other members of its room; ten conversations share one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("conv_id") / 10).alias("room"))
    users = turns.select(F.col("conv_id").alias("to_user"), "room").distinct()
    return turns.join(users, "room").where("to_user <> conv_id").select("conv_id", "turn", "to_user")


@register("SELECT l_orderkey, l_linenumber, tag FROM lineitem CROSS JOIN (VALUES ('0'), ('1'), ('2')) t(tag)")
def broadcast_union(spark, sf_dir):
    """Every line once for each of three branches that only differ in a column, so by one scan."""
    tags = F.explode(F.array(*[F.lit(str(k)) for k in range(3)])).alias("tag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tags)


@register(f"WITH {TRADE_LINKS_SQL} SELECT id, count(*) AS parts FROM trade_links WHERE id < 'ffffffff-ffff-ffff-ffff-ffffffffffff' GROUP BY id")
def partition_cover(spark, sf_dir):
    """How many of eleven ranges hold each link: one. The bounds are those of range scans; one scan tests them all."""
    ranges = Range.full(11)
    inside = [((F.col("id") >= low) & (F.col("id") < high)).cast("int") for low, high in map(ranges.part, range(11))]
    found = trade_links(spark, sf_dir).select("id", sum(inside[1:], inside[0]).alias("n")).where("n > 0")
    return found.groupBy("id").agg(F.sum("n").alias("parts"))


@register(f"""WITH {TRADE_LINKS_SQL} SELECT id, CASE WHEN id < '40000000-0000-0000-0000-000000000000' THEN 0 WHEN id < '80000000-0000-0000-0000-000000000000' THEN 1
  WHEN id < 'c0000000-0000-0000-0000-000000000000' THEN 2 WHEN id < 'ffffffff-ffff-ffff-ffff-ffffffffffff' THEN 3 END AS part FROM trade_links""")
def uuid_partition(spark, sf_dir):
    return trade_links(spark, sf_dir).select("id", Range.full(4).column(F.col("id")).alias("part"))


# Graph programs

_TRADE = "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _trade(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return suppliers.unionByName(parts), lines


_IDS = "SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part"


def _pagerank_sql(edges: str, steps: int, damping: float = 0.85, tolerance: float = 0.001) -> str:
    """Supersteps 1 to `steps` side by side; the first past 1 that moved less than the tolerance counts. No rows if none did."""
    ctes = [
        f"ids AS MATERIALIZED ({_IDS})",
        f"raw AS ({edges})",
        "links AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM raw WHERE src <> dst GROUP BY src, dst)",
        "n AS (SELECT count(*)::DOUBLE AS n FROM ids)",
        "dead AS MATERIALIZED (SELECT id FROM ids WHERE id NOT IN (SELECT src FROM links))",
        "s1 AS MATERIALIZED (SELECT id, 1 / (SELECT n FROM n) AS score FROM ids)",
    ]
    for k in range(2, steps + 1):
        ctes.append(
            f"""s{k} AS MATERIALIZED (SELECT i.id, (1 - {damping}) / (SELECT n FROM n) + {damping} * coalesce((SELECT sum(score) FROM s{k - 1} WHERE id IN (SELECT id FROM dead)), 0) / (SELECT n FROM n)
            + {damping} * coalesce(g.got, 0) AS score FROM ids i LEFT JOIN (SELECT dst, sum(score * w) AS got FROM s{k - 1} JOIN links ON src = id GROUP BY dst) g ON g.dst = i.id)"""
        )
        ctes.append(f"m{k} AS (SELECT sum(abs(a.score - b.score)) AS d FROM s{k} a JOIN s{k - 1} b ON a.id = b.id)")
    stop = "CASE " + " ".join(f"WHEN (SELECT d FROM m{k}) < {tolerance} THEN {k}" for k in range(2, steps + 1)) + " END"
    every = " UNION ALL ".join(f"SELECT id, score, {k} AS step FROM s{k}" for k in range(2, steps + 1))
    return f"WITH {', '.join(ctes)} SELECT id, round(score, 8) AS score FROM ({every}) WHERE step = {stop}"


@register(_pagerank_sql(_TRADE, 16))
def pagerank_trade(spark, sf_dir):
    """Suppliers point at the parts they sold, once per sale."""
    vertices, lines = _trade(spark, sf_dir)
    found = pagerank.pagerank(vertices, lines)
    return found.scores.select("id", F.round("score", 8).alias("score"))


_BACK = f"{_TRADE} UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1"


def _back_links(spark, sf_dir, lines):
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    back = first.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return lines.select("src", "dst").unionByName(back)


@register(_pagerank_sql(_BACK, 64))
def pagerank_back_links(spark, sf_dir):
    """The same with links back from the first line of each order, for as many steps as the tolerance takes: 44 or 45 on the given tables, as scores swing between the two sides."""
    vertices, lines = _trade(spark, sf_dir)
    return pagerank.pagerank(vertices, _back_links(spark, sf_dir, lines)).scores.select("id", F.round("score", 8).alias("score"))


@register(_pagerank_sql(_BACK, 64))
def pagerank_back_links_settled(spark, sf_dir):
    """The same graph with all sources of more than eight different targets split as hubs."""
    vertices, lines = _trade(spark, sf_dir)
    found = pagerank.pagerank(vertices, _back_links(spark, sf_dir, lines), pagerank.Config(hub_edges=8))
    return found.scores.select("id", F.round("score", 8).alias("score"))


@register(f"""WITH {_LINKS_SQL} SELECT count(*) AS pages, true AS sums_to_one FROM (SELECT url FROM pages UNION SELECT link FROM found)""")
def pagerank_crawl(spark, sf_dir):
    """Crawl all pages and rank what was found: how many links there are, and that their scores sum to 1."""
    links, edges, _ = _crawled(spark, sf_dir)
    scores = pagerank.pagerank(links, edges).scores
    return scores.agg(F.count(F.lit(1)).alias("pages"), (F.abs(F.sum("score") - 1) <= 0.001).alias("sums_to_one"))


def _paths_sql(rounds: int) -> str:
    both = "SELECT src AS a, dst AS b, q FROM t UNION ALL SELECT dst, src, q FROM t"
    ctes = [
        "t AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)",
        f"links AS MATERIALIZED ({both})",
        "d0 AS (SELECT 's1' AS id, 0::BIGINT AS cost)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(f"d{k} AS MATERIALIZED (SELECT id, min(cost) AS cost FROM (SELECT * FROM d{k - 1} UNION ALL SELECT b, cost + q FROM d{k - 1} JOIN links ON a = id) GROUP BY id)")
    return f"WITH {', '.join(ctes)} SELECT id AS dst, cost FROM d{rounds}"


def _both_ways(spark, sf_dir):
    _, lines = _trade(spark, sf_dir)
    one = lines.groupBy("src", "dst").agg(F.min("l_quantity").cast("long").alias("cost"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


@register(_paths_sql(24))
def shortest_path_costs(spark, sf_dir):
    """The least quantity of goods on a way from supplier 1 to every supplier and part."""
    return shortest_paths.shortest_paths(_both_ways(spark, sf_dir), "s1").select("dst", "cost")


def _ways_sql(rounds: int) -> str:
    """Supersteps of the relaxation with the way in each row: strictly lower costs replace, the smaller predecessor of one step wins."""
    ctes = [
        "t AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)",
        "links AS MATERIALIZED (SELECT src AS a, dst AS b, q FROM t UNION ALL SELECT dst, src, q FROM t)",
        "d0 AS (SELECT 's1' AS id, 0::BIGINT AS cost, 's1' AS way)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(f"o{k} AS MATERIALIZED (SELECT b AS id, min({{'c': cost + q, 'a': a, 'w': way || '>' || b}}) AS m FROM d{k - 1} JOIN links ON a = id GROUP BY b)")
        ctes.append(f"d{k} AS MATERIALIZED (SELECT coalesce(d.id, o.id) AS id, CASE WHEN d.cost IS NULL OR m.c < d.cost THEN m.c ELSE d.cost END AS cost, CASE WHEN d.cost IS NULL OR m.c < d.cost THEN m.w ELSE d.way END AS way FROM d{k - 1} d FULL JOIN o{k} o ON o.id = d.id)")
    return f"WITH {', '.join(ctes)} SELECT id AS dst, cost, way AS path FROM d{rounds}"


@register(_ways_sql(24))
def shortest_paths_from_one(spark, sf_dir):
    """The same with the way itself."""
    found = shortest_paths.with_paths(shortest_paths.shortest_paths(_both_ways(spark, sf_dir), "s1"))
    return found.select("dst", "cost", F.array_join("path", ">").alias("path"))


@register(f"""WITH t AS ({_TRADE}), d AS (SELECT count(DISTINCT b) AS n FROM (SELECT src AS a, dst AS b FROM t UNION ALL SELECT dst, src FROM t) GROUP BY a)
  SELECT (SELECT count(*) FROM ({_IDS})) AS vertices, 0 AS conflicts, true AS few_colors, (SELECT max(n) FROM d) AS most_neighbours""")
def coloring_stats(spark, sf_dir):
    vertices, lines = _trade(spark, sf_dir)
    found = coloring.stats(coloring.color(vertices, lines, hubs_first=True), lines)
    return found.select("vertices", "conflicts", (F.col("colors") <= F.col("most_neighbours") + 1).alias("few_colors"), "most_neighbours")


@register("""WITH RECURSIVE links AS (SELECT 'r' || r_regionkey AS id, 'n' || n_nationkey AS dep FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
  found AS (SELECT dep AS id FROM links WHERE id = 'r1' UNION SELECT dep FROM found JOIN links USING (id)) SELECT id FROM found""")
def all_dependencies(spark, sf_dir):
    """All nations, customers and orders below one region."""
    name = lambda letter, key: F.concat(F.lit(letter), key)
    nations = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("id"), name("n", "n_nationkey").alias("on"))
    customers = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("id"), name("c", "c_custkey").alias("on"))
    orders = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("id"), name("o", "o_orderkey").alias("on"))
    return closure.all_dependencies(nations.unionByName(customers).unionByName(orders), "r1").select("id")


@register(f"SELECT id, CASE WHEN id IN (SELECT dst FROM ({_TRADE}) WHERE src = 's1') THEN 42 ELSE 0 END AS value FROM ({_IDS})")
def bsp_broadcast(spark, sf_dir):
    vertices, lines = _trade(spark, sf_dir)
    return bsp.broadcast(vertices, lines, vertices.where("id = 's1'"), 42)


@register(f"SELECT id, count(src) AS got FROM ({_IDS}) LEFT JOIN ({_TRADE}) ON dst = id GROUP BY id")
def bsp_demo(spark, sf_dir):
    """A vertex program of two supersteps: every vertex greets its neighbours, and counts the greetings it got."""
    vertices, lines = _trade(spark, sf_dir)
    links = lines.select("src", "dst")
    program = bsp.Program(
        compute=lambda step, v, _: v.select("id", F.coalesce(F.col("inbox.n"), F.lit(0).cast("long")).alias("got") if step else F.lit(0).cast("long").alias("got"), F.lit(step == 0).alias("active")),
        send=lambda step, v, _: v.select(F.col("id").alias("src")).join(links, "src").select("dst", F.lit(1).alias("hello")) if step == 0 else None,
        fold=lambda: {"n": F.count(F.lit(1))},
    )
    return bsp.run(vertices, program, bsp.Config(max_steps=2)).vertices.select("id", "got")


@register(f"""SELECT id, CASE WHEN substr(id, 2)::BIGINT % 2 = 0 THEN 3 WHEN id IN (SELECT dst FROM ({_TRADE}) WHERE substr(src, 2)::BIGINT % 2 = 0) THEN 2 ELSE 1 END AS rounds FROM ({_IDS})""")
def bsp_freeze(spark, sf_dir):
    """In how many of three supersteps each vertex took part: odd ones freeze in the first, and those that even suppliers write to in the second wake in the third."""
    vertices, lines = _trade(spark, sf_dir)
    links = lines.select("src", "dst").distinct()
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    program = bsp.Program(
        compute=lambda step, v, _: v.select("id", (F.col("rounds") + 1 if step else F.lit(1)).alias("rounds"), (even & (F.lit(step) < 2)).alias("active")),
        send=lambda step, v, _: v.where("active").select(F.col("id").alias("src")).join(links, "src").select("dst") if step == 1 else None,
        fold=lambda: {"n": F.count(F.lit(1))},
    )
    return bsp.run(vertices, program, bsp.Config(max_steps=3)).vertices.select("id", "rounds")


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, sf_dir):
    """Events by hour and type; the same plan serves a stream."""
    from webloom.streaming.service import event_counts as counted

    return counted(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

