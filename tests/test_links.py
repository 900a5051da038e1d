import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import crawl, index, linkgraph, search
from webloom.operators.partition import Range
from webloom.schema import DOCUMENTS, EDGES, LINKS, zero_time
from webloom.sources import stores

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def test_ranges():
    assert [s[:8] for s in Range.full(4).splits] == ["40000000", "80000000", "c0000000", "ffffffff"]
    assert [s[:4] for s in Range.full(3).splits] == ["5555", "aaaa", "ffff"]
    four = Range.full(4)
    for key, part in (("00000000-0000-0000-0000-000000000000", 0), ("12345678-0000-0000-0000-000000000000", 0), ("40000000-0000-0000-0000-000000000000", 1), ("ffffffff-ffff-ffff-ffff-fffffffffffe", 3)):
        assert four.part_of(key) == part
    for bad in (lambda: Range.full(0), lambda: Range(four.splits[0], four.start, 2), lambda: four.part_of(four.splits[-1])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        four.part(4)
    shifted = Range("40000000-0000-0000-0000-000000000000", "80000000-0000-0000-0000-000000000000", 2)
    assert shifted.splits[0].startswith("6000")


def test_link_upserts(spark):
    links = spark.createDataFrame([("1", "a", NEW), ("2", "b", OLD)], LINKS)
    new = spark.createDataFrame([("a", OLD), ("b", NEW), ("c", OLD)], "url string, retrieved_at timestamp")
    got = {r["url"]: r for r in linkgraph.upsert_links(links, new).collect()}
    assert got["a"]["id"] == "1" and got["a"]["retrieved_at"] == NEW and got["b"]["retrieved_at"] == NEW and len(got["c"]["id"]) == 36
    with pytest.raises(linkgraph.NotFound):
        linkgraph.find(links, "id", "9")
    never = links.withColumn("retrieved_at", zero_time())
    assert linkgraph.links_in_range(never, "0", "z", F.lit(OLD)).count() == 2


def test_edge_upserts(spark):
    links = spark.createDataFrame([("1", "a", OLD), ("2", "b", OLD)], LINKS)
    edges = spark.createDataFrame([("e", "1", "2", OLD)], EDGES)
    again = linkgraph.upsert_edges(edges, edges.select("src", "dst"), links, F.lit(NEW)).collect()
    assert [(r["id"], r["updated_at"]) for r in again] == [("e", NEW)]
    with pytest.raises(linkgraph.UnknownEdgeLinks):
        linkgraph.upsert_edges(edges, spark.createDataFrame([("1", "9")], "src string, dst string"), links, F.lit(NEW))
    assert linkgraph.remove_stale_edges(edges, "1", F.lit(NEW)).count() == 0
    assert linkgraph.remove_stale_edges(edges, "2", F.lit(NEW)).count() == 1


#: The examples of RFC 3986, section 5.4 (fixed values), against its base.
RFC_BASE = "http://a/b/c/d;p?q"
RFC_EXAMPLES = [
    ("g:h", "g:h"),
    ("g", "http://a/b/c/g"),
    ("./g", "http://a/b/c/g"),
    ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"),
    ("//g", "http://g"),
    ("?y", "http://a/b/c/d;p?y"),
    ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"),
    ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"),
    ("g;x", "http://a/b/c/g;x"),
    (".", "http://a/b/c/"),
    ("./", "http://a/b/c/"),
    ("..", "http://a/b/"),
    ("../", "http://a/b/"),
    ("../g", "http://a/b/g"),
    ("../..", "http://a/"),
    ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"),
    ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."),
    ("..g", "http://a/b/c/..g"),
    ("./../g", "http://a/b/g"),
    ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"),
    ("", None),
]


def test_resolve(spark):
    rows = spark.createDataFrame([(t, RFC_BASE, want) for t, want in RFC_EXAMPLES] + [("x", "https://h.org", "https://h.org/x"), ("//m/n", "https://h.org/z", "https://m/n")], "t string, b string, want string")
    wrong = rows.withColumn("got", urls.resolve(F.col("t"), F.col("b"))).where(~F.col("got").eqNullSafe(F.col("want")))
    assert wrong.collect() == []


def test_private_networks(spark):
    """The first and last address of every network, and the neighbours outside."""
    import ipaddress

    rows = []
    for network in map(ipaddress.ip_network, urls.PRIVATE_NETWORKS):
        first, last = network.network_address, network.broadcast_address
        rows += [(str(first), True), (str(last), True), (last.exploded, True)]
        for other in (int(first) - 1, int(last) + 1):
            if 0 <= other < 1 << first.max_prefixlen:
                ip = type(first)(other)
                rows.append((str(ip), any(ip in n for n in map(ipaddress.ip_network, urls.PRIVATE_NETWORKS) if n.version == ip.version)))
    rows += [("localhost", False), ("1.2.3", False), ("300.1.1.1", False), ("", False)]
    frame = spark.createDataFrame(rows, "ip string, want boolean")
    assert frame.where(urls.private_ip(F.col("ip")) != F.col("want")).collect() == []
    assert frame.where(urls.private_ip(F.col("ip"), ("9.9.0.0/16",))).count() == 0
    assert spark.createDataFrame([("9.9.255.1",)], "ip string").where(urls.private_ip(F.col("ip"), ("9.9.0.0/16",))).count() == 1


PAGE = """<!DOCTYPE html><title>Garden <i>tools</i></title>
<p>See <a class="k" href="spades.html">spades</a>, <A HREF="spades.html#old">old ones</A> and <a href="/rakes/">rakes</a>.</p>
<p><a rel="nofollow" href="https://shop.example/cart?x=1">cart</a> <a href="//cdn.example/list">list</a></p>
<p><a href="mailto:me@x.example">mail</a> <a href="photo.JPEG">photo</a> <a href="http://192.168.7.7/admin">router</a> <a href="http://other.example:8080/">port</a></p>"""


def test_extract_links(spark):
    pages = spark.createDataFrame([("http://garden.example/a/index.html", PAGE)], "url string, html string")
    got = {r["link"]: (r["nofollow"], r["place"]) for r in crawl.extract_links(pages).collect()}
    assert got == {"http://garden.example/a/spades.html": (False, 0), "http://garden.example/rakes/": (False, 2), "https://shop.example/cart?x=1": (True, 3), "http://cdn.example/list": (False, 4)}
    based = spark.createDataFrame([("http://garden.example/", '<base href="https://mirror.example/m"><a href="./x?y#z">'), ("http://garden.example/2", '<base href=""><a href="x">')], "url string, html string")
    assert {r["link"] for r in crawl.extract_links(based).collect()} == {"https://mirror.example/m/x?y", "http://garden.example/x"}
    private = spark.createDataFrame([("shop.example", "172.20.1.1"), ("cdn.example", "1.1.1.1")], "host string, ip string")
    assert {r["link"] for r in crawl.extract_links(pages, private).collect()} == set(got) - {"https://shop.example/cart?x=1"}


def test_text(spark):
    rows = spark.createDataFrame([(1, "<p>Salt<b>ed</b> &lt;nuts&gt;</p>\n\t<unknown>and&nbsp;figs</unknown><!-- no -->\n"), (2, "<title> Two\n<b>lines</b></title><style>p {}</style><h1>Plums</h1><script>f()</script>"), (3, "<TITLE> Pears &amp; <b>plums</b> </TITLE>x")], "n int, h string")
    got = rows.select("n", html.title(F.col("h")), html.text(F.col("h"))).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [("", "Salted <nuts> and\u00a0figs"), ("", "Plums"), ("Pears & plums", "x")]


def test_fetch_filter(spark):
    rows = [("http://a.com/i.png", 200, "text/html"), ("http://a.com/index.html", 200, "text/html"), ("http://a.com:1234/x", 201, "text/html"), ("http://a.com/y", 400, "text/html"), ("http://a.com/z", 200, "application/json"), ("http://10.0.0.1/z", 200, "text/html")]
    kept = crawl.fetch_filter(spark.createDataFrame(rows, "url string, status int, content_type string"))
    assert {r["url"] for r in kept.collect()} == {"http://a.com/index.html", "http://a.com:1234/x"}


def test_crawl_pass(spark):
    empty = [spark.createDataFrame([], s) for s in (LINKS, EDGES, DOCUMENTS)]
    first = '<a href="/b"><a href="/c"><a href="/d" rel="nofollow"><title>T</title>x'
    state = crawl.crawl(*empty, spark.createDataFrame([("http://t.com/a", first)], "url string, html string"), F.lit(OLD))
    assert state[0].count() == 4 and state[1].count() == 2 and state[2].first()["title"] == "T"
    scored = index.update_scores(state[2], state[2].select("link_id", F.lit(0.5).alias("pagerank")))
    state = crawl.crawl(state[0], state[1], scored, spark.createDataFrame([("http://t.com/a", '<a href="/b">y')], "url string, html string"), F.lit(NEW))
    assert state[0].count() == 4 and state[1].count() == 1
    assert (state[2].first()["pagerank"], state[2].first()["content"]) == (0.5, "y")


def documents(spark, contents):
    rows = [(f"{i:03d}", f"u{i}", f"doc {i}", c, OLD, float(len(contents) - i)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def fruit(spark):
    """Forty documents of falling rank; every fourth has the words of a phrase in order, the others in another."""
    return documents(spark, ["Green apples, and pears" if i % 4 == 0 else "pears and green plums; apples" for i in range(40)])


@pytest.mark.parametrize("stored", [False, True])
def test_search(spark, fruit, tmp_path, stored):
    found = None
    if stored:
        index.write_postings(index.postings(fruit), str(tmp_path / "postings"))
        found = index.read_postings(spark, str(tmp_path / "postings"))
    find = lambda expression, **more: search.search(fruit, expression, postings=found, **more)
    ids = lambda hits: [r["link_id"] for r in search.ranked(hits).collect()]
    every, fours = [f"{i:03d}" for i in range(40)], [f"{i:03d}" for i in range(0, 40, 4)]
    assert ids(find('"GREEN apples and"')) == fours and ids(find('"apples and pears"')) == fours
    assert ids(find('"doc 7"')) == ["007"] and ids(find('"7 pears"')) == []  # not across fields
    assert ids(find("plums cherries")) == [i for i in every if i not in fours] and ids(find("cherries")) == []
    assert ids(find("plums apples", operator="and")) == [i for i in every if i not in fours] and ids(find("...")) == []
    pears = find("pears")
    assert [r["place"] for r in search.page(pears, 33, 5).collect()] == [34, 35, 36, 37, 38] and search.page(pears, 38).count() == 2 and search.page(pears, 90).count() == 0
    rest = search.stream(pears, 30).collect()
    assert len(rest) == 10 and {r["total"] for r in rest} == {40} and "pagerank" not in rest[0]
    assert search.stream(pears, 41).count() == 0
    assert find("apples").where("link_id = '001'").first()["score"] == 1 / 7
    assert ids(find('"and and"')) == [] and search.pagination(25, 20, 5) == {"from": 21, "to": 25, "total": 25, "prev": 10, "next": None}


def test_index(spark):
    docs = documents(spark, ["a"])
    scored = index.update_scores(docs, spark.createDataFrame([("zz", 0.5)], "link_id string, pagerank double"))
    placed = scored.where("link_id = 'zz'").select("content", "pagerank", F.year("indexed_at")).first()
    assert tuple(placed) == ("", 0.5, 1)
    with pytest.raises(index.MissingLinkId):
        index.upsert(docs, docs.withColumn("link_id", F.lit(None).cast("string")), check=True)
    assert index.postings(docs).where("term = 'a'").first()["positions"] == [0]
    twice = docs.select("link_id", "url", "title", F.explode(F.array(F.lit("late"), F.lit("early"))).alias("content")).withColumn("indexed_at", F.when(F.col("content") == "late", F.lit(NEW)).otherwise(F.lit(OLD)))
    assert [r["content"] for r in index.upsert(docs, twice).collect()] == ["late"]


def test_stores(spark, tmp_path):
    assert stores.ensure(spark, f"parquet:{tmp_path}/links", LINKS).count() == 0
    stores.write(documents(spark, ["a"]), "memory:docs")
    assert stores.read(spark, "memory:docs").count() == 1
    assert stores.jdbc_options("postgresql://u:p@h:26257/db?table=edges")["dbtable"] == "edges"
    with pytest.raises(ValueError):
        stores.read(spark, "ftp:x")


def test_mapped_addresses(spark):
    """The first family's addresses in the second's form count as what they are; networks of the second do not hold them."""
    private = ["::ffff:10.0.0.1", "::ffff:a00:1", "::FFFF:127.0.0.1", "0:0:0:0:0:ffff:192.168.1.1", "::ffff:169.254.1.1%eth0", "::1", "fe80::1%2", "::ffff:0.0.0.1"]
    public = ["::ffff:8.8.8.8", "::ffff:808:808", "::10.0.0.1", "64:ff9b::10.0.0.1", "::ffff:10.0.0", "::ffff:300.0.0.1", "10.0.0.256", "::ffff:10.0.0.1:1", "ffff:10.0.0.1", "10.0.0.1.example"]
    rows = spark.createDataFrame([(x, True) for x in private] + [(x, False) for x in public], "ip string, want boolean")
    assert rows.where(urls.private_ip(F.col("ip")) != F.col("want")).collect() == []
    assert spark.createDataFrame([("::ffff:1.2.3.4",), ("::5",)], "ip string").where(urls.private_ip(F.col("ip"), ("::/0",))).collect() == [("::5",)]


def test_networks_of_any_number(spark):
    """100,000 networks of both families against the standard library, for addresses in any form."""
    import ipaddress
    import random

    rng = random.Random(8)
    four = {(rng.getrandbits(32), rng.choice([*range(14, 33)])) for _ in range(60_000)}
    six = {(rng.getrandbits(128), rng.choice([*range(20, 129)])) for _ in range(39_990)}
    networks = [f"{ipaddress.IPv4Address(v)}/{n}" for v, n in four] + [f"{ipaddress.IPv6Address(v)}/{n}" for v, n in six] + ["0.0.0.0/33", "x/8", "1.2.3.4", "::/129", None]
    known = {(4, n, v >> 32 - n) for v, n in four} | {(6, n, v >> 128 - n) for v, n in six}
    hosts = {}
    for _ in range(2_000):
        v = rng.getrandbits(32) if rng.random() < 0.5 else rng.choice(sorted(four)[:500])[0] ^ rng.getrandbits(12)
        hit = any((4, n, v >> 32 - n) in known for n in range(33))
        hosts[str(ipaddress.IPv4Address(v))] = hosts[f"::ffff:{ipaddress.IPv4Address(v)}"] = hit
        v = rng.choice(sorted(six)[:500])[0] ^ rng.getrandbits(rng.choice([8, 60, 100]))
        hosts[str(ipaddress.IPv6Address(v))] = any((6, n, v >> 128 - n) in known for n in range(129))
    found = urls.in_networks(spark.createDataFrame([(h,) for h in [*hosts, "name", "", None]] * 2, "ip string"), spark.createDataFrame([(n,) for n in networks], "cidr string"))
    assert sorted(r["ip"] for r in found.collect()) == sorted(h for h, hit in hosts.items() if hit) and sum(hosts.values()) > 500
    assert urls.in_networks(spark.createDataFrame([("::ffff:1.2.3.4",), ("::5",)], "ip string"), spark.createDataFrame([("::/0",)], "cidr string")).collect() == [("::5",)]


def test_character_references(spark):
    """Every name of the public table and numbers of all kinds, against the standard library."""
    import html as library
    from html.entities import html5

    texts = [f"a&{name}b" for name in html5] + [f"&{name.rstrip(';')}" for name in html5] + [f"&{name.rstrip(';')}x;" for name in list(html5)[::7]]
    texts += [f"&#{n};" for n in (9, 34, 39, 65, 128, 129, 150, 159, 160, 233, 8217, 8364, 55296, 57343, 0x10FFFF, 0x110000, 99999999999999999999, 0)] + ["&#x27;", "&#X27", "&#x1F600;!", "&#39b", "&#;", "&#x;", "&", "&&amp;", "&amp;lt;", "&amp;amp;lt;", "& amp;", "&nosuch;", "&notit;", "&#0065;", "&AMP", "x &lt y"]
    valid = [t for t in texts if "&#1114111;" not in t]
    frame = spark.createDataFrame(list(enumerate(valid)), "i int, t string").repartition(4)
    got = {r["i"]: r["u"] for r in frame.select("i", html.unescape(F.col("t")).alias("u")).collect()}
    assert {valid[i]: u for i, u in got.items() if u != library.unescape(valid[i])} == {}
    assert spark.createDataFrame([("&#1114111;",)], "t string").select(html.unescape(F.col("t"))).first()[0] == chr(0x10FFFF)


def tokenized(page):
    """Text of a page by a scan of its own, character by character."""
    out, i, low = [], 0, page.lower()
    hidden = ("title", "script", "style", "iframe", "noembed", "noframes", "noscript", "object", "frameset")

    def tag_end(i):
        while i < len(page) and page[i] != ">":
            i += 1
            if page[i - 1] == "=":
                while i < len(page) and page[i] in " \t\n\x0b\f\r":
                    i += 1
                if i < len(page) and page[i] in "\"'":
                    stop = page.find(page[i], i + 1)
                    i = len(page) if stop < 0 else stop + 1
        return i + 1

    while i < len(page):
        if page[i] != "<" or i + 1 == len(page):
            out.append(page[i])
            i += 1
        elif low.startswith("<!--", i):
            if low.startswith(("<!-->", "<!--->"), i):
                i = low.index(">", i) + 1
                continue
            stops = [(low.find(s, i + 4), len(s)) for s in ("-->", "--!>")]
            i = min((at + n for at, n in stops if at >= 0), default=len(page))
        elif (name := next((h for h in hidden if low.startswith("<" + h, i) and low[i + 1 + len(h) : i + 2 + len(h)] in tuple(" \t\n\x0b\f\r/>")), None)) is not None:
            i = tag_end(i + 1 + len(name))
            while i < len(page) and not (low.startswith("</" + name, i) and low[i + 2 + len(name) : i + 3 + len(name)] in tuple(" \t\n\x0b\f\r/>")):
                i += 1
            stop = page.find(">", i)
            i = len(page) if stop < 0 else stop + 1
        elif page[i + 1].isascii() and page[i + 1].isalpha() or page[i + 1] == "/" and page[i + 2 : i + 3].isascii() and page[i + 2 : i + 3].isalpha():
            i = tag_end(i + 1)
        elif page[i + 1] in "!?/":
            stop = page.find(">", i)
            i = len(page) if stop < 0 else stop + 1
        else:
            out.append("<")
            i += 1
    return "".join(out)


def test_text_by_a_scan_of_its_own(spark):
    import html as library
    import random
    import re

    rng = random.Random(2)
    parts = ["<p>", "</p>", '<a title="x>y">', "<b it's>", "<i a=b'c>", "<img alt='a > b' x>", "<a b = \"q", "a < b", "1<2", "<3", "<!-- <b> -->", "<!-->", "<!--->", "<!doctype html>", "<?php >", "</ x>", "<script>var t='</p>';</script >", "<SCRIPT a='>'>x<b></ScRiPt>", "<style>p{}</style/>", "<title>no</title>", "<titles>yes</titles>", "<noscript>n<b>o</noscript>", "&lt;b&gt;", "&eacute;", "&#8217;", "&nbsp;", " ", "\n", "　", "word", "é", "<", ">", '"', "'", "=", "<object data=x>in</object>", "<div a=1 b='2' c=\"3\">", "--!>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(1_500)] + ["<a " + "x=1 " * 5_000 + ">end", "<" * 2_000, "<a b='" * 50, '<a title="x>y">t']
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, h string").repartition(4)
    for r in frame.select("i", html.text(F.col("h")).alias("t")).collect():
        want = library.unescape(re.sub("[\t\n\f\r ]+", " ", tokenized(pages[r["i"]]))).strip()
        assert r["t"] == want, pages[r["i"]]


def test_ensure_never_writes_over(spark, tmp_path):
    at = f"parquet:{tmp_path}/links"
    assert stores.ensure(spark, at, LINKS).count() == 0 and stores.exists(spark, at)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        stores.ensure(spark, f"parquet:{tmp_path}/broken", LINKS).count()
    assert (tmp_path / "broken" / "part-0.parquet").read_bytes() == b"not a table"
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        stores.ensure(spark, f"parquet:{tmp_path}/empty", LINKS)
    assert not stores.exists(spark, "memory:no_such_view") and stores.ensure(spark, "memory:no_such_view", LINKS).count() == 0 and stores.exists(spark, "memory:no_such_view")
    with pytest.raises(ValueError):
        stores.exists(spark, "es://x")


def test_encoded_urls(spark):
    rows = [
        ("http://h/ä b?q=ä b", "http://h/%C3%A4%20b?q=ä b"),
        ("http://h/a%20(b)", "http://h/a%20(b)"),
        ("http://h/ä(b)*!", "http://h/%C3%A4%28b%29%2A%21"),
        ("http://h/a+b é", "http://h/a+b%20%C3%A9"),
        ("http://h/%C3%A4é", "http://h/%C3%A4%C3%A9"),
        ("http://h", "http://h"),
        ("http://h/\U0001f600/x;y=1,2", "http://h/%F0%9F%98%80/x;y=1,2"),
    ]
    frame = spark.createDataFrame(rows, "u string, want string")
    assert [tuple(r) for r in frame.select("want", urls.encoded(F.col("u"))).collect() if r[0] != r[1]] == []
    good = ["http://h/a", "http://h:80/", "http://h:/", "http://[::1]:8/x", "http://h/%41", "http://h/?q=%zz", "http://ü.example/"]
    bad = ["http://h/a\nb", "http://h/%4", "http://h/%zz", "http://h:x/", "http://a b/", "http://h/\x7f", "http://h/?\x01"]
    frame = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "u string, want boolean")
    assert frame.where(urls.parsable(F.col("u")) != F.col("want")).collect() == []
    page = spark.createDataFrame([("http://h/", '<a href="/ä"><a href="/%zz"><a href="/ok">')], "url string, html string")
    assert {r["link"] for r in crawl.extract_links(page, encode=True).collect()} == {"http://h/%C3%A4", "http://h/ok"}
