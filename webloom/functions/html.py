"""Links, title and text of HTML, as expressions on the page's source.

Patterns are written for Java's engine: (?d) keeps the dot to one line, as the
matching is line by line.
"""

from __future__ import annotations

import json
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls

# What counts as a link, a nofollow mark, a base and a title must be just what crawlers of this kind take for one.
_LINK = r'<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>'
_NOFOLLOW = r'rel\s*?=\s*?"?nofollow"?'
_BASE = r'<base.*?href\s*?=\s*?"(.*?)\s*?"'
_TITLE = r"<title.*?>(.*?)</title>"

#: Named characters by name, with the semicolon where it is needed: the public table, as Python has it.
ENTITIES = entities.html5

#: Those that may stand without one, the longest first.
_BARE = sorted((n for n in ENTITIES if not n.endswith(";")), key=lambda n: (-len(n), n))

#: Named characters that are looked up first.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;", "ndash;", "mdash;", "hellip;", "rsquo;", "lsquo;", "eacute;", "euro;")

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"

#: All of Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Elements whose content shows no text.
_HIDDEN = "title|script|style|iframe|noembed|noframes|noscript|object|frameset"

#: A tag from its name on: a quote counts after an equals sign only; an end that is missing is that of the page.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+){0,400}+[^>]*+(?:>|\z)"""

#: What is not text, in the order in which it comes up in one scan.
_MARKUP = (
    r"(?is)<!--(?:>|->|.*?(?:--!?>|\z))"
    rf"|<({_HIDDEN})(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
    rf"|</?[a-z]{_REST}"
    r"|<[!?/][^>]*+(?:>|\z)"
)

_DIALECT = "(?d)(?iu)"


def link_tags(html: Column) -> Column:
    """Array of (tag, href) of every anchor, in order."""
    tags = F.regexp_extract_all(html, F.lit(f"{_DIALECT}({_LINK})"), F.lit(1))
    # The pattern is lazy, so it matches the tag alone as it did within the page.
    return F.transform(tags, lambda tag: F.struct(tag.alias("tag"), F.regexp_extract(tag, f"{_DIALECT}{_LINK}", 1).alias("href")))


def is_nofollow(tag: Column) -> Column:
    return tag.rlike(_DIALECT + _NOFOLLOW)


def base_href(html: Column) -> Column:
    """The address in the page's <base>, as written; empty without one."""
    return F.regexp_extract(html, _DIALECT + _BASE, 1)


def base_url(href: Column, url: Column) -> Column:
    """What `base_href` found, with a trailing slash and resolved; the page's own URL if it is empty."""
    return F.when(href == "", url).otherwise(urls.resolve(F.concat(F.regexp_replace(href, "/$", ""), F.lit("/")), url))


def _character(value: Column) -> Column:
    """The character of a number, as HTML reads it: what is none becomes U+FFFD, and 128 to 159 are those of code page 1252."""
    old = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}
    text = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    page = F.element_at(F.array(*[F.lit(old[k]) for k in sorted(old)]), (value - 127).cast("int"))
    none = value.isNull() | (value == 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
    return F.when(none, F.lit("\ufffd")).when(value.between(128, 159), page).otherwise(text)


def _named(names) -> Column:
    """A map from names to characters, which the optimizer makes one constant of."""
    return F.from_json(F.lit(json.dumps({n: ENTITIES[n] for n in names})), "map<string, string>")


def _decoded(reference: Column) -> Column:
    digits = F.regexp_replace(reference, "[&#xX;]", "")
    short = F.length(F.regexp_replace(digits, "^0+", "")) <= 7  # more are no character in either base
    number = lambda base: F.when(short, F.conv(digits, base, 10).try_cast("long"))
    name = F.substring(reference, 2, 64)
    # The first map answers nearly always; maps are searched entry by entry.
    whole = F.when(reference.endswith(";"), F.coalesce(F.try_element_at(_named(_COMMON), name), F.try_element_at(_named(ENTITIES), name)))
    bare = F.regexp_extract(reference, f"^&({'|'.join(_BARE)})", 1)
    begun = F.when(bare != "", F.concat(F.element_at(_named(_BARE), bare), F.substr(reference, F.length(bare) + 2)))
    return (
        F.when(reference.rlike("^&#[xX]"), _character(number(16)))
        .when(reference.startswith("&#"), _character(number(10)))
        .otherwise(F.coalesce(whole, begun, reference))
    )


def unescape(text: Column) -> Column:
    """`text` with its character references, named and numeric, replaced once."""
    around, found = F.split(text, _REFERENCE, -1), F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _decoded)
    joined = F.array_join(F.zip_with(around, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def trim(text: Column) -> Column:
    """`text` without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACES))


def _collapsed(text: Column) -> Column:
    return trim(unescape(F.regexp_replace(text, r"[\t\n\f\r ]+", " ")))


def title(html: Column) -> Column:
    inner = F.regexp_extract(html, _DIALECT + _TITLE, 1)
    return _collapsed(F.regexp_replace(inner, _MARKUP, ""))


def text(html: Column) -> Column:
    """Text outside tags; elements that show none (title, script, style and the like) are left out.

    One scan in order: a quoted value may hold a >, a comment or a script may hold
    tags, and what is not closed goes on to the end. A < before anything but a
    name, !, ? or / is text.
    """
    return _collapsed(F.regexp_replace(html, _MARKUP, ""))
