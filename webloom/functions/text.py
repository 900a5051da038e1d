"""Sentences, match ratios, summaries and highlighting of search results."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.html import trim

#: A break follows a terminator between these classes, when at least one more character is there.
_BREAK = (
    r"(?s)(?:(?<=[\p{Ll}\p{S}\p{N}\p{IsWhite_Space}][.!?])(?=[\p{P}\p{IsWhite_Space}\p{N}\p{Lu}].)"
    r"|(?<=\p{S}[.!?])(?=..))"
)


def query_terms(expression: str) -> list[str]:
    """The words of a search expression, quotes at its ends left out."""
    return expression.strip('"').split()


def parse_query(expression: str) -> tuple[str, str]:
    """(kind, expression): a phrase if the expression is quoted on both sides."""
    e = expression.strip()
    if len(e) > 1 and e.startswith('"') and e.endswith('"'):
        return "phrase", e.strip('"')
    return "match", e


def sentences(text: Column) -> Column:
    """Sentences in order, terminators and leading spaces kept; none for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, _BREAK)).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Runs of characters that are no white space of any kind."""
    return F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda w: w != "")


def match_ratio(sentence: Column, terms: list[str]) -> Column:
    """Share of the sentence's words that are search terms, whatever their case."""
    found = words(sentence)
    wanted = F.array(*[F.lit(t.lower()) for t in terms]) if terms else F.array().cast("array<string>")
    hits = F.size(F.filter(found, lambda w: F.array_contains(wanted, F.lower(w))))
    return hits / F.greatest(F.size(found), F.lit(1))


def summary(text: Column, terms: list[str], budget: int = 256) -> Column:
    """The best-matching sentences within `budget` characters, in their own order.

    Sentences are taken by falling ratio, earlier ones first on ties; one that
    is too long is cut and ends in "...". Gaps show as "..".
    """
    rated = F.filter(
        F.transform(sentences(text), lambda s, i: F.struct((-match_ratio(s, terms)).alias("r"), i.alias("i"), s.alias("s"))),
        lambda x: x["r"] < 0,
    )
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<i:int,s:string>>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        cut = F.when(F.length(x["s"]) > state["left"], F.concat(F.left(x["s"], state["left"]), F.lit("..."))).otherwise(x["s"])
        grown = F.struct(
            (state["left"] - F.length(cut)).alias("left"),
            F.concat(state["taken"], F.array(F.struct(x["i"].alias("i"), cut.alias("s")))).alias("taken"),
        )
        return F.when(state["left"] > 0, grown).otherwise(state)

    taken = F.aggregate(F.array_sort(rated), start, take, lambda state: F.array_sort(state["taken"]))
    begin = F.struct(F.lit(-1).alias("last"), F.lit("").alias("text"))

    def add(state: Column, x: Column) -> Column:
        gap = F.when((state["last"] >= 0) & (x["i"] != state["last"] + 1), F.lit("..")).otherwise(F.lit(""))
        stop = F.when(x["s"].endswith("."), F.lit("")).otherwise(F.lit("."))
        return F.struct(x["i"].alias("last"), F.concat(state["text"], gap, x["s"], stop).alias("text"))

    return trim(F.aggregate(taken, begin, add, lambda state: state["text"]))


def escape_html(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def highlight(text: Column, terms: list[str]) -> Column:
    """Every term in turn put between <em> and </em>, whatever its case."""
    for term in terms:
        text = F.regexp_replace(text, f"(?iu)({_quoted(term)})", "<em>$1</em>")
    return text


def _quoted(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+\-?^$|&#~])", r"\\\1", term)
