"""Secrets in text: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over keywords runs once over the lower-cased bytes.
Only where a keyword begins is that kind's regular expression matched, anchored
there; hexadecimal runs are found on a mask of the text. Kinds that carry a
checksum are kept only if it holds.

Kinds, as listed in results:
  assign   a password-like name, a separator and a value of 8 or more characters
  access   AKIA and capitals or digits, 16 or more characters
  hex      32 or more lower-case hexadecimal digits
  github   a prefixed token whose last six characters are its CRC-32 in base 62
  npm      likewise with npm's prefix
  jwt      a signed web token whose header decodes to JSON
  pem      a private key block up to its END line; without one, to the end of its base64 lines
Spans are whole matches in code points, end exclusive, leftmost and not
overlapping within a kind. Null and empty texts have none. Repeated rows each get their
own row, and an empty table gives an empty one. Other columns are
ignored by `find`; `redact` keeps them.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_MASK = bytes(b in b"0123456789abcdef" for b in range(256))
_HEX_RUN = b"\x01" * 32
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _checksum_holds(m: re.Match) -> bool:
    body, check = m[1], m[2].decode()
    value = 0
    for c in check:
        value = value * 62 + _DIGITS.index(c)
    return value == zlib.crc32(body)


def _is_token(m: re.Match) -> bool:
    head = m[1]
    try:
        decoded = base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))
        return isinstance(json.loads(decoded), dict)
    except RecursionError:  # too deep to be read to its end, but an object
        return decoded.lstrip()[:1] == b"{"
    except (ValueError, binascii.Error):
        return False


_PEM_LABEL = rb"(?:[A-Z]{2,12} ){0,2}PRIVATE KEY(?: BLOCK)?-----"
#: A body has no five dashes, so the next ones end it; no place is read for more than one header.
_PEM_TO_END = rb"(?:[^-]++|-(?!----))*+-----END " + _PEM_LABEL
#: Without an END line: header fields, then lines of base64, of which the last may be short.
_PEM_BREAK = rb"(?:[\s\"'>,;]|\\+[nrt])"
_PEM_RUN = (
    rb"(?:" + _PEM_BREAK + rb"*+(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*+)*+"
    rb"(?:(?:" + _PEM_BREAK + rb"*+[A-Za-z0-9+/]{16,}+={0,2})++"
    rb"(?:" + _PEM_BREAK + rb"++(?:=?[A-Za-z0-9+/]{1,15}+={1,2}|=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/])|[A-Za-z0-9+/]{1,15}+(?=[\x20\t]*+(?:[\r\n\\]|\Z))))*+)?"
)

_RUN = re.compile(rb"[A-Za-z0-9_-]+")

#: kind -> (keywords in lower case, pattern anchored at the keyword, further test of a match)
_RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode()),
        _long_value,
    ),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _checksum_holds),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _checksum_holds),
    "jwt": (("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), _is_token),
    "pem": (("-----begin ",), re.compile(rb"-----BEGIN " + _PEM_LABEL + rb"(?:" + _PEM_TO_END + rb"|" + _PEM_RUN + rb")"), lambda m: True),
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, (keywords, _, _) in _RULES.items():
        for keyword in keywords:
            automaton.add_word(keyword, (kind, len(keyword)))
    automaton.make_automaton()
    return automaton


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed."""
    raw = text.encode()
    found: list[tuple[int, int, str]] = []
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in _automaton().iter(raw.translate(_LOWER).decode("latin-1")):
        starts.setdefault(kind, []).append(end + 1 - length)
    for kind, places in starts.items():
        _, pattern, holds = _RULES[kind]
        after = 0
        for start in sorted(places):
            if start < after:
                continue
            if m := pattern.match(raw, start):
                after = m.end()
                if holds(m):
                    found.append((start, after, kind))
            elif kind == "jwt" and (run := _RUN.match(raw, start)):
                after = run.end()  # what follows the run is the same for every place in it
    mask = raw.translate(_HEX_MASK)
    at = mask.find(_HEX_RUN)
    while at >= 0:
        end = mask.find(b"\0", at)
        end = len(raw) if end < 0 else end
        found.append((at, end, "hex"))
        at = mask.find(_HEX_RUN, end)
    if not found:
        return []
    if not text.isascii():
        points, at, count = {}, 0, 0
        for place in sorted({p for start, end, _ in found for p in (start, end)}):
            count += len(raw[at:place].decode())
            points[place], at = count, place
        found = [(points[start], points[end], kind) for start, end, kind in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets): an array of (start, end, kind), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.chunks(batches):
            rows = [[dict(zip(("start", "end", "kind"), s)) for s in scan(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(span))], names=["doc_id", "secrets"])

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    texts = common.doc_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, secrets array<struct<start: long, end: long, kind: string>>")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return find(docs).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, written)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", written)).alias("spans"),
    )


def mask(text: str | None) -> str | None:
    """`text` with every secret replaced by [kind]; overlapping ones by the first's."""
    if not text or not (found := scan(text)):
        return text
    parts, at = [], 0
    for start, end, kind in found:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets in `text` masked; all other columns as they are."""

    def change(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
        field = batch.schema.field(place)
        return batch.set_column(place, field, pa.array([mask(t) for t in batch.column(place).to_pylist()], field.type))

    return common.map_rows(docs, lambda: change)
