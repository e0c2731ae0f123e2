"""Secret scan: keyword automaton, anchored patterns only at its hits, embedded checksums last.

One pass of an Aho-Corasick automaton over the case-folded text gives the places where a rule can begin; each
rule's pattern is tried at these places only, from left to right and never inside its last match. That
equals a leftmost non-overlapping search, since every match begins with one of the rule's
keywords. Long hexadecimal runs have no keyword and are found by their length.

Tokens that carry a checksum (CRC-32 of their first 30 characters as six base-62 digits) count only when it is right.

Defined results: a NULL or empty text has no spans; offsets are code points of the whole text,
ends exclusive; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.texts import UPPER, bounded, map_arrow

#: Kinds in the order used for ties. The first three are the base rules.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")

KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


def base62(number: int, width: int) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out


def checksum_holds(match: re.Match) -> bool:
    return base62(zlib.crc32(match[1].encode()), 6) == match[2]


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "github": (CHECKED, checksum_holds),
    "npm": (CHECKED, checksum_holds),
}


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for keyword, kind in KEYWORDS.items():
        made.add_word(keyword, (len(keyword), kind))
    made.make_automaton()
    return made


def spans_of(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end), by start and then kind."""
    lower = text.lower()
    if len(lower) != len(text):  # some letters grow when lower-cased, which would shift the offsets
        lower = text.translate(_ASCII_LOWER)
    starts: dict[str, list[int]] = {}
    for last, (length, kind) in keywords.iter(lower):
        starts.setdefault(kind, []).append(last - length + 1)
    found = []
    for kind, places in starts.items():
        pattern, accepted = RULES[kind]
        free = 0
        for start in sorted(places):
            if start >= free and (match := pattern.match(text, start)):
                free = match.end()
                if accepted(match):
                    found.append((start, kind, free))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and its ``spans`` (array of kind, start, end)."""

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in bounded(batches):
            rows = [
                [{"kind": kind, "start": start, "end": end} for start, kind, end in spans_of(text, keywords)] if text else []
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])

    narrow = docs.select("doc_id", "text")
    return map_arrow(narrow, scan_batches, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
