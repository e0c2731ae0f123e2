"""Benchmark decontamination on templates: typed placeholders, hash-joined windows, slot consistency.

Words are canonicalised in three forms. The literal form is the lower-cased word. The template form replaces
numbers (``3``, ``1,250.5``), units after a number and names (runs of words capitalised inside a sentence, after any
white space or punctuation that ends no sentence; a run is one slot) by typed placeholders and keeps what stood
there as slot values. The openers form also takes capitalised words that open a text or sentence for names, as
they may be. Windows of ``WINDOW`` words are hashed in each form; windows of slots only tell nothing and are left out.

A filter of fixed size over the benchmark's windows lets possible hits through, whatever the size of the
benchmark; these are joined exactly on form and hash and gathered by (document, item, form, diagonal). An item leaks
into a document when ``HITS`` windows of one diagonal (all of them, for an item with fewer) match literally, or
match as templates with ``LITERALS`` ordinary words (all but one of a shorter item) while the slot values of item and
document agree: names and units map one to one. Numbers are free where ``LITERALS`` ordinary words agree, as those of
a question asked anew are drawn independently; with fewer, equal numbers stay equal. The same question with
other numbers and names does, a text that merely has the same shape does not.

Defined results: items and documents that are NULL, empty or shorter than their windows leak
nothing; an item with ``MIN_WORDS`` to ``WINDOW`` words must occur whole, a shorter one is no evidence;
repeated rows give repeated results, repeated items are reported for each of their ids; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.bloom import build
from tillsight.llm.texts import (
    ALPHANUMERIC, ROOMY, bounded, broadcast_if_small, byte_class, hash_spans, importable, map_arrow, mix, unused, window_owners, windows, words,
)
from tillsight.session import stage

WINDOW = 8
LITERALS = 5
HITS = 3
MIN_WORDS = 4
FILTER_BITS = 1 << 24
LITERAL, TEMPLATE, OPENERS = 0, 1, 2
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
ANY = np.uint64(0)

#: Units recognised after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
    "meter", "meters", "metre", "metres", "gram", "grams", "kilogram", "kilograms", "mph", "kmh", "w", "kw", "v",
)


def _hash_texts(texts: tuple[str, ...]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    lengths = np.array([len(t) for t in raw])
    ends = np.cumsum(lengths)
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - lengths, ends)


_UNIT_HASHES = np.sort(_hash_texts(UNITS))
_MARKS = _hash_texts(("\0word", "\0number", "\0unit", "\0name"))
_SENTENCE_END = byte_class(b".!?:")
#: Bytes that end a name of several words: all but white space and hyphens.
_NO_RUN = byte_class(b for b in range(256) if b not in b" \t\n\v\f\r-")


@dataclass
class Stream:
    """Words of several texts in one form: hashes, ``kind`` of slot, slot ``value`` (``ANY``: not compared), first word of each text."""

    hashes: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, start words, owners) of the windows of ``size`` words with an ordinary word, which are all that can be evidence."""
        starts, owner = window_owners(self.first, size)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, owner
        ordinary = np.concatenate(([0], np.cumsum(self.kind == WORD)))
        some = ordinary[starts + size] > ordinary[starts]
        starts, owner = starts[some], owner[some]
        return windows(self.hashes, size)[starts], starts, owner

    def values(self, start: int, size: int, *kinds: int) -> list[int]:
        """Slot values of these kinds in one window as signed numbers, in order."""
        part = slice(start, start + size)
        return self.value[part][np.isin(self.kind[part], kinds)].view(np.int64).tolist()


def forms(column: pa.Array) -> list[Stream]:
    """The streams of all texts in the forms ``LITERAL``, ``TEMPLATE`` and ``OPENERS``."""
    found = words(column, ALPHANUMERIC)
    data, starts, ends, first = found.data, found.starts, found.ends, found.first
    n = len(starts)
    if not n:
        none = np.zeros(0, np.uint64)
        return [Stream(none, np.zeros(0, np.int8), none, first)] * 3
    digit = (data >= 0x30) & (data <= 0x39)
    number = np.add.reduceat(digit, starts, dtype=np.int32) == ends - starts
    opens = np.zeros(n, bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    gap = np.zeros(n, np.uint8)  # the byte between a word and the one before, if it is a single byte
    one = np.flatnonzero((starts[1:] - ends[:-1] == 1) & ~opens[1:]) + 1
    gap[one] = data[starts[one] - 1]
    joins = number & ((gap == 0x2C) | (gap == 0x2E))
    joins[1:] &= number[:-1]
    joins[0] = False
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~opens[1:] & ~number[1:]
    unit &= np.isin(found.hashes, _UNIT_HASHES)
    capital = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    second = data[np.minimum(starts + 1, len(data) - 1)]
    small = (ends - starts > 1) & ((second >= 0x80) | ((second >= 0x61) & (second <= 0x7A)))
    named = capital & small & ~unit
    opener = named & (opens | _between(data, starts, ends, _SENTENCE_END))
    follows = ~opens & ~_between(data, starts, ends, _NO_RUN)
    follows[0] = False
    literal = found.hashes.copy()
    heads = np.flatnonzero(~joins)
    head = heads[np.cumsum(~joins) - 1]
    for i in np.flatnonzero(joins):  # later parts of a number like 1,250.5
        whole = slice(head[i], head[i] + 1)
        literal[whole] = mix(literal[whole] + found.hashes[i : i + 1])
    words_kind = np.where(number, NUMBER, np.where(unit, UNIT, WORD)).astype(np.int8)
    out = [_stream(literal, np.zeros(n, np.int8), joins, first, np.zeros(n, bool))]
    for name in (named & ~opener, named):
        tail = name & ~opener & follows  # later words of a name like New York
        tail[1:] &= name[:-1]
        out.append(_stream(literal, np.where(name, NAME, words_kind).astype(np.int8), joins | tail, first, opener & name, tail))
    return out


def _between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a byte of ``kind`` stands between each word and the one before."""
    before = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int32)))
    out = np.zeros(len(starts), bool)
    out[1:] = before[starts[1:]] > before[ends[:-1]]
    return out


def _stream(literal: np.ndarray, kind: np.ndarray, dropped: np.ndarray, first: np.ndarray, opener: np.ndarray, tail: np.ndarray | None = None) -> Stream:
    """The stream without the ``dropped`` words; the value of a name of several words is made of all of them.

    A name of several words that opens a sentence may begin with an ordinary word, so its value is not compared.
    """
    value = literal
    if tail is not None and tail.any():
        value = literal.copy()
        kept = np.flatnonzero(~dropped)
        head = kept[np.cumsum(~dropped) - 1]
        np.add.at(value, head[tail], mix(literal[tail]))
        value[head[tail & opener[head]]] = ANY
    keep = ~dropped
    hashes = np.where(kind == WORD, literal, _MARKS[kind])
    return Stream(hashes[keep], kind[keep], value[keep], np.concatenate(([0], np.cumsum(keep)))[first])


WINDOW_SCHEMA = (
    "form int, hash long, item_id {kind}, item_at int, item_windows int, item_words int, size int, item_names array<long>, item_numbers array<long>, "
    "item_literals array<int>"
)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of every benchmark item in all forms; template forms only of items with a slot."""
    narrow = benchmark.select("item_id", "text")
    names = ["form", "hash", "item_id", "item_at", "item_windows", "item_words", "size", "item_names", "item_numbers", "item_literals"]
    kinds = [pa.int32(), pa.int64(), None, *[pa.int32()] * 4, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out = [[] for _ in names]
            for form, stream in enumerate(forms(batch.column("text"))):
                counts = np.diff(stream.first)
                slots = np.diff(np.concatenate(([0], np.cumsum(stream.kind != WORD)))[stream.first])
                for size in [WINDOW, *range(MIN_WORDS, WINDOW)]:
                    hashes, starts, owner = stream.windows(size)
                    mine = ((size == WINDOW) | (counts[owner] == size)) & ((form == LITERAL) | (slots[owner] > 0))
                    number = np.bincount(owner[mine], minlength=len(counts))
                    for h, start, i in zip(hashes[mine].view(np.int64).tolist(), starts[mine].tolist(), owner[mine].tolist(), strict=True):
                        at = int(start - stream.first[i])
                        literals = (at + np.flatnonzero(stream.kind[start : start + size] == WORD)).tolist() if form != LITERAL else []
                        row = (form, h, i, at, int(number[i]), int(counts[i]), size, stream.values(start, size, NAME, UNIT), stream.values(start, size, NUMBER), literals)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            arrays = [pa.array(v, k) if k else batch.column("item_id").take(pa.array(v, pa.int64())) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(narrow, make, WINDOW_SCHEMA.format(kind=narrow.schema["item_id"].dataType.simpleString()))


def _pairs(item: str, doc: str) -> Column:
    """Distinct pairs of slot values of a group of matching windows."""
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(item, doc))))
    return F.filter(pairs, lambda p: (p[item] != int(ANY)) & (p[doc] != int(ANY)))


def _single(pairs: str, side: str) -> Column:
    """Whether no value of a side has two partners."""
    return F.size(F.array_distinct(f"{pairs}.{side}")) == F.size(pairs)


def leaks(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each (document, item) that leaks.

    Columns ``doc_id``, ``text_hash`` (of the document's text, to tell rows with equal or NULL ids apart),
    ``item_id``, ``n_windows`` (matching windows of the best diagonal), ``coverage`` (their share of the
    item's windows) and ``verbatim`` (false: only with other slot values).
    """
    importable(docs.sparkSession, ROOMY)
    listed = stage(benchmark_windows(benchmark), "benchmark_windows")
    bloom = build(listed.select("hash"), filter_bits)
    sizes = sorted(row[0] for row in listed.select("size").distinct().collect())  # MIN_WORDS..WINDOW at most
    shared = docs.sparkSession.sparkContext.broadcast((bloom, sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, sizes = shared.value
        for batch in bounded(batches):
            for form, stream in enumerate(forms(batch.column("text"))):
                for size in sizes:
                    hashes, starts, owner = stream.windows(size)
                    hit = np.flatnonzero(bloom.maybe(hashes))
                    if not len(hit):
                        continue
                    rows, places = pa.array(owner[hit]), starts[hit].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").take(rows), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows),
                            pa.array(np.full(len(hit), form), pa.int32()), pa.array(hashes[hit].view(np.int64)),
                            pa.array((starts[hit] - stream.first[owner[hit]]).astype(np.int32)), pa.array(np.full(len(hit), size), pa.int32()),
                            pa.array([stream.values(s, size, NAME, UNIT) for s in places], pa.list_(pa.int64())),
                            pa.array([stream.values(s, size, NUMBER) for s in places], pa.list_(pa.int64())),
                        ],
                        ["row", "doc_id", "text_hash", "form", "hash", "doc_at", "size", "doc_names", "doc_numbers"],
                    )

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, text_hash long, form int, hash long, doc_at int, size int, doc_names array<long>, doc_numbers array<long>"
    matched = map_arrow(narrow, search, schema).join(listed, ["form", "hash", "size"])
    keys = ["row", "doc_id", "text_hash", "item_id", "form", "item_windows", "item_words"]
    diagonals = matched.groupBy(*keys, (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.size(F.collect_set("item_at")).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_set("item_literals")))).alias("literals"),
        _pairs("item_names", "doc_names").alias("names"), _pairs("item_numbers", "doc_numbers").alias("numbers"),
    )
    verbatim = F.col("form") == LITERAL
    names = _single("names", "item_names") & _single("names", "doc_names")
    numbers = _single("numbers", "item_numbers") | (F.col("literals") >= LITERALS)
    enough = F.col("literals") >= F.least(F.lit(LITERALS), F.col("item_words") - 1)
    found = diagonals.where((F.col("hits") >= F.least(F.lit(HITS), F.col("item_windows"))) & (verbatim | (enough & names & numbers)))
    best = F.max(F.struct(F.col("hits").cast("long").alias("n_windows"), (F.col("hits") / F.col("item_windows")).alias("coverage")))
    return found.groupBy("row", "doc_id", "text_hash", "item_id").agg(best.alias("best"), F.max(verbatim).alias("verbatim")).select(
        "doc_id", "text_hash", "item_id", "best.n_windows", "best.coverage", "verbatim"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark item leaks, with all their columns."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    flagged = broadcast_if_small(stage(found, "leaks"))
    key = unused(docs, "_text_hash")
    hashed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("leak_hash").eqNullSafe(hashed[key]) & F.col("leak_id").eqNullSafe(hashed["doc_id"])
    return hashed.join(flagged, same, "left_anti").drop(key)
