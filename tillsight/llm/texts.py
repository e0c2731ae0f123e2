"""Helpers shared by the text operators: fresh names, bounded Arrow slices, byte-level words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 1 << 20
#: Tables of ids are broadcast up to this number of rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 1_000_000

AS_IS = np.arange(256, dtype=np.uint8)
_FOLD = AS_IS.copy()
_FOLD[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it, so that it is no column of ``df`` yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Python workers serve many stages; these allocator settings make them return freed arrays at once.
LEAN = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: For queries of small slices: arrays up to a few megabytes are kept for reuse, which spares a page fault for every 4 KB of each.
ROOMY = {**LEAN, "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def importable(spark: SparkSession, allocator: dict[str, str] = LEAN) -> None:
    """Let Python workers find this package where it lies under the same path as on the driver, and keep them small.

    The first settings of an application hold.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    for name, value in allocator.items():
        environment.setdefault(name, value)
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)


def broadcast_if_small(stored: DataFrame) -> DataFrame:
    """A stored table of a few columns, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


@contextmanager
def records_per_batch(spark: SparkSession, records: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Text with A-Z, and nothing else, lower-cased; pure ASCII takes the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry at the end); NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _place_value(place: np.ndarray) -> np.ndarray:
    if not len(place) or place.max() < len(_PLACE):
        return _PLACE[place]
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


@dataclass
class Words:
    """Words of several texts: byte bounds, 64-bit hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def byte_class(pattern_bytes: Iterable[int]) -> np.ndarray:
    """Table telling for each byte value whether it belongs to a word."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


NOT_SPACE = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words(column: pa.Array, kind: np.ndarray, fold: np.ndarray = _FOLD) -> Words:
    """Maximal runs of bytes of ``kind`` in each text, hashed with A-Z lower-cased, or as ``fold`` has it.

    Byte classes that keep all bytes from 0x80 on together never cut a character.
    """
    data, offsets = flat(column)
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, hash_spans(data, starts, ends, fold), np.searchsorted(starts, offsets), offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _FOLD) -> np.ndarray:
    """64-bit hash of each byte span: a multilinear sum, then mixed with the length.

    ``fold`` maps bytes before hashing: A-Z lower-cased, or ``AS_IS``.
    """
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    edges = np.concatenate(([0], np.cumsum(lengths)))
    begin = 0
    while begin < len(starts):
        stop = int(np.searchsorted(edges, edges[begin] + (1 << 18), side="right")) - 1
        stop = min(max(stop, begin + 1), len(starts))
        size = lengths[begin:stop]
        heads = edges[begin:stop] - edges[begin]
        place = np.arange(edges[stop] - edges[begin]) - np.repeat(heads, size)
        at = place + np.repeat(starts[begin:stop], size)
        value = _BYTE_VALUE[fold[data[at]]] * _place_value(place)
        out[begin:stop] = np.add.reduceat(value, heads)
        begin = stop
    return mix(out + lengths.astype(np.uint64) * _MIX)


_STEP = tuple(np.uint64(v) for v in mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring entries; callers drop those that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64) * _MIX
    for i in range(size):
        step = _STEP[i % len(_STEP)] + np.uint64(2 * (i // len(_STEP)))
        total += hashes[i : i + n] * step
    return mix(total)


def window_owners(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows that stay inside one text, and their texts."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[owner] + within, owner


def binary_rows(lists: Iterable[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in lists]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from concatenated values and list lengths."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
