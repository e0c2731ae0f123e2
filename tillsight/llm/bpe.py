"""Byte-level BPE encoding and decoding around one global shuffle of distinct words.

Documents are cut into blocks of about ``BLOCK_BYTES`` of text. A block's pre-tokens become codes, one for each
distinct word, kept in text order; its distinct words are dealt out by a hash of the word, so that
each word of the corpus is merged once, in one place, whatever the number of its occurrences. The ids go back to
their blocks and are put in the places of the codes. What is shuffled is, for each block, the list of codes and
the distinct words, compressed; every bucket gets one row from each block, so a frequent word is no
hot key. Decoding looks ids up in the token-byte table (bounded by the vocabulary and broadcast).

Codes and words leave the texts together, in rows of one exchange: a block's codes go to the partition of the block, where
they wait, and its words to those of their buckets. Both the merging and the putting together read that exchange, so texts are
split once. Should it be made anew for one of them, both sides carry a checksum of the words, and a mismatch (an input that
changes between scans) is an error, never a wrong result.

Defined results: a NULL or empty text has no ids; repeated rows give repeated results; ids without
a token raise an error on decoding; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.texts import AS_IS, bounded, hash_spans, importable, list_array, map_arrow

BLOCK_BYTES = 3 << 20
DECODE_IDS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(numbers: np.ndarray) -> bytes:
    """Compressed unsigned numbers, as planes of equal-valued bytes."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of all (s, n), one after the other."""
    edges = np.cumsum(lengths)
    total = int(edges[-1]) if len(edges) else 0
    return values[np.arange(total) + np.repeat(starts - (edges - lengths), lengths)]


WHITE = r"\t\n\x0b\x0c\r "
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": WHITE}


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern as it acts on ASCII texts, for the faster standard engine; None if it has classes unknown here."""
    known = re.compile(r"\[\^?(?:\\p\{[LN]\}|\\s)+\]|\\p\{[LN]\}|\\s|\\S")

    def plain(found: re.Match) -> str:
        text = found[0]
        if text == r"\S":
            return f"[^{WHITE}]"
        inside = re.sub(r"\\p\{[LN]\}|\\s", lambda m: _ASCII[m[0]], text)
        return inside if text.startswith("[") else f"[{inside}]"

    rest = known.sub("", pattern)
    return None if re.search(r"\\|\[|\(\?[^!]", rest) else re.compile(known.sub(plain, pattern))


class Splitter:
    """Pre-tokens of texts."""

    def __init__(self, pattern: str) -> None:
        self.any, self.ascii = regex.compile(pattern).findall, ascii_pattern(pattern)

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.ascii.findall(text) if self.ascii is not None and text.isascii() else self.any(text)


class Vocabulary:
    """Distinct words of a block in the order of their hashes, dealt to buckets by the hash's upper bits.

    ``order`` has the places of the given words in that order, which depends on the set of words alone.
    """

    def __init__(self, words: Collection[str], buckets: int) -> None:
        raw = [w.encode() for w in words]
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        hashes = hash_spans(self.bytes, self.starts, self.starts + self.lengths, AS_IS)
        self.order = np.argsort(hashes, kind="stable")
        hashes = hashes[self.order]
        if (hashes[1:] == hashes[:-1]).any():
            place = dict(zip(raw, range(len(raw)), strict=True))
            known = dict(zip((raw[i] for i in self.order), hashes.tolist(), strict=True))
            self.order = np.array([place[w] for w in sorted(raw, key=lambda w: (known[w], w))])
        self.bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """(bucket, word lengths, word bytes) of every bucket with words."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            chosen = self.order[a:b]
            yield int(self.bucket[a]), self.lengths[chosen], gather(self.bytes, self.starts[chosen], self.lengths[chosen]).tobytes()


class _Merged(dict):
    """Numbers of words, each merged when it is first seen; the ids of all of them lie one after the other."""

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        super().__init__()
        self.encoding, self.flat, self.starts, self.counts = encoding, array("I"), array("q"), array("q")

    def __missing__(self, word: bytes) -> int:
        ids = self.encoding.encode_ordinary(word.decode())
        self.starts.append(len(self.flat))
        self.counts.append(len(ids))
        self.flat.extend(ids)
        number = self[word] = len(self)
        return number

    def ids_of(self, lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words of these lengths that ``raw`` is made of, and all their ids."""
        ends = np.cumsum(lengths, dtype=np.int64)
        found = [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        counts = np.frombuffer(self.counts, np.int64)[numbers]
        return counts, gather(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)[numbers], counts)


def _checksum(lengths: np.ndarray, raw: bytes) -> int:
    return zlib.crc32(np.ascontiguousarray(lengths, "<u4").tobytes(), zlib.crc32(raw))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of documents with their numbers, the same for every scan of the same partitions."""
    partition = TaskContext.get().partitionId()
    for number, batch in enumerate(bounded(batches, limit=BLOCK_BYTES)):
        yield (partition << 32) | number, batch


def _coded(texts: list[str | None], split: Splitter) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Codes of all pre-tokens, their number in each text, the distinct words and the word of each code.

    Frequent words have small codes, which compress well.
    """
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    parts = []
    for text in texts:
        found = split(text)
        parts.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
    seen = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    order = np.argsort(-np.bincount(seen, minlength=len(index)), kind="stable")
    rank = np.empty(len(index), np.int64)
    rank[order] = np.arange(len(index))
    return rank[seen], np.array([len(p) for p in parts], np.int32), list(index), order


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id`` and its token ``ids`` (array of int) for every document."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((ranks, pattern))
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ["target", "block", "lengths", "words", "doc_ids", "counts", "codes", "places", "check"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        for number, batch in _blocks(batches):
            coded, counts, distinct, word_of_code = _coded(batch.column("text").to_pylist(), split)
            vocabulary = Vocabulary(distinct, buckets)
            check, rows = 0, []
            for bucket, lengths, raw in vocabulary.by_bucket():
                check ^= _checksum(lengths, raw)
                rows.append((-1 - bucket, number, pack(lengths), zlib.compress(raw, 1)))
            place = np.empty(len(distinct), np.int64)
            place[vocabulary.order] = np.arange(len(distinct))
            ids, n = batch.column("doc_id"), len(rows)
            of_words = [pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)]
            of_block = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), list_array(counts, np.array([len(ids)]), pa.int32()),
                pa.array([pack(coded)], pa.binary()), pa.array([pack(place[word_of_code])], pa.binary()), pa.array([check], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*of_words, *[pa.nulls(n, c.type) for c in of_block]], names)
            keys = [pa.array([number], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*keys, *[pa.nulls(1, pa.binary())] * 2, *of_block], names)
            del coded, distinct, vocabulary, rows, of_words, of_block  # before the next block is read

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared.value
        known = _Merged(tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        for batch in batches:
            batch = batch.select(names[:4])
            for row in batch.filter(batch.column("words").is_valid()).to_pylist():
                lengths, raw = unpack(row["lengths"]), zlib.decompress(row["words"])
                counts, flat = known.ids_of(lengths, raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()), pa.array([-1 - row["target"]], pa.int32()),
                        pa.array([pack(counts)], pa.binary()), pa.array([pack(flat)], pa.binary()),
                        pa.array([_checksum(lengths, raw)], pa.int64()),
                    ],
                    ["block", "bucket", "counts", "ids", "check"],
                )

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.column("codes").null_count:  # words, which were merged
            return pa.table({"doc_id": left.column("doc_ids").combine_chunks().flatten(), "ids": pa.array([], pa.list_(pa.int32()))})
        (block,) = left.to_pylist()
        parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        check = 0
        for part in parts:
            check ^= part["check"]
        if check != block["check"]:
            raise RuntimeError("the documents changed between two scans of a block")
        counts = np.concatenate([unpack(p["counts"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ids = np.concatenate([unpack(p["ids"]) for p in parts] or [np.zeros(0, np.uint32)])
        places = unpack(block["places"])[unpack(block["codes"])]
        starts, lengths = (np.cumsum(counts) - counts)[places], counts[places]
        text_ids = gather(ids, starts, lengths)
        edges = np.concatenate(([0], np.cumsum(block["counts"])))
        done = np.concatenate(([0], np.cumsum(lengths)))[edges]
        doc_ids = left.column("doc_ids").combine_chunks().flatten()
        return pa.table({"doc_id": doc_ids, "ids": list_array(text_ids.astype(np.int32), np.diff(done), pa.int32())})

    schema = f"target long, block long, lengths binary, words binary, doc_ids array<{kind}>, counts array<int>, codes binary, places binary, check long"
    both = map_arrow(narrow, deal, schema).repartition(buckets, "target")
    merged = map_arrow(both, merge, "block long, bucket int, counts binary, ids binary, check long")
    importable(spark)
    return both.groupBy("target").cogroup(merged.groupBy("block")).applyInArrow(reassemble, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for."""
    size = max(ranks.values(), default=-1) + 1
    table = [b""] * size
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        lengths = np.array([len(t) for t in table], np.int64)
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            for part in _slices(batch, column):
                ids = part.column(column)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or not lengths[flat].all()):
                    raise ValueError("an id has no token")
                text = gather(raw, starts[flat], lengths[flat])
                edges = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                ends = np.concatenate(([0], np.cumsum(lengths[flat])))[edges].tolist()
                decoded = [text[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_arrow(encoded, look_up, f"{schema}, decoded binary")


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``DECODE_IDS`` ids."""
    edges = np.concatenate(([0], np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    start = 0
    while start < batch.num_rows:
        end = min(max(int(np.searchsorted(edges, edges[start] + DECODE_IDS, side="right")) - 1, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def id_text(ids):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
