"""Token ids as binary files of patched frame-of-reference blocks.

``write_tokens`` range-partitions documents by ``doc_id``, encodes each partition and writes it as one file; ``read_tokens``
reads the files back. A file is written to a name of its own by every attempt of a task and counts only once its row stands
in the manifest, a Parquet table that Spark commits; what lost attempts leave behind is never read.

File format, little-endian:

    "PFORIDS1"                    magic
    blocks                        128 ids each, one after the other
    document table                Arrow stream of doc_id, n_tokens
    block index                   uint64 place of every block in the file, then the end of the last one
    uint64 x 4                    place of the document table, place of the block index, blocks, ids
    "PFORIDS1"

A block is: uint32 reference (the smallest id), uint8 width, uint8 exceptions, 16 * width bytes with the differences to the
reference packed most significant bit first, then for the exceptions a uint8 position and after these a uint32 difference
each. The width is that of the percentile of differences (of ``PERCENTILES``) which makes the block smallest; what is wider
goes to the exceptions. The last block is filled up with its reference. Block b starts at entry b of the index, so ids from
any place are read without those before (``TokenFile.ids``).

Encoding takes each run of bytes other than ASCII white space by itself, and each distinct one once as long as it is
remembered (``REMEMBERED``); it goes through the library's normaliser, pre-tokeniser and model. Printable ASCII is split
by the same pattern outside the library where its definition is of a known form (``_ascii_steps``). This gives the library's ids for every tokenizer that drops white space and never joins over it;
for others pass ``by_word=False``, which hands over whole texts. Strings of special tokens in a text are ordinary text.

Defined results: a NULL or empty text has the end id alone; rows of one ``doc_id`` (NULL first) follow each other by a hash
of the text; repeated rows give repeated documents; an empty table gives an empty result. Rows of one id may lie in several
files. A task holds one slice of texts and the document table of its file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress
from operator import attrgetter, not_

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.bpe import ascii_pattern, gather
from tillsight.llm.texts import AS_IS, NOT_SPACE, ROOMY, Words, bounded, importable, map_arrow, words
from tillsight.session import stage_path

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILES = (0.85, 0.9, 0.95, 1.0)
BLOCKS_AT_ONCE = 2048
#: Bytes of text for one file, where that gives more files than ``spark.sql.shuffle.partitions``.
FILE_TEXT_BYTES = 128 << 20
#: Distinct words, and pieces of words, whose ids a task remembers; beyond that it starts anew.
REMEMBERED, REMEMBERED_PIECES = 3 << 19, 1 << 19
#: Bytes of text that are encoded together.
SLICE = 4 << 20
BREAK = "\n"
#: Words without white space or control characters; so many of them are normalised and split at a time.
PLAIN, JOINED = re.compile(r"[^\s\x00-\x20\x7f-\xa0]+").fullmatch, 1024
#: Text of characters whose classes are the same in all versions of Unicode since 5.0, so that every engine splits it alike.
LOW = re.compile("[\x20-\u024f]*").fullmatch
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = np.arange(256, dtype="<u4")
BYTE_LEVEL[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 512 - len(_SHOWN))
BYTE_LEVEL[ord(BREAK)] = ord(BREAK)  # stands between pieces
ID = attrgetter("id")
READ_IDS = 1 << 20
MANIFEST = pa.schema([("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of whole blocks (``BLOCK`` ids each), and the size of each."""
    values = np.ascontiguousarray(ids, np.uint32).reshape(-1, BLOCK)
    reference = values.min(axis=1)
    differences = values - reference[:, None]
    bits = np.frexp(differences.astype(np.float64))[1].astype(np.uint8)
    ranked = np.sort(bits, axis=1)
    width = np.zeros(len(values), np.int64)
    size = np.full(len(values), np.iinfo(np.int64).max)
    for share in PERCENTILES:
        chosen = ranked[:, int(np.ceil(share * BLOCK)) - 1].astype(np.int64)
        cost = 6 + BLOCK // 8 * chosen + 5 * (bits > chosen[:, None]).sum(axis=1)
        width, size = np.where(cost < size, chosen, width), np.minimum(cost, size)
    outside = bits > width[:, None]
    exceptions = outside.sum(axis=1)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[:, None] + np.arange(4)] = reference.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, exceptions
    low = np.where(outside, 0, differences)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        single = np.unpackbits(low[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :]
        packed = np.packbits(single.reshape(len(rows), BLOCK * w), axis=1)
        out[(at[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    row, position = np.nonzero(outside)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        patch = at[row] + 6 + BLOCK // 8 * width[row]
        out[patch + rank] = position
        places = (patch + exceptions[row] + 4 * rank)[:, None] + np.arange(4)
        out[places] = differences[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), size


def unpack_blocks(data: bytes, at: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at the places ``at`` of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    reference = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, exceptions = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    values = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = raw[(at[rows] + 6)[:, None] + np.arange(BLOCK // 8 * w)]
        single = np.zeros((len(rows), BLOCK, 32), np.uint8)
        single[:, :, 32 - w :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
        values[rows] = np.packbits(single, axis=2).view(">u4").reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(len(at)), exceptions)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        patch = at[row] + 6 + BLOCK // 8 * width[row]
        places = (patch + exceptions[row] + 4 * rank)[:, None] + np.arange(4)
        values[row, raw[patch + rank]] = np.ascontiguousarray(raw[places]).view("<u4").ravel()
    return (values + reference[:, None]).ravel()


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, named by a plain path or a URI."""
    if ":" not in uri.split("/", 1)[0]:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(uri if rest.startswith("//") else f"{scheme}://{rest}")


class TokenFile:
    """A written file, read by parts."""

    def __init__(self, uri: str) -> None:
        system, path = _opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if self.file.read_at(8, 0) != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        table, index, blocks, self.n_ids = np.frombuffer(tail[:32], "<u8").tolist()
        self.documents = pa.ipc.open_stream(self.file.read_at(index - table, table)).read_all()
        self.blocks = np.frombuffer(self.file.read_at(8 * (blocks + 1), index), "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from place ``begin`` up to ``end``."""
        first, last = begin // BLOCK, -(-end // BLOCK)
        if begin >= end:
            return np.zeros(0, np.uint32)
        at = self.blocks[first : last + 1]
        data = self.file.read_at(int(at[-1] - at[0]), int(at[0]))
        parts = [unpack_blocks(data, at[i : min(i + BLOCKS_AT_ONCE, len(at) - 1)] - at[0]) for i in range(0, len(at) - 1, BLOCKS_AT_ONCE)]
        return np.concatenate(parts)[begin - first * BLOCK : end - first * BLOCK]

    def close(self) -> None:
        self.file.close()


class _Writer:
    """Writes one file, holding back ids that fill no block yet."""

    def __init__(self, uri: str) -> None:
        system, path = _opened(uri)
        self.out, self.uri = system.open_output_stream(path), uri
        self.out.write(MAGIC)
        self.rest, self.sizes, self.tables, self.n_ids = np.zeros(0, np.uint32), [], [], 0

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.tables.append(pa.record_batch([doc_ids, pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids.astype(np.uint32)))
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), BLOCKS_AT_ONCE * BLOCK):
            data, sizes = pack_blocks(ids[i : i + BLOCKS_AT_ONCE * BLOCK])
            self.out.write(data)
            self.sizes.append(sizes)

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.concatenate((self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.uint32))))
        at = len(MAGIC) + np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.sizes])))).astype("<u8")
        table = pa.BufferOutputStream()
        with pa.ipc.new_stream(table, self.tables[0].schema) as stream:
            for batch in self.tables:
                stream.write_batch(batch)
        raw = table.getvalue().to_pybytes()
        self.out.write(raw + at.astype("<u8").tobytes())
        self.out.write(np.array([at[-1], int(at[-1]) + len(raw), len(at) - 1, self.n_ids], "<u8").tobytes() + MAGIC)
        self.out.close()


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = True
    return made


def _ascii_steps(definition: str) -> tuple[bool, re.Pattern, str] | None:
    """What a tokenizer does to printable ASCII before its merges, as (whether it lower-cases, pattern of pieces, the pattern as written);
    None if that is not known.

    Known are definitions that normalise by NFC, white space and lower case alone, and keep the matches of one pattern.
    """
    made = json.loads(definition)

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal, split = steps(made["normalizer"], "normalizers"), steps(made["pre_tokenizer"], "pretokenizers")
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(n["type"] not in ("NFC", "Lowercase") and n != blank for n in normal) or made["post_processor"] is not None:
        return None
    if len(split) != 2 or split[0]["type"] != "Split" or "Regex" not in split[0]["pattern"] or split[1]["type"] != "ByteLevel":
        return None
    if (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"], split[1].get("use_regex")) != ("Removed", True, False, False):
        return None
    written = split[0]["pattern"]["Regex"]
    pattern = ascii_pattern(written)
    return None if pattern is None else (any(n["type"] == "Lowercase" for n in normal), pattern, written)


def _byte_level(pieces: list[str]) -> list[str]:
    """Pieces in the characters that stand for their bytes, as the library's ``ByteLevel`` writes them."""
    raw = np.frombuffer(BREAK.join(pieces).encode(), np.uint8)
    return BYTE_LEVEL[raw].tobytes().decode("utf-32-le").split(BREAK) if pieces else []


def _ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of each span as numbers; spans of up to 16 bytes are fully told by them and their length."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    short = np.minimum(ends - starts, 8).astype(np.uint64)
    mask = np.where(short < 8, (np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
    return eight[starts] & mask, eight[ends - short.astype(np.int64)] & mask


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an order that puts equal hashes next to each other, first places first, and the hashes in that order.

    Upper bits of the hash and the place sort as one number, much faster than places by their hashes; that is left to do where
    different hashes agree in those bits.
    """
    below = np.uint64((1 << max(len(hashes) - 1, 1).bit_length()) - 1)
    keys = np.sort((hashes & ~below) | np.arange(len(hashes), dtype=np.uint64))
    order = (keys & below).astype(np.int64)
    ordered = hashes[order]
    if len(order) and ((ordered[1:] != ordered[:-1]) & ((keys[1:] ^ keys[:-1]) <= below)).any():
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
    return order, ordered


def _distinct(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct word, for each word which of these it equals, and size and both ends of the distinct words.

    Words count as equal by hash, length and both ends.
    """
    order, hashes = _by_hash(found.hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    marks = np.stack(((found.ends - found.starts).astype(np.uint64), *_ends_of(found.data, found.starts, found.ends)))
    for part in marks:
        part = part[order]
        if ((part[1:] != part[:-1]) & ~new[1:]).any():  # two words of one hash: compare all by their bytes
            listed = [found.data[a:b].tobytes() for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(listed))}
            inverse = np.array([number[w] for w in listed])
            places = np.unique(inverse, return_index=True)[1]
            return places, inverse, marks[:, places]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, marks[:, order[new]]


class _Table:
    """Numbers of remembered words. A word is known again by its hash, length and both ends, without its bytes.

    Of words of one hash only the first is remembered.
    """

    def __init__(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.marks = np.zeros((3, 0), np.uint64)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes belong, and whether they stand there."""
        at = np.searchsorted(self.hashes, hashes)
        inside = at < len(self.hashes)
        inside[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, inside

    def find(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those not remembered."""
        at, hit = self._place(hashes)
        number = np.full(len(hashes), -1, np.int64)
        at = at[hit]
        number[hit] = np.where((self.marks[:, at] == marks[:, hit]).all(axis=0), self.numbers[at], -1)
        return number

    def add(self, hashes: np.ndarray, marks: np.ndarray, numbers: np.ndarray) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        at, taken = self._place(hashes)
        at, first = at[~taken], first[~taken]
        self.hashes, self.numbers = np.insert(self.hashes, at, hashes[~taken]), np.insert(self.numbers, at, numbers[first])
        self.marks = np.insert(self.marks, at, marks[:, first], axis=1)


class _Encoder:
    """Ids of texts. Each distinct word of a slice is looked up once, and what is not remembered is encoded.

    The ids of remembered words lie one after the other in ``flat``; a word's number tells where. Number 0 is the end of a text.
    ``fresh`` has the words of the slice at hand that were not remembered before.
    """

    def __init__(self, definition: str, by_word: bool) -> None:
        self.tokenizer, self.by_word = _tokenizer(definition), by_word
        #: A step that is missing, or that joins pieces again, leaves each word to the library alone.
        self.steps = by_word and None not in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer) and self.tokenizer.post_processor is None
        known = _ascii_steps(definition) if self.steps else None
        self.lower, self.pattern, self.low = None, None, None
        if known is not None:
            self.lower, self.pattern, self.low = known[0], re.compile(f"{BREAK}|{known[1].pattern}"), regex.compile(f" |{known[2]}").findall
        self._forget()

    def _forget(self) -> None:
        self.known, self.fresh = _Table(), {}
        self._forget_pieces()
        self.flat, self.lengths = np.zeros(1, np.uint32), np.ones(1, np.int64)

    def _forget_pieces(self) -> None:
        self.pieces: dict[str, int] = {BREAK: 0}
        self.piece_flat, self.piece_lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _append(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.fresh.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.flat, self.lengths = np.concatenate((self.flat, ids)), np.concatenate((self.lengths, lengths))

    def _enter_pieces(self, pieces: Iterable[str]) -> None:
        """Let the tokenizer's model merge pieces that are not remembered."""
        new = list(set(pieces).difference(self.pieces))
        flat, lengths = [self.piece_flat], [self.piece_lengths]
        for begin in range(0, len(new), JOINED):
            found = list(map(self.tokenizer.model.tokenize, new[begin : begin + JOINED]))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(map(ID, chain.from_iterable(found)), np.uint32, int(lengths[-1].sum())))
        self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
        self.piece_flat, self.piece_lengths = np.concatenate(flat), np.concatenate(lengths)

    def _append_pieces(self, words: list[bytes], pieces: list[str], owner: np.ndarray | None = None) -> None:
        """Enter words that consist of pieces, whose owners are given in order, or told by breaks between words."""
        self._enter_pieces(pieces)
        number = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        taken = self.piece_lengths[number]
        ids = gather(self.piece_flat, (np.cumsum(self.piece_lengths) - self.piece_lengths)[number], taken)
        owner = np.cumsum(number == 0) if owner is None else owner
        self._append(words, ids, np.bincount(owner, taken, len(words)).astype(np.int64))

    def _learn(self, words: list[bytes], printable: list[bool]) -> None:
        """Enter new words. Those without odd characters pass the tokenizer's steps many at a time, its merges once for each distinct piece."""
        rest = words
        if self.pattern is not None:
            plain, rest = list(compress(words, printable)), list(compress(words, map(not_, printable)))
            if plain:
                text = BREAK.encode().join(plain).decode()
                self._append_pieces(plain, self.pattern.findall(text.lower() if self.lower else text))
        alone = [] if self.steps else rest
        if self.steps:
            smooth = [bool(PLAIN(w.decode())) for w in rest]
            alone = list(compress(rest, map(not_, smooth)))
            rest = list(compress(rest, smooth))
            entered, pieces, owners = [], [], [np.zeros(0, np.int64)]
            for begin in range(0, len(rest), JOINED):
                chosen = rest[begin : begin + JOINED]
                normal = self.tokenizer.normalizer.normalize_str(b" ".join(chosen).decode())
                parts = normal.split(" ")
                if len(parts) != len(chosen) or not all(parts):
                    alone += chosen  # the steps changed what separates words
                    continue
                if self.low is not None and LOW(normal):
                    found = self.low(normal)
                    owner = np.cumsum(np.fromiter(map(" ".__eq__, found), bool, len(found)))
                    kept = np.fromiter(map(" ".__ne__, found), bool, len(found))
                    pieces += _byte_level(list(compress(found, kept)))
                    owner = owner[kept]
                else:
                    found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                    pieces += [piece for piece, _ in found]
                    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), [a for _, (a, _) in found], side="right")
                owners.append(owner + len(entered))
                entered += chosen
            if entered:
                self._append_pieces(entered, pieces, np.concatenate(owners))
        for word in alone:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32)
            self._append([word], ids, np.array([len(ids)]))

    def _numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the word at each place, and the first place of each text. Whole texts are not remembered."""
        self.fresh = {}
        if not self.by_word:
            listed = [(t or "").encode() for t in column.to_pylist()]
            distinct = list(dict.fromkeys(listed))
            self._learn(distinct, [False] * len(distinct))
            return np.array([self.fresh[w] for w in listed], np.int64), np.arange(len(listed) + 1)
        found = words(column, NOT_SPACE, AS_IS)
        places, inverse, marks = _distinct(found)
        hashes = found.hashes[places]
        number = self.known.find(hashes, marks)
        new = number < 0
        if new.any():
            raw, starts, ends = found.data.tobytes(), found.starts[places[new]], found.ends[places[new]]
            odd = np.concatenate(([0], np.cumsum((found.data < 0x21) | (found.data > 0x7E), dtype=np.int32)))
            learned = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            self._learn(learned, (odd[ends] == odd[starts]).tolist())
            number[new] = np.fromiter(map(self.fresh.__getitem__, learned), np.int64, len(learned))
            self.known.add(hashes[new], marks[:, new], number[new])
        return number[inverse], found.first

    def __call__(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, and all their ids, each text's followed by the end id."""
        if not self.by_word or len(self.lengths) > REMEMBERED:
            self._forget()
        if len(self.pieces) > REMEMBERED_PIECES:
            self._forget_pieces()
        self.flat[0] = end_id
        number, first = self._numbers(column)
        entries = np.insert(number, first[1:], 0)
        taken = self.lengths[entries]
        ids = gather(self.flat, (np.cumsum(self.lengths) - self.lengths)[entries], taken)
        ends = np.cumsum(taken)[first[1:] + np.arange(len(first) - 1)]
        return np.diff(ends, prepend=0), ids


@lru_cache(maxsize=2)
def _encoder(definition: str, by_word: bool) -> _Encoder:
    """The encoder of a Python worker, which remembers words from one task to the next."""
    return _Encoder(definition, by_word)


def in_order(docs: DataFrame, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """``doc_id`` and ``text`` in partitions of ascending ``doc_id``, each sorted; rows of one id may fill several."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_text_bytes))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    placed = keyed.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie", "row")
    return placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "row").select("doc_id", "text")


def write_tokens(docs: DataFrame, definition: str, end_id: int, folder: str | None = None, by_word: bool = True,
                 file_text_bytes: int = FILE_TEXT_BYTES) -> str:
    """Write the token ids of all documents; gives the folder, whose ``manifest`` lists the files in order.

    ``definition`` is the JSON of a tokenizer, ``folder`` a place that all executors reach (a new one on shared storage if
    not given).
    """
    spark = docs.sparkSession
    importable(spark, ROOMY)
    folder = folder or stage_path(spark, "token-ids")
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    shared = spark.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = None, None
        for batch in bounded(batches, limit=SLICE):
            if writer is None:
                encoder = _encoder(shared.value, by_word)
                number = TaskContext.get().partitionId()
                writer = _Writer(f"{folder}/ids-{number:07d}-{uuid.uuid4().hex}.pfor")
            counts, ids = encoder(batch.column("text"), end_id)
            writer.add(batch.column("doc_id"), counts, ids)
        if writer is not None:
            writer.close()
            row = {"file": number, "path": writer.uri, "documents": sum(t.num_rows for t in writer.tables), "tokens": writer.n_ids}
            yield pa.RecordBatch.from_pylist([row], MANIFEST)

    written = map_arrow(in_order(docs, file_text_bytes), write, "file int, path string, documents long, tokens long")
    written.write.parquet(f"{folder}/manifest")
    return folder


def read_tokens(spark, folder: str, doc_id_type: str = "bigint") -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and its ``ids`` as little-endian uint32."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    files = manifest.select("file", "path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            file = TokenFile(row["path"])
            counts = file.documents.column("n_tokens").to_numpy()
            edges = np.concatenate(([0], np.cumsum(counts)))
            doc_ids = file.documents.column("doc_id").combine_chunks()
            a = 0
            while a < len(counts):
                b = min(max(int(np.searchsorted(edges, edges[a] + READ_IDS, side="right")) - 1, a + 1), len(counts))
                ids = np.ascontiguousarray(file.ids(int(edges[a]), int(edges[b])), "<u4")
                offsets = (edges[a : b + 1] - edges[a]) * 4
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                columns = [doc_ids[a:b], pa.array(row["start"] + edges[a:b]), pa.array(counts[a:b]), raw.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                a = b
            file.close()

    spread = files.repartition(max(1, manifest.count()))  # one task for each file
    return map_arrow(spread, read, f"doc_id {doc_id_type}, start long, n_tokens long, ids binary")
