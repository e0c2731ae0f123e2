"""Blocked Bloom filter: every key keeps its bits inside one 64-byte block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillsight.llm.texts import map_arrow, mix

WORDS_PER_BLOCK = 8


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bit mask of each key in each of the block's eight words."""
    scrambled = mix(keys)
    block = (scrambled >> np.uint64(20)) % np.uint64(blocks)
    bits = mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F))
    lane = np.arange(WORDS_PER_BLOCK, dtype=np.uint64)
    mask = np.uint64(1) << ((bits[:, None] >> (lane * np.uint64(6))) & np.uint64(63))
    return block[:, None] * np.uint64(WORDS_PER_BLOCK) + lane, mask


@dataclass
class Bloom:
    words: np.ndarray

    @classmethod
    def empty(cls, bits: int) -> Bloom:
        return cls(np.zeros(max(bits // 512, 1) * WORDS_PER_BLOCK, np.uint64))

    def add(self, keys: np.ndarray) -> None:
        index, mask = _places(keys, len(self.words) // WORDS_PER_BLOCK)
        np.bitwise_or.at(self.words, index.ravel(), mask.ravel())

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """True for every added key, and for few others."""
        blocks = len(self.words) // WORDS_PER_BLOCK
        out = np.zeros(len(keys), bool)
        for start in range(0, len(keys), 1 << 16):
            part = keys[start : start + (1 << 16)]
            block = (mix(part) >> np.uint64(20)) % np.uint64(blocks)
            bits = mix(part ^ np.uint64(0xC2B2AE3D27D4EB4F))
            alive = np.arange(len(part))
            for lane in range(WORDS_PER_BLOCK):  # most keys leave after the first words
                word = self.words[block[alive] * np.uint64(WORDS_PER_BLOCK) + np.uint64(lane)]
                bit = (bits[alive] >> np.uint64(6 * lane)) & np.uint64(63)
                alive = alive[((word >> bit) & np.uint64(1)).astype(bool)]
                if not len(alive):
                    break
            out[start + alive] = True
        return out


def build(hashes: DataFrame, bits: int, parts: int = 4) -> Bloom:
    """Filter of the long column ``hash``; ``parts`` partial filters of fixed size reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom.empty(bits)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(keys), 1 << 15):
                bloom.add(keys[start : start + (1 << 15)])
        yield pa.RecordBatch.from_arrays([pa.array([bloom.words.tobytes()], pa.binary())], ["words"])

    total = Bloom.empty(bits)
    for row in map_arrow(hashes.select("hash").coalesce(parts), partial, "words binary").toLocalIterator():
        total.words |= np.frombuffer(row[0], np.uint64)
    return total
